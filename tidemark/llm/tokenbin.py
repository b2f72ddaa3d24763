"""Token ids as binary shards with a minimal perfect hash index.

A shard file holds the raw ids of its documents, in ascending doc_id order, then an index: levels of bitmaps that map every
key of the shard to a slot of its own (a minimal perfect hash), and per slot a 32-bit fingerprint of the key, the place of
its ids and their number.  A key is found with a few bitmap probes and one read, whatever the shard's size; keys themselves
are not stored, and a foreign key is told by its fingerprint.

File layout, little-endian: MAGIC, ids (``width`` bytes each), index, footer.  Index: number of levels, words per level,
level bitmaps, set bits before each word, then the slots' fingerprints, starts and counts.  Footer: place of the index,
documents, ids, width, MAGIC.
"""
from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, chunks, flat_utf8, kept, map_arrow, mix64, text_of, written
from tidemark.session import scratch_path, ship_package

MAGIC = b"TOKSHRD1"
FOOTER = "<QQQQ8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
NULL_KEY = U64(0x6E756C6C6E756C6C)
_STEP, _PRINT = 0x9E3779B97F4A7C15, U64(0x66696E6765727072)
MOST_LEVELS = 200
#: Text of one shard, about, where the session's number of partitions would make larger ones.
SHARD_BYTES = 256 << 20


# ---------------------------------------------------------------- index

def _seed(level: int) -> np.uint64:
    return U64(level * _STEP & (1 << 64) - 1)


def key_hash(doc_ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A 64-bit key of a document id and the occurrence number among rows of that id; one-to-one for first occurrences."""
    base = np.where(nulls, mix64(NULL_KEY + np.zeros(len(nulls), np.uint64)), mix64(doc_ids.astype(np.int64).view(np.uint64)))
    return np.where(nth == 0, base, mix64(base + nth.astype(np.uint64) * U64(_STEP)))


def build_hash(keys: np.ndarray, gamma: float = 1.5) -> list[np.ndarray]:
    """Level bitmaps: a key that is alone at its place on a level stays there, the others go on to the next level."""
    levels = []
    while len(keys):
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys have the same hash")
        words = max(1, int(np.ceil(gamma * len(keys) / 64)))
        at = (mix64(keys + _seed(len(levels))) % U64(words * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        keys = keys[~alone[at]]
    return levels


class PerfectHash:
    """Slot numbers 0..n-1 of the n keys of the level bitmaps; constant time a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.words = [len(x) for x in levels]
        self.bits = np.concatenate([np.zeros(0, np.uint64), *levels]).astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.uint64)])[:-1].astype(np.uint64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level holds."""
        out, open_, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, words in enumerate(self.words):
            at = mix64(keys[open_] + _seed(level)) % U64(words * 64)
            word, bit = first + (at >> U64(6)).astype(np.int64), at & U64(63)
            here = ((self.bits[word] >> bit) & U64(1)).astype(bool)
            below = np.bitwise_count(self.bits[word] & ((U64(1) << bit) - U64(1)))
            out[open_[here]] = (self.before[word] + below)[here].astype(np.int64)
            open_ = open_[~here]
            first += words
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ _PRINT) >> U64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    levels = build_hash(keys)
    order = PerfectHash(levels).slots(keys)
    prints, first, size = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
    prints[order], first[order], size[order] = fingerprints(keys), starts, counts
    return b"".join([struct.pack("<Q", len(levels)), np.array([len(x) for x in levels], "<u8").tobytes(),
                     *[x.tobytes() for x in levels], prints.tobytes(), first.tobytes(), size.tobytes()])


class Shard:
    """A shard file opened for reading by key."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER_BYTES)
        place, self.documents, self.ids, self.width, magic = struct.unpack(FOOTER, self.file.read(FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.file.seek(place)
        index = self.file.read(self.file.size() - FOOTER_BYTES - place)
        n = struct.unpack_from("<Q", index)[0]
        words, at, levels = np.frombuffer(index, "<u8", n, 8), 8 + 8 * n, []
        for w in words.tolist():
            levels.append(np.frombuffer(index, "<u8", w, at))
            at += 8 * w
        self.hash = PerfectHash(levels)
        self.prints = np.frombuffer(index, "<u4", self.documents, at)
        self.starts = np.frombuffer(index, "<u8", self.documents, at + 4 * self.documents)
        self.counts = np.frombuffer(index, "<u8", self.documents, at + 12 * self.documents)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each key, -1 for keys that are not in the shard."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        place = np.where(known, slot, 0)
        pick = lambda x: np.where(known, x[place].astype(np.int64), -1) if self.documents else np.full(len(keys), -1)
        return pick(self.starts), pick(self.counts)

    def read(self, start: int, count: int) -> np.ndarray:
        self.file.seek(len(MAGIC) + start * self.width)
        return np.frombuffer(self.file.read(count * self.width), f"<u{self.width}").astype("<u4")


# ---------------------------------------------------------------- encoding

#: Pieces of one call of the tokenizer.
CALL_PIECES = 256
#: Pieces remembered by a worker process before its memo starts anew.
REMEMBERED = 500_000
#: The tokenizer's own pre-tokens, and the normalisers before them (fixed values: they must equal those of the file).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
#: Characters whose class and lower case are the same everywhere and that no normal form joins with a neighbour: Latin without
#: the dotted capital I, basic Cyrillic, common punctuation, unified ideographs.
CERTAIN = "\t\n\r -~¡-¬®-įı-ňŊ-žЀ-џ‐-‧€一-龥"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-žЀ-џ一-龥"
_BLANK, _LETTER, _NUMBER, _OTHER, _WORD = range(5)


def _class_table() -> np.ndarray:
    """The class of each code point below 2^16, as far as it is certain."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 1 << 16)]))
    table = np.full(1 << 16, _OTHER, np.uint8)
    for kind, members in ((_LETTER, f"[{_LETTERS}]"), (_NUMBER, "[0-9²³¹¼-¾]"), (_BLANK, "[ \t\n\r]")):
        table[[ord(c) for c in re.findall(members, every)]] = kind
    return table


_CLASSES = _class_table()


def piece_starts(data: np.ndarray, offsets: np.ndarray, certain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, class) of each piece of the texts, which together cover ``data``.

    Texts of certain characters, in lower case, are parted as PRE_TOKENS does, others at blanks and line feeds only.
    """
    kind = _CLASSES[:256][data]
    high = np.flatnonzero(data >= 0xC0)  # first bytes of the characters beyond ASCII; all bytes of one have its class
    if len(high):
        byte, after = data[high].astype(np.int32), lambda k: (data[np.minimum(high + k, len(data) - 1)] & 0x3F).astype(np.int32)
        two = byte < 0xE0
        classes = _CLASSES[np.where(two, (byte & 0x1F) << 6 | after(1), (byte & 0xF) << 12 | after(1) << 6 | after(2)) & 0xFFFF]
        kind[high], kind[high + 1] = classes, classes
        kind[(high + 2)[~two]] = classes[~two]
    for text in np.flatnonzero(~certain).tolist():
        own = data[offsets[text]:offsets[text + 1]]
        kind[offsets[text]:offsets[text + 1]] = np.where((own == 0x20) | (own == 0x0A), _BLANK, _WORD)
    begins = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
    begins[:-1] |= (kind == _NUMBER) & ((data & 0xC0) != 0x80)
    begins[offsets] = True
    # an apostrophe that starts a piece, and the contraction after it
    at = np.flatnonzero(data == 0x27)
    text = np.searchsorted(offsets, at, side="right") - 1
    mine = begins[at] & certain[text]
    at, room = at[mine], (offsets[text + 1] - at - 1)[mine]
    near = lambda k: np.where(room >= k, data[np.minimum(at + k, len(data) - 1)], 0)
    one, two = near(1), near(2)
    is_ = lambda x, letters: np.isin(x, list(letters))
    length = np.where(is_(one, b"stmd"), 1, np.where((is_(one, b"rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))), 2, 0))
    short = length > 0
    begins[at[short] + 1] = False
    begins[at[short] + length[short] + 1] = True
    start = np.flatnonzero(begins[:-1])
    return start, kind[start]


class WordEncoder:
    """The library's tokenizer, asked once for each distinct piece while its bounded memo lasts.

    A text of certain characters is put into lower case and parted into the tokenizer's own pre-tokens, many of which are
    asked in one call; the ids of each are those of its number among the call's pre-tokens.  Other texts, and those that may
    hold a special token's string, are parted at blanks and line feeds only, which the tokenizer drops before it merges and
    which neither its pattern nor its normaliser reaches across; their words are asked as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.remembered = remembered
        parts = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"]["Regex"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.known_shape = steps == NORMALISERS and splits == [PRE_TOKENS]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, f"<u{self.width}"), np.zeros(0, np.int64)

    def remember(self, pieces: list[str], single: list[bool]) -> None:
        """Ask for pieces: pre-tokens many to a call, others one by one."""
        kind = self.ids.dtype
        many = [p for p, alone in zip(pieces, single) if not alone]
        rest = [p for p, alone in zip(pieces, single) if alone]
        done, ids, counts = [], [self.ids], [self.counts]
        groups = [many[k:k + CALL_PIECES] for k in range(0, len(many), CALL_PIECES)]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            size = np.bincount(np.array(found.word_ids, np.int64), minlength=len(group))
            if len(size) != len(group) or not size.all():
                rest += group  # not one pre-token each
                continue
            done += group
            ids.append(np.array(found.ids, kind))
            counts.append(size)
        for found in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(found.ids, kind))
            counts.append(np.array([len(found.ids)]))
        self.number.update(zip(done + rest, range(len(self.counts), len(self.counts) + len(pieces))))
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts in turn, ``end_id`` after each, and how many each text has."""
        if len(self.number) >= self.remembered:
            self.forget()
        texts = texts.cast(pa.large_string())
        certain = pc.and_not(pc.match_substring_regex(texts, f"^[{CERTAIN}]*$"), pc.match_substring(texts, "<|")) if self.known_shape else (
            pa.array([False] * len(texts)))
        data, offsets = flat_utf8(pc.if_else(certain, pc.utf8_lower(texts), texts))
        ends = np.full(len(texts), end_id, self.ids.dtype)
        if not len(data):
            return ends, np.ones(len(texts), np.int64)
        start, kind = piece_starts(data, offsets, certain.to_numpy(zero_copy_only=False))
        bounds = np.append(start, len(data))
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        place = pieces.indices.to_numpy()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        blank, single = np.zeros(len(names), bool), np.zeros(len(names), bool)
        blank[place[kind == _BLANK]], single[place[kind == _WORD]] = True, True
        new = [k for k in np.flatnonzero(~blank).tolist() if names[k] not in self.number]
        if new:
            self.remember([names[k] for k in new], single[new].tolist())
        first = np.cumsum(self.counts) - self.counts
        number = np.array([0 if b else self.number[name] for name, b in zip(names, blank.tolist())], np.int64)
        size = (np.where(blank, 0, self.counts[number]) if len(self.counts) else np.zeros(len(names), np.int64))[place]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat((first[number] if len(first) else number)[place] - (upto - size), size) + np.arange(upto[-1])]
        until = np.concatenate([[0], upto])[np.searchsorted(start, offsets)]
        return np.insert(ids, until[1:], ends), np.diff(until) + 1


def _encoder(path: str) -> WordEncoder:
    return kept(("words", path), lambda: WordEncoder(path))


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, shards: int) -> DataFrame:
    """Write ``shards`` files below ``folder``; (shard, file, doc_id, nth, n_tokens) of every document, lazily.

    A task writes to a name of its own and renames at its end, so a lost or doubled task leaves one whole file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), _encoder(tokenizer_path)
        shard, attempt = context.partitionId(), context.taskAttemptId()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        own, name = f"{root}/.shard-{shard:06d}-{attempt}", f"shard-{shard:06d}.bin"
        keys, counts, last, nth, total = [], [], None, 0, 0
        with files.open_output_stream(own) as out:
            out.write(MAGIC)
            for batch in chunks(batches, "text"):
                payload, size = encoder.encode(batch.column("text"), end_id)
                numbers = []
                for doc_id in batch.column("doc_id").to_pylist():
                    nth = nth + 1 if (doc_id,) == last else 0
                    last = (doc_id,)
                    numbers.append(nth)
                ids = batch.column("doc_id")
                nulls = np.array(ids.is_null().to_numpy(zero_copy_only=False), bool)
                keys.append(key_hash(ids.fill_null(0).to_numpy(), nulls, np.array(numbers)))
                counts.append(size)
                total += int(size.sum())
                out.write(payload.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(size), pa.int32()), pa.array([name] * len(size)), ids,
                     pa.array(numbers, pa.int64()), pa.array(size)], ["shard", "file", "doc_id", "nth", "n_tokens"])
            keys, counts = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            out.write(index_bytes(keys, starts, counts))
            out.write(struct.pack(FOOTER, len(MAGIC) + total * encoder.width, len(keys), total, encoder.width, MAGIC))
        files.move(own, f"{root}/{name}")

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
            .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text"))
    return map_arrow(rows, run, "shard int, file string, doc_id long, nth long, n_tokens long")


def read_by_key(keys: DataFrame, folder: str, tasks: int) -> DataFrame:
    """(shard, doc_id, nth, start, n_tokens, ids_crc32) for keys (shard, file, doc_id, nth), looked up in the shards' indexes.

    ``start`` counts within the shard; a key that its shard does not hold raises.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(f"{folder}/{rows['file'].iloc[0]}")
        nulls = rows["doc_id"].isna().to_numpy()
        ids = rows["doc_id"].astype("Int64").fillna(0).to_numpy(np.int64)
        starts, counts = shard.find(key_hash(ids, nulls, rows["nth"].to_numpy(np.int64)))
        if (counts < 0).any():
            raise ValueError("a document is missing from its shard")
        crc = [zlib.crc32(shard.read(s, c).tobytes()) for s, c in zip(starts.tolist(), counts.tolist())]
        return pd.DataFrame({"shard": rows["shard"], "doc_id": rows["doc_id"].astype("Int64"), "nth": rows["nth"], "start": starts, "n_tokens": counts,
                             "ids_crc32": np.array(crc, np.int64)})

    ship_package(keys.sparkSession)
    # keys are small and payloads are not: a stated number of tasks, which is not reduced by the size of the keys
    return keys.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, "shard int, doc_id long, nth long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode, write the shards, read every document back by its key: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in ascending doc_id order (null ids first; rows of one doc_id in
    the order of their texts).  A null or empty text is the end id alone; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(text_of())).alias("bytes")).first()["bytes"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keys = written(write_shards(docs, tokenizer_path, folder, end_id, shards), "token-keys")
    totals = sorted((r["shard"], r["n"]) for r in keys.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a row a file
    before, base = 0, []
    for shard, n in totals:
        base.append((shard, before))
        before += n
    offsets = spark.createDataFrame(base, "shard int, base long")
    found = read_by_key(keys.select("shard", "file", "doc_id", "nth"), folder, shards)
    return found.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
