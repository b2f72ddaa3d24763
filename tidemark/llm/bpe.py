"""Byte-level BPE encoding and decoding.

Encoding is a fold of ranked merges over the byte array of each distinct word, written with
Spark higher-order functions over a literal rank map.  Interpreted lambdas cost about 0.1 ms
a word, so the fold runs over the distinct frequent words (``dictionary_words`` of them at most,
chosen by counts over the whole corpus; a bounded table that is broadcast), and words outside
the table are merged where they occur by :func:`merge_ids`, the same rule as a plain function.
Documents themselves are never shuffled.  Decoding concatenates the binary pieces of the ids.
"""
from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, kept, map_arrow, text_of, written

NO_MERGE = 1 << 30
BUCKETS = 1 << 16
#: Words of more bytes are never in the broadcast table, which bounds its size.
DICTIONARY_WORD_BYTES = 64
#: Longer words are merged with a heap instead of list scans.
LONG_WORD_BYTES = 256
#: Text worked on at once in a task.
SLICE_BYTES = 1 << 20
#: White space as the rank files' pattern means it (the White_Space property).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a rank file of base64 tokens."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge_pairs(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, id of both joined) for every token and every way to cut it into two tokens."""
    return [(ranks[token[:k]], ranks[token[k:]], rank) for token, rank in ranks.items()
            for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]


def word_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with ``\\s`` spelled out, so that every engine sees the same white space."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


# ---------------------------------------------------------------- Spark fold

def rank_tables(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: ``pairs``, an array of hash buckets each a map from a pair of ids to the merged id, and ``bytes``."""
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(BUCKETS)]
    for left, right, merged in merge_pairs(ranks):
        buckets[(left * 31 + right) % BUCKETS].append((left * 65536 + right, merged))
    return spark.createDataFrame(pa.table({
        "pairs": pa.array([buckets], pa.list_(pa.map_(pa.int64(), pa.int32()))),
        "bytes": pa.array([[ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int32()))}))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _ints(*values: Column) -> Column:
    return F.array(*values).cast("array<int>")


def fold_merges(word: Column, tables: Column) -> Column:
    """Token ids of a word: start from its bytes, join the leftmost pair of lowest rank, until none is left."""
    size = F.length(word.cast("binary"))
    hexed = F.hex(word.cast("binary"))

    def joined(left: Column, right: Column) -> Column:
        bucket = F.get(tables["pairs"], ((left * 31 + right) % BUCKETS).cast("int"))
        return F.coalesce(F.try_element_at(bucket, left.cast("long") * 65536 + right), F.lit(NO_MERGE))

    def step(state: Column, _: Column) -> Column:
        def merge(s: Column) -> Column:
            ids, ranks, best, at = s["ids"], s["ranks"], s["best"], s["at"]
            return F.struct(
                F.concat(F.slice(ids, 1, at - 1), _ints(best), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
                F.concat(F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))),
                         F.when(at > 1, _ints(joined(F.get(ids, at - 2), best))).otherwise(_ints()),
                         F.when(at < F.size(ranks), _ints(joined(best, F.get(ids, at + 1)))).otherwise(_ints()),
                         F.slice(ranks, at + 2, F.size(ranks))).alias("ranks"))

        return _let(F.array_min(state["ranks"]), lambda best: F.when(best.isNull() | (best >= NO_MERGE), state).otherwise(
            _let(F.struct(state["ids"].alias("ids"), state["ranks"].alias("ranks"), best.alias("best"),
                          F.array_position(state["ranks"], best).cast("int").alias("at")), merge)))

    def fold(ids: Column) -> Column:
        ranks = F.transform(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))),
                            lambda left, i: joined(left, F.get(ids, i + 1)))
        return F.when(F.size(ids) < 2, ids).otherwise(F.aggregate(
            F.sequence(F.lit(2), F.size(ids)), F.struct(ids.alias("ids"), ranks.alias("ranks")), step, lambda s: s["ids"]))

    byte_ids = F.transform(F.sequence(F.lit(1), size), lambda i: F.get(
        tables["bytes"], F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int")))
    return _let(F.when(size == 0, _ints()).otherwise(byte_ids), fold)


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """(word, ids) by the fold.  The rank tables enter as scalar subqueries, that is as literals at run time."""
    tables = rank_tables(words.sparkSession, ranks)
    both = F.struct(tables.select("pairs").scalar().alias("pairs"), tables.select("bytes").scalar().alias("bytes"))
    return (words.select(F.col(word).alias("word")).withColumn("tables", both)
            .select("word", F.transform(F.array("tables"), lambda t: fold_merges(F.col("word"), t))[0].alias("ids")))


# ---------------------------------------------------------------- words

def count_words(docs: DataFrame, pattern: str, flush: int = 150_000) -> DataFrame:
    """(word, n) over all documents; each task pre-aggregates ``flush`` distinct words at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = word_pattern(pattern).findall, Counter()

        def out() -> pa.RecordBatch:
            short = [(w, n) for w, n in seen.items() if len(w.encode()) <= DICTIONARY_WORD_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()),
                                               pa.array([n for _, n in short], pa.int64())], ["word", "n"])
        for batch in chunks(batches, "text", SLICE_BYTES):
            for text in batch.column(0).to_pylist():
                seen.update(find(text))
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        yield out()

    return map_arrow(docs.select(text_of().alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words above the smallest count threshold that leaves no more than ``most`` of them."""
    level = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 8 * 63 rows
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return counts.where(level >= (least if least is not None else NO_MERGE)).select("word")


def build_dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int) -> dict[str, bytes]:
    """word -> its ids as little-endian unsigned 32-bit integers, for at most ``most`` frequent words."""
    counts = written(count_words(docs, pattern), "bpe-words")
    spark = docs.sparkSession
    words = frequent_words(counts, most).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = encode_words(words, ranks).toArrow()
    ids = table.column("ids").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    payload = np.asarray(ids.flatten(), "<u4").tobytes()
    ends = np.cumsum(np.asarray(ids.value_lengths().fill_null(0), np.int64)) * 4
    return {w: payload[a:b] for w, a, b in zip(table.column("word").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist())}


# ---------------------------------------------------------------- per word, outside the table

def merge_ids(word: bytes, byte_ids: list[int], joined: dict[int, int]) -> list[int]:
    """Token ids of a word by ranked merges; ``joined`` maps left * 65536 + right to the merged id, which is its rank."""
    ids = [byte_ids[b] for b in word]
    if len(ids) > LONG_WORD_BYTES:
        return _merge_long(ids, joined)
    find = joined.get
    ranks = [find(a << 16 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
    while ranks and (best := min(ranks)) < NO_MERGE:
        i = ranks.index(best)
        ids[i:i + 2] = [best]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = find(best << 16 | ids[i + 1], NO_MERGE)
        if i:
            ranks[i - 1] = find(ids[i - 1] << 16 | best, NO_MERGE)
    return ids


def _merge_long(ids: list[int], joined: dict[int, int]) -> list[int]:
    """The same merges with a heap of (rank, position) over a linked list: n log n for words of any length."""
    n = len(ids)
    after, before, value = [*range(1, n), -1], [-1, *range(n - 1)], list(ids)
    heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := joined.get(a << 16 | b)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if value[i] < 0 or j < 0 or joined.get(value[i] << 16 | value[j]) != rank:
            continue
        value[i], value[j], after[i] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (r := joined.get(value[left] << 16 | value[right])) is not None:
                heapq.heappush(heap, (r, left))
    return [v for v in value if v >= 0]


class Codec:
    """Encoder and decoder of one Python worker; the memo of other words is emptied when full."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int], pattern: str, memo_words: int = 100_000):
        self.known, self.memo, self.memo_words = known, {}, memo_words
        self.find = word_pattern(pattern).findall
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.joined = {left << 16 | right: merged for left, right, merged in merge_pairs(ranks)}
        self.piece = {rank: token for token, rank in ranks.items()}.__getitem__

    def rare(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            found = np.array(merge_ids(word.encode(), self.byte_ids, self.joined), "<u4").tobytes()
            if len(word) <= DICTIONARY_WORD_BYTES:
                if len(self.memo) >= self.memo_words:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        words = self.find(text)
        parts = list(map(self.known.get, words))
        if None in parts:
            parts = [self.rare(w) if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)

    def decode(self, payload: bytes) -> bytes:
        return b"".join(map(self.piece, np.frombuffer(payload, "<u4").tolist()))


def _codec(shared: Broadcast) -> Codec:
    """One codec a worker process and broadcast value."""
    value = shared.value
    return kept(("codec", id(value)), lambda: Codec(*value))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, dictionary_words: int = 1 << 18) -> DataFrame:
    """Encode every whole text, then decode the ids.

    Returns doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers), decoded (binary).
    A null or empty text gives no tokens and empty bytes; repeated rows, also of one doc_id, give a row each;
    other columns are ignored; an empty table gives an empty result.
    """
    ranks = load_ranks(rank_path)
    known = build_dictionary(docs, ranks, pattern, dictionary_words)
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in chunks(batches, "text", SLICE_BYTES):
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                ids.append(codec.encode(text))
                decoded.append(codec.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run,
                     "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
