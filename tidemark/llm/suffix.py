"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts earlier goes.  A string (window) of ``length`` bytes is
keyed by the smallest hash of its 24-byte substrings, so equal windows have equal keys wherever they stand; runs of
windows with one key are regions.  Equal regions are reduced to the first, already by the tasks that find them; windows of
the others are later ones.  A key that then stands at a single place cannot repeat.  The regions of the other keys are dealt
into shards by key and every shard is sorted by external induced sorting (:mod:`tidemark.llm.induced`): neighbours whose
common prefix reaches ``length`` are equal windows, the first stays, the others cover their bytes.  Of keys with
very many regions every window is dealt by a 128-bit hash of its own bytes instead, without them: tasks keep the first place
of each hash they see, so what is sent for one window grows with the tasks, not with the documents that share it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, chunks, flat_utf8, map_arrow, mix64, seeded_words, span_hash, text_of
from tidemark.llm.induced import suffix_blocks

LENGTH = 100
GRAM = 24
#: Regions of a key beyond which its windows are dealt one by one.
HOT_REGIONS = 2000
SLICE = 1 << 20
#: Bytes of regions sorted together; a single key may exceed it, and the sorter's queues then go to disk.
SHARD_BYTES = 4 << 20
#: Places of regions that a task remembers to find equal ones before the shuffle.
REMEMBERED = 1 << 17
NULL_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_TABLE = seeded_words(5, 256)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at every position, by doubling."""
    whole, done, power, width = None, 0, _TABLE[data], 1
    while True:
        if size & width:
            # the part done so far, then this power of two of bytes after it
            if whole is None:
                whole, done = power, width
            else:
                n = len(data) - done - width + 1
                whole = whole[:max(0, n)] * U64(pow(_BASE, width, 1 << 64)) + power[done:done + max(0, n)]
                done += width
        if done == size:
            return mix64(whole)
        n = max(0, len(data) - 2 * width + 1)
        power = power[:n] * U64(pow(_BASE, width, 1 << 64)) + power[width:width + n]
        width *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    low, size = values, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[width - size:width - size + n])


def window_keys(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window, the smallest hash among its substrings of ``gram`` bytes; and the hashes."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    return sliding_min(hashes, length - gram + 1), hashes


def places_of_key(keys: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """1 for runs of windows (first to last) whose key stands at one place, 2 where it stands at several: those may repeat in themselves."""
    around = np.lib.stride_tricks.sliding_window_view(hashes, len(hashes) - len(keys) + 1)
    left = first + np.argmax(around[first] == keys[first, None], axis=1)
    right = last + around.shape[1] - 1 - np.argmax(around[last][:, ::-1] == keys[last, None], axis=1)
    return np.where(left == right, 1, 2).astype(np.int32)


class FirstPlaces:
    """The smallest place seen lately of each region, in a table of bounded size: tells later copies within a task."""

    def __init__(self, slots: int):
        self.slots = slots
        self.held = [np.zeros(slots, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int64)]
        self.held[4][:] = -1

    def later(self, key: np.ndarray, body: np.ndarray, doc: np.ndarray, version: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True where an equal region of a smaller place is known; the others are remembered."""
        slot = (mix64(key ^ body) % U64(self.slots)).astype(np.int64)
        k, b, d, v, p = (x[slot] for x in self.held)
        same = (p >= 0) & (k == key) & (b == body)
        after = (d < doc) | ((d == doc) & ((v < version) | ((v == version) & (p < lo))))
        found = same & after
        for table, values in zip(self.held, (key, body, doc, version, lo)):
            table[slot[~found]] = values[~found]
        return found


def regions(docs: DataFrame, length: int) -> DataFrame:
    """(key, body, doc, version, lo, shape) of the regions of every text.

    ``body`` hashes the region's bytes.  ``shape`` is 4 * windows, plus 2 if the key stands at several places of the region,
    plus 1 if the region is known to be a later copy: that needs no partner any more, so its key is its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = FirstPlaces(REMEMBERED)
        for batch in batches:
            data, offsets = flat_utf8(batch.column(2))
            doc, version = (batch.column(i).to_numpy() for i in (0, 1))
            # slices of bounded size, whatever the documents' sizes; a region may be cut in two, its key stays
            for at in range(0, len(data), SLICE):
                some = data[at:at + SLICE + length - 1]
                keys, hashes = window_keys(some, length, GRAM)
                if not len(keys):
                    continue
                place = at + np.arange(len(keys))
                owner = np.searchsorted(offsets, place, side="right") - 1
                valid = place + length <= offsets[owner + 1]
                new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
                starts = np.flatnonzero(new & valid)
                # valid windows of a document come before its invalid ones
                group = np.cumsum(new) - 1
                count = np.bincount(group[valid], minlength=group[-1] + 1)[group[starts]]
                several = places_of_key(keys, hashes, starts, starts + count - 1) - 1
                key, body = keys[starts], span_hash(some, starts, starts + count + length - 1)
                own = doc[owner[starts]], version[owner[starts]], place[starts] - offsets[owner[starts]]
                later = first.later(key, body, *own)
                key = np.where(later, mix64(key ^ mix64(own[0].view(np.uint64) + U64(31) * own[2].view(np.uint64))), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(body.view(np.int64)), *map(pa.array, own),
                     pa.array((4 * count + 2 * several + later).astype(np.int32))], ["key", "body", "doc", "version", "lo", "shape"])

    return map_arrow(docs, run, "key long, body long, doc long, version int, lo long, shape int")


def repeated_regions(found: DataFrame) -> DataFrame:
    """(doc, version, lo, windows, key, later, hot): later copies of regions, and the firsts of keys that stand at several places."""
    copies = Window.partitionBy("key", "body").orderBy("doc", "version", "lo")
    known = F.col("shape").bitwiseAND(1) == 1
    first = found.withColumn("copy", F.rank().over(copies) > 1).withColumn("later", F.col("copy") | known)
    # rows of one place (repeated input rows) count once
    first = first.withColumn("nth", F.row_number().over(copies))
    places = F.when(F.col("nth") == 1, 1 + F.floor(F.col("shape").bitwiseAND(2) / 2)).otherwise(0)
    keyed = first.withColumn("places", F.sum(places).over(Window.partitionBy("key")))
    return (keyed.where(F.col("later") | (F.col("places") > 1))
            .select("doc", "version", "lo", F.floor(F.col("shape") / 4).cast("int").alias("windows"), "key", "later",
                    (F.col("places") > HOT_REGIONS).alias("hot")))


def merged(ranges: list[list[int]]) -> list[list[int]]:
    """Byte ranges in ascending order, those that meet made one."""
    out: list[list[int]] = []
    for lo, end in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return out


_PLACED = "part long, doc long, version int, lo long, end long, key long, region binary"


def placed_regions(work: DataFrame, length: int) -> DataFrame:
    """Rows to be dealt by ``part``: first regions with their bytes, merged ranges of later ones without, and windows of hot
    keys with 16 bytes of hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = FirstPlaces(REMEMBERED)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for whole in batches:
            for batch in chunks(iter([whole]), "text", 1 << 20):
                out: list[tuple] = []
                for doc, version, text, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    gone: list[list[int]] = []
                    for x in sorted(found, key=lambda x: x["lo"]):
                        lo, end = x["lo"], x["lo"] + x["windows"] + length - 1
                        if x["later"]:
                            gone.append([lo, end])
                        elif not x["hot"]:
                            out.append((x["key"], doc, version, lo, end, x["key"], text[lo:end]))
                        else:
                            data = np.frombuffer(text[lo:end], np.uint8)
                            key, at = gram_hashes(data, length), np.arange(x["windows"])
                            body = span_hash(data, at, at + length)
                            # within the region only the first of equal windows stays
                            once = np.unique(np.stack([key, body]), axis=1, return_index=True)[1]
                            later = np.ones(len(at), bool)
                            later[once] = seen.later(key[once], body[once], np.full(len(once), doc),
                                                     np.full(len(once), version, np.int32), lo + once)
                            gone += [[lo + i, lo + i + length] for i in np.flatnonzero(later).tolist()]
                            for i in np.flatnonzero(~later).tolist():
                                own = int(key[i:i + 1].view(np.int64)[0])
                                out.append((own, doc, version, lo + i, lo + i + length, own, key[i].tobytes() + body[i].tobytes()))
                    gone = merged(gone)
                    out += [(doc * 31 + version & (1 << 62) - 1, doc, version, lo, end, None, None) for lo, end in gone]
                columns = list(zip(*out)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                 ["part", "doc", "version", "lo", "end", "key", "region"])

    return map_arrow(work, run, _PLACED)


def later_windows(texts: list[bytes], length: int, memory: int = 64 << 20) -> list[tuple[int, int, int]]:
    """(number of the region, first, end) of the runs of windows that stand earlier too.

    Regions are given in ascending order of their places, each with the bytes of its windows; equal regions are there once.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    text[starts[1:] - 1] = 0  # below every byte
    later = np.zeros(len(text), bool)
    for suffixes, shared in suffix_blocks(text, 257, length, memory):
        equal = np.concatenate([shared >= length, [False]])
        # groups of neighbours that agree in a whole window
        begin = np.flatnonzero(~equal[:-1] & equal[1:])
        if not len(begin):
            continue
        group = np.cumsum(~equal[:-1]) - 1
        first = np.minimum.reduceat(suffixes, np.flatnonzero(~equal[:-1]))
        later[suffixes[suffixes != first[group]]] = True
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(text)) - starts[owner]
    later &= offset <= sizes[owner] - length
    edge = np.diff(later.astype(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return list(zip(owner[a].tolist(), offset[a].tolist(), (offset[b - 1] + 1).tolist()))


def sorted_shards(parts: DataFrame, length: int) -> DataFrame:
    """(doc, version, first, end): byte ranges covered by later windows, from partitions that hold each key whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                              ["doc", "version", "first", "end"])

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (doc, version, lo, end, region); a region shorter than a window is the hash of one."""
            once: dict[bytes, tuple] = {}
            out = []
            for row in rows:
                first = once.setdefault(row[4], row)
                if first[:3] != row[:3]:
                    once[row[4]] = min(first, row)
                    out.append(max(first, row)[:4])
            unique = sorted(r for r in once.values() if len(r[4]) >= length)
            for i, a, b in later_windows([r[4] for r in unique], length) if unique else ():
                doc, version, lo = unique[i][:3]
                out.append((doc, version, lo + a, lo + b + length - 1))
            return ranges(out)

        held = []
        for batch in batches:
            known = batch.column("region").is_valid()
            own = batch.filter(pc.invert(known))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("doc", "version", "lo", "end")], ["doc", "version", "first", "end"])
            held.append(batch.filter(known).select(["key", "doc", "version", "lo", "end", "region"]))
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        table = table.take(pc.sort_indices(table, [("key", "ascending")])).combine_chunks()
        keys = table.column("key").to_numpy()
        size = np.cumsum(pc.binary_length(table.column("region")).to_numpy().astype(np.int64))
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]])
        start = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b == len(keys) or size[b - 1] - (size[start - 1] if start else 0) >= SHARD_BYTES:
                some = table.slice(start, b - start)
                yield solve(list(zip(*(some.column(c).to_pylist() for c in ("doc", "version", "lo", "end", "region")))))
                start = b

    return map_arrow(parts, run, "doc long, version int, first long, end long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): every text without its repeated strings.

    A string repeats if it starts earlier in a document of smaller doc_id, or earlier in the same one; it is judged on the
    input, may overlap its earlier place, and never crosses documents.  Null and empty texts have no bytes; texts shorter
    than ``length`` stay.  Null ids count as the smallest; rows of one doc_id are ordered by a hash of their texts, and rows
    equal in both are treated alike.  Other columns are ignored; an empty table gives an empty result.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_of().cast("binary")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.hash(text).alias("version"), text.alias("text"))
    found = regions(texts, length).repartition(n, "key")  # one shuffle for both windows
    lists = (repeated_regions(found).groupBy("doc", "version")
             .agg(F.collect_list(F.struct("lo", "windows", "key", "later", "hot")).alias("found")))
    work = texts.join(lists, ["doc", "version"]).select("doc", "version", "text", "found")
    parts = placed_regions(work, length).repartition(n, "part")
    covered = (sorted_shards(parts, length).groupBy("doc", "version")
               .agg(F.collect_list(F.struct("first", "end")).alias("ranges")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kept, at, removed, spans = [], 0, 0, 0
                for first, end in sorted((r["first"], r["end"]) for r in ranges or ()):
                    if first > at or not spans:
                        kept.append(text_[at:first])
                        spans, removed, at = spans + 1, removed + end - first, end
                    elif end > at:
                        removed, at = removed + end - at, end
                kept.append(text_[at:])
                rows.append((None if doc == NULL_ID else doc, len(text_), removed, spans, b"".join(kept)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.binary()))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(texts.join(covered, ["doc", "version"], "left").select("doc", "text", "ranges"), cut,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
