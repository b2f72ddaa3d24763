"""Near-duplicate detection by min-max hashing.

Each permutation of a document's shingle set gives two signature values, its minimum and its maximum: half the hash
evaluations for the same number of values.  Bands of the signature select candidates; links are confirmed on the full
sets.  Documents with equal sets are one representative throughout.  Within a band bucket, each member is first compared
with one central member; only what is in different components after that is compared pair by pair, inside tasks and in
blocks of bounded size, and only pairs that can be links leave a task: a large group of copies or near copies never makes
all its pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, chunks, flat_utf8, map_arrow, mix64, packed, seeded_words, span_hash, spans, text_of, unpacked, written
from tidemark.llm.components import components

WORDS = 5
PERMUTATIONS = 64
ROWS = 4
#: Candidate pairs of the last round whose estimate from all signature values is this far below the threshold (over six
#: standard errors) are dropped.
SLACK = 0.25
CELLS = 256
FULL = 65535
#: Flags of the filter by which texts are kept for their sets (2 MB).
SLOTS = 1 << 24
#: Text worked on at once in a task.
SLICE_BYTES = 512 << 10
#: Members of a bucket compared with each other in one task.
BLOCK = 512
_MULTIPLIERS = seeded_words(61, PERMUTATIONS)
_PLACES = seeded_words(62, WORDS + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): 64-bit shingle hashes of each text in turn, repeats included.

    A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09-0x0D.  A text of fewer words gives its whole word
    sequence as one shingle, a text without words none.
    """
    data, offsets = flat_utf8(texts)
    n = len(offsets) - 1
    data = _LOWER[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    start, end, of = spans(~((data == 32) | ((data >= 9) & (data <= 13))), owner)
    word = span_hash(data, start, end)
    count = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    mixed = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        mixed += word[k:k + len(mixed)] * _PLACES[k]
    whole = of[:len(mixed)] == of[WORDS - 1:] if len(mixed) else np.zeros(0, bool)
    at, value = [of[:len(mixed)][whole]], [mix64(mixed[whole])]
    for size in range(1, WORDS):
        docs = np.flatnonzero(count == size)
        total = np.full(len(docs), _PLACES[WORDS]) * U64(size)
        for k in range(size):
            total += word[first[docs] + k] * _PLACES[k]
        at.append(docs)
        value.append(mix64(total))
    at, value = np.concatenate(at), np.concatenate(value)
    order = np.argsort(at, kind="stable")
    return value[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = np.sort(hashes[a:b])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own)
    return out


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2 * PERMUTATIONS): the minima, then the maxima; zeros for empty sets."""
    n = len(offsets) - 1
    out = np.zeros((2 * PERMUTATIONS, n), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        starts = offsets[:-1][full]
        for k in range(PERMUTATIONS):
            value = hashes * _MULTIPLIERS[k]
            out[k, full] = np.minimum.reduceat(value, starts)
            out[PERMUTATIONS + k, full] = np.maximum.reduceat(value, starts)
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, bands) keys, each of ROWS signature values and the band's number."""
    grouped = signature.reshape(len(signature), -1, ROWS)
    key = np.arange(grouped.shape[1], dtype=np.uint64)[None, :] * U64(0x51ED270B)
    for k in range(ROWS):
        key = mix64(key ^ grouped[:, :, k])
    return key.view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, bands): set size, 128-bit set fingerprint and band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE_BYTES):
            hashes, offsets = shingles(batch.column("text"))
            sets, signature = distinct_sets(hashes, offsets), signatures(hashes, offsets)
            prints = [np.array([np.sum(mix64(s ^ U64(seed)), dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for seed in (1, 2)]
            keys = band_keys(signature)
            bands = list_rows(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, prints), bands], ["doc_id", "n", "f1", "f2", "bands"])

    return map_arrow(docs, run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def list_rows(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SLOTS)) + 1  # bitmap positions start at 1


def slots_of(ids: DataFrame, column: str) -> np.ndarray:
    """A table of SLOTS flags, set where an id falls: a filter of bounded size that never loses an id."""
    rows = ids.select(slot(column).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()  # SLOTS / 32768 rows of 4 KB at most
    flags = np.zeros(SLOTS + 32768 + 1, bool)
    for row in rows:
        start = (row["bucket"] - 1) * 32768 + 1
        flags[start:start + 32768] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")[:32768]
    return flags


def full_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(rep, shingles, bands, signature, spread) of the documents whose slot is wanted: the sorted distinct hashes, the band
    keys, 16 bits of each signature value, and the number of shingles in each of CELLS cells of the hash space (16 bits each)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).astype(bool)
        for whole in batches:
            whole = whole.filter(pa.array(flags[whole.column("slot").to_numpy()]))
            yield from sets_of(chunks(iter([whole]), "text", SLICE_BYTES))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = shingles(batch.column("text"))
            sets, signature = distinct_sets(hashes, offsets), signatures(hashes, offsets)
            small = (mix64(signature) & U64(0xFFFF)).astype("<u2")
            cells = np.minimum(np.stack([np.bincount((s >> U64(56)).astype(np.int64), minlength=CELLS) for s in sets]), FULL).astype("<u2")
            raw = lambda rows: pa.array([row.tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), raw(sets), list_rows(band_keys(signature)), raw(small), raw(cells)],
                                             ["rep", "shingles", "bands", "signature", "spread"])

    return map_arrow(docs.where("doc_id is not null").withColumn("slot", slot("doc_id")), run,
                     "rep long, shingles binary, bands array<long>, signature binary, spread binary")


def possible_pairs(a: dict, b: dict, same: bool, key: int, percent: int) -> np.ndarray:
    """(2, pairs) places of the pairs of two blocks of a bucket that can be links between different components.

    A pair is left to the first band in which it agrees.  The cells give an upper bound of the intersection, so that test
    loses nothing; the signatures' estimate must not be over six standard errors too low.
    """
    n, m = a["n"][:, None], b["n"][None, :]
    open_ = (a["c"][:, None] != b["c"][None, :]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
    left, right = np.nonzero(np.triu(open_) if same else open_)
    band = int(np.argmax(a["bands"][0] == key))
    out = []
    for at in range(0, len(left), 1 << 14):
        i, j = left[at:at + (1 << 14)], right[at:at + (1 << 14)]
        earlier = (a["bands"][i, :band] == b["bands"][j, :band]).any(1)
        i, j = i[~earlier], j[~earlier]
        near = (a["signature"][i] == b["signature"][j]).sum(1) >= (percent / 100 - SLACK) * 2 * PERMUTATIONS
        i, j = i[near], j[near]
        x, y = a["spread"][i], b["spread"][j]
        common = np.minimum(x, y).sum(1, dtype=np.int64)
        fits = (100 * common >= percent * (a["n"][i] + b["n"][j] - common)) | ((x == FULL) & (y == FULL)).any(1)
        out.append(np.stack([i[fits], j[fits]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def compared_blocks(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of a bucket's members in different components that can be links, found block by block in tasks."""
    spark = apart.sparkSession
    sizes = apart.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = apart.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = (dealt.select("key", "rep", "n", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "c"))
    full = paired.join(sets.select("rep", "bands", "signature", "spread"), "rep")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "i", "j", "block", "rep", "n", "c", "bands", "signature", "spread"]
    tasks = full.select(*columns).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "block")

    def solve(group: pa.Table) -> pa.RecordBatch:
        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        block = group.column("block").to_numpy()

        def side(which: int) -> dict:
            some = group.filter(pa.array(block == which))
            return {"rep": some.column("rep").to_numpy(), "n": some.column("n").to_numpy(), "c": some.column("c").to_numpy(),
                    "bands": np.array(some.column("bands").to_pylist(), np.int64).reshape(len(some), -1),
                    **{c: np.frombuffer(b"".join(some.column(c).to_pylist()), "<u2").reshape(len(some), -1) for c in ("signature", "spread")}}
        a = side(i)
        b = a if i == j else side(j)
        empty = not len(a["rep"]) or not len(b["rep"])
        left, right = np.zeros((2, 0), np.int64) if empty else possible_pairs(a, b, i == j, key, percent)
        return pa.RecordBatch.from_arrays([pa.array(a["rep"][left]), pa.array(b["rep"][right])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                now = tuple(marks[:, at])
                if held and now != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                last = now
        if held:
            yield solve(pa.Table.from_batches(held))

    return map_arrow(tasks, run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among the pairs (a, b): 100 * intersection >= percent * union on the full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).rename_columns(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = lambda name: sets.select(F.col("rep").alias(name), F.col("shingles").alias(f"x{name}"))
    return map_arrow(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "xa", "xb"), run, "u long, v long")


def members_apart(members: DataFrame, component: DataFrame) -> DataFrame:
    """(key, rep, n, c): the members, with their components, of buckets that hold several components."""
    component = written(component, "minmax-components")
    state = members.join(component, members["rep"] == component["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    open_keys = state.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    return written(state.join(open_keys, "key"), "minmax-apart")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of five-word shingles; a component's
    id is its smallest doc_id, and that document is kept.  Documents without words (null and empty texts among them) are
    linked with nothing.  Rows that share a doc_id are one node; rows with a null doc_id are linked with nothing, have a null
    component and are kept.  Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    described = written(describe(texts), "minmax-signatures")
    usable = described.where("n > 0 and doc_id is not null")
    classes = written(usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "minmax-classes")
    own = usable.join(classes, ["n", "f1", "f2"]).where("doc_id = rep").dropDuplicates(["rep", "n", "f1", "f2"])
    reps = written(own.select("rep", "n", "bands"), "minmax-reps")
    # candidates: the members of band buckets of two or more, each with its weight, the sum of its buckets' sizes
    keys = reps.select("rep", "n", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keys.join(sizes, "key"), "minmax-members")
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = written(members.join(weights, "rep").select("key", "rep", "n", "weight"), "minmax-weighted")
    # the sets of the members; the texts are filtered where they are read, not shuffled
    sets = full_sets(texts, slots_of(members, "rep"))
    sets = written(sets.join(reps.select("rep", "n"), "rep").where(F.length("shingles") == F.col("n") * 8).drop("n"), "minmax-sets")
    # rows that share a doc_id are one node
    placed = usable.join(classes, ["n", "f1", "f2"]).select("doc_id", "rep")
    split = placed.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v <> last")
    same_id = placed.join(split, "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v")

    def checked(pairs: DataFrame) -> DataFrame:
        return written(confirmed(pairs, sets, percent), "minmax-links")

    # first: each member with one pivot, the most central member of its buckets that it shares most bands with
    central = members.groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("pivot"))
    votes = members.join(central, "key").where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("shared"))
    chosen = votes.groupBy("rep").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("pivot"))
    links = checked(chosen.select(F.col("rep").alias("b"), F.col("pivot").alias("a")))
    # then, where a bucket still holds several components, what is apart in it, block by block
    apart = members_apart(members, components(links))
    links = links.unionByName(checked(compared_blocks(apart, sets, percent)))
    links = links.unionByName(same_id)
    component = components(links)
    result = (described.join(classes, ["n", "f1", "f2"], "left")
              .join(component, F.col("rep") == F.col("node"), "left"))
    alone = F.col("rep").isNull() | F.col("doc_id").isNull()
    found = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"),
                         F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with all its columns as they are.

    Of several rows with one doc_id, the one of smallest text stays; rows with a null doc_id stay.
    """
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = packed(docs).withColumn("id", F.col("row.doc_id").cast("long"))
    known = rows.where("id is not null").join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    first: Column = F.row_number().over(Window.partitionBy("id").orderBy(F.col("row.text")))
    known = known.withColumn("nth", first).where("nth = 1").select("row")
    return unpacked(known.unionByName(rows.where("id is null").select("row")), docs.columns)
