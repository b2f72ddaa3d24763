"""Exact top-k search by a bit-sliced index.

Rows are dealt into blocks; each quantised attribute of a block is stored as bit slices (bitmaps over the block's
rows).  A query adds its weighted slices with bitmap arithmetic (ripple adders over bitmaps), then walks
the score from the most significant slice downward to the best k rows; ties on the boundary go to smaller ids.
Only each block's best k rows leave a task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, written
from tidemark.session import ship_package

_ONE, _ZERO = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)


def sound(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def bitmaps(values: np.ndarray, bits: int) -> np.ndarray:
    """(attributes, bits, words) slices of an array (rows, attributes) of non-negative integers."""
    rows, attributes = values.shape
    width = -(-rows // 64)
    padded = np.zeros((width * 64, attributes), np.uint64)
    padded[:rows] = values.astype(np.uint64)
    out = np.empty((attributes, bits, width), np.uint64)
    for b in range(bits):
        bit = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[:, b] = np.packbits(np.ascontiguousarray(bit.T), axis=1, bitorder="little").view("<u8")
    return out


def score_slices(slices: np.ndarray, weights: np.ndarray, total_bits: int) -> np.ndarray:
    """Bit slices of ``sum_a weights[a] * values[a]`` for non-negative weights: (total_bits, words).

    Horner over the bits of the weights: double the sum, then add the attributes whose weight has that bit.
    """
    total = np.zeros((total_bits, slices.shape[2]), np.uint64)
    for bit in range(int(weights.max(initial=0)).bit_length() - 1, -1, -1):
        total[1:] = total[:-1].copy()
        total[0] = _ZERO
        for a in np.flatnonzero((weights >> bit) & 1):
            carry = None
            for b, term in enumerate(slices[a]):
                t = total[b]
                if carry is None:
                    carry = t & term
                    total[b] = t ^ term
                else:
                    half = t ^ term
                    over = (t & term) | (carry & half)
                    total[b] = half ^ carry
                    carry = over
            b = slices.shape[1]
            while b < total_bits and carry.any():
                t = total[b]
                total[b], carry = t ^ carry, t & carry
                b += 1
    return total


def best_rows(total: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of the allowed rows, smaller positions first among equals of the boundary."""
    sure, open_ = np.zeros_like(allowed), allowed.copy()
    count = lambda x: int(np.bitwise_count(x).sum())
    have = 0
    for b in range(len(total) - 1, -1, -1):
        high = open_ & total[b]
        n = count(high)
        if have + n > k:
            open_ = high
        else:
            sure |= high
            have += n
            open_ &= ~total[b]
            if have == k:
                break
    positions = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([positions(sure), positions(open_)[:k - have]])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, q): floor(scale * x) of every component, for sound vectors."""
    v = F.col(vector_col)
    return (vectors.where(sound(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"),
                                           F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")))


def build_index(rows: DataFrame, low: int, bits: int, block_rows: int, n_rows: int) -> DataFrame:
    """(block, ids, rows, attributes, width, slices): the values less ``low`` as bit slices, ids ascending."""
    blocks = max(1, -(-n_rows // block_rows))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        values = np.stack(frame["q"].to_numpy()).astype(np.int64) - low
        maps = bitmaps(values, bits)
        return pd.DataFrame([{"block": key[0], "ids": frame["id"].to_numpy(np.int64).tobytes(), "attributes": values.shape[1],
                              "slices": maps.tobytes()}])

    ship_package(rows.sparkSession)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "q"), F.lit(blocks)))
    return dealt.groupBy("block", F.size("q").alias("attributes")).applyInPandas(
        build, "block long, ids binary, attributes int, slices binary")


def search_block(ids: np.ndarray, slices: np.ndarray, low: int, queries: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the block's best k rows for each query; a query's own id is no candidate."""
    attributes, bits, width = slices.shape
    top = (1 << bits) - 1
    real = np.zeros(width * 64, np.uint8)
    real[:len(ids)] = 1
    real = np.packbits(real, bitorder="little").view("<u8")
    flipped = slices ^ _ONE  # top - value
    out = []
    for query, q in queries:
        # score = sum q * value; for q < 0 use |q| * (top - value), which differs by a constant of the query
        weights = np.abs(q)
        own = np.where((q < 0)[:, None, None], flipped, slices)
        total = score_slices(own, weights, max(1, (int(weights.sum()) * top).bit_length()))
        allowed = real.copy()
        for at in np.flatnonzero(ids == query):
            allowed[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        base = int(q.sum()) * low - int(weights[q < 0].sum()) * top
        for at in best_rows(total, allowed, k).tolist():
            raw = sum(int((total[b, at >> 6] >> np.uint64(at & 63)) & np.uint64(1)) << b for b in range(len(total)))
            out.append((query, int(ids[at]), raw + base))
    return out


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
          scale: int = 1024, block_rows: int = 32768, query_rows: int = 128) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest integer inner product.

    ``is_query`` is a condition on the column ``id``.  Candidates are all rows but those with the query's own id; ties go to
    smaller ids; fewer than k rows if there are fewer.  Vectors that are null, hold null or non-finite components, or have a
    null id take no part; a query meets vectors of its own length only.  Repeated candidate rows are candidates each; a repeated query id is
    searched once, with the smallest of its vectors.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = written(quantised(vectors, id_col, vector_col, scale), "bitslice-rows")
    span = rows.select(F.array_min("q").alias("a"), F.array_max("q").alias("b")).agg(
        F.min("a").alias("low"), F.max("b").alias("high"), F.count("*").alias("n")).first()
    low, high = span["low"] or 0, span["high"] or 0
    bits = max(1, int(high - low).bit_length())
    index = written(build_index(rows, low, bits, block_rows, span["n"]), "bitslice-index")
    queries = rows.where(is_query).groupBy("id").agg(F.min("q").alias("q"))
    chunks = max(1, -(-rows.where(is_query).count() // query_rows))
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks))
    # every block meets every chunk of queries: a stated query set against all rows, in blocks
    batched = queries.groupBy(chunk.alias("chunk"), F.size("q").alias("attributes")).agg(F.collect_list(F.struct("id", "q")).alias("queries"))
    tasks = (index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("chunk", F.col("chunk").cast("long"))
             .select("chunk", "attributes", "block").join(batched, ["chunk", "attributes"])
             .repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "chunk")
             .join(index, ["block", "attributes"]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["attributes"], bits, -1)
                found = search_block(ids, slices, low, [(x["id"], np.array(x["q"], np.int64)) for x in row["queries"]], k)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)],
                                                 ["query_id", "vec_id", "score"])

    found = map_arrow(tasks.select("ids", "slices", "attributes", "queries"), search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
