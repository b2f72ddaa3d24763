"""Helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import scratch_path, ship_package

U64 = np.uint64


#: What a worker process keeps from task to task, and the keys used since memory was last given back.
_KEPT: dict = {}
_USED: set = set()


def kept(key: object, make: Callable[[], object]) -> object:
    """A value of one stage, made once in a worker process; it goes when a task of another stage ends."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    _USED.add(key)
    return _KEPT[key]


def give_back() -> None:
    """Return free memory of this process to the system: workers are used again by later stages."""
    for key in _KEPT.keys() - _USED:
        del _KEPT[key]
    _USED.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers, which give back free memory after each task, and what an
    earlier stage has kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_of(col: str = "text") -> Column:
    """Whole text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def packed(df: DataFrame) -> DataFrame:
    """The input row as one struct ``row``: own columns added beside it can never clash with input names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The packed columns again, in their order, with some replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col(f"row.`{c}`")).alias(c) for c in columns])


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column of an Arrow batch as one byte buffer and its n+1 offsets (nulls are empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` of text each (one row at least), to bound working memory."""
    for batch in batches:
        sizes = np.diff(flat_utf8(batch.column(column))[1])
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, vectorised."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def seeded_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64) * U64(2) + U64(1)


def spans(inside: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of the runs of True, cut where the owner (ascending document numbers) changes."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    change = np.concatenate([[False], owner[1:] != owner[:-1]])
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | change))
    ends = np.flatnonzero(inside & (~after | np.concatenate([change[1:], [True]]))) + 1
    return starts, ends, owner[starts]


_SPAN_BASE = 0x9E3779B97F4A7C15
_SPAN_INVERSE = pow(_SPAN_BASE, -1, 1 << 64)
_SPAN_TABLE = seeded_words(9, 256)
_SPAN_BLOCK = 1 << 14


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U64(1)], np.full(max(n - 1, 0), U64(base))]), dtype=np.uint64)


_SPAN_POWERS, _SPAN_INVERSES = _powers(_SPAN_BASE, _SPAN_BLOCK), _powers(_SPAN_INVERSE, _SPAN_BLOCK)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial: linear in the buffer, whatever the spans.

    The sums are taken block by block: beside the result of 8 bytes a byte only blocks are held.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    blocks = -(-len(data) // _SPAN_BLOCK) + 1
    high = _powers(pow(_SPAN_BASE, _SPAN_BLOCK, 1 << 64), blocks)
    for k, at in enumerate(range(0, len(data), _SPAN_BLOCK)):
        values = _SPAN_TABLE[data[at:at + _SPAN_BLOCK]]
        values *= _SPAN_POWERS[:len(values)]
        values *= high[k]
        np.cumsum(values, out=total[at + 1:at + 1 + len(values)])
        total[at + 1:at + 1 + len(values)] += total[at]
    inverse = _SPAN_INVERSES[starts % _SPAN_BLOCK] * _powers(pow(_SPAN_INVERSE, _SPAN_BLOCK, 1 << 64), blocks)[starts // _SPAN_BLOCK]
    return mix64((total[ends] - total[starts]) * inverse + (ends - starts).astype(np.uint64))
