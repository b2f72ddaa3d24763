"""Bounded labelled samples, and models fitted in one task from them."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, give_back, map_arrow, text_of, written

#: Text scored at once in a task.
SLICE_BYTES = 512 << 10


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int,
                    most_bytes: int = 64 << 20) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents, the first by a hash of the id, as far as their whole texts come to
    ``most_bytes`` together: the model is fitted in one task.

    Label rows that are null or not 0/1 are left out; several rows of one document count as their largest label.
    """
    chosen = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where(usable & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # at most `most` ids of 12 bytes: a broadcast of proven size; repeated documents are reduced to `most` rows again
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    sample = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id").orderBy(*order).limit(most)
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over `most` rows
    return sample.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("text", "y")


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Array, np.ndarray], bytes]) -> bytes:
    """The model bytes of ``fit(texts, y)``, run in one task over the bounded sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        texts = pa.concat_arrays([b.column(0) for b in got]) if got else pa.array([], pa.string())
        y = np.concatenate([b.column(1).to_numpy() for b in got]) if got else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, y.astype(np.float64))], pa.binary())], ["model"])

    kept = written(sample, "sample")
    return bytes(map_arrow(kept.coalesce(1), run, "model binary").collect()[0]["model"])


def score_documents(docs: DataFrame, scorer: Callable[[pa.Array], np.ndarray], threshold: float, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ``scorer`` maps an Arrow text array to scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE_BYTES):
            scores = np.clip(scorer(batch.column(2)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_of().alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def score_of(text: Column, scorer: Callable[[pa.Array], np.ndarray]) -> Column:
    """The score of a text column; only the texts go through Python, the rest of the row stays where it is."""
    def score(texts: pa.Array) -> pa.Array:
        parts = [np.clip(scorer(part.column(0)), 0.0, 1.0) for part in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", SLICE_BYTES)]
        give_back()
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return F.arrow_udf(score, "double")(text)


def adam(shapes: list[tuple[int, ...]]) -> Callable[[list[np.ndarray], list[np.ndarray], float], None]:
    """In-place Adam steps for a list of parameter arrays."""
    m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], [0]

    def step(values: list[np.ndarray], grads: list[np.ndarray], rate: float) -> None:
        t[0] += 1
        for x, g, a, b in zip(values, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= rate * (a / (1 - 0.9 ** t[0])) / (np.sqrt(b / (1 - 0.999 ** t[0])) + 1e-8)
    return step


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))
