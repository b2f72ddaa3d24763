"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct lower-case byte n-grams of a text, hashed.  Each is scaled by
``r = log((p / |p|) / (q / |q|))`` from its smoothed document counts among toxic (p) and other (q)
training texts; a logistic regression is fitted on the scaled features.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_utf8, packed, text_of, unpacked
from tidemark.llm.training import adam, fit_in_task, fold_of, labelled_sample, score_documents, score_of, sigmoid
from tidemark.session import ship_package

BITS = 18
SIZES = (4, 6, 8)
#: Log-count ratios of fewer standard errors than this count as 0.
Z = 3.5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_slots(data: np.ndarray, size: int) -> np.ndarray:
    """The hash slot of the n-gram at every position of a lower-case byte buffer."""
    n = max(0, len(data) - size + 1)
    h = np.full(n, size * 0x9E37, np.uint32)
    for k in range(size):
        h *= np.uint32(0x01000193)
        h ^= data[k:k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def distinct_slots(texts: pa.Array):
    """The distinct n-gram slots of each text in turn; linear in the text, with one table reused for all."""
    data, offsets = flat_utf8(texts)
    data = _LOWER[data]
    slots = [gram_slots(data, size) for size in SIZES]
    last = np.zeros(1 << BITS, np.int64)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = np.concatenate([s[start:max(start, end - size + 1)] for s, size in zip(slots, SIZES)])
        order = np.arange(len(own))
        last[own] = order
        yield own[last[own] == order]


def fit(texts: pa.Array, y: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.02, decay: float = 1e-5) -> bytes:
    """The weight of each slot (ratio times coefficient) and the bias, as float32 bytes.

    Without labels of both kinds, the weights are 0 and the bias gives the share of toxic labels (0 without labels).
    """
    weights = np.zeros((1 << BITS) + 1, np.float32)
    toxic = y.mean() if len(y) else 0.0
    weights[-1] = np.log((toxic + 1e-6) / (1 - toxic + 1e-6))
    if not 0 < toxic < 1:
        return weights.tobytes()
    slots_of_texts = lambda: (own for i in range(0, len(texts), 256) for own in distinct_slots(texts[i:i + 256]))
    count = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for own, label in zip(slots_of_texts(), y):
        count[int(label)][own] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    # ratios within the noise of their counts carry no evidence; long texts would add up thousands of them
    ratio[np.abs(ratio) < Z * np.sqrt(1 / count[0] + 1 / count[1])] = 0.0
    rows = [own[ratio[own] != 0] for own in slots_of_texts()]  # the other features are 0 anyway
    w, bias = np.zeros(1 << BITS), weights[-1:].astype(np.float64)
    step, rng = adam([w.shape, bias.shape]), np.random.Generator(np.random.PCG64(8))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            slots, sizes = np.concatenate([rows[k] for k in some]), np.array([len(rows[k]) for k in some])
            x = ratio[slots]
            owner = np.repeat(np.arange(len(some)), sizes)
            error = sigmoid(np.bincount(owner, w[slots] * x, len(some)) + bias[0]) - y[some]
            grad = np.bincount(slots, error[owner] * x, 1 << BITS) / len(some) + decay * w
            step([w, bias], [grad, np.array([error.mean()])], rate)
    weights[:-1], weights[-1] = w * ratio, bias[0]
    return weights.tobytes()


def score_texts(texts: pa.Array, model: bytes) -> np.ndarray:
    weights = np.frombuffer(model, np.float32).astype(np.float64)
    return sigmoid(np.array([weights[own].sum() for own in distinct_slots(texts)]) + weights[-1])


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Callable[[pa.Array], np.ndarray]:
    """A scorer of text arrays, fitted on at most ``sample_rows`` labelled documents outside the held-out fold."""
    model = fit_in_task(labelled_sample(docs, labels, "toxic", fold_of("doc_id", 5) != 0, sample_rows), fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB whatever the input
    return lambda texts: score_texts(texts, shared.value)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, threshold: float = 0.5) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    The model is fitted on at most ``sample_rows`` labelled documents whose crc32(doc_id) mod 5 is not 0; only the
    text is an input.  Null and empty texts get the score of the bias alone; repeated rows get a row each; other
    columns are ignored; without labels every score is close to 0; an empty table gives an empty result.
    """
    return score_documents(docs, fitted(docs, labels, sample_rows), threshold, fold_of("doc_id", 5) == 0)


def reject_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with all their columns as they are."""
    scorer = fitted(docs, labels, sample_rows)
    ship_package(docs.sparkSession)
    rows = packed(docs).withColumn("score", score_of(text_of("row.text"), scorer))
    return unpacked(rows.where(F.col("score") < threshold), docs.columns)
