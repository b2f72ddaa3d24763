"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions are low rank, ``sum_{i<j} <v_i, v_j> x_i x_j``, scored in time linear in the features with
``0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import flat_utf8, span_hash, spans
from tidemark.llm.training import adam, fit_in_task, fold_of, labelled_sample, score_documents, sigmoid

WORD_SLOTS = 2048
RANK = 8
CHUNK = 512
#: Bounds (upper ends) by which each statistic becomes one-hot bins; the last bin is open.
STATISTICS = {
    "chars": (0, 50, 200, 500, 1000, 2000, 5000, 20000),
    "words": (0, 10, 30, 100, 300, 1000, 3000),
    "lines": (1, 2, 4, 8, 16, 64, 256),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14),
    "symbol_share": (0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "digit_share": (0.0, 0.002, 0.01, 0.03, 0.1, 0.3),
    "upper_share": (0.0, 0.01, 0.02, 0.04, 0.08, 0.2, 0.5),
    "space_share": (0.05, 0.1, 0.13, 0.16, 0.2, 0.3),
    "point_share": (0.0, 0.005, 0.01, 0.02, 0.04, 0.08),
    "new_word_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "repeat_share": (0.0, 0.005, 0.02, 0.05, 0.1, 0.3),
    "new_line_share": (0.2, 0.5, 0.8, 0.95, 0.999),
    "high_byte_share": (0.0, 0.01, 0.03, 0.06, 0.12, 0.3),
}
SLOTS = WORD_SLOTS + sum(len(bounds) + 1 for bounds in STATISTICS.values())


def features(texts: pa.Array) -> np.ndarray:
    """A dense row of ``SLOTS`` features for each text: word weights of unit length, then one-hot statistics."""
    data, offsets = flat_utf8(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    # white space parts words; a document's end does so too
    part = (data == 32) | ((data >= 9) & (data <= 13))

    def distinct(of: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Distinct keys of each document."""
        if not len(of):
            return np.zeros(n)
        order = np.lexsort((key, of))
        new = np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (key[order][1:] != key[order][:-1])])
        return np.bincount(of[order][new], minlength=n)

    start, end, of = spans(~part, owner)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = span_hash(lower, start, end)
    line_start, line_end, line_of = spans(data != 10, owner)
    line = span_hash(data, line_start, line_end)
    words, lines = np.bincount(of, minlength=n), np.bincount(line_of, minlength=n)
    share = lambda mark, by: np.bincount(owner, mark, minlength=n) / np.maximum(by, 1)
    letter = ((lower >= 97) & (lower <= 122)) | (data >= 128)
    digit, point = (data >= 48) & (data <= 57), (data == 46) | (data == 44)
    upper = (data >= 65) & (data <= 90)
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (of[1:] == of[:-1])]) if len(word) else np.zeros(0, bool)
    statistic = {
        "chars": size, "words": words, "lines": lines,
        "word_length": share(~part, words), "symbol_share": share(~(letter | digit | point | part), size),
        "digit_share": share(digit, size), "upper_share": share(upper, size), "space_share": share(part, size),
        "point_share": share(point, size), "new_word_share": distinct(of, word) / np.maximum(words, 1),
        "repeat_share": np.bincount(of, same, minlength=n) / np.maximum(words, 1),
        "new_line_share": distinct(line_of, line) / np.maximum(lines, 1), "high_byte_share": share(data >= 128, size),
    }
    x = np.bincount(of * WORD_SLOTS + (word % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=n * WORD_SLOTS)
    x = np.log1p(x.reshape(n, WORD_SLOTS))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    columns = [x]
    for name, bounds in STATISTICS.items():
        bins = np.searchsorted(np.asarray(bounds, np.float64), statistic[name], side="left")
        columns.append(np.eye(len(bounds) + 1)[bins])
    return np.concatenate(columns, 1).astype(np.float32)


def margin(x: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output, and ``x @ v``."""
    inner = x @ v
    return bias + x @ w + 0.5 * ((inner ** 2).sum(1) - (x ** 2) @ (v ** 2).sum(1)), inner


def fit(texts: pa.Array, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> bytes:
    """w, v and bias as float64 bytes.  Without labels of both kinds, the bias alone gives their mean (0.5 without)."""
    rng = np.random.Generator(np.random.PCG64(9))
    good = y.mean() if len(y) else 0.5
    w, v, bias = np.zeros(SLOTS), rng.normal(0, 0.05, (SLOTS, RANK)), np.array([np.log((good + 1e-6) / (1 - good + 1e-6))])
    if not len(y) or not 0 < good < 1:
        return np.concatenate([w, 0 * v.ravel(), bias]).tobytes()
    x = np.concatenate([features(texts[i:i + CHUNK]) for i in range(0, len(texts), CHUNK)])
    step = adam([w.shape, v.shape, bias.shape])
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            own = x[some].astype(np.float64)
            z, inner = margin(own, w, v, bias[0])
            error = (sigmoid(z) - y[some]) / len(some)
            grad_v = own.T @ (error[:, None] * inner) - ((own ** 2).T @ error)[:, None] * v + decay * v
            step([w, v, bias], [own.T @ error + decay * w, grad_v, np.array([error.sum()])], rate / (1 + epoch))
    return np.concatenate([w, v.ravel(), bias]).tobytes()


def score_texts(texts: pa.Array, model: bytes) -> np.ndarray:
    values = np.frombuffer(model, np.float64).astype(np.float32)
    w, v, bias = values[:SLOTS], values[SLOTS:-1].reshape(SLOTS, RANK), values[-1]
    parts = [margin(features(texts[i:i + CHUNK]), w, v, bias)[0] for i in range(0, len(texts), CHUNK)]
    return sigmoid(np.concatenate([np.zeros(0), *parts]))


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Callable[[pa.Array], np.ndarray]:
    """A scorer of text arrays, fitted on at most ``sample_rows`` labelled documents outside the held-out fold."""
    model = fit_in_task(labelled_sample(docs, labels, "quality", fold_of("doc_id", 4) != 2, sample_rows), fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 160 KB whatever the input
    return lambda texts: score_texts(texts, shared.value)


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, threshold: float = 0.7) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    The machine is fitted on at most ``sample_rows`` labelled documents whose crc32(doc_id) mod 4 is not 2.  Metadata
    are the sizes of the text itself; labels, lang, source and doc_id are no inputs.  Null and empty texts have the
    features of an empty text; repeated rows get a row each; other columns are ignored; without labels every score
    is 0.5; an empty table gives an empty result.
    """
    return score_documents(docs, fitted(docs, labels, sample_rows), threshold, fold_of("doc_id", 4) == 2)
