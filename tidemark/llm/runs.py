"""Periodic runs of words: stretches that repeat with a period, and texts with the repeats collapsed.

For each period p the places that are multiples of p form a grid; a run of three periods or more holds three grid places in
a row, so places whose words agree with the next two are the only candidates, n / p of them for each p.  The extensions of
two neighbouring grid places, read from a run-length grammar of the texts, give the whole run.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, map_arrow, text_of
from tidemark.llm.recompress import Level, compressed, extension
from tidemark.llm.words import numbered_words

#: Grid places extended at once.
HITS = 1 << 14
#: Text of one grammar: bounds the working memory of a task; a longer text is a grammar of its own.
GRAMMAR_BYTES = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _extended(levels: list[Level], x: np.ndarray, p: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, end, period) rows of the long enough stretches around the places x and x + p."""
    start = x - extension(levels, x, x + p, False)
    end = x + p + extension(levels, x, x + p, True)
    found = np.stack([start, end, p], 1)[end - start >= np.maximum(least, times * p)]
    return np.unique(found, axis=0)


def runs_of(ids: np.ndarray, offsets: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of length max(least, times * period) or more, by text, start, period.

    ``times`` is at least 3.
    """
    size = np.diff(offsets)
    # longest texts first, so that the texts a period can occur in stand together at the front
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= max(least, times)]
    if not len(order):
        return (np.zeros(0, np.int64),) * 4
    longest = size[order]
    begin = np.concatenate([[0], np.cumsum(longest + 1)]) + 1
    line = np.empty(begin[-1], np.int64)
    line[begin - 1] = -1 - np.arange(len(begin))
    for k, d in enumerate(order.tolist()):
        line[begin[k]:begin[k] + longest[k]] = ids[offsets[d]:offsets[d + 1]]
    levels = compressed(line)
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, int]] = []
    known = np.zeros((3, len(line)), np.int32)  # start, end and period of a run found at each place

    def flush() -> None:
        if not waiting:
            return
        x = np.concatenate([w[0] for w in waiting])
        p = np.repeat(np.array([w[1] for w in waiting]), [len(w[0]) for w in waiting])
        waiting.clear()
        for s in range(0, len(x), HITS):
            rows = _extended(levels, x[s:s + HITS], p[s:s + HITS], least, times)
            found.append(rows)
            for start, end, period in rows.tolist():
                place = known[:, start:end]
                place[:, (place[1] - place[0]) < end - start] = np.array([[start], [end], [period]], np.int32)

    reach = np.searchsorted(-longest, -times * np.arange(longest[0] // times + 2), side="right")
    for p in range(1, int(longest[0]) // times + 1):
        grid = line[:begin[reach[p]]:p]
        hit = np.flatnonzero((grid[:-2] == grid[1:-1]) & (grid[1:-1] == grid[2:]))
        if len(hit):
            x = hit * p
            start, end, period = known[:, x]
            # inside a known run of a divisor of p the extension is that run again
            fresh = (period == 0) | (p % np.maximum(period, 1) != 0) | (end - start < p + period) | (x + p > end)
            if fresh.any():
                waiting.append((x[fresh], p))
                if sum(len(w[0]) for w in waiting) >= HITS:
                    flush()
    flush()
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    smallest = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]) if len(rows) else np.zeros(0, bool)
    start, end, period = rows[smallest].T  # of one stretch's periods the smallest
    at = np.searchsorted(begin, start, side="right") - 1
    text, start, length = order[at], start - begin[at], end - start
    by = np.lexsort([period, start, text])
    return text[by], start[by], length[by], period[by]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for each word that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] == 0


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period, by start and period) and the ``collapsed`` text.

    Words are runs of characters other than 0x20 and 0x09-0x0D.  A run is a stretch of words with smallest period q, at least
    max(``least``, ``times`` * q) words long, that no neighbouring word extends; runs may overlap.  ``collapsed`` holds the
    words that no run covers after its first period, joined by one space.  Null and empty texts, and texts without words,
    have no words and no runs, and collapse to the empty text; null ids and repeated rows are kept, one result a row; an
    empty table gives an empty result, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", GRAMMAR_BYTES):
            words, ids, offsets = numbered_words(batch.column("text"))
            text, *facts = runs_of(ids, offsets, least, times)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            collapsed = []
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = words[a:b]
                if cut[d + 1] > cut[d]:
                    keep = _kept(b - a, *(f[cut[d]:cut[d + 1]] for f in facts))
                    own = [own[k] for k in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(own))
            values = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in facts], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_arrow(texts, run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period (ties: smallest start, then period); null without runs."""
    def before(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(left != right, F.when(left > right, -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, before), 0)


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of which a tenth is made periodic.

    With h the crc32 of the decimal id (a null id counts as empty) and g = h div 10: if h % 10 = 0, each word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8); its words are joined by one space.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    base = base.withColumn("h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    g = F.floor(F.col("h") / 10)

    def again(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                                        lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # bound to a lambda's variable the words are split once, not once for each of them
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise("")), 0)
    return base.select("doc_id", F.when(F.col("h") % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Per document: n_runs, the strongest run, and sha256 of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("best", strongest(F.col("runs")))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
