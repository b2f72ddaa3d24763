"""Mixing sources to target weights by iterative proportional fitting (raking).

Token weights are summed once over the corpus into cells of the given dimensions.  A cell's categories are those named
by the targets and one for the rest, so the number of cells is bounded by the targets, not by the data.  The fit runs
over those cells; each document is then kept with its cell's calibrated probability.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, text_of, unpacked

REST = "(rest)"
ROUNDS = 40
#: Times that the cells which can give their part are fitted again, at most; what is then still missing stays missing.
REFITS = 8
SEED = "mix-1"


def token_estimate(text: Column) -> Column:
    """Words parted by single blanks or line ends; 0 for an empty text."""
    gaps = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s)))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(gaps(" ") + gaps("\n") + 1).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the text: listing, note, article or longform."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    tokens = token_estimate(text)
    return (F.when(lines >= 10, "listing").when(tokens < 100, "note").when(tokens < 600, "article").otherwise("longform"))


def category(column: Column, target: dict[str, float]) -> Column:
    """The value if the targets name it, else ``REST``; null is in the rest."""
    return F.when(column.isin(*target), column).otherwise(F.lit(REST))


def rake(weights: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Fit a table of cell weights to the marginals of each axis, one axis after another.

    Categories without weight get none; their share goes to the others of their axis in proportion.
    """
    fitted = weights / max(weights.sum(), 1e-300)
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            now = fitted.sum(axis=tuple(a for a in range(fitted.ndim) if a != axis))
            share = np.where(now > 0, target, 0.0)
            share = share / max(share.sum(), 1e-300)
            factor = np.divide(share, now, out=np.zeros_like(now), where=now > 0)
            fitted = fitted * factor.reshape([-1 if a == axis else 1 for a in range(fitted.ndim)])
    return fitted


def shares_of(target: dict[str, float], rest: float = 0.0) -> np.ndarray:
    """The named shares and that of the rest: what they leave to 1, but ``rest`` at least, taken from all in proportion."""
    named = np.array([*target.values()])
    left = max(0.0, 1.0 - sum(target.values()))
    return np.array([*named, left]) if left >= rest else np.array([*(named * (1 - rest) / named.sum()), rest])


def calibrated(table: np.ndarray, targets: list[np.ndarray], size: float | None = None) -> np.ndarray:
    """The probability of each cell, proportional to fitted over present weight; 1 for cells without weight.

    Without ``size`` the largest ratio becomes 1, however small its cell.  ``size`` is the part of all weight to be kept:
    cells that cannot give their part of it are kept whole, and the others are fitted again to what is then missing of
    each share, until every cell can give its part (REFITS times at most).
    """
    fitted = rake(table, targets)
    ratio = np.divide(fitted, table, out=np.zeros_like(fitted), where=table > 0)
    if size is None:
        return np.where(table > 0, ratio / max(ratio.max(initial=0.0), 1e-300), 1.0)
    wanted = size * table.sum()
    kept, whole = fitted * wanted, np.zeros(table.shape, bool)
    for _ in range(REFITS):
        over = ~whole & (kept > table * (1 + 1e-9))
        if not over.any():
            break
        whole |= over
        given = np.where(whole, table, 0.0)
        missing = [np.maximum(0.0, wanted * t - given.sum(axis=tuple(a for a in range(table.ndim) if a != axis)))
                   for axis, t in enumerate(targets)]
        kept = given + rake(np.where(whole, 0.0, table), missing) * max(0.0, wanted - given.sum())
    return np.where(table > 0, np.minimum(1.0, np.divide(kept, table, out=np.zeros_like(kept), where=table > 0)), 1.0)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone: 52 bits of an MD5; null ids share one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_probability(docs: DataFrame, targets: dict[str, dict[str, float]], size: float | None = None,
                     rest: float = 0.0) -> DataFrame:
    """``row`` (the document), ``topic``, ``n_tokens``, ``probability`` and ``kept``.

    ``targets`` gives shares of the tokens for each of source, lang and topic; what they leave to 1, but ``rest``
    at least, is the share of the rest.  Probabilities are proportional to fitted over present weight in each cell, the largest being 1, so the
    expected token shares are the fitted ones; with ``size``, the part of all tokens to keep, scarce cells are kept whole
    instead of setting the scale (:func:`calibrated`).  Documents without tokens have the probability of their cell, 1 if the
    cell has no tokens at all.  A null source or lang belongs to the rest; without ``size`` or ``rest`` the rest may get the
    probability 0 (targets that sum to 1) or nearly empty the sample (a tiny cell with a share of its own).  Repeated ids are decided alike; an empty
    table gives an empty result.
    """
    names = list(targets)
    base = packed(docs).withColumn("text", text_of("row.text"))
    base = base.select("row", F.col("row.doc_id").alias("doc_id"), topic_of(F.col("text")).alias("topic"),
                       token_estimate(F.col("text")).alias("n_tokens"))
    value = {"source": F.col("row.source"), "lang": F.col("row.lang"), "topic": F.col("topic")}
    base = base.select("*", *[category(value[n], targets[n]).alias(f"cell_{n}") for n in names])
    cells = [f"cell_{n}" for n in names]
    kinds = [[*targets[n], REST] for n in names]
    table = np.zeros([len(k) for k in kinds])
    # at most the product of the target sizes
    for r in base.groupBy(*cells).agg(F.sum("n_tokens").alias("w")).collect():
        table[tuple(k.index(r[c]) for k, c in zip(kinds, cells))] = r["w"]
    probability = calibrated(table, [shares_of(targets[n], rest) for n in names], size)
    spark = docs.sparkSession
    rows = [(*(kinds[a][i] for a, i in enumerate(at)), round(float(p), 9)) for at, p in np.ndenumerate(probability)]
    known = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cells) + ", probability double")
    joined = base.join(F.broadcast(known), cells)  # as many rows as cells
    return joined.select("row", "doc_id", "topic", "n_tokens", "probability",
                         (uniform(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample_mixture(docs: DataFrame, targets: dict[str, dict[str, float]], size: float | None = None,
                   rest: float = 0.0) -> DataFrame:
    """The documents kept, with all their columns as they are."""
    return unpacked(with_probability(docs, targets, size, rest).where("kept"), docs.columns)


def mixture_sql(targets: dict[str, dict[str, float]], size: float, rest: float, documents: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB SQL for doc_id, source, lang, topic, n_tokens, probability, kept.

    One recursive table over the cells: each step fits one axis; after ``rounds`` of them the cells that cannot give their
    part are marked whole and the fit of the others starts again.
    """
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cell = lambda n: f"CASE WHEN {n} IN ({', '.join(map(quoted, targets[n]))}) THEN {n} ELSE '{REST}' END AS cell_{n}"
    names = list(targets)
    cells = ", ".join(f"cell_{n}" for n in names)
    shares = ", ".join(f"({i}, {quoted(v)}, {float(x)!r}::DOUBLE)" for i, n in enumerate(names) for v, x in zip([*targets[n], REST], shares_of(targets[n], rest)))
    axis = f"step % {len(names)}"
    value = f"CASE {axis} " + " ".join(f"WHEN {i} THEN cell_{n}" for i, n in enumerate(names)) + " END"
    fits = len(names) * rounds
    return f"""
WITH RECURSIVE base AS (
  SELECT *, CASE WHEN n_lines >= 10 THEN 'listing' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 600 THEN 'article' ELSE 'longform' END AS topic
  FROM (SELECT *, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE 2 * length(t) - length(replace(t, ' ', '')) - length(replace(t, chr(10), '')) + 1 END AS BIGINT) AS n_tokens,
               length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines
        FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM {documents}))),
marked AS (SELECT *, {', '.join(map(cell, names))} FROM base),
cells AS (SELECT {cells}, CAST(sum(n_tokens) AS DOUBLE) AS w FROM marked GROUP BY ALL),
want(axis, v, share) AS (VALUES {shares}),
fit AS (
  SELECT {cells}, w, w / greatest(sum(w) OVER (), 1e-300) AS f, false AS whole, 0.0::DOUBLE AS kept, 0 AS step, 0 AS turn,
         {size!r}::DOUBLE * sum(w) OVER () AS wanted FROM cells
  UNION ALL
  SELECT {cells}, w,
    CASE WHEN step < {fits} THEN CASE WHEN now > 0 THEN f * (lack / greatest(all_lack, 1e-300)) / now ELSE 0 END
         ELSE CASE WHEN whole OR over THEN 0 ELSE w END / greatest(sum(CASE WHEN whole OR over THEN 0 ELSE w END) OVER (), 1e-300) END AS f,
    CASE WHEN step < {fits} THEN whole ELSE whole OR over END AS whole, CASE WHEN step < {fits} THEN kept ELSE part END AS kept,
    CASE WHEN step < {fits} THEN step + 1 ELSE 0 END AS step, CASE WHEN step < {fits} THEN turn ELSE turn + 1 END AS turn, wanted
  FROM (SELECT *, sum(lack / n) OVER () AS all_lack, NOT whole AND part > w * (1 + 1e-9) AS over
        FROM (SELECT x.*, CASE WHEN now > 0 THEN greatest(0, CASE WHEN turn = 0 THEN share ELSE wanted * share - given END) ELSE 0 END AS lack,
                     CASE WHEN whole THEN w ELSE 0 END + f * greatest(0, wanted - all_given) AS part
              FROM (SELECT *, {axis} AS axis, {value} AS v, sum(f) OVER c AS now, count(*) OVER c AS n,
                           sum(CASE WHEN whole THEN w ELSE 0 END) OVER c AS given, sum(CASE WHEN whole THEN w ELSE 0 END) OVER () AS all_given
                    FROM fit WHERE turn <= {REFITS} WINDOW c AS (PARTITION BY {value})) x
              JOIN want ON want.axis = x.axis AND want.v = x.v) y) z),
chance AS (SELECT {cells}, CASE WHEN w > 0 THEN round(least(1, kept / w), 9) ELSE 1.0 END AS probability FROM fit WHERE turn = {REFITS + 1} AND step = 0)
SELECT doc_id, source, lang, topic, n_tokens, probability,
       CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < probability AS kept
FROM marked JOIN chance USING ({cells})"""
