"""External enrichment of *distinct missing* keys only, with calls that may fail (Q8).

The caller supplies ``fn(keys: pandas.Series) -> pandas.DataFrame`` with the
dictionary columns, one row per key in order (e.g. a model or service call).  It
runs inside ``mapInPandas`` on Arrow batches of distinct keys spread over the
cluster.  A call that raises, or gives another number of rows, is halved until the
failing keys stand alone; such a key is asked a bounded number of times and then
becomes a row with its error.  So one bad key costs neither the job nor the answers
of the others.  Answers are checkpointed once (task retries or a second use never
call the service again), empty answers and errors are not cached, and the dictionary
is folded with keep-last (M2) before the lookup (J1).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, work_dir
from .joins import lookup_fill, unmapped_keys
from .merge import accumulate_keep_last
from .quality import enrich_outcome

#: Times that a key which fails alone is asked.
ATTEMPTS = 3


def answers_or_errors(fn: Callable, keys, columns: Sequence[str], attempts: int = ATTEMPTS):
    """``fn``'s answers to a pandas Series of keys, with an ``error`` column: null, or why the key has no answer.

    At most 2 * n calls for n keys, and ``attempts`` for each key that fails alone.
    """
    import pandas as pd
    error = ""
    for _ in range(attempts if len(keys) == 1 else 1):
        try:
            got = fn(keys)
            if len(got) != len(keys):
                raise ValueError(f"{len(got)} answers to {len(keys)} keys")
            got = got.reset_index(drop=True).reindex(columns=list(columns))
            got["error"] = None
            return got
        except Exception as e:  # noqa: BLE001 - whatever a call raises is reported for its key
            error = f"{type(e).__name__}: {e}"
    if len(keys) == 1:
        return pd.DataFrame({**{c: [None] for c in columns}, "error": [error]})
    half = len(keys) // 2
    parts = [answers_or_errors(fn, keys.iloc[:half], columns, attempts), answers_or_errors(fn, keys.iloc[half:], columns, attempts)]
    return pd.concat(parts, ignore_index=True)


def ask_missing(df: DataFrame, key: str, dim: DataFrame, fn: Callable, dim_key: str = "work",
                values: Sequence[str] = ("keyword", "warning"), partitions: int | None = None,
                checkpoint: bool = True, attempts: int = ATTEMPTS) -> DataFrame:
    """One row per distinct unmapped key: ``(dim_key, *values, error, _seq)``; blank answers are null, without an error."""
    missing = unmapped_keys(df, key, dim, dim_key, order="_seq")
    schema = ", ".join([f"`{dim_key}` string"] + [f"`{v}` string" for v in values] + ["error string", "_seq long"])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            ans = answers_or_errors(fn, pdf["key"], values, attempts)
            ans.insert(0, dim_key, pdf["key"].to_numpy())
            ans["_seq"] = pdf["first_seen"].astype("int64").to_numpy()
            yield ans

    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    ship_package(df.sparkSession)
    asked = missing.repartition(n, "key").mapInPandas(run, schema)
    first = values[0]
    asked = asked.withColumn(first, F.when(F.trim(first) != "", F.col(first)))
    if checkpoint:
        work_dir(df.sparkSession)
        asked = asked.checkpoint(eager=True)
    return asked


def generate_missing(df: DataFrame, key: str, dim: DataFrame, fn: Callable, dim_key: str = "work",
                     values: Sequence[str] = ("keyword", "warning"), partitions: int | None = None,
                     checkpoint: bool = True) -> DataFrame:
    """Distinct unmapped keys -> ``fn`` -> non-empty answers ``(dim_key, *values, _seq)``."""
    asked = ask_missing(df, key, dim, fn, dim_key, values, partitions, checkpoint)
    return asked.filter(F.col(values[0]).isNotNull()).drop("error")


def enrich_reporting(df: DataFrame, key: str, dim: DataFrame, fn: Callable, dim_key: str = "work",
                     fill: dict[str, str] | None = None, order: Sequence[str] = ("_seq",),
                     partitions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(enriched rows, updated dictionary, outcome)``; the outcome (Q8) is one row: distinct keys asked, answered,
    failed (an error or a blank answer) and added, and the first error in key order."""
    fill = fill or {"risk_keywords": "keyword", "warning": "warning"}
    values = list(dict.fromkeys(fill.values()))
    asked = ask_missing(df, key, dim, fn, dim_key, values, partitions)
    gen = asked.filter(F.col(values[0]).isNotNull())
    base = dim.select(dim_key, *values, *order)
    new_dim = accumulate_keep_last(base, gen.select(dim_key, *values, *order), [dim_key],
                                   ("_batch", *order)).drop("_batch")
    return lookup_fill(df, key, new_dim, dim_key, fill, order), new_dim, enrich_outcome(asked, dim, dim_key, values[0], "error")


def enrich_missing(df: DataFrame, key: str, dim: DataFrame, fn: Callable, dim_key: str = "work",
                   fill: dict[str, str] | None = None, order: Sequence[str] = ("_seq",),
                   partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(enriched rows, updated dictionary)``."""
    return enrich_reporting(df, key, dim, fn, dim_key, fill, order, partitions)[:2]
