"""Row filters / predicates (F1..F11) as ``DataFrame -> DataFrame`` or ``Column``.

Plain column predicates, so Catalyst pushes them into the scan or below
``Generate`` (expansion) and joins.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col_of, contains_any, strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
# Key prefixes of subtotal rows (case-insensitive).
SUBTOTAL_PREFIXES = ("합계", "소계", "계", "total", "sum")
# Departments that count as commissioning (substring match).
COMMISSIONING_DEPTS = ("시운전1부", "시운전2부", "시운전3부", "안벽의장", "시운전팀", "해운부",
                       "해운1과", "해운2과", "친환경실증", "시운전과", "시운전기술", "LNG설비운영")
# Departments kept when loading visits (substring match).
VISIT_DEPT_FILTER = ("시운전팀", "시운전", "기장운전", "전장운전", "선장운전", "CSU", "친환경실증",
                     "해운", "해운1과", "해운2과", "시운전기술", "LNG설비운영")


def keep_equal_trimmed(df: DataFrame, col: str, value: str) -> DataFrame:
    """``trim(col) = value`` (applied before expansion and lookups)."""
    return df.filter(strip(col) == F.lit(value))


def contains_any_pred(c: Column | str, tokens: Sequence[str]) -> Column:
    """null -> false; literal substring of any token."""
    return contains_any(c, tokens)


def keep_contains_any(df: DataFrame, col: str, tokens: Sequence[str]) -> DataFrame:
    """keep rows whose column contains a token; no-op when the column is absent."""
    if col not in df.columns:
        return df
    return df.filter(contains_any(col, tokens))


def not_prefix(c: Column | str, prefixes: Sequence[str] = SUBTOTAL_PREFIXES) -> Column:
    """text does not start with any prefix (case-insensitive); null -> true."""
    rx = "(?i)^(" + "|".join(re.escape(p) for p in prefixes) + ")"
    return ~F.coalesce(col_of(c).rlike(rx), F.lit(False))


def not_null_not_blank(c: Column | str) -> Column:
    """F5."""
    c = col_of(c)
    return c.isNotNull() & (strip(c) != "")


def min_year(c: Column | str, year: int = 2000) -> Column:
    """year (already coerced to int, N7) at least ``year``."""
    return col_of(c) >= F.lit(year)


def drop_null_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F8: drop rows lacking any of the given time columns (start; start and end for visits)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def retention_cutoff(c: Column | str, as_of: str, years: int = 3) -> Column:
    """keep ``c >= as_of - 365*years days`` (D27: 365-day years; D29: clock is a parameter)."""
    return col_of(c) >= F.date_sub(F.to_date(F.lit(as_of)), 365 * years)


def search_any(cols: Sequence[str], q: str) -> Column:
    """case-insensitive *literal* substring in any of the columns."""
    needle = F.lit(q.lower())
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False))
    return cond


def equal_null_safe(cols: dict[str, object]) -> Column:
    """equality on several columns, null-safe."""
    cond = F.lit(True)
    for c, v in cols.items():
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return cond


def all_of(*preds: Column | None) -> Column:
    """conjunction of the optional predicates that are given."""
    cond = F.lit(True)
    for p in preds:
        if p is not None:
            cond = cond & p
    return cond


#: Recency classes that a period of so many days lets pass: a class is known by its longest age (1, 7 and more days).
PERIOD_CLASSES = {"today": ("new",), "7 days": ("new", "mid"), "30 days": ("new", "mid")}


def catalog_filter(has_key: bool = False, recency: Sequence[str] = (), period: str | None = None, check: bool = False,
                   search: str = "", searched: Sequence[str] = ("table",)) -> Column:
    """the filter that the given options make over catalog rows (``keys``, ``recency``, ``status`` and text columns).

    ``has_key``: tables with keys.  ``recency``: these classes.  ``period``: one of PERIOD_CLASSES.  ``check``: tables that need
    a look, empty or unreadable.  ``search``: literal text, any case, in the joined ``searched`` columns.
    """
    text = F.lower(F.concat_ws("", *[F.col(c) for c in searched]))
    wanted = search.strip().lower()
    return all_of(F.coalesce(F.col("keys"), F.lit(0)) > 0 if has_key else None,
                  F.col("recency").isin(*recency) if recency else None,
                  F.col("recency").isin(*PERIOD_CLASSES[period]) if period else None,
                  F.col("status").isin("warn", "empty") if check else None,
                  F.contains(text, F.lit(wanted)) if wanted else None)
