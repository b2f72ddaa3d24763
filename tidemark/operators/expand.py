"""Row generators (E1..E5): one input row -> many output rows via ``explode``.

Generation is narrow (no shuffle); each output row depends only on its input
row, so expansion parallelises with the input partitions.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import calendar_parts, col_of, date_key, format_ntz

def _one_day():
    return F.expr("INTERVAL 1 DAY")


def expand_daily(df: DataFrame, start: str = "STDATE", end: str = "EDDATE",
                 key_col: str = "DATE", day_col: str | None = None) -> DataFrame:
    """One row per calendar day from start to end inclusive.

    Null start -> dropped; null or earlier end -> the start day only.  Adds the
    ``yy-MM-dd`` key (N12) in ``key_col`` and optionally the date in ``day_col``.
    The end is clamped before ``sequence`` (an inverted range would throw).
    """
    s = F.to_date(F.col(start))
    e = F.greatest(s, F.coalesce(F.to_date(F.col(end)), s))
    # A null start yields a null array, which explode drops — no separate Filter,
    # so Catalyst never pushes a predicate that re-evaluates the start expression.
    out = df.withColumn("_day", F.explode(F.sequence(s, e, _one_day())))
    out = out.withColumn(key_col, date_key("_day"))
    if day_col:
        out = out.withColumnRenamed("_day", day_col)
    else:
        out = out.drop("_day")
    return out


def periods_expr(start: Column | str, end: Column | str, max_days: int = 7,
                 min_days: int = 2) -> Column:
    """E2 as an array expression: consecutive chunks of at most ``max_days`` days;
    chunks shorter than ``min_days`` are dropped; when nothing remains (or the
    range is one day / inverted) the whole interval is the single period (D6)."""
    s, e = F.to_date(col_of(start)), F.to_date(col_of(end))
    n = F.datediff(e, s) + 1
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / max_days).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(F.date_add(s, i * max_days).alias("period_start"),
                           F.least(F.date_add(s, i * max_days + (max_days - 1)), e).alias("period_end")))
    kept = F.filter(chunks, lambda p: F.datediff(p["period_end"], p["period_start"]) + 1 >= min_days)
    whole = F.array(F.struct(s.alias("period_start"), e.alias("period_end")))
    return F.when((n <= 1) | (F.size(kept) == 0), whole).otherwise(kept)


def split_periods(df: DataFrame, start: str = "visit_start", end: str = "visit_end",
                  max_days: int = 7, min_days: int = 2) -> DataFrame:
    """Explode the periods into ``period_start`` / ``period_end`` (dates)."""
    return (df.withColumn("_p", F.explode(periods_expr(start, end, max_days, min_days)))
            .withColumn("period_start", F.col("_p.period_start"))
            .withColumn("period_end", F.col("_p.period_end")).drop("_p"))


def calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None,
             company_holidays: DataFrame | None = None) -> DataFrame:
    """Dense daily calendar ``[start, end]`` with holiday flags.

    ``holidays(date, holiday_name)`` and ``company_holidays(date)`` are joined
    left; the business-day flag is not(weekend or holiday or company holiday).
    Days come from ``spark.range`` so the calendar is generated in parallel.
    """
    n = spark.sql(f"SELECT datediff(DATE'{end}', DATE'{start}') AS n").head()[0]
    days = spark.range(0, max(n, -1) + 1).select(
        F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int")).alias("date"))
    return calendar_from_days(days, holidays, company_holidays)


def calendar_from_days(days: DataFrame, holidays: DataFrame | None = None,
                       company_holidays: DataFrame | None = None) -> DataFrame:
    """E3 over an existing ``date`` column (one row per day)."""
    from .joins import holiday_flags
    parts = calendar_parts("date")
    out = days.select("date", *[v.alias(k) for k, v in parts.items()])
    out = holiday_flags(out, holidays, company_holidays)
    return out.withColumn("is_business_day",
                          ~(F.col("is_weekend") | F.col("is_holiday") | F.col("is_company_holiday")))


def explode_items(df: DataFrame, items: Column, default: Column, seq_col: str = "seq",
                  item_col: str = "item") -> DataFrame:
    """Explode an array of items with a one-row fallback; ``seq`` counts from 1."""
    arr = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(F.array(default))
    return (df.select("*", F.posexplode(arr).alias("_pos", item_col))
            .withColumn(seq_col, (F.col("_pos") + 1).cast("int")).drop("_pos"))


def split_multi(df: DataFrame, col: str, out_col: str | None = None, sep: str = ",") -> DataFrame:
    """E5: comma list -> one trimmed part per row."""
    return df.withColumn(out_col or col, F.explode(F.transform(F.split(F.col(col), sep), lambda x: F.trim(x))))


def split_multi_array(c: Column | str, sep: str = ",") -> Column:
    """E5 as an array expression."""
    return F.transform(F.split(col_of(c), sep), lambda x: F.trim(x))


__all__: Sequence[str] = ["expand_daily", "periods_expr", "split_periods", "calendar",
                          "calendar_from_days", "explode_items", "split_multi", "split_multi_array"]


# Fixed-date public holidays (MM-dd, name) and company closing days (MM-dd).  A rule
# table, not a calendar library: movable feasts are supplied as an explicit holiday table.
FIXED_HOLIDAYS = (("01-01", "신정"), ("03-01", "삼일절"), ("05-05", "어린이날"), ("06-06", "현충일"),
                  ("08-15", "광복절"), ("10-03", "개천절"), ("10-09", "한글날"), ("12-25", "성탄절"))
COMPANY_HOLIDAYS = ("05-01", "12-31")


def fixed_date_holidays(days: DataFrame, rules=FIXED_HOLIDAYS) -> DataFrame:
    """Holiday table ``(date, holiday_name)`` for the given days from (MM-dd, name) rules."""
    r = days.sparkSession.createDataFrame(list(rules), "md string, holiday_name string")
    return days.join(F.broadcast(r), format_ntz("date", "MM-dd") == F.col("md")).select("date", "holiday_name")


def fixed_date_company(days: DataFrame, rules=COMPANY_HOLIDAYS) -> DataFrame:
    """Company holiday table ``(date)`` from MM-dd rules."""
    return days.filter(format_ntz("date", "MM-dd").isin(*rules)).select("date")


def days_between(df: DataFrame, date_col: str) -> DataFrame:
    """One row per day from min to max of ``date_col`` (span bounded by the calendar, not the rows)."""
    span = df.agg(F.min(F.to_date(date_col)).alias("s"), F.max(F.to_date(date_col)).alias("e"))
    return span.select(F.explode(F.sequence("s", "e", _one_day())).alias("date"))
