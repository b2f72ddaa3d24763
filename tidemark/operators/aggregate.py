"""Aggregations (A1..A16).

Everything is a single ``groupBy().agg()`` of built-in aggregates so Spark can
run partial (map-side) aggregation before the shuffle.  Order-sensitive
aggregates use ``min_by``/``max_by`` over explicit order columns.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import code_label, col_of, compass16, round_half_even, strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
PTY_LABELS = {"0": "없음", "1": "비", "2": "비/눈", "3": "눈", "4": "소나기", "5": "빗방울",
              "6": "빗방울/눈날림", "7": "눈날림"}
SKY_LABELS = {"1": "맑음", "3": "구름많음", "4": "흐림"}
# Text shown for an empty value in value reports.
EMPTY_LABEL = "(빈값)"


def join_unique(df: DataFrame, keys: Sequence[str], value: str, order: str = "_seq",
                out_col: str | None = None, sep: str = ", ") -> DataFrame:
    """A2: distinct non-blank values (not 'nan') per key in first-seen order, joined by ``sep``.

    Two steps so a huge group never materialises its raw rows: first one row
    per (key, value) with its first position (partial aggregation), then a
    sorted ``collect_list`` of the *distinct* values only.
    """
    v = F.col(value).cast("string")
    step1 = (df.filter(v.isNotNull() & (v != "") & (v != "nan"))
             .groupBy(*keys, value).agg(F.min(order).alias("_first")))
    return step1.groupBy(*keys).agg(F.concat_ws(sep, F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("_first"), F.col(value).cast("string").alias("v")))),
        lambda x: x["v"])).alias(out_col or value))


def group_cards(df: DataFrame, keys: Sequence[str], order: str = "_seq",
                joined: Sequence[str] = ("name", "phone"), first: Sequence[str] = (),
                last: Sequence[str] = (), any_true: Sequence[str] = (), sep: str = ", ") -> DataFrame:
    """A1: one card per key in two aggregation steps and no join.

    * ``joined``: distinct non-blank values (not 'nan') in first-seen order (A2);
    * ``first``/``last``: first / last non-null value in order (pandas semantics);
    * ``any_true``: any() of a boolean column.

    Every row is stacked into one record per joined column plus one ``_base``
    record.  Step 1 groups by (keys, column, value) — partial aggregation
    collapses repeated values map-side, and the ``_base`` group carries the
    order-sensitive aggregates.  Step 2 groups by the keys and only ever
    collects the *distinct* values of a card, never its raw rows.
    """
    keys = list(keys)
    recs = [F.struct(F.lit(c).alias("_f"), F.col(c).cast("string").alias("_v")) for c in joined]
    recs.append(F.struct(F.lit("_base").alias("_f"), F.lit(None).cast("string").alias("_v")))
    vals = list(dict.fromkeys([*first, *last, *any_true]))
    long = df.select(*keys, F.col(order).alias("_o"), *vals, F.inline(F.array(*recs)))
    is_base = F.col("_f") == "_base"
    v = F.col("_v")
    long = long.filter(is_base | (v.isNotNull() & (v != "") & (v != "nan")))
    step1 = long.groupBy(*keys, "_f", "_v").agg(
        F.min("_o").alias("_first"),
        *[F.min_by(F.col(c), F.when(is_base & F.col(c).isNotNull(), F.col("_o"))).alias(f"_a_{c}")
          for c in first],
        *[F.max_by(F.col(c), F.when(is_base & F.col(c).isNotNull(), F.col("_o"))).alias(f"_z_{c}")
          for c in last],
        *[F.bool_or(F.when(is_base, F.col(c))).alias(f"_y_{c}") for c in any_true])
    base_rank = is_base.cast("int")
    step2 = step1.groupBy(*keys).agg(
        *[F.concat_ws(sep, F.transform(F.array_sort(F.collect_list(
            F.when(F.col("_f") == c, F.struct(F.col("_first"), F.col("_v"))))), lambda x: x["_v"])).alias(c)
          for c in joined],
        *[F.max_by(F.col(f"_a_{c}"), base_rank).alias(c) for c in first],
        *[F.max_by(F.col(f"_z_{c}"), base_rank).alias(c) for c in last],
        *[F.coalesce(F.max_by(F.col(f"_y_{c}"), base_rank), F.lit(False)).alias(c) for c in any_true])
    return step2


def mode_of(c: Column | str) -> Column:
    """A4: most frequent value; ties -> the smallest."""
    return F.mode(col_of(c), deterministic=True)


def daily_forecast(feed: DataFrame, date_col: str = "fcst_date", cat_col: str = "category",
                   val_col: str = "value", order: str = "_seq") -> DataFrame:
    """A3: long forecast feed -> one row per date (conditional aggregates, one shuffle).

    TMP min/max/avg (TMN/TMX: last value, used when the day has no TMP), POP max,
    PTY mode without '0' (default '0'), SKY mode (default '1'), WSD avg/max, WAV
    max, VEC mean -> degrees and 16-point label.  Averages are rounded half-even
    to one decimal, as the reference does.
    """
    cat = F.col(cat_col)
    raw = F.col(val_col).cast("string")
    num = strip(raw).try_cast("double")

    def on(c: str, x: Column = num) -> Column:
        return F.when((cat == c) & x.isNotNull(), x)

    pty = F.when((cat == "PTY") & (raw != "0"), raw)
    sky = F.when(cat == "SKY", raw)
    g = feed.groupBy(F.col(date_col).alias("forecast_date")).agg(
        F.min(on("TMP")).alias("_tmin"), F.max(on("TMP")).alias("_tmax"), F.avg(on("TMP")).alias("_tavg"),
        F.max_by(num, F.when((cat == "TMN") & num.isNotNull(), F.col(order))).alias("_tmn"),
        F.max_by(num, F.when((cat == "TMX") & num.isNotNull(), F.col(order))).alias("_tmx"),
        F.max(on("POP")).alias("pop_max"),
        F.mode(pty, deterministic=True).alias("_pty"), F.mode(sky, deterministic=True).alias("_sky"),
        F.avg(on("WSD")).alias("_wavg"), F.max(on("WSD")).alias("wsd_max"),
        F.max(on("WAV")).alias("wav_height"), F.avg(on("VEC")).alias("_vec"))
    pty_code = F.coalesce(F.col("_pty"), F.lit("0"))
    sky_code = F.coalesce(F.col("_sky"), F.lit("1"))
    return g.select(
        "forecast_date",
        F.coalesce(F.col("_tmin"), F.when(F.col("_tavg").isNull(), F.col("_tmn"))).alias("tmp_min"),
        F.coalesce(F.col("_tmax"), F.when(F.col("_tavg").isNull(), F.col("_tmx"))).alias("tmp_max"),
        round_half_even(F.col("_tavg"), 1).alias("tmp_avg"),
        "pop_max",
        pty_code.alias("pty_code"), code_label(pty_code, PTY_LABELS).alias("pty_label"),
        sky_code.alias("sky_code"), code_label(sky_code, SKY_LABELS).alias("sky_label"),
        round_half_even(F.col("_wavg"), 1).alias("wsd_avg"), "wsd_max", "wav_height",
        round_half_even(F.col("_vec"), 1).alias("vec_deg"), compass16(F.col("_vec")).alias("vec_dir"))


def value_counts(df: DataFrame, col: str, blank_label: str | None = EMPTY_LABEL) -> DataFrame:
    """Count per stripped value (as text; blanks labelled)."""
    v = strip(F.col(col).cast("string"))
    if blank_label is not None:
        v = F.when(v.isNull() | v.isin("", "None", "nan"), F.lit(blank_label)).otherwise(v)
    return df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_n_values(df: DataFrame, col: str, n: int = 5, blank_label: str | None = EMPTY_LABEL) -> DataFrame:
    """The ``n`` most frequent values (ties by value).  The limit is the feature."""
    return value_counts(df, col, blank_label).orderBy(F.col("n").desc(), F.col("value")).limit(n)


def filled_ratios(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Non-null share of each column, one aggregate pass, long format (column, filled, rows, ratio)."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_f{i}")
                                                   for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', _f{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {stack}) as (column, filled)", "_n as rows").withColumn(
        "ratio", F.when(F.col("rows") > 0, F.col("filled") / F.col("rows")))


def count_true(c: Column | str) -> Column:
    """A10."""
    return F.count_if(col_of(c))


def convertible_columns(df: DataFrame, candidates: Sequence[str], convert,
                        max_loss: float = 0.5) -> DataFrame:
    """Per candidate column, non-null count before and after conversion in ONE aggregate;
    ``ok`` when at most ``max_loss`` of the non-null values are lost."""
    aggs = []
    for i, c in enumerate(candidates):
        aggs += [F.count(F.col(f"`{c}`")).alias(f"b{i}"), F.count(convert(F.col(f"`{c}`"))).alias(f"a{i}")]
    a = df.agg(*aggs)
    stack = ", ".join(f"'{c}', b{i}, a{i}" for i, c in enumerate(candidates))
    return (a.selectExpr(f"stack({len(candidates)}, {stack}) as (column, before, after)")
            .withColumn("ok", (F.col("before") > 0) &
                        ((F.col("before") - F.col("after")) <= F.col("before") * max_loss)))


def any_match_columns(cols: Sequence[str], pattern: str) -> list[Column]:
    """A13 as aggregate expressions, named like the columns: does any non-null value match ``pattern``?"""
    return [F.coalesce(F.bool_or(F.col(f"`{c}`").cast("string").rlike(pattern)), F.lit(False)).alias(c) for c in cols]


def any_match(df: DataFrame, cols: Sequence[str], pattern: str) -> DataFrame:
    """For every column, does any non-null value match ``pattern``? (one aggregate)."""
    return df.agg(*any_match_columns(cols, pattern))


def result_summary(results: DataFrame, status: str = "status") -> DataFrame:
    """Ok / failed / skipped counts."""
    s = F.col(status)
    return results.agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "failed").alias("failed"),
                       F.count_if(s == "skipped").alias("skipped"))


def category_counts(items: DataFrame, categories: DataFrame, cat: str = "category") -> DataFrame:
    """Items per category including empty categories (left join from the category list)."""
    c = items.groupBy(cat).agg(F.count(F.lit(1)).alias("n"))
    return categories.join(c, cat, "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))


def mixed_text_columns(cols: Sequence[str]) -> list[Column]:
    """A16 (value side) as aggregate expressions, named like the columns."""
    def mixed(c: str) -> Column:
        isnum = F.when(F.col(f"`{c}`").isNotNull(), strip(F.col(f"`{c}`")).try_cast("double").isNotNull()).cast("int")
        return F.coalesce(F.max(isnum) != F.min(isnum), F.lit(False)).alias(c)
    return [mixed(c) for c in cols]


def mixed_text_probe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A16 (value side): text column holding both numeric-looking and other values."""
    return df.agg(*mixed_text_columns(cols))
