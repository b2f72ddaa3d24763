"""Join-shaped operators (J1..J11).

All joins are equi-joins.  Dimension sides are de-duplicated first and carry no hint: the planner
and AQE pick broadcast or sort-merge from sizes in bytes (``spark.sql.autoBroadcastJoinThreshold``),
and no job runs while a plan is built.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip


def dedup_dictionary(dim: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Dictionary rows: trimmed non-blank key; the last row per key (by ``order``) wins;
    null values become '' (D15)."""
    from .window import keep_last
    d = (dim.withColumn(key, strip(key)).filter(F.col(key).isNotNull() & (F.col(key) != ""))
         .select(key, *values, *order))
    d = keep_last(d, [key], order)
    return d.select(key, *[F.coalesce(F.col(v).cast("string"), F.lit("")).alias(v) for v in values])


def lookup_fill(df: DataFrame, key: str, dim: DataFrame, dim_key: str = "work",
                fill: Mapping[str, str] | None = None, order: Sequence[str] = ("_seq",),
                dedup: bool = True) -> DataFrame:
    """Left lookup on the trimmed key.

    On a hit the target columns are overwritten by the dictionary values; on a
    miss (or null/blank key) the existing values are kept (D16).
    ``fill`` maps target column -> dictionary column.
    """
    fill = dict(fill or {"risk_keywords": "keyword", "warning": "warning"})
    d = dedup_dictionary(dim, dim_key, list(dict.fromkeys(fill.values())), order) if dedup else dim
    d = d.select(F.col(dim_key).alias("_dk"), *[F.col(v).alias(f"_dv_{v}") for v in set(fill.values())])
    j = df.join(d, strip(F.col(key)) == F.col("_dk"), "left")
    hit = F.col("_dk").isNotNull()
    cols = {}
    for tgt, src in fill.items():
        old = F.col(tgt) if tgt in df.columns else F.lit(None).cast("string")
        cols[tgt] = F.when(hit, F.col(f"_dv_{src}")).otherwise(old)
    out = j.withColumns(cols)
    return out.select(*df.columns, *[c for c in fill if c not in df.columns])


def unmapped_keys(df: DataFrame, key: str, dim: DataFrame, dim_key: str = "work",
                  order: str | None = "_seq") -> DataFrame:
    """Distinct trimmed non-blank keys absent from the dictionary (left anti).

    With ``order`` the first-seen position is kept in column ``first_seen`` (U4).
    """
    k = strip(F.col(key))
    keys = df.select(k.alias("key"), *( [F.col(order).alias("_o")] if order else []))
    keys = keys.filter(F.col("key").isNotNull() & (F.col("key") != ""))
    keys = (keys.groupBy("key").agg(F.min("_o").alias("first_seen")) if order
            else keys.distinct())
    dk = dim.select(strip(F.col(dim_key)).alias("key")).distinct()
    return keys.join(dk, "key", "left_anti")


def not_in_keys(existing: DataFrame, new: DataFrame, key: str, new_key: str | None = None,
                as_text: bool = True) -> DataFrame:
    """Existing rows whose key (compared as text, null-safe) is absent from ``new``."""
    nk = new_key or key
    kcast = (lambda c: c.cast("string")) if as_text else (lambda c: c)
    keys = new.select(kcast(F.col(nk)).alias("_nk")).distinct()
    return existing.join(keys, kcast(F.col(key)).eqNullSafe(F.col("_nk")), "left_anti")


def restore_state(derived: DataFrame, existing: DataFrame, keys: Sequence[str],
                  state_cols: Sequence[str], order: Sequence[str] = ("_seq",)) -> DataFrame:
    """Per card key (null-safe) copy the state columns of the last existing row —
    even when they are null (D14).  Rows without a match keep their derived state.
    The row count never changes (existing is de-duplicated per key first)."""
    from .window import keep_last
    st = [c for c in state_cols if c in existing.columns]
    ex = keep_last(existing.select(*keys, *st, *order), list(keys), order)
    ex = ex.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_s_{c}") for c in st],
                   F.lit(True).alias("_hit"))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    j = derived.join(ex, cond, "left")
    hit = F.col("_hit").isNotNull()
    out = j.withColumns({c: F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in st})
    return out.select(*derived.columns)


def preserve_manual(derived: DataFrame, existing: DataFrame, keys: Sequence[str],
                    manual_col: str = "manual", defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Append existing manual rows (``manual = 'Y'``) whose key was not regenerated.
    Columns missing from the existing rows get ``defaults`` (else null). Always runs (D13)."""
    defaults = dict(defaults or {})
    if manual_col not in existing.columns:
        return derived
    manual = existing.filter(F.col(manual_col).cast("string") == "Y")
    dk = derived.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    keep = manual.join(dk, cond, "left_anti")
    keep = keep.select(*[(F.col(c) if c in existing.columns else defaults.get(c, F.lit(None))
                          ).cast(derived.schema[c].dataType).alias(c) for c in derived.columns])
    return derived.unionByName(keep)


def skip_done(new: DataFrame, existing: DataFrame, file_col: str,
              existing_file_col: str | None = None) -> DataFrame:
    """Only inputs whose file name is not yet in the stored table."""
    done = existing.select(F.col(existing_file_col or file_col).alias("_done")).distinct()
    return new.join(done, F.col(file_col) == F.col("_done"), "left_anti")


def tag_new_or_replaced(df: DataFrame, stored: DataFrame, key: str, out_col: str = "_tag",
                        stored_key: str | None = None) -> DataFrame:
    """J7: 'replace' when the key exists in the stored table, else 'new'."""
    sk = (stored.select(F.col(stored_key or key).cast("string").alias("_sk")).distinct()
          .withColumn("_hit", F.lit(True)))
    j = df.join(sk, F.col(key).cast("string").eqNullSafe(F.col("_sk")), "left")
    return (j.withColumn(out_col, F.when(F.col("_hit"), F.lit("replace")).otherwise(F.lit("new")))
            .drop("_sk", "_hit"))


def holiday_flags(days: DataFrame, holidays: DataFrame | None,
                  company_holidays: DataFrame | None, date_col: str = "date") -> DataFrame:
    """``is_holiday``/``holiday_name`` ('' when none) and ``is_company_holiday``."""
    out = days
    if holidays is not None:
        h = holidays.groupBy(F.col(date_col).alias("_hd")).agg(F.min("holiday_name").alias("_hn"))
        out = out.join(h, F.col(date_col) == F.col("_hd"), "left")
        out = out.withColumn("is_holiday", F.col("_hd").isNotNull()).withColumn(
            "holiday_name", F.coalesce(F.col("_hn"), F.lit(""))).drop("_hd", "_hn")
    else:
        out = out.withColumn("is_holiday", F.lit(False)).withColumn("holiday_name", F.lit(""))
    if company_holidays is not None:
        c = company_holidays.select(F.col(date_col).alias("_cd")).distinct()
        out = out.join(c, F.col(date_col) == F.col("_cd"), "left")
        out = out.withColumn("is_company_holiday", F.col("_cd").isNotNull()).drop("_cd")
    else:
        out = out.withColumn("is_company_holiday", F.lit(False))
    return out


def manifest_exists(files: DataFrame, archive: DataFrame, keys: Sequence[str],
                    out_col: str = "exists") -> DataFrame:
    """Flag files whose (section, name) already exists in the archive manifest."""
    a = archive.select(*[F.col(k).alias(f"_a_{k}") for k in keys]).distinct().withColumn("_ax", F.lit(True))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_a_{k}")
        cond = c if cond is None else cond & c
    j = files.join(a, cond, "left")
    return j.withColumn(out_col, F.coalesce(F.col("_ax"), F.lit(False))).drop(
        "_ax", *[f"_a_{k}" for k in keys])


def join_on_hull(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 how: str = "inner") -> DataFrame:
    """Join two curated tables on the hull key after canonicalisation.
    Null and blank keys match nothing."""
    from ..functions.scalars import ensure_sn
    l2 = left.withColumn("_hull", F.nullif(ensure_sn(F.col(left_key)), F.lit("")))
    r2 = right.withColumn("_hull_r", F.nullif(ensure_sn(F.col(right_key)), F.lit("")))
    return l2.join(r2, F.col("_hull") == F.col("_hull_r"), how).drop("_hull_r")
