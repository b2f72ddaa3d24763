"""Merge strategies (M1..M9): fold a load into a stored table.

Each merge is a lazy plan over (stored, load); the sink (``sources.curated``)
publishes the result atomically.  Stored rows carry ``_batch = 0`` and the
load ``_batch = 1``; ``_seq`` orders rows inside a batch.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ensure_sn
from .joins import not_in_keys, preserve_manual, restore_state, skip_done
from .schema import union_reconcile
from .window import keep_last

ORDER = ("_batch", "_seq")


def with_batch(df: DataFrame, batch: int, seq: Column | str | None = None) -> DataFrame:
    """Attach the order columns (``seq`` defaults to an existing ``_seq`` or 0)."""
    if seq is not None:
        df = df.withColumn("_seq", F.col(seq) if isinstance(seq, str) else seq)
    elif "_seq" not in df.columns:
        df = df.withColumn("_seq", F.lit(0).cast("long"))
    return df.withColumn("_batch", F.lit(batch))


def replace_by_key(existing: DataFrame, new: DataFrame, key: str = "PJT",
                   normalize: Callable[[Column], Column] | None = ensure_sn,
                   legacy_keys: Sequence[str] = ("호선",)) -> DataFrame:
    """M1: every key present in the load replaces all stored rows of that key.

    The load key is canonicalised first (N1); a legacy key name is renamed; when
    the key column is missing on either side the load is simply appended.
    Stored keys are compared as text, null-safe (J3).
    """
    for lk in legacy_keys:
        if key not in new.columns and lk in new.columns:
            new = new.withColumnRenamed(lk, key)
        if key not in existing.columns and lk in existing.columns:
            existing = existing.withColumnRenamed(lk, key)
    if key in new.columns and normalize is not None:
        new = new.withColumn(key, normalize(F.col(key)))
    if key not in new.columns or key not in existing.columns:
        return union_reconcile([with_batch(existing, 0), with_batch(new, 1)])
    kept = not_in_keys(existing, new, key)
    return union_reconcile([with_batch(kept, 0), with_batch(new, 1)])


def accumulate_keep_last(existing: DataFrame | None, new: DataFrame, keys: Sequence[str],
                         order: Sequence[str] = ORDER) -> DataFrame:
    """M2: union, then the last row per key wins; also de-duplicates inside the first load.
    History is never deleted.  Missing key columns -> no de-duplication (D24)."""
    parts = [with_batch(new, 1)] if existing is None else [with_batch(existing, 0), with_batch(new, 1)]
    merged = union_reconcile(parts)
    ks = [k for k in keys if k in merged.columns]
    return keep_last(merged, ks, order)


def upsert_by_key(existing: DataFrame, new: DataFrame, key: str = "forecast_date") -> DataFrame:
    """M3: delete-then-insert on ``key`` (sort on output only: ``orderBy(key)``)."""
    kept = existing.join(new.select(F.col(key).alias("_nk")).distinct(),
                         F.col(key).eqNullSafe(F.col("_nk")), "left_anti")
    return union_reconcile([with_batch(kept, 0), with_batch(new, 1)])


def full_replace(load: Callable[[], DataFrame], fallback: Callable[[], DataFrame],
                 write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool, str]:
    """M4: write the fresh source; if it fails, while it is opened or while its rows are written, the stored table stays.

    ``write`` stores a frame and returns the stored one (e.g. publishes it and reads it back), so the outcome is known from
    the finished write.  Returns (table, ok, error).
    """
    try:
        return write(load()), True, ""
    except Exception as e:  # noqa: BLE001 - keep-on-failure is the contract
        return fallback(), False, f"{type(e).__name__}: {e}"


# Assessment-card state columns, restored on re-derivation.
RA_STATE_COLS = ("ra_done", "ra_file", "excluded", "exclude_reason", "greeter_actual",
                 "greeter_actual_dept")
RA_CARD_KEYS = ("company", "period_start", "period_end", "work_content", "dept")
RA_MANUAL_DEFAULTS: Mapping[str, object] = {
    "is_commissioning": False, "ra_done": "N", "excluded": "N", "manual": "N"}


def rederive_preserving_state(derived: DataFrame, existing: DataFrame | None,
                              keys: Sequence[str] = RA_CARD_KEYS,
                              state_cols: Sequence[str] = RA_STATE_COLS,
                              order: Sequence[str] = ("_seq",)) -> DataFrame:
    """M5: restore the externally written state of re-derived cards (J4) and keep manual
    cards whose key was not regenerated (J5, always — D13)."""
    if existing is None:
        return derived
    defaults = {c: F.lit(RA_MANUAL_DEFAULTS.get(c, "")) for c in derived.columns}
    out = restore_state(derived, existing, keys, state_cols, order)
    return preserve_manual(out, existing, keys, "manual", defaults)


def append_unseen(existing: DataFrame | None, new_inputs: DataFrame, file_col: str,
                  process: Callable[[DataFrame], DataFrame], full: bool = False) -> DataFrame:
    """M6: only inputs whose file is not in the stored table are processed and appended.
    ``full=True`` rebuilds from all inputs (reference ``skip_existing=False``)."""
    if existing is None or full:
        return process(new_inputs)
    todo = skip_done(new_inputs, existing, file_col)
    return union_reconcile([existing, process(todo)])


def append_rows(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """M7: append."""
    return union_reconcile([existing, rows])


def delete_matching(existing: DataFrame, match: Mapping[str, object]) -> DataFrame:
    """M7: delete all rows equal (null-safe) on the given columns."""
    cond = F.lit(True)
    for c, v in match.items():
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return existing.filter(~cond)


def merge_report(existing: DataFrame | None, new: DataFrame, merged: DataFrame) -> DataFrame:
    """Dry-run counts in ONE aggregate over a tagged union (no join):
    before, load, after, kept, replaced = before + load - after (D4: rows, not keys)."""
    parts = [new.select(F.lit(1).alias("_t"), F.lit(None).cast("int").alias("_b")),
             merged.select(F.lit(2).alias("_t"), F.col("_batch").cast("int").alias("_b"))]
    if existing is not None:
        parts.append(existing.select(F.lit(0).alias("_t"), F.lit(None).cast("int").alias("_b")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    t, b = F.col("_t"), F.col("_b")
    out = u.agg(F.count_if(t == 0).alias("before_rows"), F.count_if(t == 1).alias("load_rows"),
                F.count_if(t == 2).alias("after_rows"), F.count_if((t == 2) & (b == 0)).alias("kept_rows"))
    return out.withColumn("replaced_rows", F.col("before_rows") + F.col("load_rows") - F.col("after_rows"))


def drop_order(df: DataFrame) -> DataFrame:
    """Remove the order columns before writing."""
    return df.drop("_batch", "_seq")
