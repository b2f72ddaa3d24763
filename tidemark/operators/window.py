"""Ordering-dependent operators (W1..W4), sorts/limits (O1..O3) and set ops.

Spark has no row order, so every "first/last" takes explicit order columns
(convention: ``_batch`` 0 = stored table, 1 = this load; ``_seq`` inside it).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("_batch", "_seq")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """The last row per key (nulls compare equal) by the order columns.

    Implemented as ``groupBy(keys).agg(max_by(struct(row), struct(order)))``:
    an aggregate with map-side partial combine, so a hot key is collapsed in
    every map task before the shuffle instead of being sorted in one task as a
    ``row_number`` window would.  No keys -> no de-duplication (D24).
    """
    keys = list(keys)
    if not keys:
        return df
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    ordkey = F.struct(*[F.col(o) for o in order])
    agg = df.groupBy(*keys).agg(F.max_by(packed, ordkey).alias("_last"))
    return agg.select(*keys, "_last.*").select(*df.columns)


def keep_last_window(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """W1 reference formulation (``row_number``) — used in tests to cross-check :func:`keep_last`."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_latest_n(files: DataFrame, group: str, n: int = 7, mtime: str = "modification_time",
                  name: str = "file_name", out_col: str = "action") -> DataFrame:
    """Per group keep the newest ``n`` files (mtime desc, then name); the rest -> 'delete'.

    Ranked by (mtime, name) with nulls last, nulls being a group of their own; files equal in both
    share their place, so all of them are kept or deleted.  The n-th newest of each group comes from
    ``row_number() <= n``, which Spark turns into a partial window-group-limit before the shuffle;
    one bounded list per group is joined back.
    """
    first = Window.partitionBy(group).orderBy(F.col("_m").desc_nulls_last(), F.col("_n"))
    distinct = files.select(F.col(group), F.col(mtime).alias("_m"), F.col(name).alias("_n")).distinct()
    newest = distinct.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    keep = newest.select(F.col(group).alias("_g"), "_m", "_n", "rank")
    same = (F.col(group).eqNullSafe(F.col("_g")) & F.col(name).eqNullSafe(F.col("_n"))
            & F.col(mtime).eqNullSafe(F.col("_m")))
    return (files.join(keep, same, "left")
            .withColumn(out_col, F.when(F.col("rank").isNotNull(), F.lit("keep")).otherwise(F.lit("delete")))
            .drop("_g", "_n", "_m"))


def date_header_change(df: DataFrame, date_col: str, partition: Sequence[str],
                       out_col: str = "is_first_of_date",
                       tiebreak: Sequence[str] = ()) -> DataFrame:
    """In ``date desc`` order (ties by ``tiebreak``), flag the first row of each date
    within the partition (team, ...).

    The first row of a date is the row with the smallest tiebreak among that
    (partition, date): computed as an aggregate (partial, so a hot date never
    sits in one task) and joined back — no global window over the partition.
    """
    if not partition:
        raise ValueError("date_header_change needs a partition column")
    if not tiebreak:
        raise ValueError("date_header_change needs tiebreak columns: rows have no order of their own")
    keys = [*partition, date_col]
    tb = F.struct(*[F.col(t) for t in tiebreak])
    firsts = df.groupBy(*keys).agg(F.min(tb).alias("_first")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    j = df.join(firsts, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    cond = None
    for t in tiebreak:
        c = F.col(t).eqNullSafe(F.col(f"_first.{t}"))
        cond = c if cond is None else cond & c
    return j.select(*[F.col(c) for c in df.columns], cond.alias(out_col))


def changed_since(files: DataFrame, seen: DataFrame, keys: Sequence[str] = ("file_name", "modification_time"),
                  target_mtime: object = None, mtime: str = "modification_time") -> DataFrame:
    """Files new or modified relative to a seen-manifest (anti-join on name+mtime);
    with ``target_mtime`` only files newer than it (unknown mtime included, ordered last)."""
    cond = None
    s = seen.select(*[F.col(k).alias(f"_s_{k}") for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        cond = c if cond is None else cond & c
    out = files.join(s, cond, "left_anti")
    if target_mtime is not None:
        out = out.filter(F.col(mtime).isNull() | (F.col(mtime) > F.lit(target_mtime)))
    return out


def sort_nulls_last(df: DataFrame, cols: Sequence[str | Column], desc: bool = False) -> DataFrame:
    """O1: global sort, nulls last (use only for final output; layout sorts should be
    ``sortWithinPartitions``)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return df.orderBy(*[(c.desc_nulls_last() if desc else c.asc_nulls_last()) for c in cs])


def preview(df: DataFrame, n: int = 200) -> DataFrame:
    """O2: first ``n`` rows (a preview is the feature; the limit is pushed down)."""
    return df.limit(n)


def latest_name(files: DataFrame, group: Sequence[str] = (), name: str = "file_name") -> DataFrame:
    """O3: file count and lexicographically last name (per group)."""
    aggs = [F.count(F.lit(1)).alias("n_files"), F.max(name).alias("latest_name")]
    return files.groupBy(*group).agg(*aggs) if group else files.agg(*aggs)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate with the union of columns, missing -> null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def key_classes(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(key, in_new, in_old) of every distinct key, from one aggregate over both sides; nulls are a key."""
    side = lambda df, is_new: df.select(F.col(key).alias("key"), F.lit(is_new).alias("in_new"), F.lit(not is_new).alias("in_old"))
    return side(new, True).unionByName(side(old, False)).groupBy("key").agg(F.max("in_new").alias("in_new"), F.max("in_old").alias("in_old"))


def key_sets(new: DataFrame, old: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new - old, new ∩ old, old - new) on distinct keys."""
    c = key_classes(new, old, key)
    return (c.filter("in_new and not in_old").select("key"), c.filter("in_new and in_old").select("key"),
            c.filter("in_old and not in_new").select("key"))


def distinct_first_seen(df: DataFrame, cols: Sequence[str], order: str = "_seq") -> DataFrame:
    """U4: order-preserving distinct — one row per value with its first position."""
    return df.groupBy(*cols).agg(F.min(order).alias("first_seen"))
