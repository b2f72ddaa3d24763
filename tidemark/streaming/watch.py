"""Incremental ingestion with Structured Streaming (T1..T5, T7).

* T1 ``watch_landing``: a file-source stream over a landing folder (direct
  children, glob filter, ``_`` files hidden); the checkpoint's file log makes
  every file count exactly once, across restarts (T3 catch-up).
* T2 ``stream_merge``: ``foreachBatch`` runs the same merge as the batch
  pipeline against the latest published version and publishes the next one.  The
  load is named by the checkpoint's own id and the batch id, so a replayed batch is
  a no-op, and another stream or a new checkpoint never clashes with it.  It writes
  the whole table each batch: for large tables use :func:`stream_merge_partitioned`.
* T4: ``cleanSource=archive`` moves processed files (done lazily by Spark).
* T5: ``availableNow`` run (process everything present, then stop) + status row.
* T7: the dictionary is re-read in every batch (stream-static lookup).

Rejected rows, broken files and whole import runs (T4, T5) are in ``importer``.
"""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.curated import (ConcurrentCommitError, hadoop_path, path_exists, prune_versions, publish, read_curated, read_text,
                               write_new)
from ..sources.status import append_status


def watch_landing(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                  glob: str | None = None, max_files_per_trigger: int | None = None,
                  archive_dir: str | None = None, options: dict | None = None) -> DataFrame:
    """T1 (+T4): streaming DataFrame over the files of ``path``."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if fmt == "csv":
        r = r.option("header", True)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(path)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark has given to the stream of this checkpoint folder (it stays over restarts)."""
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


def _start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool):
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return q


def stream_merge(stream: DataFrame, root: str, table: str,
                 merge: Callable[[DataFrame, DataFrame | None, int], DataFrame],
                 checkpoint: str, available_now: bool = True, job: str | None = None,
                 output_columns: list[str] | None = None, keep_versions: int | None = None):
    """For each micro-batch ``merge(batch, stored, batch_id)``, then publish.
    ``keep_versions`` prunes older versions after each batch.  Returns the (finished, when
    ``available_now``) query."""
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            out = merge(batch, read_curated(spark, root, table), batch_id)
            if output_columns:
                out = out.select(*output_columns)
            publish(out, root, table, version=f"{checkpoint_id(spark, checkpoint)}:{batch_id}", refuse_empty=False)
            if keep_versions:
                prune_versions(spark, root, table, keep_versions)
        except Exception as e:  # noqa: BLE001 - record, then let the query fail/retry
            if job:
                append_status(spark, root, job, False, f"batch {batch_id}", f"{type(e).__name__}: {e}")
            raise
        if job:
            append_status(spark, root, job, True, f"batch {batch_id}")

    return _start(stream, run, checkpoint, available_now)


#: Partition values that a read names one by one; beyond that their range and a semi-join take their place.
MOST_VALUES = 10_000


def recorded_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns of a partitioned table as its last merge recorded them, so that no footer has to be opened.

    A table without a record, written by something else, is read once with ``mergeSchema``; None if there is no table.
    """
    folder = f"{path}/_schema"
    if path_exists(spark, folder):
        fs, p = hadoop_path(spark, folder)
        names = sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit())
        if names:
            return T.StructType.fromJson(json.loads(read_text(spark, f"{folder}/{names[-1]}")))
    return spark.read.option("mergeSchema", True).parquet(path).schema if path_exists(spark, path) else None


def _record_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Record a schema that has changed.  It is recorded before the data: a reader finds null for columns not yet written."""
    folder = f"{path}/_schema"
    fs, p = hadoop_path(spark, folder)
    names = [int(n) for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()).isdigit()]
    columns = lambda s: {(f.name, f.dataType) for f in s.fields}
    if names and columns(T.StructType.fromJson(json.loads(read_text(spark, f"{folder}/{max(names):06d}")))) == columns(schema):
        return
    fs.mkdirs(p)
    if not write_new(spark, f"{folder}/{max(names, default=0) + 1:06d}", schema.json()):
        raise ConcurrentCommitError(f"{path}: another writer has changed the columns")


def partition_values(values: DataFrame, column: str, most: int = MOST_VALUES) -> Column:
    """A filter on ``column`` for the distinct values of a one-column frame, as literals that prune partitions before the read.

    At most ``most`` values come to the driver; with more the filter is their range, and the caller joins besides.
    """
    name = values.columns[0]
    rows = [r[0] for r in values.distinct().limit(most + 1).collect()]
    known = [v for v in rows if v is not None]
    if len(rows) <= most:
        inside, null = F.col(column).isin(known) if known else F.lit(False), None in rows
    else:
        edge = values.agg(F.min(name), F.max(name), F.count_if(F.col(name).isNull())).first()
        inside, null = F.col(column).between(edge[0], edge[1]), edge[2] > 0
    return inside | F.col(column).isNull() if null else inside


def stored_partitions(spark: SparkSession, path: str, schema: T.StructType, values: DataFrame, partition_col: str,
                      most: int = MOST_VALUES) -> DataFrame:
    """The rows of a stored table in the partitions named by ``values``; only those partitions are listed in the scan."""
    pruned = spark.read.schema(schema).parquet(path).where(partition_values(values, partition_col, most))
    touched = values.select(F.col(values.columns[0]).alias("_touched")).distinct()
    return pruned.join(touched, F.col(partition_col).eqNullSafe(F.col("_touched")), "left_semi")


def _stored_schema(spark: SparkSession, path: str, batch: DataFrame, partition_col: str) -> T.StructType | None:
    """The table's columns; the partition column keeps the batch's type, a path alone would be guessed at."""
    schema = recorded_schema(spark, path)
    if schema is None:
        return None
    return T.StructType([batch.schema[partition_col] if f.name == partition_col else f for f in schema.fields])


def _merged(batch: DataFrame, path: str, keys: list[str], partition_col: str, order: tuple[str, ...],
            also: DataFrame | None = None) -> DataFrame:
    """The batch merged with the partitions it touches, and with those of ``also`` (one column of partition values)."""
    from ..operators.merge import with_batch
    from ..operators.schema import union_reconcile
    from ..operators.window import keep_last
    spark = batch.sparkSession
    keys = list(dict.fromkeys([*keys, partition_col]))   # functionally dependent: same groups
    b = with_batch(batch, 1)
    schema = _stored_schema(spark, path, batch, partition_col)
    if schema is None:
        return keep_last(b, keys, order).drop("_batch")
    values = b.select(F.col(partition_col).alias("_v"))
    if also is not None:
        values = values.unionByName(also.select(F.col(also.columns[0]).alias("_v")))
    affected = stored_partitions(spark, path, schema, values, partition_col)
    return keep_last(union_reconcile([with_batch(affected, 0), b]), keys, order).drop("_batch")


def _replace_partitions(rows: DataFrame, path: str, partition_col: str) -> None:
    """Write the rows over the partitions they are in; they are cut from their lineage first, as they may read their target."""
    from ..session import work_dir
    spark = rows.sparkSession
    if path_exists(spark, path):
        work_dir(spark)
        rows = rows.checkpoint(eager=True)
    _record_schema(spark, path, rows.schema)
    # rows of a partition together, but a large partition in several tasks and files
    (rows.hint("rebalance", F.col(partition_col)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def merge_into_partitions(batch: DataFrame, path: str, keys: list[str], partition_col: str,
                          order: tuple[str, ...] = ("_batch", "_seq")) -> None:
    """Incremental M2 for a table partitioned by a column that is a function of the key
    (e.g. the month of a date key), so keep-last per key is exact inside a partition.

    The batch's distinct partition values become a literal filter of the stored table's read, so only
    the partitions the batch touches are listed and read; its columns come from the table's own record,
    not from its files.  All stored columns stay; columns that one side lacks are null.  The rows are
    merged with keep-last, cut from their lineage with a reliable checkpoint (the write must not
    read its own target) and written back with dynamic partition overwrite.  Cost is
    O(batch + touched partitions), not O(table).  Re-running a batch gives the same
    result (idempotent).  Partitions are replaced one by one at commit: readers that
    need a consistent multi-partition snapshot should use the versioned publisher.
    """
    _replace_partitions(_merged(batch, path, keys, partition_col, order), path, partition_col)


def stream_merge_partitioned(stream: DataFrame, path: str, keys: list[str], partition_col: str,
                             prepare: Callable[[DataFrame, int], DataFrame], checkpoint: str,
                             available_now: bool = True):
    """T2 at scale: ``prepare(batch, batch_id)`` (cleaning, expansion, enrichment) then
    :func:`merge_into_partitions` into the partitioned table at ``path``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        merge_into_partitions(prepare(batch, batch_id), path, keys, partition_col)

    return _start(stream, run, checkpoint, available_now)


def changed_entries(dictionary: DataFrame, previous: DataFrame | None, key: str, values: list[str],
                    order: tuple[str, ...] = ("_seq",)) -> DataFrame:
    """Dictionary entries (last row per key) that are new or have other values than before."""
    from ..operators.joins import dedup_dictionary
    now = dedup_dictionary(dictionary, key, values, order)
    if previous is None:
        return now
    return now.join(dedup_dictionary(previous, key, values, order), [key, *values], "left_anti")


def _entries(batch: DataFrame, path: str, partition_col: str, key: str, dictionary: DataFrame, previous: DataFrame | None,
             dim_key: str, values: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(entries to fill from, values of the stored partitions that hold a key with a new or changed entry)."""
    from ..functions.scalars import strip
    from ..operators.joins import dedup_dictionary
    from ..session import work_dir
    spark = batch.sparkSession
    work_dir(spark)
    changed = changed_entries(dictionary, previous, dim_key, values).checkpoint(eager=True)
    own = batch.select(strip(F.col(key)).alias("_own")).distinct()
    entries = dedup_dictionary(dictionary, dim_key, values, ("_seq",)).join(own, F.col(dim_key) == F.col("_own"), "left_semi")
    entries = entries.unionByName(changed.select(*entries.columns)).dropDuplicates([dim_key]).checkpoint(eager=True)
    schema = _stored_schema(spark, path, batch, partition_col)
    if schema is None or changed.isEmpty():
        return entries, None
    # two columns of the stored table, and only when the dictionary has changed
    stored = spark.read.schema(schema).parquet(path).select(F.col(partition_col).alias("_v"), strip(F.col(key)).alias("_k"))
    held = stored.join(changed.select(F.col(dim_key).alias("_changed")), F.col("_k") == F.col("_changed"), "left_semi")
    return entries, held.select("_v").distinct().checkpoint(eager=True)


def merge_then_refill(batch: DataFrame, path: str, keys: list[str], partition_col: str, key: str,
                      dictionary: Callable[[], DataFrame], previous: DataFrame | None, dim_key: str, fill: dict[str, str]) -> str:
    """Save a batch, filled from the dictionary together with the stored rows whose entries are new or changed.

    The partitions of the batch and those that hold such a key are read, merged, filled and written once.  ``previous`` is the
    dictionary as it was; without it the entries applied last are compared, which the table keeps beside its data (none the
    first time).  The save stands whatever happens to the dictionary: returns the error of the fill, '' if there was none.
    """
    from ..operators.joins import lookup_fill
    spark, order, error, entries, held = batch.sparkSession, ("_batch", "_seq"), "", None, None
    values = list(dict.fromkeys(fill.values()))
    try:
        now = dictionary()
        known = previous if previous is not None else read_curated(spark, path, "_dictionary")
        entries, held = _entries(batch, path, partition_col, key, now, known, dim_key, values)
    except Exception as e:  # noqa: BLE001 - keep the save, report the fault
        error, entries = f"{type(e).__name__}: {e}", None
    merged = _merged(batch, path, keys, partition_col, order, held)
    if entries is None:
        _replace_partitions(merged, path, partition_col)
        return error
    columns = merged.columns
    _replace_partitions(lookup_fill(merged, key, entries, dim_key, fill, dedup=False).select(*columns), path, partition_col)
    publish(now.select(dim_key, *values, "_seq"), path, "_dictionary", refuse_empty=False)
    prune_versions(spark, path, "_dictionary", 2)
    return ""
