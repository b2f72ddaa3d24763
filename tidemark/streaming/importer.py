"""Imports that keep bad rows and bad files apart (T4) and run over several sources (T5), with catch-up.

Every batch is read once, permissively, into the shared folder.  Rows that do not parse, or fail the source's own test, go to
a quarantine table with their file and reason; the others are merged and published.  A file that cannot be read at all does
not stop the others: it gives no row, and the run reports every file that was there and gave none.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, work_dir
from ..sources.curated import delete_path, hadoop_path, path_exists, publish, read_curated
from ..sources.files import file_manifest
from ..sources.status import append_status
from .watch import checkpoint_id, watch_landing

CORRUPT = "_corrupt_record"
FILE_SCHEMA = "file string, modified long, rows long, rejected long"
RESULT_SCHEMA = ("source string, state string, files long, files_ok long, files_failed long, rows_read long, rows long, rejected long, "
                 "error string")


@dataclass(frozen=True)
class Source:
    """One landing folder and the table it feeds.

    ``merge(batch, stored)`` folds the accepted rows (the schema's columns, ``_file`` and ``_seq``) into the stored table;
    ``valid`` is an optional test that a parsed row must pass, ``why`` the reason given where it does not.
    """
    name: str
    path: str
    schema: str
    merge: Callable[[DataFrame, DataFrame | None], DataFrame]
    fmt: str = "csv"
    glob: str | None = None
    valid: Column | None = None
    why: str = "invalid"
    max_files_per_trigger: int | None = None
    options: dict = field(default_factory=dict)


def checked(rows: DataFrame, valid: Column | None, why: str) -> DataFrame:
    """Rows with ``_reason``: 'malformed' if the record did not parse, ``why`` if it fails the test, null if it is good."""
    failed = ~F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False)
    return rows.withColumn("_reason", F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")).when(failed, F.lit(why)))


def _load_path(root: str, kind: str, source: str, load: str) -> str:
    return f"{root}/_imports/{kind}/source={source}/load={load.replace(':', '-')}"


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """All rejected rows of all sources: source, load, _file, _reason, record (the row as it came)."""
    schema = "_file string, _reason string, record string, source string, load string"
    path = f"{root}/_imports/rejected"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def file_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """All files that gave rows: source, load, file, its time of change (ms), rows, rejected."""
    path = f"{root}/_imports/files"
    schema = f"{FILE_SCHEMA}, source string, load string"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def import_batch(batch: DataFrame, source: Source, root: str, load: str) -> None:
    """One batch: read once, bad rows set apart, outcome of each file, good rows merged and published.

    What a batch writes is named by its load: a batch that runs again after a stop replaces its own quarantine and outcomes,
    and its publish is a replay if it had come that far.
    """
    spark = batch.sparkSession
    path = scratch_path(spark, f"import-{source.name}")
    # numbered once, where the rows are written: what is read back has one order
    checked(batch, source.valid, source.why).withColumn("_seq", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("_reason", T.StringType()),
                                           T.StructField("_seq", T.LongType())])).parquet(path)
    columns = [c for c in batch.columns if c not in (CORRUPT, "_file", "_modified")]
    bad, good = rows.where("_reason is not null"), rows.where("_reason is null").drop(CORRUPT, "_reason", "_modified")
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))
    bad.select("_file", "_reason", record.alias("record")).write.mode("overwrite").parquet(_load_path(root, "rejected", source.name, load))
    outcome = rows.groupBy(F.col("_file").alias("file"), F.col("_modified").alias("modified")).agg(F.count_if(F.col("_reason").isNull()).alias("rows"),
                                                             F.count_if(F.col("_reason").isNotNull()).alias("rejected"))
    publish(source.merge(good, read_curated(spark, root, source.name)), root, source.name, version=load, refuse_empty=False)
    # last: a file has an outcome once its rows are in the table
    outcome.write.mode("overwrite").parquet(_load_path(root, "files", source.name, load))
    delete_path(spark, path)


def _unreadable_path(root: str, source: Source) -> str:
    return f"{root}/_imports/unreadable/{source.name}"


def _unreadable(spark: SparkSession, root: str, source: Source) -> DataFrame:
    """(file, modified) of the files of a source that gave no row at all."""
    path = _unreadable_path(root, source)
    return spark.read.schema("file string, modified long").parquet(path) if path_exists(spark, path) else spark.createDataFrame([], "file string, modified long")


def import_source(spark: SparkSession, source: Source, root: str) -> dict:
    """Process everything that has landed since the last run, then stop; a row of RESULT_SCHEMA.

    Files counted are those that were there when the run began and had no outcome yet; a file without bytes is not there yet.  ``state``: 'ok', 'partial' (some
    files or rows were refused), 'idle' (nothing new) or 'failed' (the run was stopped; the next one takes its batch again).
    """
    checkpoint = f"{root}/_imports/checkpoint/{source.name}"
    schema = T.StructType.fromDDL(source.schema).add(CORRUPT, "string")
    result = dict.fromkeys(("files", "files_ok", "files_failed", "rows_read", "rows", "rejected"), 0)
    result |= {"source": source.name, "state": "idle", "error": ""}
    query = None

    def outcomes() -> DataFrame:
        return file_outcomes(spark, root).where(F.col("source") == source.name)

    try:
        there = file_manifest(spark, source.path, source.glob).where(~F.col("file_name").rlike("^[_.]")).select(
            F.col("file_name").alias("file"), F.unix_millis(F.col("modification_time").cast("timestamp")).alias("modified"))
        known = outcomes().select("file").unionByName(_unreadable(spark, root, source).select("file")).distinct()
        # a name and a time for each file that has landed since the last run
        work_dir(spark)
        new = there.join(known, "file", "left_anti").checkpoint(eager=True)
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreCorruptFiles": True, **source.options}
        stream = watch_landing(spark, source.path, schema, source.fmt, source.glob, source.max_files_per_trigger, options=options)
        stream = stream.withColumn("_file", F.col("_metadata.file_name")).withColumn("_modified", F.unix_millis(F.col("_metadata.file_modification_time")))

        def run(batch: DataFrame, batch_id: int) -> None:
            import_batch(batch, source, root, f"{checkpoint_id(spark, checkpoint)}:{batch_id}")

        query = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        seen = new.join(outcomes().select("file", "rows", "rejected"), "file", "left")
        usable = F.coalesce(F.col("rows"), F.lit(0)) > 0
        counts = seen.agg(F.count("*").alias("files"), F.count_if(usable).alias("files_ok"), F.count_if(~usable).alias("files_failed"),
                          F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected")).first()
        result |= counts.asDict()
        seen.where("rows is null").select("file", "modified").write.mode("append").parquet(_unreadable_path(root, source))
        if result["files"]:
            result["state"] = "partial" if result["files_failed"] or result["rejected"] else "ok"
    except Exception as e:  # noqa: BLE001 - one source must not stop the others
        result |= {"state": "failed", "error": f"{type(e).__name__}: {e}"}
    if query is not None:
        result["rows_read"] = sum(p["numInputRows"] for p in query.recentProgress)
    return result


def scheduled_import(spark: SparkSession, sources: Sequence[Source], root: str, job: str = "import") -> tuple[int, DataFrame]:
    """T5: one run over all sources, each on its own; (exit state, a row for each source).

    The exit state is 0 if something was saved or nothing was new, and nothing was refused; 1 if a file was refused or a
    source failed.  Rejected rows alone are reported, not a failure.  One status row sums up the run.
    """
    results = [import_source(spark, s, root) for s in sources]
    saved = any(r["files_ok"] for r in results)
    failed = any(r["state"] == "failed" or r["files_failed"] for r in results)
    summary = "; ".join(f"{r['source']} {r['state']}: {r['files_ok']}/{r['files']} files, {r['rows']} rows, {r['rejected']} rejected" for r in results)
    append_status(spark, root, job, saved or not failed, summary, "; ".join(r["error"] for r in results if r["error"]))
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    return int(failed), spark.createDataFrame([tuple(r[c] for c in names) for r in results], RESULT_SCHEMA)


def settle_files(spark: SparkSession, source: Source, root: str, done_dir: str, failed_dir: str) -> dict[str, int]:
    """T4: move the files that gave rows to ``done_dir`` and those that gave none to ``failed_dir``; how many of each.

    A loop over the names of landed files, as the file source's own clean-up does.  Only a file with an outcome is moved, and
    only as it was read: one written anew since stays.  A name already there gets a number behind it; the step can be repeated.
    """
    own = file_outcomes(spark, root).where(F.col("source") == source.name).select("file", "modified", "rows")
    own = own.unionByName(_unreadable(spark, root, source).withColumn("rows", F.lit(0).cast("long")))
    outcome = {(r["file"], r["modified"]): r["rows"] > 0 for r in own.collect()}
    moved = {"done": 0, "failed": 0}
    fs, folder = hadoop_path(spark, source.path)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if (name, status.getModificationTime()) not in outcome:
            continue
        kind, target = ("done", done_dir) if outcome[name, status.getModificationTime()] else ("failed", failed_dir)
        fs.mkdirs(path(target))
        stem, dot, ending = name.partition(".")
        free = next(n for i in range(1 << 20) if not fs.exists(path(f"{target}/{(n := f'{stem}_{i}{dot}{ending}' if i else name)}")))
        if fs.rename(status.getPath(), path(f"{target}/{free}")):
            moved[kind] += 1
    return moved
