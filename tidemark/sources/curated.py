"""Curated tables: immutable data directories and numbered commits (S3, K1, K4, K6, M8).

Layout of a table ``<root>/<table>``::

    v=<unique name>/part-*.parquet   data of one publish, never changed
    _commits/<number>                one commit: JSON with the data directory, the load's id and the loads known so far

Commits are numbered one after another, without gaps.  A commit's marker is written under another name and then gets its
number in one step that fails if the number is taken, so a marker is never seen without its content, and of two writers
that follow the same version one is refused.  Readers take the marker of the largest number and read that one file.
"""
from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


class EmptyLoadError(ValueError):
    """K6: refusing to replace a table with an empty result."""


class ConcurrentCommitError(RuntimeError):
    """Another writer has committed the number this one was to have."""


class CorruptCommitError(RuntimeError):
    """A marker that this module did not write: its number is taken, but nobody knows by what."""


#: Ids of loads that a marker remembers, beside the last batch of every stream.
RECENT_LOADS = 200


@dataclass(frozen=True)
class Commit:
    version: str               # zero-padded number
    data: str                  # data directory
    load: str | None           # id of the load, for replays
    streams: dict[str, int]    # last batch of each stream that has loaded into the table
    recent: tuple[str, ...]    # ids of the last other loads

    def knows(self, load: str) -> bool:
        """Whether the load, ``<stream>:<batch>`` or any other id, has been committed."""
        stream, batch = _stream_batch(load)
        return load in self.recent if batch is None else self.streams.get(stream, -1) >= batch


def _stream_batch(load: str) -> tuple[str, int | None]:
    stream, _, batch = load.rpartition(":")
    return (stream, int(batch)) if stream and batch.isdigit() else (load, None)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists; faults of the file system are raised."""
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _marker(root: str, table: str, number: int) -> str:
    return f"{root}/{table}/_commits/{number:012d}"


def _numbers(spark: SparkSession, root: str, table: str) -> list[int]:
    """The numbers committed, oldest first; only names are listed."""
    fs, p = hadoop_path(spark, f"{root}/{table}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def _read_commit(spark: SparkSession, root: str, table: str, number: int) -> Commit:
    try:
        entry = json.loads(read_text(spark, _marker(root, table, number)))
        return Commit(f"{number:012d}", entry["data"], entry.get("load"), entry.get("streams", {}), tuple(entry.get("recent", ())))
    except (ValueError, KeyError) as e:
        raise CorruptCommitError(f"{table}: commit {number} cannot be read") from e


def commits(spark: SparkSession, root: str, table: str) -> list[Commit]:
    """All commits, oldest first; opens every marker."""
    return [_read_commit(spark, root, table, n) for n in _numbers(spark, root, table)]


def latest_commit(spark: SparkSession, root: str, table: str) -> Commit | None:
    """The newest commit; one listing and one small read, however many there are."""
    numbers = _numbers(spark, root, table)
    return _read_commit(spark, root, table, numbers[-1]) if numbers else None


def link_new(spark: SparkSession, source: str, target: str) -> bool:
    """Local folders: a finished file under a second name, in one step; False if the name is taken."""
    nio = spark.sparkContext._jvm.java.nio.file.Files
    local = [spark.sparkContext._jvm.java.io.File(hadoop_path(spark, p)[1].toUri().getPath()).toPath() for p in (target, source)]
    try:
        nio.createLink(*local)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Other stores: rename without overwrite (one step on HDFS); False if the name is taken."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    options = sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    (_, src), (_, dst) = hadoop_path(spark, source), hadoop_path(spark, target)
    try:
        hadoop.FileContext.getFileContext(src.toUri(), sc._jsc.hadoopConfiguration()).rename(src, dst, options)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def write_new(spark: SparkSession, path: str, content: str) -> bool:
    """A file that appears with its whole content, in one step; False if there is one of that name.

    It is written beside its place under a hidden name first.  The store must rename in one step, as HDFS and local folders do.
    """
    folder, _, _ = path.rpartition("/")
    draft = f"{folder}/.{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, draft)
    out = fs.create(p, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    try:
        return (link_new if fs.getUri().getScheme() == "file" else rename_new)(spark, draft, path)
    finally:
        fs.delete(p, False)


def _commit(spark: SparkSession, root: str, table: str, last: Commit | None, data: str, load: str | None) -> str:
    """Commit ``data`` as the version right after ``last``."""
    number = int(last.version) + 1 if last else 1
    streams, recent = dict(last.streams if last else {}), list(last.recent if last else ())
    if load is not None:
        stream, batch = _stream_batch(load)
        if batch is None:
            recent = [*recent, load][-RECENT_LOADS:]
        else:
            streams[stream] = max(batch, streams.get(stream, -1))
    if not write_new(spark, _marker(root, table, number), json.dumps({"data": data, "load": load, "streams": streams, "recent": recent})):
        raise ConcurrentCommitError(f"{table}: commit {number} is taken")
    return f"{number:012d}"


def committed_versions(spark: SparkSession, root: str, table: str) -> list[str]:
    return [f"{n:012d}" for n in _numbers(spark, root, table)]


def current_version(spark: SparkSession, root: str, table: str) -> str | None:
    versions = committed_versions(spark, root, table)
    return versions[-1] if versions else None


def read_curated(spark: SparkSession, root: str, table: str, schema: T.StructType | str | None = None,
                 version: str | None = None) -> DataFrame | None:
    """S3: the current (or given) committed version; absent -> empty frame with ``schema``
    (or None when no schema is given)."""
    if version is None:
        found = latest_commit(spark, root, table)
    elif version.isdigit() and int(version) in _numbers(spark, root, table):
        found = _read_commit(spark, root, table, int(version))
    else:
        raise ValueError(f"{table}: version {version} is not committed")
    if found is None:
        return spark.createDataFrame([], schema) if schema is not None else None
    return _data(spark, root, table, found, schema)


def _data(spark: SparkSession, root: str, table: str, commit: Commit, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(f"{root}/{table}/{commit.data}")


def _write_data(df: DataFrame, root: str, table: str, refuse_empty: bool, partitions: int | None) -> tuple[str, int]:
    """(data directory, rows) of a finished write; the rows are counted by the write itself."""
    data = f"v={uuid.uuid4().hex}"
    path = f"{root}/{table}/{data}"
    seen = Observation()
    (df.repartition(partitions) if partitions else df).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    rows = seen.get["rows"]
    if refuse_empty and not rows:
        delete_path(df.sparkSession, path)
        raise EmptyLoadError(f"refusing to publish an empty result to {table}")
    return data, rows


def publish(df: DataFrame, root: str, table: str, version: str | None = None,
            refuse_empty: bool = True, partitions: int | None = None) -> str | None:
    """K1 (+K6): write the data and commit it as the next version, whatever was committed before.

    ``version`` names the load (an id that no other load has; a stream's checkpoint id and batch number as ``<id>:<batch>``);
    publishing a load or a version that is already committed is a replay: nothing is written and None returned.
    """
    done = _publish(df, root, table, version, refuse_empty, partitions)
    return done[0] if done else None


def _publish(df: DataFrame, root: str, table: str, version: str | None = None, refuse_empty: bool = True,
             partitions: int | None = None) -> tuple[str, int] | None:
    """(version, rows) of a publish, None for a replay."""
    spark = df.sparkSession
    last = latest_commit(spark, root, table)
    if version is not None and last and (last.knows(version) or version in committed_versions(spark, root, table)):
        return None
    data, rows = _write_data(df, root, table, refuse_empty, partitions)
    while True:
        try:
            return _commit(spark, root, table, last, data, version), rows
        except ConcurrentCommitError:  # a whole table replaces whatever came in between
            last = latest_commit(spark, root, table)
            if version is not None and last.knows(version):
                delete_path(spark, f"{root}/{table}/{data}")
                return None


RESULT_SCHEMA = "table string, status string, version string, rows long, message string"


def _outcome(name: str, build: Callable[[], DataFrame], root: str) -> tuple:
    """Publish one table; what goes wrong is a row, not an error."""
    try:
        version, rows = _publish(build(), root, name)
        return name, "ok", version, rows, ""
    except EmptyLoadError as e:
        return name, "skipped", None, 0, str(e)
    except Exception as e:  # noqa: BLE001 - isolation per table is the contract
        return name, "failed", None, None, f"{type(e).__name__}: {e}"


def publish_many(frames: Mapping[str, Callable[[], DataFrame]], root: str) -> DataFrame:
    """K4: N tables; a failing one does not stop the others.  Result rows (table, status, version, rows, message)."""
    rows = [_outcome(name, build, root) for name, build in frames.items()]
    return SparkSession.getActiveSession().createDataFrame(rows, RESULT_SCHEMA)


def publish_from(source: DataFrame, tables: Mapping[str, Callable[[DataFrame], DataFrame]], root: str,
                 accept: Column | None = None) -> DataFrame:
    """K4 + K6 + A11: one read -> N tables, with the counts of the read and of every write.

    The source is read once into the shared folder, where every table is made from it.  Rows that ``accept`` does not hold
    for are rejected: they reach no table and are counted.  Every result row carries rows_in and rows_rejected of the read
    and the rows of its own write; all counts are taken while the rows pass, no plan runs twice.  (The read is the last stage
    of its job, so a lost executor does not count rows twice.)
    """
    spark = source.sparkSession
    seen = Observation()
    keep = F.coalesce(accept, F.lit(False)) if accept is not None else F.lit(True)
    marked = source.withColumn("_accepted", keep).observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(~F.col("_accepted")).alias("rejected"))
    path = scratch_path(spark, "publish-from")
    marked.where("_accepted").drop("_accepted").write.parquet(path)
    shared = spark.read.schema(source.schema).parquet(path)
    rows = [_outcome(name, lambda make=make: make(shared), root) for name, make in tables.items()]
    delete_path(spark, path)
    return spark.createDataFrame(rows, RESULT_SCHEMA).select(
        "*", F.lit(seen.get["rows_in"]).cast("long").alias("rows_in"), F.lit(seen.get["rejected"]).cast("long").alias("rows_rejected"))


def merge_latest_and_publish(spark: SparkSession, root: str, table: str,
                             merge: Callable[[DataFrame | None], DataFrame], retries: int = 3) -> str | None:
    """M8: merge onto the newest version and commit as the one right after it; if another writer has committed in
    between, the merge runs again on top of that."""
    for _ in range(retries):
        last = latest_commit(spark, root, table)
        data, _ = _write_data(merge(_data(spark, root, table, last) if last else None), root, table, False, None)
        try:
            return _commit(spark, root, table, last, data, None)
        except ConcurrentCommitError:
            delete_path(spark, f"{root}/{table}/{data}")
    raise RuntimeError(f"{table}: concurrent publishers, gave up after {retries} attempts")


def prune_versions(spark: SparkSession, root: str, table: str, keep: int = 7) -> list[str]:
    """Delete markers and data of all but the newest ``keep`` (at least one) commits; opens the markers it deletes."""
    old = [_read_commit(spark, root, table, n) for n in _numbers(spark, root, table)[:-max(1, keep)]]
    for c in old:
        delete_path(spark, _marker(root, table, int(c.version)))
        delete_path(spark, f"{root}/{table}/{c.data}")
    return [c.version for c in old]


def vacuum(spark: SparkSession, root: str, table: str, older_than_hours: float = 24) -> list[str]:
    """Delete what refused or crashed publishes left: data directories that no commit names, and drafts of markers, that have
    not changed for ``older_than_hours`` (longer than any publish takes).  Returns their names."""
    named = {c.data for c in commits(spark, root, table)}
    limit = (time.time() - 3600 * older_than_hours) * 1000
    gone = []
    for folder, is_left in ((f"{root}/{table}", lambda n: n.startswith("v=") and n not in named),
                            (f"{root}/{table}/_commits", lambda n: n.startswith(".") and not n.endswith(".crc"))):
        fs, p = hadoop_path(spark, folder)
        for status in fs.listStatus(p) if fs.exists(p) else []:
            if is_left(status.getPath().getName()) and status.getModificationTime() < limit:
                fs.delete(status.getPath(), True)
                gone.append(status.getPath().getName())
    return gone
