"""Imports with bad rows and bad files, pruned partition merges, one rewrite a batch."""
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import accumulate_keep_last
from tidemark.sources.curated import committed_versions, publish, read_curated
from tidemark.sources.status import latest_status, read_status
from tidemark.streaming import watch
from tidemark.streaming.importer import Source, file_outcomes, import_source, quarantine, scheduled_import, settle_files


def _write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def _source(folder, **more):
    keep = lambda batch, stored: accumulate_keep_last(stored, batch.drop("_file"), ["k"]).drop("_batch")
    return Source("t", folder, "k long, v string", keep, valid=F.col("k") > 0, why="not positive", **more)


def test_bad_rows_and_files_are_set_apart(spark):
    root = tempfile.mkdtemp(prefix="tm-imp-")
    folder = f"{root}/land"
    _write(f"{folder}/a.csv", "k,v\n1,one\n-2,minus\nx,letters\n3,three\n")
    _write(f"{folder}/b.csv", "k,v\n1,again\n4,four,more\n")
    _write(f"{folder}/bad.csv", "k,v\nx,y\n")
    _write(f"{folder}/broken.csv.gz", b"no gzip")
    _write(f"{folder}/empty.csv", "")
    _write(f"{folder}/_hidden.csv", "k,v\n9,nine\n")
    result = import_source(spark, _source(folder, max_files_per_trigger=1), root)
    assert (result["state"], result["files"], result["files_ok"], result["files_failed"]) == ("partial", 4, 2, 2)
    assert (result["rows"], result["rejected"], result["rows_read"]) == (3, 4, 7)
    got = {r.k: r.v for r in read_curated(spark, root, "t").collect()}
    assert set(got) == {1, 3} and got[3] == "three"
    bad = sorted((r._file, r._reason, r.record) for r in quarantine(spark, root).collect())
    assert bad == [("a.csv", "malformed", "x,letters"), ("a.csv", "not positive", '{"k":-2,"v":"minus"}'),
                   ("b.csv", "malformed", "4,four,more"), ("bad.csv", "malformed", "x,y")]
    assert import_source(spark, _source(folder), root)["state"] == "idle"
    assert settle_files(spark, _source(folder), root, f"{root}/done", f"{root}/failed") == {"done": 2, "failed": 2}
    assert sorted(f for f in os.listdir(f"{root}/done") if f[0] not in "._") == ["a.csv", "b.csv"]
    assert sorted(f for f in os.listdir(f"{root}/failed") if f[0] not in "._") == ["bad.csv", "broken.csv.gz"]
    _write(f"{folder}/a.csv", "k,v\n7,seven\n")  # nothing is moved that has not been read
    assert settle_files(spark, _source(folder), root, f"{root}/done", f"{root}/failed") == {"done": 0, "failed": 0}
    assert sorted(f for f in os.listdir(folder) if f[0] != ".") == ["_hidden.csv", "a.csv", "empty.csv"]
    _write(f"{folder}/new.csv", "k,v\n8,eight\n")
    _write(f"{root}/done/new.csv", "an older file of that name")
    import_source(spark, _source(folder), root)
    assert settle_files(spark, _source(folder), root, f"{root}/done", f"{root}/failed")["done"] == 1
    assert {"new.csv", "new_1.csv"} <= set(os.listdir(f"{root}/done"))


def test_a_stopped_batch_leaves_one_outcome(spark):
    root = tempfile.mkdtemp(prefix="tm-stop-")
    folder = f"{root}/land"
    _write(f"{folder}/a.csv", "k,v\n1,one\nx,bad\n")
    faults = [1]

    def merge(batch, stored):
        if faults:
            faults.pop()
            raise RuntimeError("stopped")
        return batch.drop("_file")

    source = Source("t", folder, "k long, v string", merge)
    assert import_source(spark, source, root)["state"] == "failed"
    assert import_source(spark, source, root)["rows"] == 1
    assert file_outcomes(spark, root).count() == 1 and quarantine(spark, root).count() == 1
    assert len(committed_versions(spark, root, "t")) == 1


def test_scheduled_import_isolates_sources(spark):
    root = tempfile.mkdtemp(prefix="tm-run-")
    _write(f"{root}/one/a.csv", "k,v\n1,one\n")
    ok = _source(f"{root}/one")
    missing = Source("gone", f"{root}/nowhere", "k long", lambda b, s: b)
    state, rows = scheduled_import(spark, [missing, ok], root)
    assert state == 1 and {r.source: r.state for r in rows.collect()} == {"gone": "failed", "t": "ok"}
    last = latest_status(read_status(spark, root)).first()
    assert last.ok and "t ok: 1/1 files, 1 rows" in last.summary and last.error
    assert scheduled_import(spark, [ok], root)[0] == 0


def _partitions_read(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in re.findall(r"PartitionFilters: \[(.*?)\],", plan) if s]
    return scans


def test_only_touched_partitions_are_read(spark):
    path = tempfile.mkdtemp(prefix="tm-prune-") + "/t"
    schema = "k string, d string, v string, _seq long"
    rows = [(f"k{i}", f"d{i % 6}" if i % 6 else None, "1", i) for i in range(24)]
    watch.merge_into_partitions(spark.createDataFrame(rows, schema), path, ["k"], "d")
    files = {(p, f): os.path.getmtime(os.path.join(p, f)) for p, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    stored = watch.recorded_schema(spark, path)
    batch = spark.createDataFrame([("k1", "d1", "2", 99), ("new", None, "2", 100)], schema)
    for most in (10, 1):  # literal values, then their range
        df = watch.stored_partitions(spark, path, stored, batch.select("d"), "d", most)
        assert _partitions_read(df)
        read = {r.p for r in df.select(F.coalesce("d", F.lit("null")).alias("p")).distinct().collect()}
        assert read == {"d1", "null"}
    scan = spark.read.schema(stored).parquet(path).where(watch.partition_values(batch.select("d"), "d"))
    node = scan._jdf.queryExecution().executedPlan()
    scan.collect()
    assert re.search(r"PartitionFilters: \[.*d#\d+", node.toString())
    assert len(scan.select(F.input_file_name().alias("f")).distinct().collect()) == 2  # of six partitions, one file each
    watch.merge_into_partitions(batch, path, ["k"], "d")
    now = {(p, f): os.path.getmtime(os.path.join(p, f)) for p, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    kept = {os.path.basename(p) for p, f in files if (p, f) in now}
    assert kept == {"d=d2", "d=d3", "d=d4", "d=d5"}
    assert spark.read.parquet(path).count() == 25


def test_columns_come_from_the_tables_record(spark):
    path = tempfile.mkdtemp(prefix="tm-rec-") + "/t"
    watch.merge_into_partitions(spark.createDataFrame([("a", "d1", "x", 1)], "k string, d string, extra string, _seq long"), path, ["k"], "d")
    watch.merge_into_partitions(spark.createDataFrame([("b", "d2", "y", 2)], "k string, d string, other string, _seq long"), path, ["k"], "d")
    watch.merge_into_partitions(spark.createDataFrame([("c", "d2", 3)], "k string, d string, _seq long"), path, ["k"], "d")
    schema = watch.recorded_schema(spark, path)
    assert set(schema.names) == {"k", "d", "extra", "other", "_seq"}
    assert sorted(n for n in os.listdir(f"{path}/_schema") if n.isdigit()) == ["000001", "000002"]
    rows = spark.read.schema(schema).parquet(path).select("k", "extra", "other").collect()
    assert sorted(map(tuple, rows)) == [("a", "x", None), ("b", None, "y"), ("c", None, None)]


def test_one_rewrite_for_save_and_refill(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="tm-refill-") + "/t"
    schema = "k string, d string, code string, hint string, _seq long"
    words = lambda *rows: spark.createDataFrame(list(rows), "work string, keyword string, _seq long")
    writes = []
    replace = watch._replace_partitions
    monkeypatch.setattr(watch, "_replace_partitions", lambda *a: (writes.append(1), replace(*a)))

    def save(rows, dictionary):
        before = {(p, f) for p, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
        writes.clear()
        assert watch.merge_then_refill(spark.createDataFrame(rows, schema), path, ["k"], "d", "code", lambda: dictionary, None, "work", {"hint": "keyword"}) == ""
        assert len(writes) == 1
        now = {(p, f) for p, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
        return {os.path.basename(p) for p, _ in now - before if "=" in p and "_dictionary" not in p}

    assert save([("a", "d1", "w1", None, 1), ("b", "d2", "w2", None, 2)], words(("w1", "one", 1))) == {"d=d1", "d=d2"}
    # nothing new in the dictionary: only the batch's partition
    assert save([("c", "d3", "w1", None, 3)], words(("w1", "one", 1))) == {"d=d3"}
    # an entry that d2 waits for
    assert save([("e", "d3", "w9", None, 4)], words(("w1", "one", 1), ("w2", "two", 2))) == {"d=d2", "d=d3"}
    got = {r.k: r.hint for r in spark.read.schema(watch.recorded_schema(spark, path)).parquet(path).collect()}
    assert got == {"a": "one", "b": "two", "c": "one", "e": None}


def test_full_replace_keeps_the_version(spark):
    from tidemark.operators.merge import full_replace
    root = tempfile.mkdtemp(prefix="tm-full-")
    publish(spark.createDataFrame([(1,)], "k int"), root, "t")

    def write(df):
        publish(df, root, "t")
        return read_curated(spark, root, "t")

    late = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("late"))).otherwise(F.col("id")).cast("int").alias("k"))
    table, ok, error = full_replace(lambda: late, lambda: read_curated(spark, root, "t"), write)
    assert not ok and "late" in error and [r.k for r in table.collect()] == [1]
    assert len(committed_versions(spark, root, "t")) == 1


@pytest.mark.parametrize("most", [0, 3])
def test_partition_values_of_nothing_or_null(spark, most):
    empty = spark.createDataFrame([], "d string")
    rows = spark.createDataFrame([("a",), (None,)], "d string")
    assert rows.where(watch.partition_values(empty, "d", 3)).count() == 0
    only_null = spark.createDataFrame([(None,)], "d string")
    assert [r.d for r in rows.where(watch.partition_values(only_null, "d", most)).collect()] == [None]
