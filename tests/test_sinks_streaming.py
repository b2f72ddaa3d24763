"""Versioned publish, refuse-empty guard, and streaming = batch / restart idempotence."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources.curated import (EmptyLoadError, committed_versions, publish, publish_many,
                                      read_curated)
from tidemark.streaming.watch import stream_merge, watch_landing
from tidemark.operators.merge import accumulate_keep_last


def test_publish_versions(spark):
    root = tempfile.mkdtemp(prefix="tm-pub-")
    df1 = spark.createDataFrame([(1, "a")], "k int, v string")
    v1 = publish(df1, root, "t")
    reader = read_curated(spark, root, "t")
    df2 = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    v2 = publish(df2, root, "t")
    assert committed_versions(spark, root, "t") == sorted([v1, v2])
    assert sorted(tuple(r) for r in reader.collect()) == [(1, "a")]   # old version still readable
    assert sorted(tuple(r) for r in read_curated(spark, root, "t").collect()) == [(1, "b"), (2, "c")]
    assert publish(df2, root, "t", version=v2) is None                 # replay is a no-op
    with pytest.raises(EmptyLoadError):
        publish(df1.limit(0), root, "t")
    res = publish_many({"ok": lambda: df1, "bad": lambda: df1.select(F.col("nope"))}, root)
    assert {r.table: r.status for r in res.collect()} == {"ok": "ok", "bad": "failed"}


def test_stream_merge_equals_batch_and_restart_adds_nothing(spark):
    landing = tempfile.mkdtemp(prefix="tm-land-")
    root = tempfile.mkdtemp(prefix="tm-root-")
    schema = "k string, v string, _seq long"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], schema).coalesce(1).write.parquet(f"{landing}/f1")
    spark.createDataFrame([("a", "2", 3), ("c", "2", 4)], schema).coalesce(1).write.parquet(f"{landing}/f2")
    os.makedirs(f"{landing}/all", exist_ok=True)
    for d in ("f1", "f2"):
        for f in os.listdir(f"{landing}/{d}"):
            if f.endswith(".parquet"):
                os.rename(f"{landing}/{d}/{f}", f"{landing}/all/{d}.parquet")

    def merge(batch, stored, batch_id):
        return accumulate_keep_last(stored, batch.drop("_batch") if "_batch" in batch.columns else batch,
                                    ["k"]).drop("_batch")

    chk = f"{root}/_chk"
    s = watch_landing(spark, f"{landing}/all", schema, "parquet", glob="*.parquet", max_files_per_trigger=1)
    stream_merge(s, root, "t", merge, chk)
    first = sorted((r.k, r.v) for r in read_curated(spark, root, "t").collect())
    assert first == [("a", "2"), ("b", "1"), ("c", "2")]
    n_versions = len(committed_versions(spark, root, "t"))
    s2 = watch_landing(spark, f"{landing}/all", schema, "parquet", glob="*.parquet", max_files_per_trigger=1)
    stream_merge(s2, root, "t", merge, chk)
    assert len(committed_versions(spark, root, "t")) == n_versions


def test_merge_into_partitions_incremental(spark):
    from tidemark.streaming.watch import merge_into_partitions
    path = tempfile.mkdtemp(prefix="tm-part-") + "/t"
    schema = "k string, d string, v string, _seq long"
    merge_into_partitions(spark.createDataFrame([("a", "d1", "1", 1), ("b", "d2", "1", 2)], schema), path, ["k", "d"], "d")
    merge_into_partitions(spark.createDataFrame([("a", "d1", "2", 3), ("c", "d1", "2", 4)], schema), path, ["k", "d"], "d")
    merge_into_partitions(spark.createDataFrame([("a", "d1", "2", 3), ("c", "d1", "2", 4)], schema), path, ["k", "d"], "d")
    got = sorted((r.k, r.d, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", "d1", "2"), ("b", "d2", "1"), ("c", "d1", "2")]


def test_archive_processed_files(spark):
    """T4: processed landing files are moved under the archive folder (Spark does this
    lazily, when a later micro-batch runs)."""
    landing = tempfile.mkdtemp(prefix="tm-arch-land-")
    archive = tempfile.mkdtemp(prefix="tm-arch-done-")
    root = tempfile.mkdtemp(prefix="tm-arch-root-")
    schema = "k string, v string, _seq long"
    for i in range(3):
        d = tempfile.mkdtemp(prefix="tm-arch-src-")
        spark.createDataFrame([(f"k{i}", "v", i)], schema).coalesce(1).write.mode("overwrite").parquet(d)
        part = [f for f in os.listdir(d) if f.endswith(".parquet")][0]
        os.rename(f"{d}/{part}", f"{landing}/f{i}.parquet")
    s = watch_landing(spark, landing, schema, "parquet", glob="*.parquet", max_files_per_trigger=1,
                      archive_dir=archive)
    stream_merge(s, root, "t", lambda b, st, i: accumulate_keep_last(st, b, ["k"]).drop("_batch"),
                 f"{root}/_chk")
    assert sorted(r.k for r in read_curated(spark, root, "t").collect()) == ["k0", "k1", "k2"]
    archived = [f for _, _, fs in os.walk(archive) for f in fs if f.endswith(".parquet")]
    assert "f0.parquet" in archived
    assert not os.path.exists(f"{landing}/f0.parquet")


def _land(spark, folder, name, rows, schema):
    """One parquet file of the landing folder."""
    d = tempfile.mkdtemp(prefix="tm-src-")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(d)
    part = [f for f in os.listdir(d) if f.endswith(".parquet")][0]
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{d}/{part}", f"{folder}/{name}.parquet")


def test_two_streams_and_a_batch_publish_lose_nothing(spark):
    from tidemark.sources.curated import merge_latest_and_publish, prune_versions
    root = tempfile.mkdtemp(prefix="tm-two-")
    schema = "k string, v string, _seq long"
    merge = lambda b, st, i: accumulate_keep_last(st, b, ["k"]).drop("_batch")
    for name in ("one", "two"):
        for i in range(3):
            _land(spark, f"{root}/land-{name}", f"f{i}", [(f"{name}{i}", "v", i)], schema)
        s = watch_landing(spark, f"{root}/land-{name}", schema, "parquet", glob="*.parquet", max_files_per_trigger=1)
        stream_merge(s, root, "t", merge, f"{root}/_chk-{name}")
    assert len(committed_versions(spark, root, "t")) == 6
    more = spark.createDataFrame([("batch", "v", 1)], schema)
    merge_latest_and_publish(spark, root, "t", lambda st: accumulate_keep_last(st, more, ["k"]).drop("_batch"))
    want = sorted([f"{n}{i}" for n in ("one", "two") for i in range(3)] + ["batch"])
    assert sorted(r.k for r in read_curated(spark, root, "t").collect()) == want
    assert len(prune_versions(spark, root, "t", keep=2)) == 5
    assert sorted(r.k for r in read_curated(spark, root, "t").collect()) == want


def test_commit_between_read_and_write_is_merged_again(spark):
    from tidemark.sources.curated import merge_latest_and_publish
    root = tempfile.mkdtemp(prefix="tm-race-")
    schema = "k string, _seq long"
    publish(spark.createDataFrame([("a", 1)], schema), root, "t")
    calls = []

    def merge(stored):
        if not calls:  # another writer commits while this one merges
            publish(stored.unionByName(spark.createDataFrame([("other", 2)], schema)), root, "t")
        calls.append(1)
        return stored.unionByName(spark.createDataFrame([("mine", 3)], schema))

    merge_latest_and_publish(spark, root, "t", merge)
    assert len(calls) == 2
    assert sorted(r.k for r in read_curated(spark, root, "t").collect()) == ["a", "mine", "other"]


def test_a_number_taken_is_a_conflict_not_a_gap(spark):
    """A marker nobody can read blocks the table: a writer must not commit behind it, as its owner may still finish."""
    from tidemark.sources.curated import CorruptCommitError, vacuum, write_new
    root = tempfile.mkdtemp(prefix="tm-half-")
    df = spark.createDataFrame([(1,)], "k int")
    v1 = publish(df, root, "t")
    open(f"{root}/t/_commits/{int(v1) + 1:012d}", "w").close()
    with pytest.raises(CorruptCommitError):
        publish(df, root, "t")
    with pytest.raises(CorruptCommitError):
        read_curated(spark, root, "t")
    os.remove(f"{root}/t/_commits/{int(v1) + 1:012d}")
    # a writer that dies before its marker appears takes no number
    os.makedirs(f"{root}/t/v=left")
    open(f"{root}/t/_commits/.draft", "w").close()
    assert int(publish(df, root, "t")) == int(v1) + 1
    assert vacuum(spark, root, "t") == [] and sorted(vacuum(spark, root, "t", -1)) == [".draft", "v=left"]
    assert read_curated(spark, root, "t").count() == 1
    assert write_new(spark, f"{root}/once", "a") and not write_new(spark, f"{root}/once", "b")
    assert open(f"{root}/once").read() == "a" and not [f for f in os.listdir(root) if f.startswith(".") and not f.endswith(".crc")]


def test_names_are_given_once(spark):
    from tidemark.sources.curated import link_new, rename_new
    root = tempfile.mkdtemp(prefix="tm-link-")
    for give in (link_new, rename_new):
        for name in "ab":
            with open(f"{root}/{name}", "w") as f:
                f.write(name)
        target = f"{root}/{give.__name__}"
        assert give(spark, f"{root}/a", target) and not give(spark, f"{root}/b", target)
        assert open(target).read() == "a"


def test_two_writers_at_once_both_survive(spark):
    """Writers in threads, each merging its rows many times: no row is lost, no number is skipped."""
    import threading
    from tidemark.sources.curated import merge_latest_and_publish
    root = tempfile.mkdtemp(prefix="tm-threads-")
    schema = "k string"
    publish(spark.createDataFrame([("start",)], schema), root, "t")
    faults = []

    def write(name):
        try:
            for i in range(4):
                merge_latest_and_publish(spark, root, "t", lambda st: st.unionByName(spark.createDataFrame([(f"{name}{i}",)], schema)), retries=20)
        except Exception as e:  # noqa: BLE001
            faults.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xyz"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not faults
    assert sorted(r.k for r in read_curated(spark, root, "t").collect()) == sorted(["start"] + [f"{n}{i}" for n in "xyz" for i in range(4)])
    assert [int(v) for v in committed_versions(spark, root, "t")] == list(range(1, 14))


def test_replays_are_known_from_the_newest_marker(spark):
    from tidemark.sources.curated import latest_commit
    root = tempfile.mkdtemp(prefix="tm-replay-")
    df = spark.createDataFrame([(1,)], "k int")
    for load in ("s1:0", "s2:0", "s1:1", "import-7"):
        assert publish(df, root, "t", version=load)
    for load in ("s1:0", "s1:1", "s2:0", "import-7"):
        assert publish(df, root, "t", version=load) is None
    assert publish(df, root, "t", version="s2:1")
    last = latest_commit(spark, root, "t")
    assert last.streams == {"s1": 1, "s2": 1} and last.recent == ("import-7",)


def test_publish_from_counts_while_rows_pass(spark):
    from tidemark.sources.curated import publish_from
    root = tempfile.mkdtemp(prefix="tm-fan-")
    source = spark.createDataFrame([(i, str(i)) for i in range(10)] + [(None, "x")], "k int, v string")
    res = publish_from(source, {"even": lambda d: d.where("k % 2 = 0"), "none": lambda d: d.where("k < 0"),
                                "bad": lambda d: d.selectExpr("k / nope"), "late": lambda d: d.selectExpr("cast('x' as int) as k")}, root, F.col("k") > 0)
    got = {r.table: (r.status, r.rows, r.rows_in, r.rows_rejected) for r in res.collect()}
    assert got == {"even": ("ok", 4, 11, 2), "none": ("skipped", 0, 11, 2), "bad": ("failed", None, 11, 2), "late": ("failed", None, 11, 2)}


def test_partition_merge_keeps_columns_and_null_partitions(spark):
    from tidemark.streaming.watch import merge_into_partitions
    path = tempfile.mkdtemp(prefix="tm-part2-") + "/t"
    merge_into_partitions(spark.createDataFrame([("a", "d1", "x", 1), ("n", None, "x", 2)], "k string, d string, extra string, _seq long"),
                          path, ["k"], "d")
    merge_into_partitions(spark.createDataFrame([("b", "d1", "new", 3), ("m", None, "new", 4)], "k string, d string, other string, _seq long"),
                          path, ["k"], "d")
    rows = spark.read.option("mergeSchema", True).parquet(path).select("k", "d", "extra", "other").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("a", "d1", "x", None), ("b", "d1", None, "new"), ("n", None, "x", None), ("m", None, None, "new")], key=str)


def test_failing_batch_reports_its_whole_error(spark):
    from tidemark.sources.status import read_status
    root = tempfile.mkdtemp(prefix="tm-fail-")
    schema = "k string, _seq long"
    assert read_status(spark, root).count() == 0
    _land(spark, f"{root}/land", "f0", [("a", 1)], schema)
    s = watch_landing(spark, f"{root}/land", schema, "parquet", glob="*.parquet")

    def merge(batch, stored, batch_id):
        raise ValueError("x" * 2000)

    with pytest.raises(Exception):
        stream_merge(s, root, "t", merge, f"{root}/_chk", job="j")
    row = read_status(spark, root).first()
    assert not row["ok"] and "x" * 2000 in row["error"]


def test_dictionary_fault_leaves_the_save_intact(spark):
    from tidemark.streaming.watch import merge_then_refill
    path = tempfile.mkdtemp(prefix="tm-dict-") + "/t"
    batch = spark.createDataFrame([("a", "d1", "w", None, 1)], "k string, d string, work_code string, hint string, _seq long")

    def broken():
        raise OSError("no dictionary")

    error = merge_then_refill(batch, path, ["k"], "d", "work_code", broken, None, "work", {"hint": "keyword"})
    assert "no dictionary" in error and spark.read.parquet(path).count() == 1
    words = spark.createDataFrame([("w", "word", 1)], "work string, keyword string, _seq long")
    assert merge_then_refill(batch, path, ["k"], "d", "work_code", lambda: words, None, "work", {"hint": "keyword"}) == ""
    assert spark.read.parquet(path).first()["hint"] == "word"
