"""Merge, join and aggregate fixtures (FIXTURES.md §4)."""
import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import aggregate as A
from tidemark.operators import joins as J
from tidemark.operators import merge as M
from tidemark.operators import quality as Qy
from tidemark.operators.schema import union_reconcile
from tidemark.operators.window import keep_last, keep_last_window


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_replace_by_key(spark):
    old = spark.createDataFrame([("SN1", "a", 1), ("SN1", "b", 2), ("SN2", "c", 3)], "PJT string, v string, _seq long")
    new = spark.createDataFrame([("1", "x", 1)], "PJT string, v string, _seq long")
    out = M.replace_by_key(old, new, "PJT")
    assert rows(out, "PJT", "v") == [("SN1", "x"), ("SN2", "c")]
    rep = M.merge_report(old, new, out).collect()[0]
    assert (rep.kept_rows, rep.replaced_rows) == (1, 2)


def test_accumulate_keep_last(spark):
    old = spark.createDataFrame([("k1", "old", 1), ("k2", "b", 2)], "k string, v string, _seq long")
    new = spark.createDataFrame([("k1", "new", 1), ("k1", "newer", 2), ("k3", "c", 3)], "k string, v string, _seq long")
    out = M.accumulate_keep_last(old, new, ["k"])
    assert rows(out, "k", "v") == [("k1", "newer"), ("k2", "b"), ("k3", "c")]


def test_accumulate_null_key(spark):
    old = spark.createDataFrame([(None, "A", 1)], "k string, v string, _seq long")
    new = spark.createDataFrame([(None, "B", 1)], "k string, v string, _seq long")
    assert rows(M.accumulate_keep_last(old, new, ["k"]), "k", "v") == [(None, "B")]


def test_accumulate_no_keys_no_dedup(spark):
    new = spark.createDataFrame([("a", 1), ("a", 1)], "v string, _seq long")
    assert M.accumulate_keep_last(None, new, ["missing"]).count() == 2


def test_upsert(spark):
    d = dt.date
    old = spark.createDataFrame([(d(2026, 3, 1), "v1"), (d(2026, 3, 2), "v1")], "forecast_date date, v string")
    new = spark.createDataFrame([(d(2026, 3, 2), "v2"), (d(2026, 3, 3), "v2")], "forecast_date date, v string")
    out = M.upsert_by_key(old, new).orderBy("forecast_date")
    assert [tuple(r) for r in out.select("forecast_date", "v").collect()] == [
        (d(2026, 3, 1), "v1"), (d(2026, 3, 2), "v2"), (d(2026, 3, 3), "v2")]


def test_append_unseen(spark):
    existing = spark.createDataFrame([("a", "done")], "f string, r string")
    inputs = spark.createDataFrame([("a",), ("b",)], "f string")
    seen = []

    def process(df):
        seen.append(sorted(r[0] for r in df.collect()))
        return df.withColumn("r", F.lit("new"))
    out = M.append_unseen(existing, inputs, "f", process)
    assert rows(out, "f", "r") == [("a", "done"), ("b", "new")]
    assert seen == [["b"]]


def _card(spark, data):
    cols = ["company", "period_start", "period_end", "work_content", "dept", "ra_done", "manual"]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))


def test_restore_state(spark):
    existing = _card(spark, [("K", "1", "2", "w", "d", "Y", "N"), ("M", "1", "2", "w", "d", "Y", "Y")]) \
        .withColumn("_seq", F.lit(0).cast("long"))
    derived = _card(spark, [("K", "1", "2", "w", "d", "N", "N"), ("L", "1", "2", "w", "d", "N", "N")])
    out = M.rederive_preserving_state(derived, existing, state_cols=["ra_done"])
    assert rows(out, "company", "ra_done", "manual") == [("K", "Y", "N"), ("L", "N", "N"), ("M", "Y", "Y")]


def test_restore_state_nothing_regenerated(spark):
    existing = _card(spark, [("M", "1", "2", "w", "d", "Y", "Y")]).withColumn("_seq", F.lit(0).cast("long"))
    derived = _card(spark, []).limit(0)
    out = M.rederive_preserving_state(derived, existing, state_cols=["ra_done"])
    assert rows(out, "company") == [("M",)]


def test_group_cards(spark):
    df = spark.createDataFrame(
        [("k", "A", "s1", "e1", 1, False), ("k", "B", "s2", "e1", 2, True), ("k", "A", "s3", "e2", 3, False),
         ("k", "", "s4", "e2", 4, False)],
        "key string, name string, visit_start string, visit_end string, _seq long, c boolean")
    out = A.group_cards(df, ["key"], joined=["name"], first=["visit_start"], last=["visit_end"], any_true=["c"])
    r = out.collect()[0]
    assert (r.name, r.visit_start, r.visit_end, r.c) == ("A, B", "s1", "e2", True)


def test_analyze_diff(spark):
    new = spark.createDataFrame([(2,), (4,)], "k int")
    old = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    r = Qy.analyze_diff(new, old, "k").collect()[0]
    assert (r.added, r.changed, r.kept, r.new_rows, r.exist_rows) == (1, 1, 2, 2, 3)


def test_lookup_fill(spark):
    dim = spark.createDataFrame([("W", "k1", "w1", 1), ("W", "k2", "w2", 2)], "work string, keyword string, warning string, _seq long")
    df = spark.createDataFrame([(1, "W", None), (2, "V", "old"), (3, None, None)], "id int, ACODENM string, risk_keywords string")
    out = J.lookup_fill(df, "ACODENM", dim)
    assert rows(out, "id", "risk_keywords", "warning") == [(1, "k2", "w2"), (2, "old", None), (3, None, None)]


def test_union_reconcile(spark):
    a = spark.createDataFrame([(1,)], "a bigint")
    b = spark.createDataFrame([("x", 5)], "a string, b int")
    out = union_reconcile([a, b])
    assert dict(out.dtypes) == {"a": "string", "b": "int"}
    assert rows(out, "a", "b") == [("1", None), ("x", 5)]


def test_keep_last_matches_window(spark):
    df = spark.range(0, 2000).select((F.col("id") % 37).alias("k"), (F.col("id") % 5).alias("k2"),
                                     F.col("id").alias("_seq"), F.lit(1).alias("_batch"),
                                     (F.col("id") * 3).alias("v"))
    a = keep_last(df, ["k", "k2"])
    b = keep_last_window(df, ["k", "k2"])
    assert rows(a, "k", "k2", "v") == rows(b, "k", "k2", "v")


def test_join_unique_equals_the_cards(spark):
    from tidemark.operators.aggregate import group_cards, join_unique
    rows = [("a", "x", 3), ("a", "y", 1), ("a", "x", 0), ("a", "nan", 2), ("b", None, 4), ("b", "", 5), ("c", "z", 6)]
    df = spark.createDataFrame(rows, "k string, name string, _seq long")
    cards = {r.k: r.name for r in group_cards(df, ["k"], joined=("name",)).collect()}
    alone = {r.k: r.name for r in join_unique(df, ["k"], "name").collect()}
    assert cards == {"a": "x, y", "b": "", "c": "z"} and alone == {"a": "x, y", "c": "z"}
