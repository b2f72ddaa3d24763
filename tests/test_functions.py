"""Golden truth tables for the scalar functions (FIXTURES.md §3)."""
import datetime as dt

from pyspark.sql import functions as F

import tidemark.functions as tf


def one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_ensure_sn(spark):
    ins = ["SN2601", " sn2601 ", "S2601", "2601", "2601.0", "S", "s26a", "ABC-1", None, "",
           "nan", "NaT", "None", "SN"]
    out = ["SN2601", "SN2601", "SN2601", "SN2601", "2601.0", "S", "S26A", "ABC-1", "", "",
           "", "", "", "SN"]
    assert one(spark, ins, tf.ensure_sn) == out


def test_parse_ts_mixed(spark):
    T = dt.datetime
    cases = {
        "2026-06-14 02:30 PM": T(2026, 6, 14, 14, 30),
        "2026/06/14 2:30:15 am": T(2026, 6, 14, 2, 30, 15),
        "2026-06-14 오후 2:30:00": T(2026, 6, 14, 14, 30),
        "2026/06/14 오전 12:05": T(2026, 6, 14, 0, 5),
        "2026-06-14 14:30 PM": None,
        "": None, "nan": None, None: None,
        "2026-06-14": T(2026, 6, 14),
        "26/05/06 08:00": None,
    }
    assert one(spark, list(cases), tf.parse_ts_mixed) == list(cases.values())


def test_excel_serial(spark):
    got = one(spark, [45000.5, 999.0, 200000.0, None], lambda c: tf.parse_ts_mixed(c, numeric=True),
              "double")
    assert got == [dt.datetime(2023, 3, 15, 12, 0), None, None, None]


def test_parse_ts_formats(spark):
    T = dt.datetime
    cases = {"26/05/06 08:00": T(2026, 5, 6, 8, 0), "2026/05/06 08:00": T(2026, 5, 6, 8, 0),
             "2026-05-06 08:00:30": T(2026, 5, 6, 8, 0, 30), "99/05/06 08:00": T(1999, 5, 6, 8, 0),
             "x": None}
    assert one(spark, list(cases), tf.parse_ts_formats) == list(cases.values())


def test_parse_date_flex(spark):
    cases = {"20260614": dt.date(2026, 6, 14), "20260230": None,
             "2026-06-14": dt.date(2026, 6, 14), "": None}
    assert one(spark, list(cases), tf.parse_date_flex) == list(cases.values())


def test_masks(spark):
    names = ["홍길동", "이순", "K", "Kim, Lee", "Christopher", ""]
    assert one(spark, names, tf.mask_name) == ["홍*동", "이*", "K", "K*m, L*e", "C*********r", ""]
    phones = ["010-1234-5678", "01012345678", "0212345678", "010-1, 010-2", "123", "010 1234 5678"]
    assert one(spark, phones, tf.mask_phone) == ["010-****-5678", "010****5678", "021****678",
                                                 "****", "***-****-****", "010****5678"]


def test_compass(spark):
    got = one(spark, [0.0, 11.25, 11.5, 33.75, 180.0, 348.75, 360.0, None], tf.compass16, "double")
    assert got == ["N", "N", "NNE", "NE", "S", "N", "N", "-"]


def test_publication_slot(spark):
    T = dt.datetime
    ts = [T(2026, 3, 1, 0, 5), T(2026, 3, 1, 2, 9), T(2026, 3, 1, 2, 10), T(2026, 3, 1, 5, 9),
          T(2026, 3, 1, 23, 10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t timestamp_ntz")
    got = [tuple(r[0]) for r in df.orderBy("i").select(tf.publication_slot("t")).collect()]
    assert got == [("20260228", "2300"), ("20260228", "2300"), ("20260301", "0200"),
                   ("20260301", "0200"), ("20260301", "2300")]


def test_strip_prefix_and_json(spark):
    df = spark.createDataFrame([("20260731_20260730_foo.xlsx",), ("foo.xlsx",)], "n string")
    got = [(r[0], r[1]) for r in df.select(tf.strip_date_prefixes("n"), tf.date_prefix_depth("n")).collect()]
    assert got == [("foo.xlsx", 2), ("foo.xlsx", 0)]
    answers = ['<think>a</think>{"k":1}', '```json {"k":1} ```', 'note {"k":1} end', "nothing"]
    assert one(spark, answers, tf.clean_llm_json) == ['{"k":1}'] * 3 + [None]


def test_suffix_override_and_misc(spark):
    df = spark.createDataFrame([("98K ethane ", "X"), ("98K LNG", "Y")], "m string, t string")
    assert [r[0] for r in df.select(tf.suffix_override("m", "t")).collect()] == ["LPG", "Y"]
    assert one(spark, [2701.0, 2701.5, None], tf.int_like_float_to_string, "double") == \
        ["2701", "2701.5", None]
    assert one(spark, ["3월", "x", None, " 12 "], tf.to_int_default) == [3, 0, 0, 12]


def test_parse_by_type(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 6, 14, 14, 30, 0, 123000), 45000.5, "2026-06-14 02:30 PM")],
                               "t timestamp_ntz, x double, s string")
    r = df.select(tf.parse_ts_by_type(df, "t").alias("t"), tf.parse_ts_by_type(df, "x").alias("x"),
                  tf.parse_ts_by_type(df, "s").alias("s")).collect()[0]
    assert r.t == dt.datetime(2026, 6, 14, 14, 30, 0, 123000)
    assert r.x == dt.datetime(2023, 3, 15, 12, 0)
    assert r.s == dt.datetime(2026, 6, 14, 14, 30)


def test_zone_independent_formatting(spark):
    """A wall-clock time inside a DST gap keeps its text whatever the session zone."""
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([(dt.datetime(2001, 4, 1, 2, 30),)], "t timestamp_ntz")
        r = df.select(tf.format_ntz("t", "yyyy-MM-dd HH:mm hh a").alias("s"),
                      tf.publication_slot("t").alias("p")).collect()[0]
        assert r.s == "2001-04-01 02:30 02 AM"
        assert tuple(r.p) == ("20010401", "0200")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_time_columns_stay_within_what_the_jvm_compiles(spark):
    """The JVM does not compile methods of over 8,000 bytes; a sheet with several time and number columns must stay well below."""
    from tidemark.plans.pipelines import sheet_pipeline
    columns = ["PJT", "Start", "Finish", "HFO(ton)", "LS HFO (ton)", "LS MGO"]
    raw = spark.createDataFrame([tuple("x" * len(columns))], ", ".join(f"`{c}` string" for c in columns)).where("PJT <> ''")
    path = __import__("tempfile").mkdtemp(prefix="tm-gen-") + "/t"
    raw.toDF(*[f"c{i}" for i in range(len(columns))]).write.parquet(path)
    stored = spark.read.parquet(path).toDF(*columns)
    module = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    stages = module.codegenStringSeq(sheet_pipeline(stored, "fuel_usage")._jdf.queryExecution().executedPlan())
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 6000, sizes


def test_shapes_of_times(spark):
    """Edges of the accepted shapes: wrong widths, trailing text, impossible clocks, empty and control characters."""
    import datetime as dt
    from tidemark.functions import parse_ts_formats, parse_ts_mixed
    T = dt.datetime
    cases = {"2024-05-01 3:05 PM": T(2024, 5, 1, 15, 5), "2024/05-01 12:05:10 am tail": T(2024, 5, 1, 0, 5, 10), "2024-05-01 오후 3:05:1": T(2024, 5, 1, 15, 5),
             "2024-05-01 오전 12:00": T(2024, 5, 1), "2024-05-01 13:05 PM": None, "2024-5-01 3:05 PM": None, "2024-05-01 3:05:1 PM": None,
             "2024-5-1 3:5:7": T(2024, 5, 1, 3, 5, 7), "2024/5-1": None, "20240501": T(2024, 5, 1), "2024.5.1": T(2024, 5, 1), "2024.5.1 3:05": None,
             "2024-05-01T3:5:7": T(2024, 5, 1, 3, 5, 7), "2024-05-01T3:5": None, "2024-02-30": None, "2024-05-01 24:00": None, "": None, " ": None,
             "\x01|2024|01|01": None, "24/5/1 3:05": None, "2024-05-01 x": None, "202405011": None, " 2024-05-01 ": T(2024, 5, 1), None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.t for r in df.select("s", parse_ts_mixed("s").alias("t")).collect()}
    assert got == cases
    short = {"24/5/1 3:05": T(2024, 5, 1, 3, 5), "68/12/31 23:59:59": T(2068, 12, 31, 23, 59, 59), "69/01/01 0:0": T(1969, 1, 1), "24/5/1": None,
             "2024/5/1 3:05": T(2024, 5, 1, 3, 5), "24-5-1 3:05": None, "2024-05-01 3:05 PM": None}
    df = spark.createDataFrame([(k,) for k in short], "s string")
    assert {r.s: r.t for r in df.select("s", parse_ts_formats("s").alias("t")).collect()} == short
