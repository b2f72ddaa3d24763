"""Queries of landed files looked at again, documents from files, catalog options, dictionary refresh and whole pipelines."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.documents import accident_items, guide_items
from ..operators.quality import archive_plan, archive_totals, health_report
from ..operators.window import keep_latest_n
from ..session import scratch_path
from ..sources.curated import delete_path, hadoop_path, publish, read_curated
from ..sources.files import file_manifest, read_documents
from ..sources.landing import scan_landing
from . import sqlfrag as Q
from .models import failing_model, text_model
from .pipelines import PIPELINES
from .q_docs import RUN_DATE, _SQL_MIGRATED
from .q_more import _AS_OF, _CATALOG, _CATALOG_SQL
from .queries import register
from .views import read, v_dict, v_message, v_permit, with_views


# ---------------------------------------------------------------------- S7 into W4, W2 and Q11, from files
def land_named(rows, folder):
    """Land (name, line) rows as one text file per name; returns the names.  A loop over names: a landing folder of one query."""
    spark = rows.sparkSession
    staged = scratch_path(spark, "staged")
    rows.select("name", "line").repartition("name").write.partitionBy("name").text(staged)
    fs, top = hadoop_path(spark, staged)
    _, target = hadoop_path(spark, folder)
    fs.mkdirs(target)
    path, names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for part in fs.listStatus(top):
        key, _, name = part.getPath().getName().partition("=")
        if key == "name":
            file = next(f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-"))
            fs.delete(path(f"{folder}/{name}"), False)
            fs.rename(file, path(f"{folder}/{name}"))
            names.append(name)
    delete_path(spark, staged)
    return names


def set_month_times(spark, folder, names):
    """Give files named by month (yyyy-MM in the name) the first of that month as their time."""
    import calendar
    import re
    fs, _ = hadoop_path(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in names:
        year, month = map(int, re.search(r"(\d{4})-(\d{2})", name).groups())
        fs.setTimes(path(f"{folder}/{name}"), calendar.timegm((year, month, 1, 12, 0, 0)) * 1000, -1)


def order_files(spark, sf_dir, name="orders_%s.csv"):
    """(month, name, line): one file of order keys per month."""
    month = tf.format_ntz(F.col("o_orderdate"), "yyyy-MM")
    before, _, after = name.partition("%s")
    return read(spark, sf_dir, "orders").select(month.alias("month"), F.concat(F.lit(before), month, F.lit(after)).alias("name"),
                                                F.col("o_orderkey").cast("string").alias("line"))


_MONTHS = "months AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)"


@register("landing_scan", f"""
WITH {_MONTHS}
SELECT 1 AS scan, 'orders_' || month || '.csv' AS file_name, 'new' AS state FROM months WHERE month < '1998'
UNION ALL
SELECT 2, 'orders_' || month || '.csv', CASE WHEN month >= '1998' THEN 'new' WHEN month < '1993' THEN 'gone'
  WHEN month LIKE '1995%' THEN 'changed' ELSE 'same' END FROM months""")
def q_landing_scan(spark, sf_dir):
    """S7 + W4: a folder listed twice; between the looks files of 1998 arrive, those of 1995 grow, those of 1992 go."""
    root = scratch_path(spark, "landing-scan")
    folder, files = f"{root}/land", order_files(spark, sf_dir)
    names = land_named(files.where("month < '1998'"), folder)
    first = scan_landing(spark, folder, root, glob="*.csv").select(F.lit(1).alias("scan"), "file_name", "state")
    grown = files.where("month like '1995%'")
    land_named(grown.unionByName(grown), folder)
    land_named(files.where("month >= '1998'"), folder)
    for name in names:
        if name.startswith("orders_1992"):
            delete_path(spark, f"{folder}/{name}")
    second = scan_landing(spark, folder, root, glob="*.csv").select(F.lit(2).alias("scan"), "file_name", "state")
    return first.unionByName(second)


@register("landing_surplus", f"""
WITH {_MONTHS},
f AS (SELECT 'orders' AS section, 'orders_' || month || '.csv' AS file_name, month FROM months
      UNION ALL SELECT 'recent', 'recent_' || month || '.csv', month FROM months WHERE month >= '1998-05'),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY month DESC) AS rn FROM f)
SELECT section, file_name, CASE WHEN rn <= 7 THEN 'keep' ELSE 'delete' END AS action, CASE WHEN rn <= 7 THEN CAST(rn AS INTEGER) END AS rank FROM r""")
def q_landing_surplus(spark, sf_dir):
    """S7 + W2: of two folders of real files the seven newest of each stay, by the files' own times."""
    root = scratch_path(spark, "landing-surplus")
    for section, rows in (("orders", order_files(spark, sf_dir)), ("recent", order_files(spark, sf_dir, "recent_%s.csv").where("month >= '1998-05'"))):
        set_month_times(spark, f"{root}/land/{section}", land_named(rows, f"{root}/land/{section}"))
    files = file_manifest(spark, f"{root}/land", "*.csv", recursive=True).select("section", "file_name", "modification_time")
    return keep_latest_n(files, "section", 7).select("section", "file_name", "action", "rank")


@register("archive_totals", f"""
WITH {_MONTHS},
p AS (SELECT CASE WHEN month >= '1998' THEN 'ignore' WHEN month < '1994' THEN 'duplicate' ELSE 'move' END AS action,
        CASE WHEN month LIKE '1996%' THEN 2 ELSE 1 END AS depth FROM months)
SELECT coalesce(action, '(all)') AS action, count(*) AS files, count(*) FILTER (WHERE depth > 1) AS nested, CAST(max(depth) AS INTEGER) AS deepest
FROM p GROUP BY ROLLUP (action)""")
def q_archive_totals(spark, sf_dir):
    """S7 + Q11 with its totals: landed files with one date prefix (two in 1996), no data files of 1998, those before 1994 archived."""
    root = scratch_path(spark, "archive-totals")
    files = order_files(spark, sf_dir)
    prefix = F.concat(F.replace("month", F.lit("-"), F.lit("")), F.lit("01_"))
    name = F.concat(prefix, F.when(F.col("month").like("1996%"), F.lit("20200101_")).otherwise(F.lit("")),
                    F.when(F.col("month") >= "1998", F.replace("name", F.lit(".csv"), F.lit(".txt"))).otherwise(F.col("name")))
    land_named(files.withColumn("name", name), f"{root}/orders")
    land_named(files.where("month < '1994'"), f"{root}/archive/orders")
    return archive_totals(archive_plan(file_manifest(spark, f"{root}/orders"), file_manifest(spark, f"{root}/archive/orders")))


# ---------------------------------------------------------------------- S6 into C9
@register("documents_files", f"""
WITH d AS (SELECT 'item_' || CAST(item_id AS VARCHAR) AS stem, text || chr(10) AS text, CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 2 END AS run FROM benchmark)
SELECT 'guide' AS kind, stem || '#1' AS id, 'T' || CAST(length(text) AS VARCHAR) AS title, stem || '.txt' AS pdf_filename, run, md5(text) AS text_md5 FROM d
UNION ALL SELECT 'guide', 'S', stem, stem || '.txt', run, md5(text) FROM d
UNION ALL SELECT 'accident', stem || '#1', 'S' || CAST(length(text) AS VARCHAR), stem || '.txt', run, md5(text) FROM d""")
def q_documents_files(spark, sf_dir):
    """S6 + C9: documents read whole from files, guides and accident reports; the second run answers only the files that have
    arrived since the first."""
    root = scratch_path(spark, "documents-files")
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"),
                                                    F.col("text").alias("line"), (F.length("text") % 2 == 0).alias("early"))
    halves = {"guide": guide_items, "accident": lambda d: accident_items(d, RUN_DATE)}
    for run, rows in ((1, items.where("early")), (2, items.where("not early"))):
        land_named(rows, f"{root}/land")
        docs = read_documents(spark, f"{root}/land", "*.txt").withColumnRenamed("file_name", "pdf_filename")
        for kind, make in halves.items():
            stored = read_curated(spark, root, kind)
            publish(PIPELINES["documents"](docs, stored, text_model, items=lambda d, make=make, run=run: make(d).withColumn("run", F.lit(run))), root, kind)
    out = [read_curated(spark, root, kind).select(F.lit(kind).alias("kind"), "id", F.col("title" if kind == "guide" else "summary").alias("title"),
                                                  "pdf_filename", "run", F.md5(F.col("text").cast("binary")).alias("text_md5")) for kind in halves]
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------------- F10 / C12, Q3
_LABELS = {"orders": ("Order book", "sales"), "customer": ("Customers", "sales"), "part": ("Parts", "stock"), "supplier": ("Suppliers", "stock"),
           "nothing": ("No rows", "stock"), "broken": ("Broken table", "other"), "missing": ("No file", "other")}
_OPTIONS = {"all": {}, "has_key": {"has_key": True}, "recency": {"recency": ("old", "none")}, "today": {"period": "today"},
            "7 days": {"period": "7 days"}, "30 days": {"period": "30 days"}, "check": {"check": True}, "search": {"search": " SALES"},
            "several": {"has_key": True, "recency": ("new", "old"), "search": "book"}}
_OPTION_SQL = {"all": "true", "has_key": "coalesce(keys, 0) > 0", "recency": "recency IN ('old', 'none')", "today": "recency = 'new'",
               "7 days": "recency IN ('new', 'mid')", "30 days": "recency IN ('new', 'mid')", "check": "status IN ('warn', 'empty')",
               "search": "category = 'sales'", "several": "\"table\" = 'orders' AND recency IN ('new', 'old')"}


def catalog_tables(spark, sf_dir):
    """The catalog's tables: four that are there, one without rows, one that breaks at its last rows, one that is missing."""
    broken = lambda: read(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") >= 0, F.raise_error(F.lit("bad block"))).cast("long").alias("k")).where("k > 0")
    return {**{t: read(spark, sf_dir, t) for t in _CATALOG}, "nothing": read(spark, sf_dir, "orders").where("o_orderkey < 0"), "broken": broken,
            "missing": lambda: spark.read.parquet(f"{sf_dir}/no such table")}


@register("catalog_options", f"""
WITH c AS ({_CATALOG_SQL}
  UNION ALL SELECT 'nothing', 0, 0, 'empty', 'none' UNION ALL SELECT 'broken', NULL, NULL, 'warn', 'none' UNION ALL SELECT 'missing', NULL, NULL, 'warn', 'none'),
l("table", category) AS (VALUES {', '.join(f"('{t}', '{c}')" for t, (_, c) in _LABELS.items())}),
m AS (SELECT c.*, category FROM c JOIN l USING ("table"))
""" + "\nUNION ALL ".join(f"SELECT '{name}' AS option, \"table\", rows, keys, status, recency FROM m WHERE {where}" for name, where in _OPTION_SQL.items()))
def q_catalog_options(spark, sf_dir):
    """The catalog under each named option of F10 and under several; tables that cannot be read show as 'warn'."""
    times = spark.createDataFrame([(t, m, a) for t, (_, m, a) in _CATALOG.items()], "table string, modified string, auto boolean").withColumn(
        "modified", F.col("modified").cast("timestamp_ntz"))
    labels = spark.createDataFrame([(t, *x) for t, x in _LABELS.items()], "table string, label string, category string")
    keys = {**{t: k for t, (k, _, _) in _CATALOG.items() if k}, "nothing": "o_orderkey"}
    whole = PIPELINES["catalog"](catalog_tables(spark, sf_dir), keys, times, _AS_OF, labels).checkpoint(eager=True)
    from ..operators.filters import catalog_filter
    out = None
    for name, options in _OPTIONS.items():
        rows = whole.filter(catalog_filter(searched=("label", "table", "category"), **options)).select(
            F.lit(name).alias("option"), "table", "rows", "keys", "status", "recency")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("health_found", """
SELECT * FROM (VALUES ('broken', 'FAIL'), ('missing', 'FAIL'), ('weather', 'WARN')) v("table", "check") CROSS JOIN (SELECT CAST(NULL AS VARCHAR) AS detail)
UNION ALL SELECT 'orders', 'PASS', CAST(count(*) AS VARCHAR) || ' x ' || CAST((SELECT count(*) FROM (DESCRIBE orders)) AS VARCHAR) FROM orders
UNION ALL SELECT 'part', 'PASS', CAST(count(*) AS VARCHAR) || ' x ' || CAST((SELECT count(*) FROM (DESCRIBE part)) AS VARCHAR) FROM part
UNION ALL SELECT '(found)', 'WARN', '2/5'""")
def q_health_found(spark, sf_dir):
    """Q3: the report tries to read the tables itself: one is missing, one breaks while it is counted, one is not listed."""
    h = health_report(spark, catalog_tables(spark, sf_dir), ("orders", "part", "broken", "missing", "weather"))
    return h.select("table", "check", F.when(F.col("check").isin("PASS") | (F.col("table") == "(found)"), F.col("detail")).alias("detail"))


# ---------------------------------------------------------------------- X5 / Q8 / C10
_SQL_GEN = """
dict AS (SELECT trim(work) AS work, coalesce(arg_max(keyword, _seq), '') AS keyword, coalesce(arg_max(warning, _seq), '') AS warning
         FROM v_dict WHERE trim(work) <> '' GROUP BY 1),
asked AS (SELECT DISTINCT trim(ACODENM) AS work FROM v_permit WHERE trim(ACODENM) <> '' AND trim(ACODENM) NOT IN (SELECT work FROM dict)),
d AS (SELECT * FROM dict UNION ALL SELECT work, 'KW-' || upper(work), 'check ' || work FROM asked WHERE NOT starts_with(work, 'CONF'))"""


@register("dictionary_refresh", with_views("v_permit", "v_dict") + "," + _SQL_GEN + """
SELECT _seq, ACODENM, d.keyword AS risk_keywords, d.warning FROM v_permit LEFT JOIN d ON trim(v_permit.ACODENM) = d.work""")
def q_dictionary_refresh(spark, sf_dir):
    """A stored dictionary, a model that fails for some keys, the dictionary merged at the write, rows filled; a second
    refresh asks only for the keys that failed."""
    return _refreshed(spark, sf_dir)[0]


def _refreshed(spark, sf_dir):
    root = scratch_path(spark, "refresh")
    publish(v_dict(spark, sf_dir).select(F.trim("work").alias("work"), "keyword", "warning", F.col("_seq").cast("long").alias("_seq")), root, "mapping")
    rows = v_permit(spark, sf_dir).select("_seq", "ACODENM")
    refresh = PIPELINES["dictionary_refresh"]
    _, first = refresh(rows, "ACODENM", root, "mapping", failing_model)
    first = first.checkpoint(eager=True)
    filled, second = refresh(rows, "ACODENM", root, "mapping", failing_model)
    return filled, first, second


@register("enrich_errors", with_views("v_permit", "v_dict") + "," + _SQL_GEN + """,
f AS (SELECT work FROM asked WHERE starts_with(work, 'CONF'))
SELECT 1 AS run, count(*) AS keys, count(*) - (SELECT count(*) FROM f) AS ok, (SELECT count(*) FROM f) AS failed,
  count(*) - (SELECT count(*) FROM f) AS added, (SELECT 'ValueError: no answer for ' || min(work) FROM f) AS first_error FROM asked
UNION ALL SELECT 2, count(*), 0, count(*), 0, 'ValueError: no answer for ' || min(work) FROM f""")
def q_enrich_errors(spark, sf_dir):
    """X5 + Q8: keys asked, answered, failed and added, and the first error, from calls that fail; two runs."""
    _, first, second = _refreshed(spark, sf_dir)
    return first.select(F.lit(1).alias("run"), "*").unionByName(second.select(F.lit(2).alias("run"), "*"))


# ---------------------------------------------------------------------- whole pipelines: C7, C8, C11, C13, S3
@register("message_board", with_views("v_message") + "," + _SQL_MIGRATED + """,
b AS (SELECT date, team, content, ref_type, ref_path FROM migrated WHERE turn < 2
      UNION ALL SELECT date, team, content, ref_type, ref_path FROM migrated WHERE turn >= 2),
k AS (SELECT * FROM b WHERE NOT (team = 'assistant' AND ref_type = 'link')),
s AS (SELECT * FROM k WHERE contains(lower(content), 'an.') OR contains(lower(team), 'an.') OR contains(lower(ref_path), 'an.'))
SELECT date, team, content, ref_type, ref_path, dense_rank() OVER (PARTITION BY team, date ORDER BY content, ref_type, ref_path) = 1 AS is_first_of_date FROM s""")
def q_message_board(spark, sf_dir):
    """C11: stored messages migrated, new ones appended, some deleted, a literal search, first-of-date flags."""
    m = v_message(spark, sf_dir)
    legacy = m.select("date", "team", "message", "ref_type", "ref_path", "turn")
    return PIPELINES["messages"](legacy.where("turn < 2").drop("turn"), legacy.where("turn >= 2").drop("turn"),
                                 {"team": "assistant", "ref_type": "link"}, "AN.")


@register("custom_table", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""")
def q_custom_table(spark, sf_dir):
    """Any landed files as a table of text columns, published and read back."""
    root = scratch_path(spark, "custom")
    read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").write.option("header", True).csv(f"{root}/land")
    publish(PIPELINES["custom_table"](spark, f"{root}/land", "csv", "*.csv"), root, "custom")
    return read_curated(spark, root, "custom")


@register("mirror_steps", f"""
WITH s AS (SELECT *, CAST('2024-03-01' AS TIMESTAMP) + to_hours(CAST(s_suppkey % 40 AS BIGINT)) AS t FROM supplier)
SELECT {Q.ensure_sn("CAST(s_suppkey + 2601 AS VARCHAR)")} AS project, CASE WHEN s_suppkey % 4 = 0 THEN '98K Ethane' ELSE 'VLCC' END AS "TYPEMODEL",
  CASE WHEN s_suppkey % 4 = 0 THEN 'LPG' ELSE 'OIL' END AS "SHIPTYPE", t AS "WORKFINISH", CAST(t AS VARCHAR) AS "NOTE" FROM s""")
def q_mirror_steps(spark, sf_dir):
    """C8 without its database: personal data dropped, times converted where they are times, key renamed and canonical, ETHANE."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    t = F.timestamp_add("HOUR", k % 40, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    kr = F.concat(tf.format_ntz(t, "yyyy-MM-dd"), F.when(F.hour(t) < 12, F.lit(" 오전 ")).otherwise(F.lit(" 오후 ")), tf.format_ntz(t, "h:mm:ss"))
    source = s.select((k + 2601).cast("string").alias("SHIPNUM"), F.col("s_name").alias("INSERTBY"), F.col("s_phone" if "s_phone" in s.columns else "s_name").alias("TEL"),
                      F.when(k % 4 == 0, F.lit("98K Ethane")).otherwise(F.lit("VLCC")).alias("TYPEMODEL"), F.lit("OIL").alias("SHIPTYPE"),
                      kr.alias("WORKFINISH"), tf.format_ntz(t, "yyyy-MM-dd HH:mm:ss").alias("NOTE"))
    frame, _ = PIPELINES["mirror"](source)
    return frame.select("project", "TYPEMODEL", "SHIPTYPE", "WORKFINISH", "NOTE")


@register("curated_versions", """
SELECT 'version 1' AS what, count(*) AS rows, sum(o_custkey) AS keys FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'current', count(*), sum(o_custkey) FROM orders
UNION ALL SELECT 'replay', count(*), sum(o_custkey) FROM orders
UNION ALL SELECT 'absent', 0, NULL""")
def q_curated_versions(spark, sf_dir):
    """S3 + K1: two versions of a table, the older one still readable; a load published twice counts once; an absent table is empty."""
    root = scratch_path(spark, "versions")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    v1 = publish(o.where("o_orderstatus = 'F'"), root, "orders", version="load:1")
    publish(o, root, "orders", version="load:2")
    publish(o.where("o_orderstatus = 'F'"), root, "orders", version="load:1")
    frames = {"version 1": read_curated(spark, root, "orders", version=v1), "current": read_curated(spark, root, "orders"),
              "replay": read_curated(spark, root, "orders"), "absent": read_curated(spark, root, "none", o.schema)}
    out = None
    for what, df in frames.items():
        row = df.agg(F.lit(what).alias("what"), F.count("*").alias("rows"), F.sum("o_custkey").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out
