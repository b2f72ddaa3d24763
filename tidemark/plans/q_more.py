"""Queries of operators that no pipeline query reaches: headers, files, previews, sheets with a stored table, catalog."""
from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.aggregate import count_true
from ..operators.filters import all_of, drop_null_time, equal_null_safe
from ..operators.quality import catalog_metadata, diff_preview, enrich_outcome, table_health
from ..operators.schema import first_present, front_columns, lower_headers, nfc_headers
from ..operators.window import changed_since, preview, sort_nulls_last, union_all
from ..sources.files import PERMIT_FILE_GLOBS, match_files
from . import sqlfrag as Q
from .pipelines import PLAN_COLUMNS, PLAN_FLOAT_COLS, forecast_pipeline, plan_pipeline_from_cells, sheet_pipeline, unreadable_forecast_rows
from .q_docs import SQL_V_MANIFEST, _SQL_MIGRATED, _migrated, v_manifest
from .queries import register
from .views import read, v_fuel_new, v_fuel_old, with_views


@register("lower_front_headers", """
SELECT p_partkey AS project, p_name, p_brand, p_size AS "크기" FROM part""")
def q_lower_front_headers(spark, sf_dir):
    """P4 lower case, P5 NFC (a decomposed header), P3 first present key, P11 listed columns first."""
    decomposed = unicodedata.normalize("NFD", "크기")
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("P_Name"), F.col("p_size").alias(decomposed),
                                           F.col("p_brand").alias("P_BRAND"), F.col("p_partkey").alias("SHIPNUM"))
    d = nfc_headers(lower_headers(first_present(p, ["PJT", "SHIPNUM"], "project")))
    return front_columns(d, ["project", "p_name"])


@register("int_like_text", """
SELECT l_orderkey, l_linenumber, CASE WHEN q = floor(q) THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS q
FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) / 2 END AS q FROM lineitem) l""")
def q_int_like_text(spark, sf_dir):
    """Whole numbers without a fraction, others with it, null stays null."""
    x = F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double") / 2)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tf.int_like_float_to_string(x).alias("q"))


@register("message_select", with_views("v_message") + "," + _SQL_MIGRATED + """
SELECT * FROM migrated WHERE team = 'assistant' AND ref_type = 'link' AND date IS NOT DISTINCT FROM '2024-01-05'""")
def q_message_select(spark, sf_dir):
    """rows equal (null-safe) on three columns."""
    return _migrated(spark, sf_dir).filter(equal_null_safe({"team": "assistant", "ref_type": "link", "date": "2024-01-05"}))


@register("flag_counts", """
SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1""")
def q_flag_counts(spark, sf_dir):
    """A10: number of true flags."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(count_true(F.col("o_totalprice") > 100000).alias("large"),
                                          count_true(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@register("files_changed", "WITH " + SQL_V_MANIFEST + """,
f AS (SELECT section, file_name, CASE WHEN _seq % 11 = 0 THEN NULL ELSE modification_time END AS modification_time FROM v_manifest),
seen AS (SELECT file_name, CASE WHEN _seq % 11 = 0 THEN NULL WHEN _status = 'F' THEN modification_time END AS modification_time
         FROM v_manifest WHERE _status <> 'O')
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.file_name = f.file_name
    AND s.modification_time IS NOT DISTINCT FROM f.modification_time)
  AND (modification_time IS NULL OR modification_time > TIMESTAMP '1995-06-01 00:00:00')""")
def q_files_changed(spark, sf_dir):
    """Files that are new or have another time than seen, newer than the target or of unknown time."""
    m = v_manifest(spark, sf_dir)
    time = F.when(F.col("_seq") % 11 != 0, F.col("modification_time"))
    files = m.select("section", "file_name", time.alias("modification_time"))
    seen = m.filter("_status <> 'O'").select("file_name", F.when(F.col("_status") == "F", time).alias("modification_time"))
    target = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    return changed_since(files, seen, target_mtime=target)


@register("sorted_preview", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer
ORDER BY bal DESC NULLS LAST, c_custkey DESC LIMIT 200""")
def q_sorted_preview(spark, sf_dir):
    """O1 + O2: the first 200 rows (a preview is the feature) in descending order, nulls last."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("bal"))
    return preview(sort_nulls_last(c, ["bal", "c_custkey"], desc=True), 200)


@register("matched_files", "WITH " + SQL_V_MANIFEST + """,
n AS (SELECT _seq, CASE _seq % 4 WHEN 0 THEN 'My_PTWLIST_' || file_name WHEN 1 THEN '_ptwlist' || file_name
                   WHEN 2 THEN '밀폐구역 ' || file_name ELSE file_name END AS name FROM v_manifest)
SELECT _seq, name FROM n WHERE name NOT LIKE '\\_%' ESCAPE '\\' AND (
  lower(name) LIKE '%ptwlist%.xlsx' OR lower(name) LIKE '%ptwlist%.xls' OR lower(name) LIKE '밀폐구역%.xlsx' OR lower(name) LIKE '밀폐구역%.xls')""")
def q_matched_files(spark, sf_dir):
    """Base names that match a glob in any case and do not start with '_'."""
    f = F.col("file_name")
    name = (F.when(F.col("_seq") % 4 == 0, F.concat(F.lit("My_PTWLIST_"), f)).when(F.col("_seq") % 4 == 1, F.concat(F.lit("_ptwlist"), f))
            .when(F.col("_seq") % 4 == 2, F.concat(F.lit("밀폐구역 "), f)).otherwise(f))
    m = v_manifest(spark, sf_dir).select("_seq", name.alias("name"))
    return m.filter(match_files("name", PERMIT_FILE_GLOBS))


@register("union_columns", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def q_union_columns(spark, sf_dir):
    """Union of the columns, missing ones null."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return union_all([c, s])


@register("diff_preview", with_views("v_fuel") + f""",
n AS (SELECT {Q.ensure_sn('PJT')} AS PJT, HFO, _seq FROM v_fuel_new)
SELECT PJT, HFO, _seq, CASE WHEN PJT IN (SELECT PJT FROM v_fuel_old) THEN 'replace' ELSE 'new' END AS _tag
FROM n ORDER BY _seq LIMIT 200""")
def q_diff_preview(spark, sf_dir):
    """Q9: head of the load (by its order), tagged by whether the stored table has the key."""
    new = v_fuel_new(spark, sf_dir).select(tf.ensure_sn("PJT").alias("PJT"), "HFO", "_seq")
    return diff_preview(new, v_fuel_old(spark, sf_dir), "PJT", 200, order=["_seq"])


@register("time_complete", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 0""")
def q_time_complete(spark, sf_dir):
    """F8: rows that have both times."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("st"),
                                             F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("ed"))
    return drop_null_time(o, ["st", "ed"]).select("o_orderkey")


# ---------------------------------------------------------------------- C2: the other sheets, replaced by key in a stored table

def _sheet(spark, sf_dir, columns: dict):
    """(load with raw texts, stored table made by the same pipeline) from lineitem."""
    li = read(spark, sf_dir, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    raw = li.select(F.concat(F.lit("SN"), (F.col("l_suppkey") * 2 + (seq % 3 == 0).cast("int") * (F.col("l_suppkey") % 2)).cast("string")).alias("PJT"),
                    *[v.alias(k) for k, v in columns.items()], seq.cast("long").alias("_seq"))
    return raw.filter(F.col("_seq") % 3 == 0), raw.filter(F.col("_seq") % 3 != 0)


def _sheet_sql(columns: dict[str, str]) -> str:
    cols = ", ".join(f'{v} AS "{k}"' for k, v in columns.items())
    return f"""
WITH raw AS (SELECT 'SN' || CAST(l_suppkey * 2 + CASE WHEN (l_orderkey * 10 + l_linenumber) % 3 = 0 THEN l_suppkey % 2 ELSE 0 END AS VARCHAR) AS "PJT",
  {cols}, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS _seq FROM lineitem),
fresh AS (SELECT * FROM raw WHERE _seq % 3 = 0), stored AS (SELECT * FROM raw WHERE _seq % 3 <> 0)
SELECT * FROM stored WHERE "PJT" NOT IN (SELECT "PJT" FROM fresh) UNION ALL SELECT * FROM fresh"""


def _run_sheet(spark, sf_dir, name, columns):
    new, stored = _sheet(spark, sf_dir, columns)
    return sheet_pipeline(new, name, sheet_pipeline(stored, name))


@register("sheet_trial_schedule", _sheet_sql({
    "출항": "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR",
    "복귀": "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) + 3 AS TIMESTAMP) + INTERVAL 20 HOUR END"}))
def q_sheet_trial_schedule(spark, sf_dir):
    """C2 trial schedule: two time columns, then key-set replace (M1)."""
    text = lambda days, hour: F.concat(F.date_add(F.to_date("l_shipdate"), days).cast("string"), F.lit(f" {hour}:00:00"))
    return _run_sheet(spark, sf_dir, "trial_schedule", {
        "출항": text(0, "08"), "복귀": F.when(F.col("l_linenumber") == 2, F.lit("")).otherwise(text(3, "20"))})


@register("sheet_fuel_price", _sheet_sql({
    "HFO": "CAST(floor(l_quantity) AS DOUBLE) + 0.25", "LDO": "CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END",
    "비고": "l_linestatus"}))
def q_sheet_fuel_price(spark, sf_dir):
    """C2 fuel prices: unit suffixes in headers, numbers from text, then key-set replace."""
    whole = F.floor("l_quantity").cast("long").cast("string")
    return _run_sheet(spark, sf_dir, "fuel_price", {
        "HFO(USD)": F.concat(F.lit(" "), whole, F.lit(".25")), "LDO (USD)": F.when(F.col("l_linenumber") == 4, F.lit("-")).otherwise(F.col("l_linenumber").cast("string")),
        "비고": F.col("l_linestatus")})


@register("sheet_lng_usage", _sheet_sql({
    "Loading": "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)", "Unloading": "CAST(CAST(l_shipdate AS DATE) + 2 AS TIMESTAMP) + INTERVAL 12 HOUR",
    "비용": "CAST(floor(l_extendedprice) AS DOUBLE)", "양": "CAST(l_linenumber AS DOUBLE) + 0.5"}))
def q_sheet_lng_usage(spark, sf_dir):
    """C2 LNG usage: two time columns and numbers, then key-set replace."""
    return _run_sheet(spark, sf_dir, "lng_usage", {
        "Loading": F.concat(F.col("l_shipdate").cast("date").cast("string"), F.lit(" 00:00")),
        "Unloading": F.concat(F.date_add(F.to_date("l_shipdate"), 2).cast("string"), F.lit(" 12:00")),
        "비용": F.floor("l_extendedprice").cast("long").cast("string"), "양": F.concat(F.col("l_linenumber").cast("string"), F.lit(".5"))})


# ---------------------------------------------------------------------- Q2 / Q3 / F10 / Q8
_CATALOG = {"orders": ("o_orderkey", "2024-04-30 10:00:00", False), "customer": ("c_custkey", "2024-04-20 10:00:00", False),
            "part": (None, "2024-03-01 00:00:00", True), "supplier": ("s_suppkey", None, False)}
_AS_OF = "2024-05-01"
_CATALOG_SQL = "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS rows, "
    + (f"(SELECT count(DISTINCT {k}) FROM {t}) AS keys, " if k else "CAST(NULL AS BIGINT) AS keys, ") +
    f"CASE WHEN (SELECT count(*) FROM {t}) = 0 THEN 'empty' WHEN {str(auto).lower()} THEN 'auto' ELSE 'saved' END AS status, "
    + (f"CASE WHEN date_diff('day', DATE '{m[:10]}', DATE '{_AS_OF}') <= 1 THEN 'new' WHEN date_diff('day', DATE '{m[:10]}', DATE '{_AS_OF}') <= 7 "
       f"THEN 'mid' ELSE 'old' END AS recency" if m else "'none' AS recency")
    for t, (k, m, auto) in _CATALOG.items())


def _catalog(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in _CATALOG}
    # file times as a manifest would give them, one row per table read
    times = spark.createDataFrame([(t, m, a) for t, (_, m, a) in _CATALOG.items()], "table string, modified string, auto boolean")
    return catalog_metadata(tables, {t: k for t, (k, _, _) in _CATALOG.items() if k},
                            times.withColumn("modified", F.col("modified").cast("timestamp_ntz")), _AS_OF)


@register("catalog_filtered", f"""
WITH c AS ({_CATALOG_SQL})
SELECT "table", rows, keys, status, recency FROM c WHERE keys IS NOT NULL AND recency IN ('new', 'old', 'none') AND status = 'saved' AND rows > 0""")
def q_catalog_filtered(spark, sf_dir):
    """Q2 with recency and status, filtered by the optional predicates of F10."""
    c = _catalog(spark, sf_dir)
    return c.filter(all_of(F.col("keys").isNotNull(), F.col("recency").isin("new", "old", "none"), F.col("status") == "saved",
                           F.col("rows") > 0, None)).select("table", "rows", "keys", "status", "recency")


@register("health_report", f"""
WITH c AS ({_CATALOG_SQL}),
e AS (SELECT * FROM (VALUES ('orders'), ('part'), ('weather'), ('broken')) v("table")),
r AS (SELECT e."table", CASE WHEN e."table" = 'broken' THEN 'FAIL' WHEN c.rows IS NULL THEN 'WARN' ELSE 'PASS' END AS "check", c.rows FROM e LEFT JOIN c ON c."table" = e."table")
SELECT "table", "check", rows FROM r
UNION ALL SELECT '(found)', CAST(count(*) FILTER (WHERE "check" = 'PASS') AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR), sum(rows) FROM r""")
def q_health_report(spark, sf_dir):
    """Q3 with an unreadable table (FAIL) and the found/expected line."""
    c = _catalog(spark, sf_dir).withColumn("cols", F.lit(1))
    h = table_health(spark, c, ("orders", "part", "weather", "broken"), unreadable={"broken": "no such file"})
    rows = h.join(c.select("table", "rows"), "table", "left").select("table", "check", "rows")
    total = rows.agg(F.lit("(found)").alias("table"), F.concat(F.count_if(F.col("check") == "PASS").cast("string"), F.lit("/"),
                                                               F.count("*").cast("string")).alias("check"), F.sum("rows").alias("rows"))
    return rows.unionByName(total)


@register("enrich_outcome", """
SELECT count(*) AS keys, count(*) FILTER (WHERE k % 5 <> 0) AS ok, count(*) FILTER (WHERE k % 5 = 0) AS failed,
  count(*) FILTER (WHERE k % 5 <> 0 AND k % 2 = 0) AS added, min(CASE WHEN k % 5 = 0 THEN 'error for ' || lpad(CAST(k AS VARCHAR), 8, '0') END) AS first_error
FROM (SELECT DISTINCT o_custkey AS k FROM orders) o""")
def q_enrich_outcome(spark, sf_dir):
    """Q8: keys asked, answered, failed, newly added, and the first error in key order."""
    k = F.col("o_custkey")
    answers = read(spark, sf_dir, "orders").select(
        F.lpad(k.cast("string"), 8, "0").alias("work"), F.when(k % 5 != 0, F.lit("word")).alias("keyword"),
        F.when(k % 5 == 0, F.concat(F.lit("error for "), F.lpad(k.cast("string"), 8, "0"))).alias("error"))
    known = read(spark, sf_dir, "orders").filter(k % 2 != 0).select(F.lpad(k.cast("string"), 8, "0").alias("work"))
    return enrich_outcome(answers, known, "work", "keyword", "error")



# ---------------------------------------------------------------------- T7: stored rows refilled when the dictionary grows
@register("dictionary_growth", with_views("v_permit", "v_dict") + """,
d AS (SELECT trim(work) AS work, coalesce(arg_max(keyword, _seq), '') AS keyword, coalesce(arg_max(warning, _seq), '') AS warning
      FROM v_dict WHERE trim(work) <> '' GROUP BY 1)
SELECT p._seq, p.ACODENM, CASE WHEN p._seq % 17 = 0 THEN NULL ELSE 'm' || CAST(p._seq % 12 AS VARCHAR) END AS part,
  d.keyword AS risk_keywords, d.warning FROM v_permit p LEFT JOIN d ON trim(p.ACODENM) = d.work""")
def q_dictionary_growth(spark, sf_dir):
    """The first batch is saved with a third of the dictionary; the second brings the rest, also for rows of the first."""
    from ..session import scratch_path
    from ..streaming.watch import merge_then_refill
    from .views import v_dict, v_permit
    rows = v_permit(spark, sf_dir).select(
        "_seq", "ACODENM", F.when(F.col("_seq") % 17 != 0, F.concat(F.lit("m"), (F.col("_seq") % 12).cast("string"))).alias("part"),
        F.lit(None).cast("string").alias("risk_keywords"), F.lit(None).cast("string").alias("warning"))
    full = v_dict(spark, sf_dir)
    some = full.filter(F.col("work") < "M")
    path, fill = scratch_path(spark, "growth"), {"risk_keywords": "keyword", "warning": "warning"}
    for batch, now, before in ((rows.filter("_seq % 2 = 0"), some, None), (rows.filter("_seq % 2 = 1"), full, some)):
        error = merge_then_refill(batch, path, ["_seq"], "part", "ACODENM", lambda now=now: now, before, "work", fill)
        if error:
            raise RuntimeError(error)
    return spark.read.schema(rows.schema).parquet(path)


# ---------------------------------------------------------------------- C3 with P9, C6 with the call's time
@register("plan_from_cells", """
SELECT 'SN' || CAST(o_custkey % 40 + 2601 AS VARCHAR) AS "PJT", CAST(year(o_orderdate) AS INTEGER) AS "인도년",
  CAST(month(o_orderdate) AS INTEGER) AS "인도월", """ + ", ".join(f'CAST(0.0 AS DOUBLE) AS "{c}"' for c in PLAN_FLOAT_COLS) + """
FROM orders WHERE o_custkey % 20 <> 19 AND year(o_orderdate) >= 1995""")
def q_plan_from_cells(spark, sf_dir):
    """C3 from sheets without column names: header row found per file (P9), columns in another order in every second file."""
    from .q_ops import header_less_sheets
    cells = header_less_sheets(spark, sf_dir)
    swap = F.col("file").rlike("[02468]$")
    moved = cells.select("file", "seq", F.when(swap, F.col("c2")).otherwise(F.col("c0")).alias("c0"), "c1",
                         F.when(swap, F.col("c0")).otherwise(F.col("c2")).alias("c2"))
    return plan_pipeline_from_cells(moved, "file", "seq", ["c0", "c1", "c2"], 1995).select(*PLAN_COLUMNS)


@register("forecast_fetched", with_views("v_forecast") + """
SELECT CAST(strptime(fcstDate, '%Y%m%d') AS DATE) AS forecast_date, TIMESTAMP '2024-05-01 05:10:00' AS fetched_at FROM v_forecast
WHERE fcstDate IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, NULL FROM v_forecast WHERE _seq % 97 = 0""")
def q_forecast_fetched(spark, sf_dir):
    """C6 with the time of the call; rows with an unreadable date make no day and are reported apart (here as empty rows)."""
    from .views import v_forecast
    feed = v_forecast(spark, sf_dir)
    days = forecast_pipeline(feed, fetched_at="2024-05-01 05:10:00").select("forecast_date", "fetched_at")
    broken = feed.filter(F.col("_seq") % 97 == 0).withColumn("fcstDate", F.concat(F.lit("x"), "fcstDate"))
    none = unreadable_forecast_rows(feed.unionByName(broken))
    return days.unionByName(none.select(F.lit(None).cast("date").alias("forecast_date"), F.lit(None).cast("timestamp_ntz").alias("fetched_at")))
