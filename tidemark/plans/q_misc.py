"""Queries: plan sheet, schema operators, profiles, reports, enrichment, streaming."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.aggregate import filled_ratios, top_n_values, value_counts
from ..operators.enrich import enrich_missing
from ..operators.joins import join_on_hull
from ..operators.merge import merge_report, replace_by_key
from ..operators.quality import (adaptive_datetime_columns, catalog_profile, enrich_stats, rejected_report,
                                 table_health)
from ..operators.schema import (PERMIT_HEADER_CANDIDATES, drop_columns_by_token, first_present,
                                map_headers, normalize_headers, plan_headers, union_reconcile)
from ..session import scratch_path
from ..sources.status import latest_status
from . import sqlfrag as Q
from .models import stub_model
from .pipelines import PERMIT_KEYS, PLAN_COLUMNS, permit_pipeline, plan_pipeline, visits_pipeline
from .queries import PERMIT_OUT, SQL_PERMIT_DAILY, register
from .views import (permit_view, read, v_dict, v_fuel_new, v_fuel_old, v_permit,
                    with_views)


# ---------------------------------------------------------------------- C3 plan sheet
def v_plan_raw(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    hn = (ck % 40 + 2601).cast("string")
    pjt = (F.when(k % 29 == 0, F.lit("합계")).when(k % 31 == 0, F.lit("Total")).when(k % 37 == 0, F.lit("소계A"))
           .when(k % 41 == 0, F.lit("")).when(k % 43 == 0, F.lit("summary"))
           .when(k % 5 == 0, F.concat(F.lit(" "), hn, F.lit(" "))).otherwise(F.concat(F.lit("SN"), hn)))
    return o.select(
        pjt.alias("호선"),
        F.when(k % 17 == 0, F.lit("TBD")).otherwise((F.year("o_orderdate") + 4).cast("string")).alias("인도년"),
        F.concat(F.month("o_orderdate").cast("string"), F.lit("월")).alias("인도월"),
        (k % 100).cast("string").alias("LNG(ton)"),
        F.when(k % 7 == 0, F.lit("x")).otherwise((ck % 50).cast("string")).alias("HFO (ton)"),
        F.concat((k % 9).cast("string"), F.lit(".5")).alias("LS HFO"),
        F.floor("o_totalprice").cast("long").cast("string").alias("MGO"),
        (k % 3).cast("string").alias("메탄올"),
        F.lit("note").alias("Remark/비고"))


_SQL_PLAN = """
WITH raw AS (SELECT
  CASE WHEN o_orderkey % 29 = 0 THEN '합계' WHEN o_orderkey % 31 = 0 THEN 'Total' WHEN o_orderkey % 37 = 0 THEN '소계A'
       WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN 'summary'
       WHEN o_orderkey % 5 = 0 THEN ' ' || hn || ' ' ELSE 'SN' || hn END AS pjt,
  CASE WHEN o_orderkey % 17 = 0 THEN 'TBD' ELSE CAST(year(o_orderdate) + 4 AS VARCHAR) END AS yr,
  CAST(month(o_orderdate) AS VARCHAR) || '월' AS mo,
  CAST(o_orderkey % 100 AS VARCHAR) AS lng,
  CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey % 50 AS VARCHAR) END AS hfo,
  CAST(o_orderkey % 9 AS VARCHAR) || '.5' AS ls_hfo,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS mgo,
  CAST(o_orderkey % 3 AS VARCHAR) AS meoh
  FROM (SELECT *, CAST(o_custkey % 40 + 2601 AS VARCHAR) AS hn FROM orders) o),
t AS (SELECT trim(pjt) AS "PJT",
   coalesce(CAST(try_cast(trim(yr) AS DOUBLE) AS INTEGER), 0) AS "인도년",
   coalesce(CAST(try_cast(trim(replace(mo, '월', '')) AS DOUBLE) AS INTEGER), 0) AS "인도월",
   coalesce(try_cast(trim(lng) AS DOUBLE), 0.0) AS "LNG", coalesce(try_cast(trim(hfo) AS DOUBLE), 0.0) AS "HFO",
   coalesce(try_cast(trim(ls_hfo) AS DOUBLE), 0.0) AS "LS_HFO", CAST(0.0 AS DOUBLE) AS "RMA10",
   coalesce(try_cast(trim(mgo) AS DOUBLE), 0.0) AS "LS_MGO", CAST(0.0 AS DOUBLE) AS "LDO",
   coalesce(try_cast(trim(meoh) AS DOUBLE), 0.0) AS "메탄올", CAST(0.0 AS DOUBLE) AS "LPG"
  FROM raw WHERE pjt IS NOT NULL)
SELECT * FROM t WHERE NOT regexp_matches("PJT", '^(합계|소계|계|total|sum)', 'i') AND "PJT" <> '' AND "인도년" >= 2000"""


@register("plan_rows", _SQL_PLAN)
def q_plan_rows(spark, sf_dir):
    return plan_pipeline(v_plan_raw(spark, sf_dir)).select(*PLAN_COLUMNS)


# ---------------------------------------------------------------------- P1 / P2 / P7 / U2
@register("normalize_headers", """
SELECT l_quantity AS "LS_HFO", l_tax AS "AB", l_discount AS "x_y", l_linenumber AS "(unit)",
       l_orderkey AS "a", l_partkey AS "a_2" FROM lineitem""")
def q_normalize_headers(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_quantity").alias("LS HFO(ton)"), F.col("l_tax").alias("A/B"),
                    F.col("l_discount").alias("x\ny"), F.col("l_linenumber").alias("(unit)"),
                    F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("a"))
    return normalize_headers(raw)


_MAP_RAW = {"호선(선박)": "HULLNO", "작업 시작일": "STDATE", "팀명": "TEAMNM", "작업\n위치": "AREA_DETAIL",
            "팀장명": "WORK_NM", "DEPTNM": "DEPTNM", "허가 대상": "ACODENM", "종료일(예정)": "EDDATE"}


@register("map_headers", with_views("v_permit") + """
SELECT CAST(NULL AS VARCHAR) AS KYULGBN, CAST(NULL AS VARCHAR) AS PTW_AGBN, TEAMNM, DEPTNM,
  CAST(NULL AS VARCHAR) AS IOWKGBNNM, CAST(NULL AS VARCHAR) AS WKGBNNM, STDATE, EDDATE, HULLNO AS PJT, AREA_DETAIL,
  CAST(NULL AS VARCHAR) AS WORK_NM, ACODENM, _seq FROM v_permit""")
def q_map_headers(spark, sf_dir):
    """P2 on drifting headers: exact after normalisation, then substring (>= 3 chars);
    '팀장명' matches nothing; '허가 대상' hits ACODENM by substring, '종료일(예정)' EDDATE exactly."""
    p = v_permit(spark, sf_dir)
    raw = p.select(*[F.col(src).alias(hdr) for hdr, src in _MAP_RAW.items()], "_seq")
    return map_headers(raw, PERMIT_HEADER_CANDIDATES)


def v_ship(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    sk = F.col("s_suppkey")
    num = (sk + 2601).cast("string")
    return j.select(
        F.when(sk % 3 == 0, num).when(sk % 3 == 1, F.concat(F.lit("S"), num)).otherwise(F.concat(F.lit(" sn"), num))
        .alias("SHIPNUM"),
        F.col("s_name").alias("TITLE"),
        F.element_at(F.array(F.lit("98K ethane "), F.lit("98K LNG"), F.lit("VLCC"), F.lit("174K Ethane")),
                     (sk % 4 + 1).cast("int")).alias("TYPEMODEL"),
        F.col("n_name").alias("SHIPTYPE"),
        F.col("s_name").alias("HNAME"), F.concat(F.lit("010-"), num).alias("Phone_No"),
        F.concat(F.lit("051-"), num).alias("INSERT_TEL"), F.concat(F.lit("H"), num).alias("HOTEL_CODE"),
        F.concat(F.lit("s"), num, F.lit("@example.com")).alias("EMAIL"),
        F.concat(F.lit("D"), (F.col("s_nationkey") % 5).cast("string")).alias("DOCK"))


@register("drop_pii", f"""
WITH s AS (SELECT s_suppkey, s_name, n_name, s_nationkey, CAST(s_suppkey + 2601 AS VARCHAR) AS num
           FROM supplier JOIN nation ON s_nationkey = n_nationkey),
v AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN num WHEN 1 THEN 'S' || num ELSE ' sn' || num END AS shipnum,
   s_name AS "TITLE", ['98K ethane ', '98K LNG', 'VLCC', '174K Ethane'][CAST(s_suppkey % 4 + 1 AS INTEGER)] AS "TYPEMODEL",
   n_name AS shiptype, 'D' || CAST(s_nationkey % 5 AS VARCHAR) AS "DOCK" FROM s)
SELECT {Q.ensure_sn('shipnum')} AS project, "TITLE", "TYPEMODEL",
  CASE WHEN upper(trim("TYPEMODEL")) LIKE '%ETHANE' THEN 'LPG' ELSE shiptype END AS "SHIPTYPE", "DOCK" FROM v""")
def q_drop_pii(spark, sf_dir):
    """C8 mirror steps: drop personal-data columns (token match, 'tel' also hits HOTEL, D23),
    SHIPNUM -> project (N1), ETHANE models -> LPG (N24)."""
    d = drop_columns_by_token(v_ship(spark, sf_dir))
    d = first_present(d, ["PJT", "pjt", "SHIPNUM", "shipnum"], "project")
    return d.withColumns({"project": tf.ensure_sn("project"),
                          "SHIPTYPE": tf.suffix_override("TYPEMODEL", "SHIPTYPE")}) \
        .select("project", "TITLE", "TYPEMODEL", "SHIPTYPE", "DOCK")


@register("union_reconcile", """
SELECT CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS s, CAST(NULL AS INTEGER) AS b FROM orders
UNION ALL
SELECT 'K' || CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS s, CAST(o_custkey % 100 AS INTEGER) AS b FROM orders""")
def q_union_reconcile(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("s"))
    b = o.select(F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("a"),
                 F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 100).cast("int").alias("b"))
    return union_reconcile([a, b]).select("a", "s", "b")


# ---------------------------------------------------------------------- C15 milestone
# The 15 milestone events of the wide table.
MILESTONE_EVENTS = ("LC", "SP", "BT", "GT", "CMR", "COLDFROM", "COLDTO", "IE", "MT", "GASFROM", "GASTO",
                    "STFROM", "STTO", "WF", "DL")


def milestone_wide(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    cols = [tf.ensure_sn(F.concat(F.lit("S"), (F.col("o_custkey") % 40 + 2601).cast("string"))).alias("project"),
            k.alias("_seq")]
    for i, ev in enumerate(MILESTONE_EVENTS):
        cols += [F.timestamp_add("DAY", F.lit(3 * i), d).alias(f"PLAN{ev}"),
                 F.timestamp_add("DAY", F.lit(3 * i + 1), d).alias(f"PROS{ev}"),
                 F.when((k + i) % 4 != 0, F.timestamp_add("DAY", F.lit(3 * i + 2), d)).alias(f"PERF{ev}")]
    return o.select(*cols)


def milestone_long(wide, ids=("project", "_seq")):
    """Wide PLAN/PROS/PERF x event columns -> (kind, event, ts); null dates dropped."""
    vals = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(list(ids), vals, "col", "ts").filter(F.col("ts").isNotNull())
    rx = r"^(PLAN|PROS|PERF)(.*)$"
    return long.select(*ids, F.regexp_extract("col", rx, 1).alias("kind"),
                       F.regexp_extract("col", rx, 2).alias("event"), "ts")


_MS_SQL_COLS = ", ".join(
    f"o_orderdate + INTERVAL {3 * i} DAY AS PLAN{ev}, o_orderdate + INTERVAL {3 * i + 1} DAY AS PROS{ev}, "
    f"CASE WHEN (o_orderkey + {i}) % 4 <> 0 THEN o_orderdate + INTERVAL {3 * i + 2} DAY END AS PERF{ev}"
    for i, ev in enumerate(MILESTONE_EVENTS))


@register("milestone_long", f"""
WITH w AS (SELECT 'SN' || CAST(o_custkey % 40 + 2601 AS VARCHAR) AS project, o_orderkey AS _seq, {_MS_SQL_COLS} FROM orders),
l AS (UNPIVOT w ON COLUMNS(* EXCLUDE (project, _seq)) INTO NAME col VALUE ts)
SELECT project, _seq, regexp_extract(col, '^(PLAN|PROS|PERF)(.*)$', 1) AS kind,
       regexp_extract(col, '^(PLAN|PROS|PERF)(.*)$', 2) AS event, ts FROM l WHERE ts IS NOT NULL""")
def q_milestone_long(spark, sf_dir):
    return milestone_long(milestone_wide(spark, sf_dir))


# ---------------------------------------------------------------------- J11
@register("join_on_hull", with_views("v_permit") + f"""
SELECT _seq, {Q.ensure_sn('HULLNO')} AS _hull, s_suppkey, s_name FROM v_permit
JOIN supplier ON {Q.ensure_sn('HULLNO')} = {Q.ensure_sn("'S' || CAST(s_suppkey + 2601 AS VARCHAR)")}""")
def q_join_on_hull(spark, sf_dir):
    p = v_permit(spark, sf_dir).select("_seq", "HULLNO")
    s = read(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.concat(F.lit("S"), (F.col("s_suppkey") + 2601).cast("string")).alias("PJT"))
    return join_on_hull(p, s, "HULLNO", "PJT").select("_seq", "_hull", "s_suppkey", "s_name")


@register("join_blank_hull", """
SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_orderkey % 7 <> 0 AND s_suppkey % 3 <> 0
  AND CAST(o_orderkey % 50 AS BIGINT) = s_suppkey""")
def q_join_blank_hull(spark, sf_dir):
    """J11 where a seventh of the left and a third of the right keys are null, empty or blank: they match nothing."""
    def key(part, every):
        blank = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("  ")), (part % 3 + 1).cast("int"))
        return F.when(part % every == 0, blank)
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(
        key(F.col("o_orderkey"), 7), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 50).cast("string"))).alias("HULLNO"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(
        key(F.col("s_suppkey"), 3), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string"))).alias("PJT"))
    return join_on_hull(o, s, "HULLNO", "PJT").select("o_orderkey", "s_suppkey")


# ---------------------------------------------------------------------- A7 / A8 / A9 / Q5
@register("value_counts", with_views("v_permit") + """
SELECT CASE WHEN DEPTNM IS NULL OR trim(DEPTNM) IN ('', 'None', 'nan') THEN '(빈값)' ELSE DEPTNM END AS value,
       count(*) AS n FROM v_permit WHERE trim(TEAMNM) <> 'F' GROUP BY 1""")
def q_value_counts(spark, sf_dir):
    """Departments of the rows the team filter rejects."""
    p = v_permit(spark, sf_dir)
    return value_counts(p.filter(tf.strip("TEAMNM") != "F"), "DEPTNM")


@register("value_counts_top", with_views("v_permit") + """
SELECT value, n FROM (SELECT CASE WHEN ACODENM IS NULL OR trim(ACODENM) IN ('', 'None', 'nan') THEN '(빈값)'
  ELSE ACODENM END AS value, count(*) AS n FROM v_permit WHERE trim(TEAMNM) <> 'F' GROUP BY 1)
ORDER BY n DESC, value LIMIT 5""")
def q_value_counts_top(spark, sf_dir):
    """Top-5 work codes among rejected rows (the limit is the report)."""
    p = v_permit(spark, sf_dir)
    return top_n_values(p.filter(tf.strip("TEAMNM") != "F"), "ACODENM", 5)


@register("value_counts_team", with_views("v_permit") + """
SELECT CASE WHEN TEAMNM IS NULL OR trim(TEAMNM) IN ('', 'None', 'nan') THEN '(빈값)' ELSE trim(TEAMNM) END AS value,
       count(*) AS n FROM v_permit GROUP BY 1""")
def q_value_counts_team(spark, sf_dir):
    """A7 on padded team names: equal after stripping."""
    return value_counts(v_permit(spark, sf_dir), "TEAMNM")


@register("value_counts_team_top", with_views("v_permit") + """
SELECT trim(TEAMNM) AS value, count(*) AS n FROM v_permit WHERE trim(TEAMNM) <> 'F' GROUP BY 1 ORDER BY n DESC, value LIMIT 5""")
def q_value_counts_team_top(spark, sf_dir):
    """A8 on padded team names of the rows the team filter rejects."""
    p = v_permit(spark, sf_dir)
    return top_n_values(p.filter(tf.strip("TEAMNM") != "F"), "TEAMNM", 5)


_FR_COLS = ("KYULGBN", "STDATE", "EDDATE", "HULLNO", "ACODENM")


@register("filled_ratio", with_views("v_permit") + ", c AS (SELECT count(*) AS rows, "
          + ", ".join(f"count({c}) AS f_{c}" for c in _FR_COLS) + " FROM v_permit)\n"
          + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", f_{c} AS filled, rows, "
                               f"CASE WHEN rows > 0 THEN f_{c} / rows END AS ratio FROM c" for c in _FR_COLS))
def q_filled_ratio(spark, sf_dir):
    return filled_ratios(v_permit(spark, sf_dir), list(_FR_COLS))


@register("rejected_report", with_views("v_permit") + "," + """
permit_parsed AS (SELECT *, """ + Q.parse_permit("STDATE") + """ AS st, """ + Q.parse_permit("EDDATE") + """ AS ed FROM v_permit),
kept AS (SELECT * FROM permit_parsed WHERE trim(TEAMNM) = 'F'),
top AS (SELECT string_agg(value || ' (' || CAST(n AS VARCHAR) || ')', ' | ' ORDER BY n DESC, value) AS t FROM (
  SELECT CASE WHEN TEAMNM IS NULL OR trim(TEAMNM) IN ('', 'None', 'nan') THEN '(빈값)' ELSE trim(TEAMNM) END AS value,
         count(*) AS n FROM v_permit WHERE coalesce(trim(TEAMNM) <> 'F', true) GROUP BY 1 ORDER BY n DESC, value LIMIT 5) y)
SELECT (SELECT count(*) FROM v_permit) AS rows_in, (SELECT count(*) FROM kept) AS rows_kept,
  (SELECT CAST(coalesce(sum(date_diff('day', CAST(st AS DATE), greatest(CAST(st AS DATE), coalesce(CAST(ed AS DATE), CAST(st AS DATE)))) + 1), 0) AS BIGINT)
   FROM kept WHERE st IS NOT NULL) AS rows_expanded,
  (SELECT count(*) FROM kept WHERE st IS NULL AND trim(coalesce(STDATE, '')) <> '') AS rows_unparsed,
  (SELECT count(*) FROM v_permit) - (SELECT count(*) FROM kept) AS rows_dropped,
  (SELECT t FROM top) AS top_dropped, 'IOWKGBNNM | WKGBNNM' AS unmapped""")
def q_rejected_report(spark, sf_dir):
    """Q5 for the permit load: rows in / kept / expanded / dropped, start times not understood, the teams most
    often dropped, and the standard columns the header mapping could not fill."""
    raw = v_permit(spark, sf_dir).drop("IOWKGBNNM", "WKGBNNM")
    plan = plan_headers([c for c in raw.columns if not c.startswith("_")], PERMIT_HEADER_CANDIDATES)
    r = rejected_report(raw, tf.strip("TEAMNM") == "F", "TEAMNM", "STDATE", tf.parse_ts_formats("STDATE"),
                        tf.parse_ts_formats("EDDATE"), plan.unmapped)
    return r.select("rows_in", "rows_kept", "rows_expanded", "rows_unparsed", "rows_dropped",
                    F.concat_ws(" | ", "top_dropped").alias("top_dropped"),
                    F.concat_ws(" | ", "unmapped").alias("unmapped"))


# ---------------------------------------------------------------------- M9 merge report
@register("merge_report", with_views("v_fuel") + f""",
nk AS (SELECT DISTINCT {Q.ensure_sn('PJT')} AS k FROM v_fuel_new),
kept AS (SELECT count(*) AS n FROM v_fuel_old WHERE PJT NOT IN (SELECT k FROM nk))
SELECT (SELECT count(*) FROM v_fuel_old) AS before_rows, (SELECT count(*) FROM v_fuel_new) AS load_rows,
  (SELECT n FROM kept) + (SELECT count(*) FROM v_fuel_new) AS after_rows, (SELECT n FROM kept) AS kept_rows,
  (SELECT count(*) FROM v_fuel_old) - (SELECT n FROM kept) AS replaced_rows""")
def q_merge_report(spark, sf_dir):
    """M9: dry run of the key-set replace — counts only, nothing written."""
    old, new = v_fuel_old(spark, sf_dir), v_fuel_new(spark, sf_dir)
    return merge_report(old, new, replace_by_key(old, new, "PJT"))


# ---------------------------------------------------------------------- Q6
def v_ship_times(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    b = F.timestamp_add("MINUTE", (k % 24) * 60 + (k % 4) * 15, F.col("o_orderdate"))
    kr = F.concat(tf.format_ntz(b, "yyyy-MM-dd"), F.lit(" "),
                  F.when(F.hour(b) < 12, F.lit("오전")).otherwise(F.lit("오후")), F.lit(" "),
                  tf.format_ntz(b, "h:mm:ss"))
    return o.select(k.alias("o_orderkey"), kr.alias("WORKFINISH"),
                    F.when(k % 10 == 0, kr).otherwise(F.lit("pending")).alias("REMARK"),
                    F.col("o_orderpriority").alias("GRADE"))


@register("adaptive_dates", f"""
WITH b AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST((o_orderkey % 24) * 60 + (o_orderkey % 4) * 15 AS BIGINT)) AS b,
                  o_orderpriority FROM orders),
t AS (SELECT o_orderkey, strftime(b, '%Y-%m-%d') || ' ' || CASE WHEN hour(b) < 12 THEN '오전' ELSE '오후' END || ' '
             || strftime(b, '%-I:%M:%S') AS kr, o_orderpriority FROM b)
SELECT o_orderkey, {Q.parse_mixed('kr')} AS "WORKFINISH", CASE WHEN o_orderkey % 10 = 0 THEN kr ELSE 'pending' END AS "REMARK",
       o_orderpriority AS "GRADE" FROM t""")
def q_adaptive_dates(spark, sf_dir):
    """Q6: WORKFINISH holds 오전/오후 times and converts; REMARK mentions them in 10 % of rows
    (would lose > 50 %, stays text); GRADE never mentions them."""
    df, _converted = adaptive_datetime_columns(v_ship_times(spark, sf_dir))
    return df


# ---------------------------------------------------------------------- K5
@register("job_latest", """
SELECT event_type AS job, ts, value >= 5 AS ok, 'event ' || CAST(event_id AS VARCHAR) AS summary, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""")
def q_job_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = e.select(F.col("event_type").alias("job"), "ts", (F.col("value") >= 5).alias("ok"),
                      F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("summary"), "event_id")
    return latest_status(status, "job", "ts", "event_id")


# ---------------------------------------------------------------------- X5 / Q8
@register("enrich_missing", with_views("v_permit", "v_dict") + """,
dict AS (SELECT trim(work) AS work, coalesce(arg_max(keyword, _seq), '') AS keyword,
                coalesce(arg_max(warning, _seq), '') AS warning FROM v_dict WHERE trim(work) <> '' GROUP BY 1),
gen AS (SELECT DISTINCT trim(ACODENM) AS work, 'KW-' || upper(trim(ACODENM)) AS keyword, 'check ' || trim(ACODENM) AS warning
        FROM v_permit WHERE trim(ACODENM) <> '' AND trim(ACODENM) NOT IN (SELECT work FROM dict)
          AND NOT starts_with(trim(ACODENM), 'CONF')),
d AS (SELECT * FROM dict UNION ALL SELECT * FROM gen)
SELECT _seq, ACODENM, d.keyword AS risk_keywords, d.warning AS warning
FROM v_permit LEFT JOIN d ON trim(v_permit.ACODENM) = d.work""")
def q_enrich_missing(spark, sf_dir):
    """Only distinct unmapped codes go to the (stub) model; CONFINED gets an empty
    answer, is not cached and stays unfilled."""
    p = v_permit(spark, sf_dir).select("_seq", "ACODENM")
    out, _dim = enrich_missing(p, "ACODENM", v_dict(spark, sf_dir), stub_model)
    return out.select("_seq", "ACODENM", "risk_keywords", "warning")


@register("enrich_stats", with_views("v_permit", "v_dict") + """
SELECT count(*) FILTER (WHERE work IS NULL) AS unmapped, count(*) FILTER (WHERE work IS NOT NULL) AS ok
FROM (SELECT DISTINCT trim(ACODENM) AS k FROM v_permit WHERE trim(ACODENM) <> '') a
LEFT JOIN (SELECT DISTINCT trim(work) AS work FROM v_dict) d ON a.k = d.work""")
def q_enrich_stats(spark, sf_dir):
    from ..operators.joins import lookup_fill
    p = v_permit(spark, sf_dir).select("_seq", "ACODENM")
    return enrich_stats(lookup_fill(p, "ACODENM", v_dict(spark, sf_dir)), "ACODENM")


# ---------------------------------------------------------------------- C4
_VISIT_RAW = {"이름": "name", "연락처": "phone", "회사명": "company", "방문시작": "visit_start",
              "방문종료": "visit_end", "호선": "project", "업무내용": "work_content", "접견자": "greeter",
              "방문부서": "dept"}


@register("visits_pipeline", with_views("v_visit") + f""",
r AS (SELECT name, phone, company, visit_start, visit_end, project, work_content, greeter, dept, _seq FROM v_visit
      WHERE contains(coalesce(dept, ''), '시운전') OR contains(coalesce(dept, ''), '해운'))
SELECT name, phone, company, visit_start, visit_end, {Q.ensure_sn('project')} AS project, work_content, greeter, dept, _seq
FROM r QUALIFY row_number() OVER (PARTITION BY name, company, visit_start, visit_end, work_content ORDER BY _seq DESC) = 1""")
def q_visits_pipeline(spark, sf_dir):
    """C4: Korean headers -> rename, text dates -> N5, department filter, keep-last, N1."""
    from .views import v_visit
    v = v_visit(spark, sf_dir)
    raw = v.select(*[(tf.format_ntz(F.col(src), "yyyyMMdd") if src in ("visit_start", "visit_end")
                      else F.col(src)).alias(hdr) for hdr, src in _VISIT_RAW.items()], "_seq")
    out = visits_pipeline(raw)
    return out.select("name", "phone", "company", "visit_start", "visit_end", "project", "work_content",
                      "greeter", "dept", "_seq")


# ---------------------------------------------------------------------- T1..T3, T7
@register("stream_permits", SQL_PERMIT_DAILY)
def q_stream_permits(spark, sf_dir):
    """Streaming = batch: the orders file arrives in a watched folder; each micro-batch is
    cleaned, expanded and enriched (dictionary re-read per batch, T7), then merged
    incrementally into the month-partitioned permit table (the month is a function of the
    DATE key) — only touched months are rewritten."""
    from ..streaming.watch import stream_merge_partitioned, watch_landing
    root = scratch_path(spark, "stream-permits")
    schema = read(spark, sf_dir, "orders").schema
    stream = watch_landing(spark, sf_dir, schema, "parquet", glob="orders.parquet", max_files_per_trigger=1)

    def prepare(batch, batch_id):
        out = permit_pipeline(permit_view(batch), None, v_dict(spark, sf_dir))
        return out.select(*PERMIT_OUT, "_seq", F.substring("DATE", 1, 5).alias("_month"))

    stream_merge_partitioned(stream, f"{root}/ptwlist", list(PERMIT_KEYS), "_month", prepare,
                             f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/ptwlist").select(*PERMIT_OUT)




# ---------------------------------------------------------------------- Q2 / Q3
# Driver tables profiled as curated tables, with their key column.
PROFILE_TABLES = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey",
                  "part": "p_partkey", "supplier": "s_suppkey", "events": "user_id",
                  "documents": "doc_id", "conversations": "conv_id"}
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS cols, "
    f"count(DISTINCT {k}) AS keys FROM {t}" for t, k in PROFILE_TABLES.items())


@register("catalog_profile", f"""
WITH p AS ({_PROFILE_SQL})
SELECT *, CASE WHEN rows = 0 THEN 'empty' ELSE 'saved' END AS status FROM p""")
def q_catalog_profile(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in PROFILE_TABLES}
    return catalog_profile(tables, PROFILE_TABLES)


HEALTH_EXPECTED = tuple(PROFILE_TABLES) + ("ptwlist", "weather")


@register("table_health", f"""
WITH p AS ({_PROFILE_SQL}),
e AS (SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in HEALTH_EXPECTED)}) v("table"))
SELECT e."table", CASE WHEN p.rows IS NULL THEN 'WARN' ELSE 'PASS' END AS "check",
  CASE WHEN p.rows IS NULL THEN 'missing' ELSE CAST(p.rows AS VARCHAR) || ' x ' || CAST(p.cols AS VARCHAR) END AS detail
FROM e LEFT JOIN p ON e."table" = p."table\"""")
def q_table_health(spark, sf_dir):
    prof = catalog_profile({t: read(spark, sf_dir, t) for t in PROFILE_TABLES}, PROFILE_TABLES)
    return table_health(spark, prof, HEALTH_EXPECTED)


# ---------------------------------------------------------------------- C2 sheets
def v_usage_sheet(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
                                                "l_tax", "l_discount", "l_returnflag", "l_shipdate")
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    b = F.timestamp_add("MINUTE", (k % 24) * 60 + (ln % 4) * 15, F.col("l_shipdate"))
    frac = F.concat(F.floor("l_quantity").cast("long").cast("string"), F.lit("."),
                    F.lpad(((k * 7 + ln) % 10000).cast("string"), 4, "0"))
    return li.select(
        F.concat(F.lit("SN"), F.col("l_suppkey").cast("string")).alias("PJT"),
        F.col("l_returnflag").alias("일정구분"), F.concat(F.lit("S"), (k % 4).cast("string")).alias("공급처"),
        F.when(ln % 2 == 0, F.lit("수급")).otherwise(F.lit("사용")).alias("수급사용"),
        F.when(ln % 3 == 0, tf.format_ntz(b, "yyyy-MM-dd hh:mm a")).otherwise(tf.format_ntz(b, "yyyy-MM-dd HH:mm:ss"))
        .alias("Start"),
        F.when(k % 9 == 0, F.lit("")).otherwise(tf.format_ntz(F.timestamp_add("HOUR", F.lit(30), b), "yyyy/MM/dd HH:mm"))
        .alias("Finish"),
        F.when(ln == 7, F.lit("n/a")).otherwise(frac).alias("HFO(ton)"),
        F.concat(F.lit(" "), (F.col("l_tax") * 1000).cast("long").cast("string"), F.lit(".125 ")).alias("LS HFO (ton)"),
        (F.col("l_discount") * 100).cast("long").cast("string").alias("LS MGO"),
        (k * 10 + ln).alias("_seq"))


@register("sheet_fuel_usage", f"""
WITH li AS (SELECT *, l_shipdate + to_minutes(CAST((l_orderkey % 24) * 60 + (l_linenumber % 4) * 15 AS BIGINT)) AS b FROM lineitem),
raw AS (SELECT 'SN' || CAST(l_suppkey AS VARCHAR) AS "PJT", l_returnflag AS "일정구분", 'S' || CAST(l_orderkey % 4 AS VARCHAR) AS "공급처",
  CASE WHEN l_linenumber % 2 = 0 THEN '수급' ELSE '사용' END AS "수급사용",
  CASE WHEN l_linenumber % 3 = 0 THEN strftime(b, '%Y-%m-%d %I:%M %p') ELSE strftime(b, '%Y-%m-%d %H:%M:%S') END AS st,
  CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE strftime(b + INTERVAL 30 HOUR, '%Y/%m/%d %H:%M') END AS fi,
  CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '.'
       || lpad(CAST((l_orderkey * 7 + l_linenumber) % 10000 AS VARCHAR), 4, '0') END AS hfo,
  ' ' || CAST(CAST(l_tax * 1000 AS BIGINT) AS VARCHAR) || '.125 ' AS lshfo,
  CAST(CAST(l_discount * 100 AS BIGINT) AS VARCHAR) AS lsmgo, l_orderkey * 10 + l_linenumber AS _seq FROM li)
SELECT "PJT", "일정구분", "공급처", "수급사용", {Q.parse_mixed('st')} AS "Start", {Q.parse_mixed('fi')} AS "Finish",
  {Q.round_half_even('try_cast(trim(hfo) AS DOUBLE)', 3)} AS "HFO", {Q.round_half_even('try_cast(trim(lshfo) AS DOUBLE)', 3)} AS "LS_HFO",
  {Q.round_half_even('try_cast(trim(lsmgo) AS DOUBLE)', 3)} AS "LS_MGO", _seq FROM raw""")
def q_sheet_fuel_usage(spark, sf_dir):
    """C2 fuel-usage sheet: unit suffixes in headers, AM/PM and ISO times, numbers rounded
    half-even to 3 decimals (x.xxx5 ties included)."""
    from .pipelines import sheet_pipeline
    return sheet_pipeline(v_usage_sheet(spark, sf_dir), "fuel_usage")


@register("sheet_pjtmethod", """
SELECT trim('SN' || CAST(p_partkey AS VARCHAR)) AS "PJT", nullif(trim(p_type), 'nan') AS "공법",
  nullif(trim(CASE WHEN p_size % 5 = 0 THEN 'nan' ELSE p_brand END), 'nan') AS "통합",
  nullif(trim(CAST(p_size % 3 AS VARCHAR)), 'nan') AS "역", nullif(trim(' B' || CAST(p_size % 4 AS VARCHAR)), 'nan') AS "선적",
  nullif(trim(substr(p_name, 1, 5)), 'nan') AS "하역", nullif(trim(CAST(p_size AS VARCHAR)), 'nan') AS "Speed",
  nullif(trim(CASE WHEN p_size % 7 = 0 THEN 'nan' ELSE 'Y' END), 'nan') AS "SG" FROM part""")
def q_sheet_pjtmethod(spark, sf_dir):
    """C2 method sheet: legacy header names 부/부두1 renamed, listed columns dropped,
    text trimmed and 'nan' -> null, fixed column order."""
    from .pipelines import sheet_pipeline
    p = read(spark, sf_dir, "part")
    raw = p.select(F.lit(1).alias("No"), F.col("p_type").alias("시리즈"),
                   F.concat(F.lit("SN"), F.col("p_partkey").cast("string")).alias("PJT"),
                   F.col("p_type").alias("공법"),
                   F.when(F.col("p_size") % 5 == 0, F.lit("nan")).otherwise(F.col("p_brand")).alias("통합"),
                   (F.col("p_size") % 3).cast("string").alias("부"),
                   F.concat(F.lit(" B"), (F.col("p_size") % 4).cast("string")).alias("부두1"),
                   F.substring("p_name", 1, 5).alias("하역"), F.col("p_size").cast("string").alias("Speed"),
                   F.when(F.col("p_size") % 7 == 0, F.lit("nan")).otherwise(F.lit("Y")).alias("SG"),
                   F.lit("X").alias("OWNER"))
    return sheet_pipeline(raw, "pjtmethod")


# ---------------------------------------------------------------------- S1 / S5 round trips
@register("landing_permits", SQL_PERMIT_DAILY)
def q_landing_permits(spark, sf_dir):
    """S1 + C1: permit rows land as CSV files (text only); the landing reader takes them
    back with all-string columns and the permit pipeline runs on them."""
    from ..sources.files import read_landing
    root = scratch_path(spark, "landing")
    v = v_permit(spark, sf_dir).drop("_odate").withColumnRenamed("_seq", "order_key")
    (v.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/ptw"))
    raw = read_landing(spark, f"{root}/ptw", "csv", glob="*.csv").drop("_seq", "_file", "_mtime", "_block")
    raw = raw.withColumn("_seq", F.col("order_key").cast("long")).drop("order_key")
    return permit_pipeline(raw, None, v_dict(spark, sf_dir)).select(*PERMIT_OUT)


def q_forecast_json(spark, sf_dir):
    """S5 + C6: the forecast feed lands as API pages (<= 1000 items, with or without the
    ``response`` wrapper, plus one empty page); the reader unwraps them and the forecast
    pipeline rolls them up — equal to the direct roll-up."""
    from ..sources.forecast import read_forecast_json
    from .pipelines import forecast_pipeline
    from .q_forecast import FORECAST_COLS
    from .views import v_forecast
    root = scratch_path(spark, "forecast")
    feed = v_forecast(spark, sf_dir)
    item = F.struct("fcstDate", F.lit("0000").alias("fcstTime"), "category", "fcstValue", F.col("_seq").alias("seq"))
    pages = feed.groupBy("fcstDate", (F.col("_seq") / 1000).cast("long").alias("page")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(item).alias("item"))
    body = F.struct(F.col("n").alias("totalCount"), F.struct(F.col("item").alias("item")).alias("items"))
    docs = pages.select(F.when(F.col("page") % 2 == 0, F.struct(body.alias("body"))).alias("response"),
                        F.when(F.col("page") % 2 == 1, body).alias("body"))
    empty = spark.createDataFrame([(None, (0, (None,)))],
                                  "response struct<body:struct<totalCount:long,items:struct<item:array<string>>>>, "
                                  "body struct<totalCount:long,items:struct<item:array<string>>>")
    docs.write.json(f"{root}/pages")
    empty.write.mode("append").json(f"{root}/pages")
    rows = read_forecast_json(spark, f"{root}/pages", multi_line=False)
    fed = rows.select("fcstDate", "category", "fcstValue", F.col("seq").alias("_seq"))
    return forecast_pipeline(fed).select(*FORECAST_COLS)


from .queries import ORACLES as _ORACLES  # noqa: E402

register("forecast_json", _ORACLES["forecast_daily"])(q_forecast_json)
