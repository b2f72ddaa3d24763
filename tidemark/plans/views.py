"""Adapter views: the reference's raw inputs re-expressed over the driver tables.

Each view is a deterministic expression over a WHOLE driver table (values
vary by key arithmetic; no row is filtered out), defined twice: as a Spark
DataFrame builder and as a DuckDB CTE with identical values, so every
registered query has an independent SQL oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as tf

# Work codes used by the permit view: the six part types plus two codes that
# are deliberately missing from the dictionary.
WORK_CODES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "HOTWORK", "CONFINED")
# Text layouts of the permit start time, by customer key class.
PERMIT_TEXT_FORMATS = ("yy/MM/dd HH:mm", "yy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm",
                       "yyyy-MM-dd HH:mm:ss")
# Visit departments by key class ('' = missing department, D30).
VISIT_DEPTS = ("시운전1부", "해운1과", None, "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _case(expr, mapping: dict) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = F.when(expr == k, v) if out is None else out.when(expr == k, v)
    return out


# ------------------------------------------------------------------ v_permit
def v_permit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permit_view(read(spark, sf_dir, "orders"))


def permit_view(orders: DataFrame) -> DataFrame:
    """Raw permit sheet rows rendered from order rows (usable on a stream micro-batch).

    Built from SQL expression strings: a handful of JVM round trips instead of hundreds.
    """
    from ..functions.scalars import format_ntz_sql
    codes = ", ".join(f"'{c}'" for c in WORK_CODES)
    ed = "timestampadd(MINUTE, ((o_orderkey % 6) - 1) * 1440 + 180, _bt)"
    two = "o_custkey % 5 <= 1"
    sep = "CASE WHEN o_custkey % 5 <= 2 THEN '/' ELSE '-' END"
    st = (f"concat(CASE WHEN {two} THEN lpad(CAST(year(_bt) % 100 AS STRING), 2, '0') "
          f"ELSE lpad(CAST(year(_bt) AS STRING), 4, '0') END, {sep}, lpad(CAST(month(_bt) AS STRING), 2, '0'), "
          f"{sep}, lpad(CAST(dayofmonth(_bt) AS STRING), 2, '0'), ' ', lpad(CAST(hour(_bt) AS STRING), 2, '0'), "
          f"':', lpad(CAST(minute(_bt) AS STRING), 2, '0'), CASE WHEN o_custkey % 5 IN (1, 4) "
          f"THEN concat(':', lpad(CAST(second(_bt) AS STRING), 2, '0')) ELSE '' END)")
    hn = "CAST(o_custkey % 40 + 2601 AS STRING)"
    o = orders.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
                          "timestampadd(MINUTE, (o_orderkey % 10) * 60 + (o_orderkey % 4) * 15, o_orderdate) AS _bt")
    return o.selectExpr(
        "o_orderkey AS _seq", "o_orderdate AS _odate", "'APPROVED' AS KYULGBN",
        "substring(o_orderpriority, 1, 1) AS PTW_AGBN",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', o_orderstatus, ' ') ELSE o_orderstatus END AS TEAMNM",
        "o_orderpriority AS DEPTNM",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS IOWKGBNNM",
        "'GENERAL' AS WKGBNNM",
        f"CASE WHEN o_orderkey % 13 = 0 THEN 'nan' ELSE {st} END AS STDATE",
        f"CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS STRING) ELSE {format_ntz_sql(ed, 'yyyy-MM-dd HH:mm:ss')} END AS EDDATE",
        f"CASE o_orderkey % 5 WHEN 0 THEN {hn} WHEN 1 THEN concat('S', {hn}) WHEN 2 THEN concat('SN', {hn}) "
        f"WHEN 3 THEN concat(' sn', {hn}, ' ') ELSE '' END AS HULLNO",
        "concat('AREA', CAST(o_orderkey % 7 AS STRING)) AS AREA_DETAIL",
        "concat('W', CAST(o_custkey % 13 AS STRING)) AS WORK_NM",
        f"element_at(array({codes}), CAST(o_orderkey % 8 + 1 AS INT)) AS ACODENM")


SQL_V_PERMIT = f"""
v_permit AS (
  SELECT o_orderkey AS _seq, o_orderdate AS _odate,
    'APPROVED' AS KYULGBN,
    substr(o_orderpriority, 1, 1) AS PTW_AGBN,
    CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderstatus || ' ' ELSE o_orderstatus END AS TEAMNM,
    o_orderpriority AS DEPTNM,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS IOWKGBNNM,
    'GENERAL' AS WKGBNNM,
    CASE WHEN o_orderkey % 13 = 0 THEN 'nan' ELSE
      CASE o_custkey % 5 WHEN 0 THEN strftime(bt, '%y/%m/%d %H:%M')
                         WHEN 1 THEN strftime(bt, '%y/%m/%d %H:%M:%S')
                         WHEN 2 THEN strftime(bt, '%Y/%m/%d %H:%M')
                         WHEN 3 THEN strftime(bt, '%Y-%m-%d %H:%M')
                         ELSE strftime(bt, '%Y-%m-%d %H:%M:%S') END END AS STDATE,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE
      strftime(bt + to_minutes(CAST(((o_orderkey % 6) - 1) * 1440 + 180 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS EDDATE,
    CASE o_orderkey % 5 WHEN 0 THEN hn WHEN 1 THEN 'S' || hn WHEN 2 THEN 'SN' || hn
                        WHEN 3 THEN ' sn' || hn || ' ' ELSE '' END AS HULLNO,
    'AREA' || CAST(o_orderkey % 7 AS VARCHAR) AS AREA_DETAIL,
    'W' || CAST(o_custkey % 13 AS VARCHAR) AS WORK_NM,
    ({_sql_list(WORK_CODES)})[CAST(o_orderkey % 8 + 1 AS INTEGER)] AS ACODENM
  FROM (SELECT *, o_orderdate + to_minutes(CAST((o_orderkey % 10) * 60 + (o_orderkey % 4) * 15 AS BIGINT)) AS bt,
               CAST(o_custkey % 40 + 2601 AS VARCHAR) AS hn FROM orders) o
)"""


# ------------------------------------------------------------------ v_dict
def v_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("work"), F.col("p_brand").alias("keyword"),
                    F.col("p_name").alias("warning"), F.col("p_partkey").alias("_seq"))


SQL_V_DICT = """
v_dict AS (SELECT p_type AS work, p_brand AS keyword, p_name AS warning, p_partkey AS _seq FROM part)"""


# ------------------------------------------------------------------ v_visit
def v_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    hn = "CAST(o_custkey % 40 + 2601 AS STRING)"
    return j.selectExpr(
        "o_orderkey AS _seq", "c_name AS name",
        "concat('010-', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'), '-', "
        "lpad(CAST((o_custkey * 7) % 10000 AS STRING), 4, '0')) AS phone",
        "c_mktsegment AS company",
        "to_date(o_orderdate) AS visit_start",
        "date_add(to_date(o_orderdate), CAST(o_orderkey % 17 - 1 AS INT)) AS visit_end",
        f"CASE o_orderkey % 3 WHEN 0 THEN {hn} WHEN 1 THEN concat('S', {hn}) ELSE concat('sn', {hn}) END AS project",
        "concat('W', CAST(o_orderkey % 5 AS STRING)) AS work_content",
        "concat('G', CAST(o_custkey % 9 AS STRING)) AS greeter",
        f"CASE o_orderkey % 4 WHEN 0 THEN '{VISIT_DEPTS[0]}' WHEN 1 THEN '{VISIT_DEPTS[1]}' "
        f"WHEN 2 THEN o_orderpriority ELSE '{VISIT_DEPTS[3]}' END AS dept")


SQL_V_VISIT = f"""
v_visit AS (
  SELECT o_orderkey AS _seq, c_name AS name,
    '010-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST((o_custkey * 7) % 10000 AS VARCHAR), 4, '0') AS phone,
    c_mktsegment AS company,
    CAST(o_orderdate AS DATE) AS visit_start,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 17 - 1 AS INTEGER) AS visit_end,
    CASE o_orderkey % 3 WHEN 0 THEN hn WHEN 1 THEN 'S' || hn ELSE 'sn' || hn END AS project,
    'W' || CAST(o_orderkey % 5 AS VARCHAR) AS work_content,
    'G' || CAST(o_custkey % 9 AS VARCHAR) AS greeter,
    CASE o_orderkey % 4 WHEN 0 THEN '{VISIT_DEPTS[0]}' WHEN 1 THEN '{VISIT_DEPTS[1]}'
                        WHEN 2 THEN o_orderpriority ELSE '' END AS dept
  FROM (SELECT *, CAST(o_custkey % 40 + 2601 AS VARCHAR) AS hn FROM orders) o
  JOIN customer ON o.o_custkey = customer.c_custkey
)"""


# ------------------------------------------------------------------ v_fuel (old / new)
def _fuel_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey",
                                                "l_quantity", "l_tax", "l_returnflag", "l_shipdate")
    qty = ("concat(CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), '.', "
           "lpad(CAST(l_linenumber AS STRING), 2, '0'))")
    return li.selectExpr(
        "l_orderkey * 10 + l_linenumber AS _seq",
        "(l_orderkey % 3 = 0 AND l_suppkey % 2 = 0) AS _is_new",
        "l_suppkey AS _sk",
        "l_returnflag AS `일정구분`",
        f"CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN concat(' ', {qty}, ' ') "
        f"WHEN l_linenumber = 5 THEN '1,200' ELSE {qty} END AS HFO",
        "CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING) AS LDO",
        "to_date(l_shipdate) AS Start")


def v_fuel_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _fuel_base(spark, sf_dir)
    return b.filter(~F.col("_is_new")).select(
        F.concat(F.lit("SN"), F.col("_sk").cast("string")).alias("PJT"), "일정구분", "HFO", "LDO", "Start", "_seq")


def v_fuel_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _fuel_base(spark, sf_dir)
    sk = F.col("_sk").cast("string")
    pjt = _case(F.col("_seq") % 3, {0: sk, 1: F.concat(F.lit("S"), sk), 2: F.concat(F.lit(" sn"), sk)})
    return b.filter(F.col("_is_new")).select(pjt.alias("PJT"), "일정구분", "HFO", "LDO", "Start", "_seq")


SQL_V_FUEL = """
fuel_base AS (
  SELECT l_orderkey * 10 + l_linenumber AS _seq,
    (l_orderkey % 3 = 0 AND l_suppkey % 2 = 0) AS _is_new,
    l_suppkey AS _sk,
    l_returnflag AS "일정구분",
    CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN ' ' || qty || ' '
         WHEN l_linenumber = 5 THEN '1,200' ELSE qty END AS HFO,
    CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) AS LDO,
    CAST(l_shipdate AS DATE) AS "Start"
  FROM (SELECT *, CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS qty
        FROM lineitem) li
),
v_fuel_old AS (SELECT 'SN' || CAST(_sk AS VARCHAR) AS PJT, "일정구분", HFO, LDO, "Start", _seq FROM fuel_base WHERE NOT _is_new),
v_fuel_new AS (
  SELECT CASE _seq % 3 WHEN 0 THEN CAST(_sk AS VARCHAR) WHEN 1 THEN 'S' || CAST(_sk AS VARCHAR)
                       ELSE ' sn' || CAST(_sk AS VARCHAR) END AS PJT,
         "일정구분", HFO, LDO, "Start", _seq FROM fuel_base WHERE _is_new)"""


# ------------------------------------------------------------------ v_forecast
def v_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import format_ntz_sql
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    e = e.selectExpr(
        "event_id", "ts", "value", "CAST(floor(value) AS BIGINT) AS fv",
        "CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN 'TMN' "
        "WHEN event_type = 'view' AND event_id % 50 = 1 THEN 'TMX' WHEN event_type = 'view' THEN 'TMP' "
        "WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'WAV' WHEN event_type = 'click' THEN 'POP' "
        "WHEN event_type = 'signup' THEN 'WSD' WHEN event_type = 'purchase' THEN 'VEC' "
        "WHEN event_id % 2 = 0 THEN 'PTY' ELSE 'SKY' END AS category")
    return e.selectExpr(
        f"{format_ntz_sql('ts', 'yyyyMMdd')} AS fcstDate", "category",
        "CASE WHEN event_id % 97 = 0 THEN 'x' "
        "WHEN category IN ('TMP', 'TMN', 'TMX') THEN CAST(fv - 10 AS STRING) "
        "WHEN category = 'POP' THEN CAST((event_id * 7) % 101 AS STRING) "
        "WHEN category = 'WAV' THEN concat(CAST(CAST(fv / 10 AS BIGINT) AS STRING), '.', CAST(fv % 10 AS STRING)) "
        "WHEN category = 'WSD' THEN CAST(CAST(floor(value / 4) AS BIGINT) AS STRING) "
        "WHEN category = 'VEC' THEN CAST((event_id * 37) % 360 AS STRING) "
        "WHEN category = 'PTY' THEN CAST(event_id % 8 AS STRING) "
        "ELSE element_at(array('1', '3', '4'), CAST(event_id % 3 + 1 AS INT)) END AS fcstValue",
        "event_id AS _seq")


SQL_V_FORECAST = """
v_forecast AS (
  SELECT fcstDate, category,
    CASE WHEN event_id % 97 = 0 THEN 'x'
         WHEN category IN ('TMP', 'TMN', 'TMX') THEN CAST(fv - 10 AS VARCHAR)
         WHEN category = 'POP' THEN CAST((event_id * 7) % 101 AS VARCHAR)
         WHEN category = 'WAV' THEN CAST(fv // 10 AS VARCHAR) || '.' || CAST(fv % 10 AS VARCHAR)
         WHEN category = 'WSD' THEN CAST(CAST(floor(value / 4) AS BIGINT) AS VARCHAR)
         WHEN category = 'VEC' THEN CAST((event_id * 37) % 360 AS VARCHAR)
         WHEN category = 'PTY' THEN CAST(event_id % 8 AS VARCHAR)
         ELSE CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE '4' END END AS fcstValue,
    event_id AS _seq
  FROM (SELECT *, strftime(ts, '%Y%m%d') AS fcstDate, CAST(floor(value) AS BIGINT) AS fv,
          CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN 'TMN'
               WHEN event_type = 'view' AND event_id % 50 = 1 THEN 'TMX'
               WHEN event_type = 'view' THEN 'TMP'
               WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'WAV'
               WHEN event_type = 'click' THEN 'POP'
               WHEN event_type = 'signup' THEN 'WSD'
               WHEN event_type = 'purchase' THEN 'VEC'
               WHEN event_id % 2 = 0 THEN 'PTY' ELSE 'SKY' END AS category
        FROM events) e
)"""


# ------------------------------------------------------------------ v_message (legacy schema)
def v_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    cid = F.col("conv_id")
    return c.select(
        tf.format_ntz(F.date_add(F.lit("2024-01-01").cast("date"), (cid % 30).cast("int")), "yyyy-MM-dd").alias("date"),
        F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("role")).alias("team"),
        F.col("text").alias("message"),
        F.when(F.col("turn") % 4 == 1, F.lit("link")).alias("ref_type"),
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit("msg/"), cid.cast("string"), F.lit(".pdf"))).alias("ref_path"),
        cid.alias("conv_id"), F.col("turn"))


SQL_V_MESSAGE = """
v_message AS (
  SELECT strftime(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER), '%Y-%m-%d') AS date,
    CASE WHEN role = 'system' THEN '' ELSE role END AS team,
    text AS message,
    CASE WHEN turn % 4 = 1 THEN 'link' END AS ref_type,
    CASE WHEN turn % 4 = 1 THEN 'msg/' || CAST(conv_id AS VARCHAR) || '.pdf' END AS ref_path,
    conv_id, turn
  FROM conversations
)"""


SQL_VIEWS = {"v_permit": SQL_V_PERMIT, "v_dict": SQL_V_DICT, "v_visit": SQL_V_VISIT,
             "v_fuel": SQL_V_FUEL, "v_forecast": SQL_V_FORECAST, "v_message": SQL_V_MESSAGE}


def with_views(*names: str) -> str:
    """``WITH`` prefix holding the named SQL views (in the given order)."""
    return "WITH " + ",".join(SQL_VIEWS[n] for n in names)
