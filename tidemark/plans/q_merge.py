"""Queries over the fuel views: key-set replace, diff, tagging, numeric and time cleaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.joins import tag_new_or_replaced
from ..operators.merge import replace_by_key
from ..operators.quality import analyze_diff
from . import sqlfrag as Q
from .queries import register
from .views import read, v_fuel_new, v_fuel_old, v_permit, with_views

_FUEL = ("PJT", "일정구분", "HFO", "LDO", "Start", "_seq")
_QF = ", ".join(f'"{c}"' for c in _FUEL)


@register("replace_by_key", with_views("v_fuel") + f""",
nk AS (SELECT DISTINCT {Q.ensure_sn('PJT')} AS k FROM v_fuel_new)
SELECT {_QF}, 0 AS _batch FROM v_fuel_old WHERE PJT NOT IN (SELECT k FROM nk)
UNION ALL
SELECT {Q.ensure_sn('PJT')} AS PJT, "일정구분", HFO, LDO, "Start", _seq, 1 AS _batch FROM v_fuel_new""")
def q_replace_by_key(spark, sf_dir):
    out = replace_by_key(v_fuel_old(spark, sf_dir), v_fuel_new(spark, sf_dir), "PJT")
    return out.select(*_FUEL, F.col("_batch").cast("int"))


@register("analyze_diff", with_views("v_fuel") + f""",
n AS (SELECT {Q.ensure_sn('PJT')} AS k, count(*) AS nr FROM v_fuel_new GROUP BY 1),
o AS (SELECT PJT AS k, count(*) AS er FROM v_fuel_old GROUP BY 1),
j AS (SELECT n.nr, o.er FROM n FULL OUTER JOIN o ON n.k = o.k)
SELECT count(*) FILTER (WHERE nr IS NOT NULL AND er IS NULL) AS added,
       count(*) FILTER (WHERE nr IS NOT NULL AND er IS NOT NULL) AS changed,
       count(*) FILTER (WHERE nr IS NULL AND er IS NOT NULL) AS kept,
       CAST(coalesce(sum(nr), 0) AS BIGINT) AS new_rows, CAST(coalesce(sum(er), 0) AS BIGINT) AS exist_rows
FROM j""")
def q_analyze_diff(spark, sf_dir):
    new = v_fuel_new(spark, sf_dir).withColumn("PJT", tf.ensure_sn("PJT"))
    return analyze_diff(new, v_fuel_old(spark, sf_dir), "PJT")


@register("analyze_empty", with_views("v_fuel") + """
SELECT CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS kept, CAST(0 AS BIGINT) AS new_rows,
       count(*) AS exist_rows FROM v_fuel_old""")
def q_analyze_empty(spark, sf_dir):
    """Q1 with a load whose rows all fail the filter: nothing is compared."""
    new = v_fuel_new(spark, sf_dir).filter(F.col("PJT") == "no such hull")
    return analyze_diff(new, v_fuel_old(spark, sf_dir), "PJT")


@register("tag_new", with_views("v_permit") + f""",
stored AS (SELECT DISTINCT 'SN' || CAST(s_suppkey + 2620 AS VARCHAR) AS k FROM supplier)
SELECT _seq, {Q.ensure_sn('HULLNO')} AS PJT,
  CASE WHEN {Q.ensure_sn('HULLNO')} IN (SELECT k FROM stored) THEN 'replace' ELSE 'new' END AS _tag
FROM v_permit""")
def q_tag_new(spark, sf_dir):
    new = v_permit(spark, sf_dir).select("_seq", tf.ensure_sn("HULLNO").alias("PJT"))
    stored = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("SN"), (F.col("s_suppkey") + 2620).cast("string")).alias("PJT"))
    return tag_new_or_replaced(new, stored, "PJT")


@register("numeric_clean", with_views("v_fuel") + f"""
SELECT _seq, HFO AS raw, try_cast(trim(HFO) AS DOUBLE) AS hfo,
  {Q.round_half_even('try_cast(trim(HFO) AS DOUBLE) / 8', 2)} AS hfo_eighth,
  try_cast(trim(LDO) AS DOUBLE) AS ldo,
  coalesce(CAST(try_cast(trim(replace(m, '월', '')) AS DOUBLE) AS INTEGER), 0) AS month
FROM (SELECT *, CASE _seq % 3 WHEN 0 THEN CAST(month("Start") AS VARCHAR) || '월'
                              WHEN 1 THEN ' ' || CAST(month("Start") AS VARCHAR) || ' ' ELSE 'x월' END AS m
      FROM (SELECT * FROM v_fuel_old UNION ALL SELECT * FROM v_fuel_new) u) t""")
def q_numeric_clean(spark, sf_dir):
    u = v_fuel_old(spark, sf_dir).unionByName(v_fuel_new(spark, sf_dir))
    m = (F.when(F.col("_seq") % 3 == 0, F.concat(F.month("Start").cast("string"), F.lit("월")))
         .when(F.col("_seq") % 3 == 1, F.concat(F.lit(" "), F.month("Start").cast("string"), F.lit(" ")))
         .otherwise(F.lit("x월")))
    hfo = tf.to_number("HFO")
    return u.select("_seq", F.col("HFO").alias("raw"), hfo.alias("hfo"),
                    tf.round_half_even(hfo / 8, 2).alias("hfo_eighth"), tf.to_number("LDO").alias("ldo"),
                    tf.to_int_default(m, "월").alias("month"))


def _mixed_text(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    bt = F.timestamp_add("MINUTE", (k % 24) * 60 + (k % 4) * 15, F.col("o_orderdate"))
    o = o.withColumn("_bt", bt)
    b = F.col("_bt")
    kr = F.concat(tf.format_ntz(b, "yyyy-MM-dd"), F.lit(" "),
                  F.when(F.hour(b) < 12, F.lit("오전")).otherwise(F.lit("오후")), F.lit(" "),
                  tf.format_ntz(b, "h:mm:ss"))
    txt = (F.when(k % 6 == 0, tf.format_ntz(b, "yyyy-MM-dd hh:mm a"))
           .when(k % 6 == 1, F.lower(tf.format_ntz(b, "yyyy/MM/dd h:mm:ss a")))
           .when(k % 6 == 2, kr)
           .when(k % 6 == 3, F.concat(tf.format_ntz(b, "yyyy-MM-dd HH:mm"), F.lit(" PM")))
           .when(k % 6 == 4, tf.format_ntz(b, "yyyy-MM-dd"))
           .otherwise(F.element_at(F.array(tf.format_ntz(b, "yyyyMMdd"), tf.format_ntz(b, "yyyy.MM.dd"),
                                           F.lit("nan"), F.lit("garbage text")), (k % 4 + 1).cast("int"))))
    return o.select(k.alias("_seq"), txt.alias("raw"))


@register("parse_ts_mixed", f"""
WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST((o_orderkey % 24) * 60 + (o_orderkey % 4) * 15 AS BIGINT)) AS b
           FROM orders),
t AS (SELECT o_orderkey AS _seq, CASE o_orderkey % 6
   WHEN 0 THEN strftime(b, '%Y-%m-%d %I:%M %p')
   WHEN 1 THEN lower(strftime(b, '%Y/%m/%d %-I:%M:%S %p'))
   WHEN 2 THEN strftime(b, '%Y-%m-%d') || ' ' || CASE WHEN hour(b) < 12 THEN '오전' ELSE '오후' END || ' ' || strftime(b, '%-I:%M:%S')
   WHEN 3 THEN strftime(b, '%Y-%m-%d %H:%M') || ' PM'
   WHEN 4 THEN strftime(b, '%Y-%m-%d')
   ELSE [strftime(b, '%Y%m%d'), strftime(b, '%Y.%m.%d'), 'nan', 'garbage text'][CAST(o_orderkey % 4 + 1 AS INTEGER)] END AS raw
 FROM o)
SELECT _seq, raw, {Q.parse_mixed('raw')} AS ts FROM t""")
def q_parse_ts_mixed(spark, sf_dir):
    t = _mixed_text(spark, sf_dir)
    return t.select("_seq", "raw", tf.parse_ts_mixed("raw").alias("ts"))


@register("excel_serial", """
WITH t AS (SELECT o_orderkey AS _seq, CASE WHEN o_orderkey % 50 = 0 THEN 999.0 WHEN o_orderkey % 50 = 1 THEN 250000.0
   ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) + (o_orderkey % 96) / 96.0 END AS serial
 FROM orders)
SELECT _seq, serial, CASE WHEN serial > 1000 AND serial < 200000
  THEN TIMESTAMP '1899-12-30 00:00:00' + to_microseconds(CAST(round(serial * 86400000000.0) AS BIGINT)) END AS ts FROM t""")
def q_excel_serial(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    serial = (F.when(k % 50 == 0, F.lit(999.0)).when(k % 50 == 1, F.lit(250000.0))
              .otherwise(F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("double")
                         + (k % 96) / 96.0))
    return o.select(k.alias("_seq"), serial.alias("serial"),
                    tf.parse_ts_mixed(serial, numeric=True).alias("ts"))
