"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus DuckDB oracles.

Every query reads whole driver tables (through the adapter views) so its work
grows with the data; output columns are aliased identically on both sides.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as tf
from ..operators import window as W
from ..operators.joins import lookup_fill, unmapped_keys
from ..operators.merge import accumulate_keep_last
from . import sqlfrag as Q
from .pipelines import PERMIT_COLUMNS, permit_pipeline
from .views import v_dict, v_permit, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ====================================================================== C1 permit
PERMIT_OUT = PERMIT_COLUMNS + ["risk_keywords", "warning"]

_SQL_PERMIT_PARSED = f"""
permit_parsed AS (
  SELECT KYULGBN, PTW_AGBN, TEAMNM, DEPTNM, IOWKGBNNM, WKGBNNM,
    {Q.parse_permit('STDATE')} AS STDATE, {Q.parse_permit('EDDATE')} AS EDDATE,
    {Q.ensure_sn('HULLNO')} AS PJT, AREA_DETAIL, WORK_NM, ACODENM, _seq
  FROM v_permit)"""

_SQL_EXPAND = """
SELECT *, strftime(d, '%y-%m-%d') AS DATE FROM (
  SELECT t.*, unnest(generate_series(CAST(STDATE AS DATE),
      greatest(CAST(STDATE AS DATE), coalesce(CAST(EDDATE AS DATE), CAST(STDATE AS DATE))), INTERVAL 1 DAY)) AS d
  FROM {src} t WHERE STDATE IS NOT NULL) x"""

_SQL_DICT = """
dict AS (SELECT trim(work) AS work, coalesce(arg_max(keyword, _seq), '') AS keyword,
                coalesce(arg_max(warning, _seq), '') AS warning
         FROM v_dict WHERE trim(work) <> '' GROUP BY 1)"""

SQL_PERMIT_DAILY = with_views("v_permit", "v_dict") + "," + _SQL_PERMIT_PARSED + "," + _SQL_DICT + f""",
filtered AS (SELECT * FROM permit_parsed WHERE trim(TEAMNM) = 'F'),
expanded AS ({_SQL_EXPAND.format(src='filtered')}),
latest AS (SELECT * FROM expanded
           QUALIFY row_number() OVER (PARTITION BY DEPTNM, PJT, AREA_DETAIL, ACODENM, DATE ORDER BY _seq DESC) = 1)
SELECT {', '.join('l.' + c for c in PERMIT_COLUMNS)},
       CASE WHEN dict.work IS NOT NULL THEN dict.keyword END AS risk_keywords,
       CASE WHEN dict.work IS NOT NULL THEN dict.warning END AS warning
FROM latest l LEFT JOIN dict ON trim(l.ACODENM) = dict.work"""


def permit_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = permit_pipeline(v_permit(spark, sf_dir), None, v_dict(spark, sf_dir), team="F")
    return out.select(*PERMIT_OUT)


register("permit_daily", SQL_PERMIT_DAILY)(permit_daily)


# ====================================================================== N1 / N4
@register("ensure_sn", with_views("v_permit") + f"""
SELECT _seq, HULLNO AS raw, {Q.ensure_sn('HULLNO')} AS sn FROM v_permit""")
def q_ensure_sn(spark, sf_dir):
    return v_permit(spark, sf_dir).select("_seq", F.col("HULLNO").alias("raw"), tf.ensure_sn("HULLNO").alias("sn"))


@register("parse_ts_formats", with_views("v_permit") + f"""
SELECT _seq, STDATE AS raw_start, {Q.parse_permit('STDATE')} AS start_ts,
       EDDATE AS raw_end, {Q.parse_permit('EDDATE')} AS end_ts FROM v_permit""")
def q_parse_ts_formats(spark, sf_dir):
    return v_permit(spark, sf_dir).select(
        "_seq", F.col("STDATE").alias("raw_start"), tf.parse_ts_formats("STDATE").alias("start_ts"),
        F.col("EDDATE").alias("raw_end"), tf.parse_ts_formats("EDDATE").alias("end_ts"))


# ====================================================================== E1
@register("expand_daily", with_views("v_permit") + "," + _SQL_PERMIT_PARSED + f"""
SELECT _seq, DATE, CAST(d AS DATE) AS day FROM ({_SQL_EXPAND.format(src='permit_parsed')}) e""")
def q_expand_daily(spark, sf_dir):
    from ..operators.expand import expand_daily
    p = v_permit(spark, sf_dir).select("_seq", tf.parse_ts_formats("STDATE").alias("STDATE"),
                                       tf.parse_ts_formats("EDDATE").alias("EDDATE"))
    return expand_daily(p, "STDATE", "EDDATE", "DATE", day_col="day").select("_seq", "DATE", "day")


# ====================================================================== W1 / M2
_KL_KEYS = ("PJT", "ACODENM", "AREA_DETAIL")


@register("keep_last", with_views("v_permit") + f"""
SELECT PJT, ACODENM, AREA_DETAIL, DEPTNM, STDATE, _seq FROM (
  SELECT {Q.ensure_sn('HULLNO')} AS PJT, ACODENM, AREA_DETAIL, DEPTNM, STDATE, _seq FROM v_permit) t
QUALIFY row_number() OVER (PARTITION BY PJT, ACODENM, AREA_DETAIL ORDER BY _seq DESC) = 1""")
def q_keep_last(spark, sf_dir):
    p = v_permit(spark, sf_dir).select(tf.ensure_sn("HULLNO").alias("PJT"), "ACODENM", "AREA_DETAIL",
                                       "DEPTNM", "STDATE", "_seq")
    return W.keep_last(p, _KL_KEYS, ("_seq",))


@register("accumulate", with_views("v_permit") + f"""
, base AS (SELECT {Q.ensure_sn('HULLNO')} AS PJT, ACODENM, AREA_DETAIL, DEPTNM, STDATE, _seq,
                  CASE WHEN _odate < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS _batch FROM v_permit)
SELECT PJT, ACODENM, AREA_DETAIL, DEPTNM, STDATE, _seq, _batch FROM base
QUALIFY row_number() OVER (PARTITION BY PJT, ACODENM, AREA_DETAIL ORDER BY _batch DESC, _seq DESC) = 1""")
def q_accumulate(spark, sf_dir):
    """Stored table = permits of orders placed before 1998, load = the later ones."""
    p = v_permit(spark, sf_dir).select(tf.ensure_sn("HULLNO").alias("PJT"), "ACODENM", "AREA_DETAIL",
                                       "DEPTNM", "STDATE", "_seq", "_odate")
    old = F.col("_odate") < F.lit("1998-01-01").cast("timestamp_ntz")
    merged = accumulate_keep_last(p.filter(old).drop("_odate"), p.filter(~old).drop("_odate"), _KL_KEYS)
    return merged.select("PJT", "ACODENM", "AREA_DETAIL", "DEPTNM", "STDATE", "_seq",
                         F.col("_batch").cast("int").alias("_batch"))


# ====================================================================== J1 / J2
@register("lookup_fill", with_views("v_permit", "v_dict") + "," + _SQL_DICT + """
SELECT _seq, ACODENM,
  CASE WHEN dict.work IS NOT NULL THEN dict.keyword ELSE 'old:' || WORK_NM END AS risk_keywords,
  CASE WHEN dict.work IS NOT NULL THEN dict.warning END AS warning
FROM v_permit LEFT JOIN dict ON trim(v_permit.ACODENM) = dict.work""")
def q_lookup_fill(spark, sf_dir):
    """Rows carry an old keyword; hits are overwritten, misses keep it."""
    p = v_permit(spark, sf_dir).select("_seq", "ACODENM",
                                       F.concat(F.lit("old:"), F.col("WORK_NM")).alias("risk_keywords"))
    return lookup_fill(p, "ACODENM", v_dict(spark, sf_dir), "work",
                       {"risk_keywords": "keyword", "warning": "warning"}, ("_seq",))


@register("unmapped_keys", with_views("v_permit", "v_dict") + """
SELECT trim(ACODENM) AS key, min(_seq) AS first_seen FROM v_permit
WHERE trim(ACODENM) <> '' AND trim(ACODENM) NOT IN (SELECT trim(work) FROM v_dict WHERE work IS NOT NULL)
GROUP BY 1""")
def q_unmapped_keys(spark, sf_dir):
    return unmapped_keys(v_permit(spark, sf_dir), "ACODENM", v_dict(spark, sf_dir), "work", "_seq")


# Register the remaining query modules (import order = registration order).
from . import q_forecast, q_merge, q_visits  # noqa: E402,F401
from . import q_docs, q_misc  # noqa: E402,F401
from . import q_ops  # noqa: E402,F401
from . import q_more  # noqa: E402,F401
from . import q_import  # noqa: E402,F401
from . import q_landing  # noqa: E402,F401
