"""Queries over the forecast feed (events) and the calendar."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.expand import (COMPANY_HOLIDAYS, FIXED_HOLIDAYS, calendar_from_days, days_between,
                                fixed_date_company, fixed_date_holidays)
from ..operators.merge import upsert_by_key
from ..operators.aggregate import PTY_LABELS, SKY_LABELS
from . import sqlfrag as Q
from .pipelines import forecast_pipeline
from .queries import register
from .views import read, v_forecast, with_views

FORECAST_COLS = ("forecast_date", "tmp_min", "tmp_max", "tmp_avg", "pop_max", "pty_code", "pty_label",
                 "sky_code", "sky_label", "wsd_avg", "wsd_max", "wav_height", "vec_deg", "vec_dir",
                 "keyword", "warning")


def _label_case(x: str, m: dict) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in m.items()) + " ELSE '-' END)"


def _num(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


_RISK = [("tmp_min <= 0", "동파위험", f"'최저기온 ' || {_num('tmp_min')} || '°C — 블랙아이스·동파 주의'"),
         ("tmp_max >= 30", "온열질환", f"'최고기온 ' || {_num('tmp_max')} || '°C — 온열질환 주의'"),
         ("pop_max >= 30", "미끄럼주의", f"'강수확률 ' || {_num('pop_max')} || '% — 침수·미끄럼 주의'"),
         ("wsd_max >= 15", "강풍", f"'최대풍속 ' || {_num('wsd_max')} || 'm/s — 고소작업 제한'"),
         ("wav_height >= 1.0", "수중작업금지", f"'파고 ' || {_num('wav_height')} || 'm — 수중작업 중지'")]
_KW = "nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k, _ in _RISK) + "), '')"
_WN = "nullif(concat_ws(' / ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, _, t in _RISK) + "), '')"


def sql_daily(src: str) -> str:
    """DuckDB daily summary (+ risk rules) of a forecast feed CTE named ``src``."""
    return f"""
f_{src} AS (SELECT CAST(strptime(fcstDate, '%Y%m%d') AS DATE) AS d, category AS cat, fcstValue AS raw,
            try_cast(trim(fcstValue) AS DOUBLE) AS num, _seq FROM {src}),
g_{src} AS (SELECT d,
    min(num) FILTER (WHERE cat = 'TMP' AND num IS NOT NULL) AS tmin,
    max(num) FILTER (WHERE cat = 'TMP' AND num IS NOT NULL) AS tmax,
    avg(num) FILTER (WHERE cat = 'TMP' AND num IS NOT NULL) AS tavg,
    arg_max(num, _seq) FILTER (WHERE cat = 'TMN' AND num IS NOT NULL) AS tmn,
    arg_max(num, _seq) FILTER (WHERE cat = 'TMX' AND num IS NOT NULL) AS tmx,
    max(num) FILTER (WHERE cat = 'POP' AND num IS NOT NULL) AS pop_max,
    avg(num) FILTER (WHERE cat = 'WSD' AND num IS NOT NULL) AS wavg,
    max(num) FILTER (WHERE cat = 'WSD' AND num IS NOT NULL) AS wsd_max,
    max(num) FILTER (WHERE cat = 'WAV' AND num IS NOT NULL) AS wav_height,
    avg(num) FILTER (WHERE cat = 'VEC' AND num IS NOT NULL) AS vec
  FROM f_{src} GROUP BY d),
pty_{src} AS (SELECT d, raw FROM f_{src} WHERE cat = 'PTY' AND raw <> '0' GROUP BY d, raw
              QUALIFY row_number() OVER (PARTITION BY d ORDER BY count(*) DESC, raw) = 1),
sky_{src} AS (SELECT d, raw FROM f_{src} WHERE cat = 'SKY' GROUP BY d, raw
              QUALIFY row_number() OVER (PARTITION BY d ORDER BY count(*) DESC, raw) = 1),
daily0_{src} AS (SELECT g.d AS forecast_date,
    coalesce(tmin, CASE WHEN tavg IS NULL THEN tmn END) AS tmp_min,
    coalesce(tmax, CASE WHEN tavg IS NULL THEN tmx END) AS tmp_max,
    {Q.round_half_even('tavg', 1)} AS tmp_avg, pop_max,
    coalesce(p.raw, '0') AS pty_code, {_label_case("coalesce(p.raw, '0')", PTY_LABELS)} AS pty_label,
    coalesce(s.raw, '1') AS sky_code, {_label_case("coalesce(s.raw, '1')", SKY_LABELS)} AS sky_label,
    {Q.round_half_even('wavg', 1)} AS wsd_avg, wsd_max, wav_height,
    {Q.round_half_even('vec', 1)} AS vec_deg, {Q.compass16('vec')} AS vec_dir
  FROM g_{src} g LEFT JOIN pty_{src} p ON g.d = p.d LEFT JOIN sky_{src} s ON g.d = s.d),
daily_{src} AS (SELECT *, {_KW} AS keyword, {_WN} AS warning FROM daily0_{src})"""


@register("forecast_daily", with_views("v_forecast") + "," + sql_daily("v_forecast") + f"""
SELECT {', '.join(FORECAST_COLS)} FROM daily_v_forecast""")
def q_forecast_daily(spark, sf_dir):
    return forecast_pipeline(v_forecast(spark, sf_dir)).select(*FORECAST_COLS)


@register("upsert_by_date", with_views("v_forecast") + """,
feed_old AS (SELECT * FROM v_forecast WHERE fcstDate < '20240120'),
feed_new AS (SELECT * FROM v_forecast WHERE fcstDate >= '20240110'),""" + sql_daily("feed_old") + ","
          + sql_daily("feed_new") + f"""
SELECT {', '.join(FORECAST_COLS)}, 0 AS _batch FROM daily_feed_old
WHERE forecast_date NOT IN (SELECT forecast_date FROM daily_feed_new)
UNION ALL SELECT {', '.join(FORECAST_COLS)}, 1 AS _batch FROM daily_feed_new""")
def q_upsert_by_date(spark, sf_dir):
    """Stored forecast computed up to the 19th; a re-fetch from the 10th on replaces the overlap."""
    feed = v_forecast(spark, sf_dir)
    old = forecast_pipeline(feed.filter(F.col("fcstDate") < "20240120"))
    new = forecast_pipeline(feed.filter(F.col("fcstDate") >= "20240110"))
    return upsert_by_key(old, new, "forecast_date").select(*FORECAST_COLS, F.col("_batch").cast("int"))


@register("compass", f"""
WITH t AS (SELECT event_id, ((event_id * 37) % 1440) / 4.0 AS deg FROM events)
SELECT event_id, CAST(deg AS DOUBLE) AS deg, {Q.compass16('CAST(deg AS DOUBLE)')} AS dir FROM t""")
def q_compass(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id")
    deg = (((F.col("event_id") * 37) % 1440) / 4.0).cast("double")
    return e.select("event_id", deg.alias("deg"), tf.compass16(deg).alias("dir"))


@register("publication_slot", """
WITH t AS (SELECT event_id, ts - INTERVAL 10 MINUTE AS u FROM events),
s AS (SELECT event_id, u, list_max(list_filter(['0200','0500','0800','1100','1400','1700','2000','2300'],
        lambda x: x <= strftime(u, '%H%M'))) AS sl FROM t)
SELECT event_id, CASE WHEN sl IS NULL THEN strftime(CAST(u AS DATE) - 1, '%Y%m%d') ELSE strftime(u, '%Y%m%d') END
       AS base_date, coalesce(sl, '2300') AS base_time FROM s""")
def q_publication_slot(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "ts")
    return e.select("event_id", tf.publication_slot("ts").alias("p")).select("event_id", "p.*")


_HOL_VALUES = ", ".join(f"('{md}', '{n}')" for md, n in FIXED_HOLIDAYS)
_COMPANY = ", ".join(f"'{md}'" for md in COMPANY_HOLIDAYS)


@register("calendar", f"""
WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders),
days AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
hol AS (SELECT * FROM (VALUES {_HOL_VALUES}) h(md, holiday_name))
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
  substr('월화수목금토일', CAST(isodow(date) AS INTEGER), 1) AS weekday_name_kor,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(week(date) AS INTEGER) AS week_of_year,
  isodow(date) >= 6 AS is_weekend, hol.md IS NOT NULL AS is_holiday, coalesce(hol.holiday_name, '') AS holiday_name,
  strftime(date, '%m-%d') IN ({_COMPANY}) AS is_company_holiday,
  NOT (isodow(date) >= 6 OR hol.md IS NOT NULL OR strftime(date, '%m-%d') IN ({_COMPANY})) AS is_business_day
FROM days LEFT JOIN hol ON strftime(days.date, '%m-%d') = hol.md""")
def q_calendar(spark, sf_dir):
    days = days_between(read(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate")
    days = days.repartition(max(1, spark.sparkContext.defaultParallelism), "date")
    return calendar_from_days(days, fixed_date_holidays(days), fixed_date_company(days))


@register("risk_rules", with_views("v_forecast") + "," + sql_daily("v_forecast") + """
SELECT forecast_date, tmp_min, tmp_max, pop_max, wsd_max, wav_height, keyword, warning FROM daily_v_forecast""")
def q_risk_rules(spark, sf_dir):
    """Q7 alone: rule keywords and warnings of each forecast day."""
    from ..operators.aggregate import daily_forecast
    from ..operators.quality import risk_rules
    feed = v_forecast(spark, sf_dir).withColumn("fcst_date", F.try_to_date(F.col("fcstDate"), "yyyyMMdd"))
    daily = daily_forecast(feed, "fcst_date", "category", "fcstValue", "_seq")
    return risk_rules(daily).select("forecast_date", "tmp_min", "tmp_max", "pop_max", "wsd_max", "wav_height",
                                    "keyword", "warning")
