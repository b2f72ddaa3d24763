"""Queries over the visit view: periods, assessment cards, state restore, masking."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.expand import split_periods
from ..operators.merge import rederive_preserving_state
from ..operators.quality import mask_for_display
from ..operators.filters import COMMISSIONING_DEPTS
from . import sqlfrag as Q
from .pipelines import RA_COLUMNS, RA_KEYS, assessment_cards
from .queries import register
from ..session import work_dir
from .views import read, v_visit, with_views

AS_OF = "2001-12-31"


# ---------------------------------------------------------------------- E2
_SQL_PERIODS = """
pbase AS (SELECT *, date_diff('day', visit_start, visit_end) + 1 AS n FROM {src}),
pchunks AS (
  SELECT * FROM (
    SELECT pbase.*, visit_start + CAST(7 * i AS INTEGER) AS ps,
           least(visit_start + CAST(7 * i + 6 AS INTEGER), visit_end) AS pe
    FROM (SELECT *, unnest(generate_series(0, greatest(CAST(ceil(n / 7.0) AS BIGINT) - 1, 0))) AS i FROM pbase) pbase
  ) c WHERE n > 1 AND date_diff('day', ps, pe) + 1 >= 2),
periods AS (
  SELECT * EXCLUDE (i) FROM pchunks
  UNION ALL
  SELECT pbase.*, visit_start AS ps, visit_end AS pe FROM pbase
  WHERE n <= 1 OR NOT EXISTS (SELECT 1 FROM pchunks WHERE pchunks._seq = pbase._seq))"""


@register("split_periods", with_views("v_visit") + "," + _SQL_PERIODS.format(src="v_visit") + """
SELECT _seq, ps AS period_start, pe AS period_end FROM periods""")
def q_split_periods(spark, sf_dir):
    v = v_visit(spark, sf_dir).select("_seq", "visit_start", "visit_end")
    return split_periods(v).select("_seq", "period_start", "period_end")


# ---------------------------------------------------------------------- C5 cards
_COMM = " OR ".join(f"contains(coalesce(dept, ''), '{d}')" for d in COMMISSIONING_DEPTS)
_SQL_CARDS = (_SQL_PERIODS.format(src="vbase") + f""",
crow AS (
  SELECT coalesce(trim(name), '') AS name, coalesce(trim(phone), '') AS phone,
         coalesce(trim(company), '') AS company, coalesce(trim(project), '') AS project,
         coalesce(trim(work_content), '') AS work_content, coalesce(trim(greeter), '') AS greeter,
         coalesce(dept, '') AS dept, CAST(visit_start AS VARCHAR) AS visit_start,
         CAST(visit_end AS VARCHAR) AS visit_end, CAST(ps AS VARCHAR) AS period_start,
         CAST(pe AS VARCHAR) AS period_end, ({_COMM}) AS is_commissioning, _seq
  FROM periods),
cname AS (SELECT company, period_start, period_end, work_content, dept, string_agg(v, ', ' ORDER BY fs) AS name
          FROM (SELECT company, period_start, period_end, work_content, dept, name AS v, min(_seq) AS fs FROM crow
                WHERE name <> '' AND name <> 'nan' GROUP BY ALL) x GROUP BY ALL),
cphone AS (SELECT company, period_start, period_end, work_content, dept, string_agg(v, ', ' ORDER BY fs) AS phone
          FROM (SELECT company, period_start, period_end, work_content, dept, phone AS v, min(_seq) AS fs FROM crow
                WHERE phone <> '' AND phone <> 'nan' GROUP BY ALL) x GROUP BY ALL),
cbase AS (SELECT company, period_start, period_end, work_content, dept,
                 arg_min(visit_start, _seq) AS visit_start, arg_max(visit_end, _seq) AS visit_end,
                 arg_min(project, _seq) AS project, arg_min(greeter, _seq) AS greeter,
                 bool_or(is_commissioning) AS is_commissioning
          FROM crow GROUP BY ALL),
cards AS (
  SELECT coalesce(cname.name, '') AS name, coalesce(cphone.phone, '') AS phone, b.company, b.visit_start,
         b.visit_end, b.project, b.work_content, b.greeter, b.dept, b.period_start, b.period_end,
         b.is_commissioning, 'N' AS ra_done, '' AS ra_file, 'N' AS excluded, '' AS exclude_reason,
         '' AS greeter_actual, '' AS greeter_actual_dept, 'N' AS manual
  FROM cbase b
  LEFT JOIN cname USING (company, period_start, period_end, work_content, dept)
  LEFT JOIN cphone USING (company, period_start, period_end, work_content, dept))""")

_SQL_VBASE = f"""
vbase AS (SELECT * FROM v_visit WHERE visit_start IS NOT NULL AND visit_end IS NOT NULL
          AND visit_start >= DATE '{AS_OF}' - 1095)"""


@register("assessment_cards", with_views("v_visit") + "," + _SQL_VBASE + "," + _SQL_CARDS + f"""
SELECT {', '.join(RA_COLUMNS)} FROM cards""")
def q_assessment_cards(spark, sf_dir):
    return assessment_cards(v_visit(spark, sf_dir), AS_OF)


# ---------------------------------------------------------------------- M5 (J4 + J5)
def existing_state(cards):
    """Stored cards with externally written state (built from the derived cards):
    every card except work W0 carries state; W2 cards were also edited by hand
    (later, so they win); W1 cards exist as manual cards under another company."""
    n = F.length("name")
    ra_done = F.when(n % 3 == 0, F.lit("Y")).otherwise(F.lit("N"))
    excluded = F.when(F.length("phone") % 5 == 0, F.lit("Y")).otherwise(F.lit("N"))
    state = cards.filter(F.col("work_content") != "W0").withColumns({
        "ra_done": ra_done, "ra_file": F.when(ra_done == "Y", F.concat(F.lit("ra/"), F.col("company"), F.lit(".pdf")))
        .otherwise(F.lit("")), "excluded": excluded,
        "exclude_reason": F.when(excluded == "Y", F.lit("dup")).otherwise(F.lit("")),
        "greeter_actual": F.concat(F.col("greeter"), F.lit("*")),
        "greeter_actual_dept": F.lit(None).cast("string"), "_seq": F.lit(0).cast("long")})
    edited = cards.filter(F.col("work_content") == "W2").withColumns({
        "ra_done": F.lit("Y"), "ra_file": F.lit("manual.pdf"), "manual": F.lit("Y"), "_seq": F.lit(1).cast("long")})
    manual = cards.filter(F.col("work_content") == "W1").withColumns({
        "company": F.concat(F.lit("MANUAL-"), F.col("company")), "manual": F.lit("Y"),
        "ra_done": F.lit("Y"), "_seq": F.lit(2).cast("long")})
    return state.unionByName(edited).unionByName(manual)


_STATE_SQL = """
state AS (
  SELECT * REPLACE (
    CASE WHEN length(name) % 3 = 0 THEN 'Y' ELSE 'N' END AS ra_done,
    CASE WHEN length(name) % 3 = 0 THEN 'ra/' || company || '.pdf' ELSE '' END AS ra_file,
    CASE WHEN length(phone) % 5 = 0 THEN 'Y' ELSE 'N' END AS excluded,
    CASE WHEN length(phone) % 5 = 0 THEN 'dup' ELSE '' END AS exclude_reason,
    greeter || '*' AS greeter_actual, CAST(NULL AS VARCHAR) AS greeter_actual_dept), 0 AS _seq
  FROM cards WHERE work_content <> 'W0'
  UNION ALL
  SELECT * REPLACE ('Y' AS ra_done, 'manual.pdf' AS ra_file, 'Y' AS manual), 1 AS _seq FROM cards WHERE work_content = 'W2'
  UNION ALL
  SELECT * REPLACE ('MANUAL-' || company AS company, 'Y' AS manual, 'Y' AS ra_done), 2 AS _seq
  FROM cards WHERE work_content = 'W1'),
slast AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY company, period_start, period_end,
          work_content, dept ORDER BY _seq DESC) = 1)"""

_STATE_COLS = ("ra_done", "ra_file", "excluded", "exclude_reason", "greeter_actual", "greeter_actual_dept")
_RESTORED = ", ".join(
    (f"CASE WHEN s.company IS NOT NULL THEN s.{c} ELSE c.{c} END AS {c}" if c in _STATE_COLS else f"c.{c}")
    for c in RA_COLUMNS)


@register("restore_state", with_views("v_visit") + "," + _SQL_VBASE + "," + _SQL_CARDS + "," + _STATE_SQL + f"""
SELECT {_RESTORED} FROM cards c LEFT JOIN slast s USING (company, period_start, period_end, work_content, dept)
UNION ALL
SELECT {', '.join(RA_COLUMNS)} FROM state m
WHERE manual = 'Y' AND NOT EXISTS (SELECT 1 FROM cards c WHERE c.company = m.company AND c.period_start = m.period_start
  AND c.period_end = m.period_end AND c.work_content = m.work_content AND c.dept = m.dept)""")
def q_restore_state(spark, sf_dir):
    """The derived cards are checkpointed once (reliable checkpoint in the shared work
    folder): the stored state is built from them, as a stored table would be read."""
    work_dir(spark)
    cards = assessment_cards(v_visit(spark, sf_dir), AS_OF).checkpoint(eager=True)
    return rederive_preserving_state(cards, existing_state(cards), RA_KEYS).select(*RA_COLUMNS)


# ---------------------------------------------------------------------- N5
def _flex_text(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    txt = (F.when(k % 5 == 0, tf.format_ntz(d, "yyyyMMdd"))
           .when(k % 5 == 1, tf.format_ntz(d, "yyyy-MM-dd"))
           .when(k % 5 == 2, F.concat(tf.format_ntz(d, "yyyy"), F.lit("13"), tf.format_ntz(d, "dd")))
           .when(k % 5 == 3, F.lit(""))
           .otherwise(tf.format_ntz(d, "yyyy/M/d")))
    return o.select(k.alias("_seq"), txt.alias("raw"))


@register("parse_date_flex", f"""
WITH t AS (SELECT o_orderkey AS _seq,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
       WHEN 2 THEN strftime(o_orderdate, '%Y') || '13' || strftime(o_orderdate, '%d') WHEN 3 THEN ''
       ELSE strftime(o_orderdate, '%Y/%-m/%-d') END AS raw FROM orders)
SELECT _seq, raw, {Q.date_flex('raw')} AS d FROM t""")
def q_parse_date_flex(spark, sf_dir):
    t = _flex_text(spark, sf_dir)
    return t.select("_seq", "raw", tf.parse_date_flex("raw").alias("d"))


# ---------------------------------------------------------------------- Q4 / N16 / N17
def _people(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    ck, nm, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    a = F.lpad((ck % 10000).cast("string"), 4, "0")
    b = F.lpad(((ck * 7) % 10000).cast("string"), 4, "0")
    name = (F.when(ck % 5 == 0, nm).when(ck % 5 == 1, F.substring(nm, 10, 2))
            .when(ck % 5 == 2, F.concat(nm, F.lit(", "), seg)).when(ck % 5 == 3, F.substring(nm, 1, 1))
            .otherwise(F.concat(F.lit("김"), F.substring(seg, 1, 2))))
    phone = (F.when(ck % 6 == 0, F.concat(F.lit("010-"), a, F.lit("-"), b))
             .when(ck % 6 == 1, F.concat(F.lit("010"), a, b)).when(ck % 6 == 2, F.concat(F.lit("02"), a, b))
             .when(ck % 6 == 3, F.lit("010-1, 010-2")).when(ck % 6 == 4, F.lit("123"))
             .otherwise(F.concat(F.lit("010 "), a, F.lit(" "), b)))
    return c.select(ck.alias("c_custkey"), name.alias("name"), phone.alias("phone"), seg.alias("greeter"),
                    seg.alias("segment"))


_SQL_PEOPLE = """
people AS (SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN substr(c_name, 10, 2) WHEN 2 THEN c_name || ', ' || c_mktsegment
       WHEN 3 THEN substr(c_name, 1, 1) ELSE '김' || substr(c_mktsegment, 1, 2) END AS name,
  CASE c_custkey % 6 WHEN 0 THEN '010-' || a || '-' || b WHEN 1 THEN '010' || a || b WHEN 2 THEN '02' || a || b
       WHEN 3 THEN '010-1, 010-2' WHEN 4 THEN '123' ELSE '010 ' || a || ' ' || b END AS phone,
  c_mktsegment AS greeter, c_mktsegment AS segment
  FROM (SELECT *, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS a,
               lpad(CAST((c_custkey * 7) % 10000 AS VARCHAR), 4, '0') AS b FROM customer) c)"""


@register("mask_people", "WITH " + _SQL_PEOPLE + f"""
SELECT c_custkey, {Q.mask_name('name')} AS name, {Q.mask_phone('phone')} AS phone,
       {Q.mask_name('greeter')} AS greeter, segment FROM people""")
def q_mask_people(spark, sf_dir):
    return mask_for_display(_people(spark, sf_dir))
