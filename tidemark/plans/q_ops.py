"""Small operator queries: set ops, probes, manifest helpers, message edits."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.aggregate import any_match_columns, category_counts, mixed_text_columns, result_summary
from ..operators.expand import split_multi
from ..operators.merge import delete_matching
from ..operators.window import distinct_first_seen, key_classes, latest_name
from . import sqlfrag as Q
from .q_docs import SQL_V_MANIFEST, _migrated, v_manifest
from .queries import register
from .views import read, v_fuel_new, v_fuel_old, v_permit, with_views


@register("key_sets", with_views("v_fuel") + f""",
n AS (SELECT DISTINCT {Q.ensure_sn('PJT')} AS k FROM v_fuel_new), o AS (SELECT DISTINCT PJT AS k FROM v_fuel_old)
SELECT (SELECT count(*) FROM n WHERE k NOT IN (SELECT k FROM o)) AS only_new,
       (SELECT count(*) FROM n WHERE k IN (SELECT k FROM o)) AS both,
       (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM n)) AS only_old""")
def q_key_sets(spark, sf_dir):
    """New − old, new ∩ old, old − new on distinct keys, counted from one key aggregate."""
    new = v_fuel_new(spark, sf_dir).withColumn("PJT", tf.ensure_sn("PJT"))
    c = key_classes(new, v_fuel_old(spark, sf_dir), "PJT")
    return c.agg(F.count_if(F.col("in_new") & ~F.col("in_old")).alias("only_new"),
                 F.count_if(F.col("in_new") & F.col("in_old")).alias("both"),
                 F.count_if(F.col("in_old") & ~F.col("in_new")).alias("only_old"))


@register("distinct_first_seen", with_views("v_permit") + """
SELECT DEPTNM, AREA_DETAIL, min(_seq) AS first_seen FROM v_permit GROUP BY 1, 2""")
def q_distinct_first_seen(spark, sf_dir):
    """U4: order-preserving distinct (first position per value)."""
    return distinct_first_seen(v_permit(spark, sf_dir), ["DEPTNM", "AREA_DETAIL"])


@register("latest_name", "WITH " + SQL_V_MANIFEST + """
SELECT section, count(*) AS n_files, max(file_name) AS latest_name FROM v_manifest
WHERE NOT starts_with(file_name, '_') GROUP BY 1""")
def q_latest_name(spark, sf_dir):
    """O3 per landing section (names starting with '_' are hidden, as in a folder listing)."""
    m = v_manifest(spark, sf_dir).filter(~F.col("file_name").startswith("_"))
    return latest_name(m, ["section"])


AS_OF = "2001-08-01"


@register("manifest_labels", "WITH " + SQL_V_MANIFEST + f"""
SELECT _seq, lower(CASE WHEN contains(file_name, '.') THEN split_part(file_name, '.', -1) ELSE '' END) AS ext,
  CASE lower(CASE WHEN contains(file_name, '.') THEN split_part(file_name, '.', -1) ELSE '' END)
    WHEN 'pdf' THEN 'pdf' WHEN 'pptx' THEN 'ppt' WHEN 'ppt' THEN 'ppt' WHEN 'xlsx' THEN 'excel' WHEN 'xls' THEN 'excel'
    WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'gif' THEN 'image'
    WHEN 'mp4' THEN 'video' WHEN 'mov' THEN 'video' WHEN 'avi' THEN 'video' ELSE 'pdf' END AS ext_type,
  CASE WHEN modification_time IS NULL THEN 'none'
       WHEN date_diff('day', CAST(modification_time AS DATE), DATE '{AS_OF}') <= 1 THEN 'new'
       WHEN date_diff('day', CAST(modification_time AS DATE), DATE '{AS_OF}') <= 7 THEN 'mid' ELSE 'old' END AS recency,
  CASE WHEN date_diff('day', CAST(modification_time AS DATE), DATE '{AS_OF}') = 0
       THEN '오늘 ' || strftime(modification_time, '%H:%M')
       WHEN date_diff('day', CAST(modification_time AS DATE), DATE '{AS_OF}') = 1 THEN '어제'
       ELSE CAST(date_diff('day', CAST(modification_time AS DATE), DATE '{AS_OF}') AS VARCHAR) || '일 전' END AS label
FROM v_manifest""")
def q_manifest_labels(spark, sf_dir):
    """N21 extension -> type, N28 recency class and label against a fixed as-of date."""
    m = v_manifest(spark, sf_dir)
    return m.select("_seq", tf.file_ext("file_name").alias("ext"), tf.ext_type("file_name").alias("ext_type"),
                    tf.recency_class("modification_time", F.lit(AS_OF)).alias("recency"),
                    tf.recency_label("modification_time", F.lit(AS_OF)).alias("label"))


@register("message_delete", with_views("v_message") + """,
migrated AS (SELECT coalesce(date, '') AS date, coalesce(nullif(team, ''), '전체') AS team, coalesce(message, '') AS content,
  coalesce(nullif(ref_type, ''), '없음') AS ref_type, coalesce(ref_path, '') AS ref_path, conv_id, turn FROM v_message)
SELECT * FROM migrated WHERE NOT (team = 'assistant' AND ref_type = '없음' AND ref_path = '')""")
def q_message_delete(spark, sf_dir):
    """M7: delete every message equal (null-safe) on three columns."""
    return delete_matching(_migrated(spark, sf_dir), {"team": "assistant", "ref_type": "없음", "ref_path": ""})


_PROBE_COLS = ("HFO", "LDO", "일정구분")


@register("value_probes", with_views("v_fuel") + """
SELECT bool_or(contains(HFO, '/')) AS any_slash_hfo, bool_or(contains(LDO, '/')) AS any_slash_ldo,
  bool_or(contains("일정구분", '/')) AS any_slash_flag,
  count(*) FILTER (WHERE HFO IS NOT NULL) AS hfo_before, count(try_cast(trim(HFO) AS DOUBLE)) AS hfo_after,
  count(*) FILTER (WHERE LDO IS NOT NULL) AS ldo_before, count(try_cast(trim(LDO) AS DOUBLE)) AS ldo_after,
  (max(CAST(try_cast(trim(HFO) AS DOUBLE) IS NOT NULL AS INTEGER)) FILTER (WHERE HFO IS NOT NULL))
   <> (min(CAST(try_cast(trim(HFO) AS DOUBLE) IS NOT NULL AS INTEGER)) FILTER (WHERE HFO IS NOT NULL)) AS hfo_mixed
FROM (SELECT * FROM v_fuel_old UNION ALL SELECT * FROM v_fuel_new) u""")
def q_value_probes(spark, sf_dir):
    """A13 (any value matches), A12 (loss check before/after conversion), A16 (mixed text)."""
    u = v_fuel_old(spark, sf_dir).unionByName(v_fuel_new(spark, sf_dir))
    names = dict(zip(_PROBE_COLS, ("any_slash_hfo", "any_slash_ldo", "any_slash_flag")))
    counts = [f(v).alias(f"{c.lower()}_{when}") for c in ("HFO", "LDO") for when, v, f in
              (("before", c, F.count), ("after", tf.to_number(c), F.count))]
    return u.agg(*[e.alias(names[c]) for c, e in zip(_PROBE_COLS, any_match_columns(_PROBE_COLS, "/"))], *counts,
                 mixed_text_columns(["HFO"])[0].alias("hfo_mixed"))


@register("category_counts", with_views("v_permit") + """
SELECT c.category, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD', 'HOTWORK', 'CONFINED', 'UNUSED']) AS category) c
LEFT JOIN (SELECT ACODENM AS category, count(*) AS n FROM v_permit GROUP BY 1) p USING (category)""")
def q_category_counts(spark, sf_dir):
    """Items per category including empty categories."""
    from .views import WORK_CODES
    cats = spark.createDataFrame([(c,) for c in (*WORK_CODES, "UNUSED")], "category string")
    p = v_permit(spark, sf_dir).select(F.col("ACODENM").alias("category"))
    return category_counts(p, cats).select("category", F.col("n").cast("long"))


@register("result_summary", """
SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'skipped') AS skipped
FROM (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status FROM events) e""")
def q_result_summary(spark, sf_dir):
    """A14 over a job-result table derived from the event stream."""
    e = read(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "view", F.lit("skipped"))
        .otherwise(F.lit("ok")).alias("status"))
    return result_summary(e)


@register("split_multi", """
WITH c AS (SELECT c_custkey, c_name || ', ' || c_mktsegment || ',' || CAST(c_nationkey AS VARCHAR) AS names FROM customer)
SELECT c_custkey, trim(unnest(string_split(names, ','))) AS part FROM c""")
def q_split_multi(spark, sf_dir):
    """E5: comma-joined multi-values -> one trimmed part per row."""
    c = read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit(","),
                              F.col("c_nationkey").cast("string")).alias("part"))
    return split_multi(c, "part")


@register("doc_snippets", """
SELECT doc_id, substr(regexp_replace(text, chr(10), ' ', 'g'), 1, 22) AS snippet,
       substr(split_part(text, chr(10), 1), 1, 100) AS first_line, length(text) AS n_chars FROM documents""")
def q_doc_snippets(spark, sf_dir):
    """List snippet and first line (display features) next to the whole-text length."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", tf.snippet("text", 22).alias("snippet"), tf.first_line("text", 100).alias("first_line"),
                    F.length("text").cast("long").alias("n_chars"))


# ---------------------------------------------------------------------- P9
def header_less_sheets(spark, sf_dir):
    """Header-less plan sheets, one per customer group: data rows from orders, and above
    each file's first data row two junk rows and a header row (PJT or 호선); file
    plan_19 has no header row."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    f = F.concat(F.lit("plan_"), (F.col("o_custkey") % 20).cast("string"))
    data = o.select(f.alias("file"), (F.col("o_orderkey") * 10).alias("seq"),
                    F.concat(F.lit("SN"), (F.col("o_custkey") % 40 + 2601).cast("string")).alias("c0"),
                    F.year("o_orderdate").cast("string").alias("c1"),
                    F.concat(F.month("o_orderdate").cast("string"), F.lit("월")).alias("c2"))
    first = data.groupBy("file").agg(F.min("seq").alias("m")).filter(F.col("file") != "plan_19")
    key = F.when(F.substring("file", -1, 1).isin("1", "3", "5", "7", "9"), F.lit("호선")).otherwise(F.lit("PJT"))
    head = first.select("file", (F.col("m") - 5).alias("seq"), key.alias("c0"), F.lit("인도년").alias("c1"),
                        F.lit("인도월").alias("c2"))
    junk1 = first.select("file", (F.col("m") - 8).alias("seq"), F.lit("Fuel plan").alias("c0"),
                         F.lit(None).cast("string").alias("c1"), F.lit(None).cast("string").alias("c2"))
    junk2 = first.select("file", (F.col("m") - 7).alias("seq"), F.lit(None).cast("string").alias("c0"),
                         F.lit("unit: ton").alias("c1"), F.lit(None).cast("string").alias("c2"))
    return data.unionByName(head).unionByName(junk1).unionByName(junk2)


@register("header_rows", """
WITH data AS (SELECT 'plan_' || CAST(o_custkey % 20 AS VARCHAR) AS file, o_orderkey * 10 AS seq,
   'SN' || CAST(o_custkey % 40 + 2601 AS VARCHAR) AS c0, CAST(year(o_orderdate) AS VARCHAR) AS c1,
   CAST(month(o_orderdate) AS VARCHAR) || '월' AS c2 FROM orders),
first AS (SELECT file, min(seq) AS m FROM data WHERE file <> 'plan_19' GROUP BY 1),
cells AS (SELECT * FROM data
  UNION ALL SELECT file, m - 5, CASE WHEN right(file, 1) IN ('1','3','5','7','9') THEN '호선' ELSE 'PJT' END, '인도년', '인도월' FROM first
  UNION ALL SELECT file, m - 8, 'Fuel plan', NULL, NULL FROM first
  UNION ALL SELECT file, m - 7, NULL, 'unit: ton', NULL FROM first),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS rn FROM cells),
heads AS (SELECT file, arg_min(seq, (CASE WHEN upper(trim(c0)) IN ('PJT', '호선') OR upper(trim(c1)) IN ('PJT', '호선')
            OR upper(trim(c2)) IN ('PJT', '호선') THEN 0 ELSE 1 END, rn)) AS hseq,
            arg_min(concat_ws('|', c0, c1, c2), (CASE WHEN upper(trim(c0)) IN ('PJT', '호선') OR upper(trim(c1)) IN ('PJT', '호선')
            OR upper(trim(c2)) IN ('PJT', '호선') THEN 0 ELSE 1 END, rn)) AS header
          FROM ranked WHERE rn <= 10 GROUP BY file)
SELECT c.file, c.seq, c.c0, c.c1, c.c2, h.header FROM cells c JOIN heads h USING (file) WHERE c.seq > h.hseq""")
def q_header_rows(spark, sf_dir):
    from ..operators.schema import find_header_row
    out = find_header_row(header_less_sheets(spark, sf_dir), "file", "seq", ["c0", "c1", "c2"])
    return out.select("file", "seq", "c0", "c1", "c2", F.concat_ws("|", "_header").alias("header"))
