"""Queries over documents, conversations and file manifests."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators.documents import accident_items, guide_items
from ..operators.filters import search_any
from ..operators.joins import skip_done
from ..operators.quality import archive_plan, doc_progress
from ..operators.schema import to_new_schema
from ..operators.window import date_header_change, keep_latest_n
from .queries import register
from .views import read, v_message, with_views

# ---------------------------------------------------------------------- documents
_SQL_ITEM_SCHEMA = ('{"guides":[{"standard_id":"VARCHAR","title":"VARCHAR","keywords":"VARCHAR"}],'
                    '"standard_id":"VARCHAR","title":"VARCHAR","keywords":"VARCHAR"}')


def v_docs(spark, sf_dir):
    """Documents with a model answer per document (shapes vary by id: fenced, reasoning
    prefix, single object, empty list, no JSON, null keywords)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id").cast("string")
    ans = (F.when(F.col("doc_id") % 6 == 0, F.concat(
                F.lit('{"guides": [{"standard_id": "SG-'), i, F.lit('", "title": "T'), i,
                F.lit('a", "keywords": "'), F.col("lang"), F.lit(", "), F.col("source"),
                F.lit('"}, {"standard_id": "", "title": "T'), i, F.lit('b", "keywords": "k"}]}')))
           .when(F.col("doc_id") % 6 == 1, F.concat(
                F.lit('<think>reasoning {not json}</think>{"guides": [{"standard_id": "GD-'),
                (F.col("doc_id") % 13).cast("string"), F.lit('", "title": "", "keywords": "x"}]}')))
           .when(F.col("doc_id") % 6 == 2, F.concat(F.lit('```json\n{"title": "Single '), i,
                                                     F.lit('", "keywords": "one"}\n```')))
           .when(F.col("doc_id") % 6 == 3, F.lit('Here you go: {"guides": []} thanks'))
           .when(F.col("doc_id") % 6 == 4, F.lit("not json at all"))
           .otherwise(F.concat(F.lit('{"guides": [{"standard_id": " SG-9 ", "title": "T'), i,
                               F.lit('", "keywords": null}]}'))))
    return d.select(F.concat(F.lit("doc_"), i, F.lit(".pdf")).alias("pdf_filename"),
                    F.concat(F.lit("doc_"), i).alias("stem"), "text", "lang", ans.alias("answer"))


SQL_V_DOCS = """
v_docs AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS pdf_filename, 'doc_' || CAST(doc_id AS VARCHAR) AS stem,
  text, lang, CASE doc_id % 6
   WHEN 0 THEN '{"guides": [{"standard_id": "SG-' || CAST(doc_id AS VARCHAR) || '", "title": "T' || CAST(doc_id AS VARCHAR)
        || 'a", "keywords": "' || lang || ', ' || source || '"}, {"standard_id": "", "title": "T' || CAST(doc_id AS VARCHAR)
        || 'b", "keywords": "k"}]}'
   WHEN 1 THEN '<think>reasoning {not json}</think>{"guides": [{"standard_id": "GD-' || CAST(doc_id % 13 AS VARCHAR)
        || '", "title": "", "keywords": "x"}]}'
   WHEN 2 THEN '```json' || chr(10) || '{"title": "Single ' || CAST(doc_id AS VARCHAR) || '", "keywords": "one"}' || chr(10) || '```'
   WHEN 3 THEN 'Here you go: {"guides": []} thanks'
   WHEN 4 THEN 'not json at all'
   ELSE '{"guides": [{"standard_id": " SG-9 ", "title": "T' || CAST(doc_id AS VARCHAR) || '", "keywords": null}]}' END AS answer
 FROM documents)"""

SQL_DOC_ITEMS = """
dclean AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)),
             '^```(?:json)?\\s*', ''), '\\s*```$', ''), ' ' || chr(9) || chr(10) || chr(13)) AS c FROM {src}),
djson AS (SELECT *, CASE WHEN json_valid(c) THEN c
                         WHEN regexp_extract(c, '(?s)\\{.*\\}', 0) <> '' AND json_valid(regexp_extract(c, '(?s)\\{.*\\}', 0))
                         THEN regexp_extract(c, '(?s)\\{.*\\}', 0) END AS js FROM dclean),
dobj AS (SELECT *, from_json(js, '""" + _SQL_ITEM_SCHEMA + """') AS o FROM djson),
ditems AS (SELECT *, CASE WHEN len(o.guides) > 0 THEN o.guides
                          WHEN coalesce(o.title, '') <> '' THEN [{'standard_id': o.standard_id, 'title': o.title, 'keywords': o.keywords}]
                          ELSE [{'standard_id': '', 'title': stem, 'keywords': ''}] END AS items FROM dobj),
dexp AS (SELECT pdf_filename, stem, text, unnest(items) AS it, unnest(range(1, len(items) + 1)) AS seq FROM ditems),
drows AS (SELECT coalesce(nullif(trim(coalesce(it.standard_id, ''), ' ' || chr(9) || chr(10) || chr(13)), ''), stem || '#' || CAST(seq AS VARCHAR)) AS id,
   trim(coalesce(it.standard_id, ''), ' ' || chr(9) || chr(10) || chr(13)) AS standard_id, CAST(seq AS INTEGER) AS seq,
   coalesce(nullif(it.title, ''), stem) AS title, it.keywords AS keywords, text, pdf_filename FROM dexp)"""

_ITEM_COLS = ("id", "standard_id", "seq", "title", "keywords", "text", "pdf_filename")


@register("docs_items", "WITH " + SQL_V_DOCS + "," + SQL_DOC_ITEMS.replace("{src}", "v_docs")
          + f"\nSELECT {', '.join(_ITEM_COLS)} FROM drows")
def q_docs_items(spark, sf_dir):
    return guide_items(v_docs(spark, sf_dir))


@register("docs_append", "WITH " + SQL_V_DOCS + "," + SQL_DOC_ITEMS.replace("{src}", "v_docs") + f"""
SELECT {', '.join(_ITEM_COLS)}, CASE WHEN pdf_filename IN (SELECT pdf_filename FROM v_docs WHERE lang = 'en')
  THEN 'stored' ELSE 'new' END AS origin FROM drows""")
def q_docs_append(spark, sf_dir):
    """M6: documents in English were processed before; only the others are processed now."""
    docs = v_docs(spark, sf_dir)
    stored = guide_items(docs.filter(F.col("lang") == "en")).withColumn("origin", F.lit("stored"))
    todo = skip_done(docs, stored, "pdf_filename")
    return stored.unionByName(guide_items(todo).withColumn("origin", F.lit("new")))


@register("doc_progress", "WITH " + SQL_V_DOCS + "," + SQL_DOC_ITEMS.replace("{src}", "v_docs") + """
SELECT v.pdf_filename, CAST(coalesce(c.items, 0) AS BIGINT) AS items, coalesce(c.items, 0) > 0 AS parsed
FROM v_docs v LEFT JOIN (SELECT pdf_filename, count(*) AS items FROM drows WHERE seq > 1 OR standard_id <> ''
                          GROUP BY 1) c USING (pdf_filename)""")
def q_doc_progress(spark, sf_dir):
    """Q10: items per document (fallback-only documents count as not parsed)."""
    docs = v_docs(spark, sf_dir)
    items = guide_items(docs).filter((F.col("seq") > 1) | (F.col("standard_id") != ""))
    return doc_progress(docs.select("pdf_filename"), items).select(
        "pdf_filename", F.col("items").cast("long"), "parsed")


_ACC = ("summary", "cause", "result", "countermeasure", "accident_type", "keywords")
_SQL_ACC = ",".join(f'"{f}":"VARCHAR"' for f in _ACC)
RUN_DATE = "2024-05-01"


def v_reports(spark, sf_dir):
    """Accident reports with a model answer made from the whole text: two items, one item, an empty list, or none."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    n, i = F.length("text").cast("string"), F.col("doc_id").cast("string")
    words = F.size(F.split("text", " ")).cast("string")
    ans = (F.when(F.col("doc_id") % 5 == 0, F.concat(
                F.lit('{"accidents": [{"summary": "S'), i, F.lit('", "cause": "chars '), n, F.lit('", "result": null}, {"summary": "", "accident_type": "fire", "keywords": "words '),
                words, F.lit('"}]}')))
           .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('```json\n{"summary": "single '), n, F.lit('", "countermeasure": "check"}\n```')))
           .when(F.col("doc_id") % 5 == 2, F.lit('{"accidents": []}'))
           .when(F.col("doc_id") % 5 == 3, F.lit("no json")).otherwise(F.lit('{"summary": "", "cause": "lost"}')))
    return d.select(F.concat(F.lit("acc_"), i, F.lit(".pdf")).alias("pdf_filename"), F.concat(F.lit("acc_"), i).alias("stem"), "text", ans.alias("answer"))


SQL_ACCIDENTS = f"""
v_reports AS (SELECT 'acc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS pdf_filename, 'acc_' || CAST(doc_id AS VARCHAR) AS stem, text,
  CASE doc_id % 5
   WHEN 0 THEN '{{"accidents": [{{"summary": "S' || CAST(doc_id AS VARCHAR) || '", "cause": "chars ' || CAST(length(text) AS VARCHAR)
        || '", "result": null}}, {{"summary": "", "accident_type": "fire", "keywords": "words ' || CAST(len(string_split(text, ' ')) AS VARCHAR) || '"}}]}}'
   WHEN 1 THEN '{{"summary": "single ' || CAST(length(text) AS VARCHAR) || '", "countermeasure": "check"}}'
   WHEN 2 THEN '{{"accidents": []}}' WHEN 3 THEN NULL ELSE '{{"summary": "", "cause": "lost"}}' END AS js FROM documents),
robj AS (SELECT *, from_json(js, '{{"accidents":[{{{_SQL_ACC}}}],{_SQL_ACC}}}') AS o FROM v_reports),
ritems AS (SELECT *, CASE WHEN len(o.accidents) > 0 THEN o.accidents
    WHEN coalesce(o.summary, '') <> '' THEN [{{{', '.join(f"'{f}': o.{f}" for f in _ACC)}}}]
    ELSE [{{'summary': left(split_part(text, chr(10), 1), 100), {', '.join(f"'{f}': ''" for f in _ACC[1:])}}}] END AS items FROM robj),
rexp AS (SELECT pdf_filename, stem, text, unnest(items) AS it, unnest(range(1, len(items) + 1)) AS seq FROM ritems)
SELECT stem || '#' || CAST(seq AS VARCHAR) AS id, CAST(seq AS INTEGER) AS seq, '{RUN_DATE}' AS date,
  {', '.join(f"coalesce(it.{f}, '') AS {f}" for f in _ACC)}, text, pdf_filename AS source, pdf_filename FROM rexp"""


@register("docs_accidents", "WITH " + SQL_ACCIDENTS)
def q_docs_accidents(spark, sf_dir):
    """E4 for accident reports: list under ``accidents``, a single object, or the default row."""
    return accident_items(v_reports(spark, sf_dir), RUN_DATE)


@register("documents_run", """
SELECT 'N' || CAST(length(text) AS VARCHAR) AS id, 'N' || CAST(length(text) AS VARCHAR) AS standard_id, 1 AS seq,
  CASE WHEN length(text) > 1000 THEN 'long' ELSE 'doc_' || CAST(doc_id AS VARCHAR) END AS title, CAST(NULL AS VARCHAR) AS keywords, text,
  'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS pdf_filename FROM documents""")
def q_documents_run(spark, sf_dir):
    """C9 as a whole in two runs: the second processes only documents that the first has not stored (M6)."""
    from .pipelines import documents_pipeline

    def model(texts):  # stands in for the model: an answer from the whole text
        return ['{"guides": [{"standard_id": "N%d", "title": "%s"}]}' % (len(t or ""), "long" if len(t or "") > 1000 else "") for t in texts]

    docs = v_docs(spark, sf_dir).select("pdf_filename", "stem", "text", "lang")
    first = documents_pipeline(docs.filter("lang = 'en'").drop("lang"), None, model)
    return documents_pipeline(docs.drop("lang"), first, model)


# ---------------------------------------------------------------------- messages
_MSG_COLS = ("date", "team", "content", "ref_type", "ref_path")
_SQL_MIGRATED = """
migrated AS (SELECT coalesce(date, '') AS date, coalesce(nullif(team, ''), '전체') AS team, coalesce(message, '') AS content,
  coalesce(nullif(ref_type, ''), '없음') AS ref_type, coalesce(ref_path, '') AS ref_path, conv_id, turn FROM v_message)"""


def _migrated(spark, sf_dir):
    m = v_message(spark, sf_dir).withColumnsRenamed({"conv_id": "_conv_id", "turn": "_turn"})
    return to_new_schema(m).withColumnsRenamed({"_conv_id": "conv_id", "_turn": "turn"})


@register("message_migrate", with_views("v_message") + "," + _SQL_MIGRATED + f"""
SELECT {', '.join(_MSG_COLS)}, conv_id, turn FROM migrated""")
def q_message_migrate(spark, sf_dir):
    return _migrated(spark, sf_dir)


SEARCH_TEXT = "ou."


@register("message_search", with_views("v_message") + "," + _SQL_MIGRATED + f"""
SELECT conv_id, turn, team, content FROM migrated
WHERE contains(lower(content), '{SEARCH_TEXT}') OR contains(lower(team), '{SEARCH_TEXT}')""")
def q_message_search(spark, sf_dir):
    """the search text is literal ('.' is not a wildcard, D18)."""
    m = _migrated(spark, sf_dir)
    return m.filter(search_any(["content", "team"], SEARCH_TEXT)).select("conv_id", "turn", "team", "content")


@register("message_headers", with_views("v_message") + "," + _SQL_MIGRATED + """
SELECT conv_id, turn, team, date,
  row_number() OVER (PARTITION BY team, date ORDER BY conv_id, turn) = 1 AS is_first_of_date FROM migrated""")
def q_message_headers(spark, sf_dir):
    m = _migrated(spark, sf_dir).select("conv_id", "turn", "team", "date")
    return date_header_change(m, "date", ["team"], tiebreak=["conv_id", "turn"])


# ---------------------------------------------------------------------- manifests
def v_manifest(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    p1 = tf.format_ntz(d, "yyyyMMdd")
    p2 = tf.format_ntz(F.date_add(F.to_date(d), 1), "yyyyMMdd")
    prefix = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(p1, F.lit("_")))
              .when(k % 4 == 2, F.concat(p2, F.lit("_"), p1, F.lit("_"))).otherwise(F.lit("_processed_")))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".xlsx", ".xls", ".csv", ".txt", ".XLSX")]),
                       (k % 5 + 1).cast("int"))
    return o.select(F.element_at(F.array(F.lit("esg"), F.lit("ptw"), F.lit("out")), (k % 3 + 1).cast("int"))
                    .alias("section"),
                    F.concat(prefix, F.lit("file"), k.cast("string"), ext).alias("file_name"),
                    F.timestamp_add("SECOND", k, d).alias("modification_time"),
                    F.col("o_orderstatus").alias("_status"), k.alias("_seq"))


SQL_V_MANIFEST = """
v_manifest AS (SELECT ['esg', 'ptw', 'out'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS section,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') || '_'
       WHEN 2 THEN strftime(CAST(o_orderdate AS DATE) + 1, '%Y%m%d') || '_' || strftime(o_orderdate, '%Y%m%d') || '_'
       ELSE '_processed_' END || 'file' || CAST(o_orderkey AS VARCHAR)
    || ['.xlsx', '.xls', '.csv', '.txt', '.XLSX'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS file_name,
  o_orderdate + to_seconds(o_orderkey) AS modification_time, o_orderstatus AS _status, o_orderkey AS _seq FROM orders)"""


@register("archive_plan", "WITH " + SQL_V_MANIFEST + """,
m AS (SELECT *, regexp_replace(file_name, '^([0-9]{8}_)+', '') AS clean_name,
        CAST(length(regexp_extract(file_name, '^([0-9]{8}_)+', 0)) / 9 AS INTEGER) AS depth FROM v_manifest),
a AS (SELECT DISTINCT section, regexp_replace(file_name, '^([0-9]{8}_)+', '') AS clean_name FROM v_manifest WHERE _status = 'F')
SELECT m._seq, m.section, m.file_name, m.clean_name, m.depth, a.section IS NOT NULL AS archived,
  CASE WHEN NOT (lower(m.file_name) LIKE '%.xlsx' OR lower(m.file_name) LIKE '%.xls' OR lower(m.file_name) LIKE '%.csv')
            OR m.file_name LIKE '\\_%' ESCAPE '\\' THEN 'ignore'
       WHEN a.section IS NOT NULL THEN 'duplicate' ELSE 'move' END AS action
FROM m LEFT JOIN a ON m.section = a.section AND m.clean_name = a.clean_name""")
def q_archive_plan(spark, sf_dir):
    """Q11: archive = files of finished orders (already moved)."""
    m = v_manifest(spark, sf_dir)
    plan = archive_plan(m, m.filter(F.col("_status") == "F"))
    return plan.select("_seq", "section", "file_name", "clean_name", "depth", "archived", "action")


@register("keep_latest", "WITH " + SQL_V_MANIFEST + """,
r AS (SELECT section, file_name, modification_time,
        row_number() OVER (PARTITION BY section ORDER BY modification_time DESC, file_name) AS rn FROM v_manifest)
SELECT section, file_name, modification_time, CASE WHEN rn <= 7 THEN 'keep' ELSE 'delete' END AS action,
  CASE WHEN rn <= 7 THEN CAST(rn AS INTEGER) END AS rank FROM r""")
def q_keep_latest(spark, sf_dir):
    m = v_manifest(spark, sf_dir).select("section", "file_name", "modification_time")
    return keep_latest_n(m, "section", 7)


@register("keep_latest_mixed", "WITH " + SQL_V_MANIFEST + """,
m AS (SELECT _seq, CASE WHEN _seq % 5 = 0 THEN NULL ELSE section END AS section, 'file' || CAST(_seq % 40 AS VARCHAR) AS file_name,
        CAST(CAST(modification_time AS DATE) AS TIMESTAMP) AS modification_time FROM v_manifest),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY modification_time DESC, file_name) AS rn
      FROM (SELECT DISTINCT section, file_name, modification_time FROM m))
SELECT m._seq, m.section, m.file_name, m.modification_time, CASE WHEN rn <= 7 THEN 'keep' ELSE 'delete' END AS action,
  CASE WHEN rn <= 7 THEN CAST(rn AS INTEGER) END AS rank
FROM m JOIN r ON m.section IS NOT DISTINCT FROM r.section AND m.file_name = r.file_name AND m.modification_time = r.modification_time""")
def q_keep_latest_mixed(spark, sf_dir):
    """W2 with names that come back at other times, equal files and files without a folder."""
    m = v_manifest(spark, sf_dir).select(
        "_seq", F.when(F.col("_seq") % 5 != 0, F.col("section")).alias("section"),
        F.concat(F.lit("file"), (F.col("_seq") % 40).cast("string")).alias("file_name"),
        F.to_date("modification_time").cast("timestamp_ntz").alias("modification_time"))
    return keep_latest_n(m, "section", 7)
