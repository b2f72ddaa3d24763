"""Line deduplication over overlapping windows of three lines, in DataFrame operations only.

Every window of consecutive lines is hashed (128 bits); the first place of each repeated window is found over the whole
corpus; each later occurrence covers its lines, covered positions merge to runs, and the runs are cut out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, text_of, unpacked


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(base: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of every window but those of blank lines only."""
    lines = F.col("lines")
    parts = lambda i: [F.element_at(lines, i + k) for k in range(1, size + 1)]
    one = lambda i: F.struct(i.alias("pos"), (F.length(F.trim(F.concat(*parts(i)))) == 0).alias("blank"),
                             F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit(size), *reversed(parts(i))).alias("h2"))
    return (base.select("doc_id", "version", _lines(F.col("text")).alias("lines")).where(F.size("lines") >= size)
            .select("doc_id", "version", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), one)).alias("w"))
            .select("doc_id", "version", "w.*").where(~F.col("blank")).drop("blank"))


def covered_starts(base: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, starts): the ascending starts of windows that also occur earlier."""
    found = windows(base, size)
    place = F.struct("doc_id", "version", "pos")
    repeated = (found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .where(F.col("n") > 1).select("h1", "h2", "first"))
    return (found.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
            .groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("starts")))


def kept_lines(lines: Column, starts: Column, size: int) -> Column:
    """The lines outside the merged windows; linear in lines and starts."""
    from_ = F.filter(starts, lambda x, i: (i == 0) | (x > F.get(starts, i - 1) + size))
    to = F.transform(F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + 1) > x + size, F.lit(True))), lambda x: x + size)
    ends = F.concat(F.array(F.lit(0)), to)
    begins = F.concat(from_, F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")),
                                 lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"])))


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """``row`` (the document), ``kept_text``, ``n_lines`` and ``n_removed``.

    An occurrence is later if its (doc_id, text hash, position) is larger; null ids come first.  Lines are parted by line
    feeds and compared as they are.  Texts of fewer than ``size`` lines, and null or empty texts, stay as they are; a null
    text has no lines.  Repeated rows (same id and text) are treated alike; an empty table gives an empty result.
    """
    base = (packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), text_of("row.text").alias("text"))
            .withColumn("version", F.xxhash64("text")))
    starts = covered_starts(base, size).select(F.col("doc_id").alias("c_doc"), F.col("version").alias("c_version"), "starts")
    joined = base.join(starts, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("version") == F.col("c_version")), "left")
    cut = F.col("starts").isNotNull()
    lines = _lines(F.col("text"))
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(lines)).cast("long")
    kept = kept_lines(lines, F.col("starts"), size)
    return (joined.select("row", "doc_id", "text", cut.alias("cut"), n_lines.alias("n_lines"), F.when(cut, kept).alias("kept"))
            .select("row", "doc_id", F.when(F.col("cut"), F.array_join("kept", "\n")).otherwise(F.col("row.text")).alias("kept_text"),
                    "n_lines", F.when(F.col("cut"), F.col("n_lines") - F.size("kept")).otherwise(F.lit(0)).cast("long").alias("n_removed")))


def without_repeated_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """The documents with repeated lines cut out of their text and every other column as it is.

    ``n_chars``, where present, is set to the length of the new text; a document left without text stays, empty.
    """
    result = dedup_lines(docs, size)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(result, docs.columns, **new)


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
trio AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3 FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS nth
  FROM trio WHERE line3 IS NOT NULL AND length(trim(line || line2 || line3)) > 0),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM marked, (VALUES (0), (1), (2)) t(k) WHERE nth > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_all, count(g.pos) AS n_removed,
         string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS kept_text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_all END AS BIGINT) AS n_lines,
       CAST(n_removed AS BIGINT) AS n_removed, md5(coalesce(kept_text, '')) AS kept_md5
FROM documents d JOIN kept k USING (doc_id)"""
