"""Model answers about documents -> item rows (E4 with N19 and N27): guides and accident reports.

An answer is JSON text, possibly fenced or with reasoning before it.  It holds a list of items or is one item itself;
without either, the document still gives one default row, so no document is lost.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as tf
from .expand import explode_items

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
GUIDE_FIELDS = ("standard_id", "title", "keywords")
ACCIDENT_FIELDS = ("summary", "cause", "result", "countermeasure", "accident_type", "keywords")
# Characters of the first text line that stand for a missing accident summary.
DEFAULT_SUMMARY_CHARS = 100


def answer_items(docs: DataFrame, list_name: str, fields: Sequence[str], needed: str, default: dict[str, Column],
                 answer: str = "answer") -> DataFrame:
    """One row per item (struct ``it``, 1-based ``seq``): the answer's non-empty list, else the answer itself if its
    ``needed`` field is not empty, else the default."""
    one = ",".join(f"{f}:string" for f in fields)
    parsed = F.from_json(tf.clean_llm_json(answer), f"struct<{list_name}:array<struct<{one}>>,{one}>")
    d = docs.withColumn("_o", parsed)
    o = F.col("_o")
    itself = F.array(F.struct(*[o[f].alias(f) for f in fields]))
    items = (F.when(F.coalesce(F.size(o[list_name]), F.lit(0)) > 0, o[list_name])
             .when(F.coalesce(o[needed], F.lit("")) != "", itself))
    empty = F.struct(*[default.get(f, F.lit("")).alias(f) for f in fields])
    return explode_items(d, items, empty, "seq", "it")


def guide_items(docs: DataFrame) -> DataFrame:
    """Guide rows of documents (pdf_filename, stem, text, answer)."""
    x = answer_items(docs, "guides", GUIDE_FIELDS, "title", {"title": F.col("stem")})
    sid = tf.strip(F.coalesce(F.col("it.standard_id"), F.lit("")))
    return x.select(tf.item_id(sid, "stem", "seq").alias("id"), sid.alias("standard_id"), "seq",
                    F.coalesce(F.nullif(F.col("it.title"), F.lit("")), F.col("stem")).alias("title"),
                    F.col("it.keywords").alias("keywords"), "text", "pdf_filename")


def accident_items(docs: DataFrame, as_of: str) -> DataFrame:
    """Accident rows of documents (pdf_filename, stem, text, answer); ``as_of`` is the date of the run.

    A document without a usable answer gives one row with the start of its first line as summary.
    """
    line = F.substring(F.substring_index(F.coalesce(F.col("text"), F.lit("")), "\n", 1), 1, DEFAULT_SUMMARY_CHARS)
    x = answer_items(docs, "accidents", ACCIDENT_FIELDS, "summary", {"summary": line})
    return x.select(F.concat("stem", F.lit("#"), F.col("seq").cast("string")).alias("id"), "seq", F.lit(as_of).alias("date"),
                    *[F.coalesce(F.col(f"it.{f}"), F.lit("")).alias(f) for f in ACCIDENT_FIELDS],
                    "text", F.col("pdf_filename").alias("source"), "pdf_filename")
