"""Recover a JSON object from a model answer, fully JVM-side."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col_of


def clean_llm_text(c: Column | str) -> Column:
    """Drop ``<think>..</think>`` blocks and a surrounding code fence."""
    s = F.regexp_replace(col_of(c), r"(?s)<think>.*?</think>", "")
    s = F.trim(s, F.lit(" \t\r\n"))
    s = F.regexp_replace(s, r"^```(?:json)?\s*", "")
    s = F.regexp_replace(s, r"\s*```$", "")
    return F.trim(s, F.lit(" \t\r\n"))


def clean_llm_json(c: Column | str) -> Column:
    """Cleaned answer when it parses as JSON, else the outermost ``{...}`` span, else null.

    Returns the JSON text (string) so callers can ``from_json`` it with their schema.
    """
    s = clean_llm_text(c)
    whole = F.when(F.try_parse_json(s).isNotNull(), s)
    span = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    inner = F.when((span != "") & F.try_parse_json(span).isNotNull(), span)
    return F.coalesce(whole, inner)
