"""Scalar cleaning functions: ``Column -> Column``, built-in expressions only.

All functions stay inside whole-stage codegen (no Python UDF); they can be
used in ``select``/``withColumn``/``filter`` and inside higher-order lambdas.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
# Text that counts as "no value" after strip + lower-case.
BLANK_TOKENS = ("", "nan", "nat", "none")
# 16-point compass labels, clockwise from north.
COMPASS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
              "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
# Weekday letters Monday..Sunday.
WEEKDAY_KOR = "월화수목금토일"
# Attachment extension -> reference type (default "pdf").
EXT_TYPE = {"pdf": "pdf", "pptx": "ppt", "ppt": "ppt", "xlsx": "excel", "xls": "excel",
            "png": "image", "jpg": "image", "jpeg": "image", "gif": "image",
            "mp4": "video", "mov": "video", "avi": "video"}

_WS = " \t\r\n\f\u000b"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim surrounding whitespace (space, tab, CR, LF, FF, VT)."""
    return F.trim(col_of(c).cast("string"), F.lit(_WS))


def is_blank(c: Column | str) -> Column:
    """Null, or text that is empty / nan / nat / none after strip.

    The length guard keeps ``lower()`` off every ordinary (longer) value.
    """
    c = col_of(c)
    s = strip(c)
    return c.isNull() | ((F.length(s) <= 4) & F.lower(s).isin(*BLANK_TOKENS))


def ensure_sn(c: Column | str) -> Column:
    """Hull number to the canonical ``SN<digits>`` spelling.

    blank -> ''; strip + upper; ``SN...`` kept; ``S<digits>`` -> ``SN<digits>``;
    ``<digits>`` -> ``SN<digits>``; anything else upper-cased unchanged.
    Digits are ASCII ``[0-9]`` (documented deviation D12).
    """
    c = col_of(c)
    # One rewrite covers both "S<digits>" and "<digits>"; "SN..." and anything else
    # do not match and stay as they are (upper-cased).
    return F.when(is_blank(c), F.lit("")).otherwise(
        F.regexp_replace(F.upper(strip(c)), r"^S?([0-9]+)$", "SN$1"))


def to_number(c: Column | str) -> Column:
    """Text -> double; unparsable -> null (never throws under ANSI)."""
    return strip(c).try_cast("double")


def to_int_default(c: Column | str, suffix: str = "월", default: int = 0) -> Column:
    """Drop a unit suffix, coerce, null -> default, truncate to int."""
    s = col_of(c).cast("string")
    if suffix:
        s = F.replace(s, F.lit(suffix), F.lit(""))
    s = strip(s)
    return F.coalesce(s.try_cast("double").try_cast("int"), F.lit(default))


def round_half_even(c: Column | str, scale: int = 3) -> Column:
    """pandas/numpy rounding: ``rint(x * 10^n) / 10^n`` — half-even on the binary
    value (``F.round`` is half-up; ``F.bround`` rounds the decimal text, which differs
    e.g. for 2.675)."""
    f = float(10 ** scale)
    return F.rint(col_of(c).cast("double") * f) / f


def blank_string_to_null(c: Column | str) -> Column:
    """To trimmed text; literal ``nan`` -> null."""
    return F.nullif(strip(c), F.lit("nan"))


def str_or_empty(c: Column | str) -> Column:
    """Null -> '', otherwise trimmed text."""
    return F.coalesce(strip(c), F.lit(""))


def int_like_float_to_string(c: Column | str) -> Column:
    """2701.0 -> '2701'; 2701.5 -> '2701.5'; null -> null."""
    x = col_of(c).cast("double")
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x == F.floor(x), x.cast("long").cast("string"))
            .otherwise(x.cast("string")))


_FMT_TOKENS = ("yyyy", "yy", "MM", "M", "dd", "d", "HH", "H", "hh", "h", "mm", "ss", "a")


def format_ntz(c: Column | str, pattern: str) -> Column:
    """Render a ``timestamp_ntz``/``date`` as text from its fields, independent of the
    session time zone (``date_format`` converts through the session zone, which shifts
    wall-clock times inside a DST gap).  Supports yyyy yy MM M dd d HH H hh h mm ss a;
    other characters are literals."""
    c = col_of(c)

    def pad(x: Column, n: int) -> Column:
        return F.lpad(x.cast("string"), n, "0")

    def h12() -> Column:
        return ((F.hour(c) + 11) % 12) + 1

    # Built lazily: every F.* call is a round trip to the JVM, so only fields the
    # pattern uses are constructed.
    build = {"yyyy": lambda: pad(F.year(c), 4), "yy": lambda: pad(F.year(c) % 100, 2),
             "MM": lambda: pad(F.month(c), 2), "M": lambda: F.month(c).cast("string"),
             "dd": lambda: pad(F.dayofmonth(c), 2), "d": lambda: F.dayofmonth(c).cast("string"),
             "HH": lambda: pad(F.hour(c), 2), "H": lambda: F.hour(c).cast("string"),
             "hh": lambda: pad(h12(), 2), "h": lambda: h12().cast("string"),
             "mm": lambda: pad(F.minute(c), 2), "ss": lambda: pad(F.second(c), 2),
             "a": lambda: F.when(F.hour(c) < 12, F.lit("AM")).otherwise(F.lit("PM"))}
    parts, i, literal = [], 0, ""
    while i < len(pattern):
        tok = next((t for t in _FMT_TOKENS if pattern.startswith(t, i)), None)
        if tok:
            if literal:
                parts.append(F.lit(literal))
                literal = ""
            parts.append(build[tok]())
            i += len(tok)
        else:
            literal += pattern[i]
            i += 1
    if literal:
        parts.append(F.lit(literal))
    return F.concat(*parts)


def format_ntz_sql(expr: str, pattern: str) -> str:
    """SQL-text twin of :func:`format_ntz` (same fields, same padding) for ``selectExpr``
    / ``F.expr`` builders: one JVM round trip instead of one per sub-expression."""
    def pad(x: str, n: int) -> str:
        return f"lpad(CAST({x} AS STRING), {n}, '0')"
    h12 = f"((hour({expr}) + 11) % 12 + 1)"
    build = {"yyyy": pad(f"year({expr})", 4), "yy": pad(f"year({expr}) % 100", 2), "MM": pad(f"month({expr})", 2),
             "M": f"CAST(month({expr}) AS STRING)", "dd": pad(f"dayofmonth({expr})", 2),
             "d": f"CAST(dayofmonth({expr}) AS STRING)", "HH": pad(f"hour({expr})", 2),
             "H": f"CAST(hour({expr}) AS STRING)", "hh": pad(h12, 2), "h": f"CAST({h12} AS STRING)",
             "mm": pad(f"minute({expr})", 2), "ss": pad(f"second({expr})", 2),
             "a": f"CASE WHEN hour({expr}) < 12 THEN 'AM' ELSE 'PM' END"}
    parts, i, literal = [], 0, ""
    while i < len(pattern):
        tok = next((t for t in _FMT_TOKENS if pattern.startswith(t, i)), None)
        if tok:
            if literal:
                parts.append("'" + literal.replace("'", "''") + "'")
                literal = ""
            parts.append(build[tok])
            i += len(tok)
        else:
            literal += pattern[i]
            i += 1
    if literal:
        parts.append("'" + literal.replace("'", "''") + "'")
    return "concat(" + ", ".join(parts) + ")"


def date_key(c: Column | str) -> Column:
    """``yy-MM-dd`` text key of a date/timestamp (zone-free)."""
    return format_ntz(c, "yy-MM-dd")


def compass16(deg: Column | str) -> Column:
    """Degrees -> 16-point label by half-even rounding of deg/22.5; null -> '-'."""
    d = col_of(deg).cast("double")
    idx = F.pmod(F.rint(d / 22.5).cast("long"), F.lit(16)) + 1
    return F.when(d.isNull(), F.lit("-")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in COMPASS_16]), idx.cast("int")))


def code_label(c: Column | str, mapping: Mapping[str, str], default: str = "-") -> Column:
    """Dictionary lookup of a code with a default for unknown codes."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col_of(c).cast("string")), F.lit(default))


def suffix_override(model: Column | str, target: Column | str,
                    suffix: str = "ETHANE", value: str = "LPG") -> Column:
    """When ``model`` ends with ``suffix`` (trim, upper) the target becomes ``value``."""
    return F.when(F.upper(strip(model)).endswith(suffix), F.lit(value)).otherwise(col_of(target))


def snippet(c: Column | str, n: int) -> Column:
    """Newlines -> spaces, first ``n`` characters."""
    return F.substring(F.regexp_replace(col_of(c), "\n", " "), 1, n)


def first_line(c: Column | str, n: int = 100) -> Column:
    """First line, at most ``n`` characters."""
    return F.substring(F.substring_index(col_of(c), "\n", 1), 1, n)


def item_id(standard_id: Column | str | None, stem: Column | str, seq: Column | str) -> Column:
    """The standard id when given, else ``stem#seq``."""
    generated = F.concat(col_of(stem), F.lit("#"), col_of(seq).cast("string"))
    if standard_id is None:
        return generated
    return F.coalesce(F.nullif(strip(standard_id), F.lit("")), generated)


def strip_date_prefixes(c: Column | str) -> Column:
    """Remove repeated ``yyyyMMdd_`` prefixes."""
    return F.regexp_replace(col_of(c), "^([0-9]{8}_)+", "")


def date_prefix_depth(c: Column | str) -> Column:
    """Number of ``yyyyMMdd_`` prefixes removed."""
    return (F.length(F.regexp_extract(col_of(c), "^([0-9]{8}_)+", 0)) / 9).cast("int")


def file_ext(c: Column | str) -> Column:
    """Lower-case text after the last dot ('' when there is none)."""
    c = col_of(c)
    return F.when(c.contains("."), F.lower(F.substring_index(c, ".", -1))).otherwise(F.lit(""))


def ext_type(c: Column | str) -> Column:
    """Attachment type from the file extension, default ``pdf``."""
    return code_label(file_ext(c), EXT_TYPE, "pdf")


def calendar_parts(d: Column | str) -> dict[str, Column]:
    """Calendar attributes of a date (weekday 0 = Monday, ISO week)."""
    d = col_of(d)
    wd = F.weekday(d)
    return {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
        "weekday": wd,
        "weekday_name_kor": F.substring(F.lit(WEEKDAY_KOR), wd + 1, 1),
        "quarter": F.quarter(d), "week_of_year": F.weekofyear(d),
        "is_weekend": wd >= 5,
    }


def recency_class(mtime: Column | str, as_of: Column | str) -> Column:
    """New (<=1 day), mid (<=7), old; missing -> none."""
    days = F.datediff(F.to_date(col_of(as_of)), F.to_date(col_of(mtime)))
    return (F.when(col_of(mtime).isNull(), F.lit("none"))
            .when(days <= 1, F.lit("new")).when(days <= 7, F.lit("mid"))
            .otherwise(F.lit("old")))


def recency_label(mtime: Column | str, as_of: Column | str) -> Column:
    """N28 label: 오늘 HH:mm / 어제 / n일 전 / 없음."""
    days = F.datediff(F.to_date(col_of(as_of)), F.to_date(col_of(mtime)))
    return (F.when(col_of(mtime).isNull(), F.lit("없음"))
            .when(days == 0, F.concat(F.lit("오늘 "), format_ntz(mtime, "HH:mm")))
            .when(days == 1, F.lit("어제"))
            .otherwise(F.concat(days.cast("string"), F.lit("일 전"))))


def num_text(c: Column | str) -> Column:
    """A double rendered as Python ``str(float)`` does for ordinary values."""
    return col_of(c).cast("double").cast("string")


def contains_any(c: Column | str, tokens: Sequence[str]) -> Column:
    """F2/F3 helper: null-safe 'text contains one of the tokens' (literal match)."""
    s = F.coalesce(col_of(c).cast("string"), F.lit(""))
    cond = F.lit(False)
    for t in tokens:
        cond = cond | s.contains(t)
    return cond
