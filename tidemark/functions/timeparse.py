"""Timestamp / date parsing with explicit format lists.

Every parser is a ``coalesce`` of ``try_to_timestamp`` calls, so bad text
gives null instead of failing the job under ANSI mode.  Results are
``timestamp_ntz`` (source values carry no zone).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col_of, format_ntz, strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
# Permit-sheet formats, tried in this order (two-digit years first).
PERMIT_FORMATS = ("yy/M/d H:m", "yy/M/d H:m:s", "yyyy/M/d H:m", "yyyy-M-d H:m", "yyyy-M-d H:m:s")
# Explicit replacement of free-form inference (decision D8).
GENERAL_FORMATS = ("yyyy-M-d", "yyyy-M-d H:m", "yyyy-M-d H:m:s", "yyyy/M/d", "yyyy/M/d H:m",
                   "yyyy/M/d H:m:s", "yyyy.M.d", "yyyyMMdd", "yyyy-M-d'T'H:m:s")
# Forecast publication slots (HHmm) and the publication lag in minutes.
BASE_TIMES = ("0200", "0500", "0800", "1100", "1400", "1700", "2000", "2300")
PUBLICATION_LAG_MIN = 10
# Spreadsheet serial-day epoch and the accepted open interval of serials.
EXCEL_EPOCH = "1899-12-30 00:00:00"
EXCEL_SERIAL_RANGE = (1000.0, 200000.0)
# Two-digit years at or after this parsed year belong to the previous century.
TWO_DIGIT_PIVOT_YEAR = 2069


# The accepted shapes.  They are fixed values too (FIXTURES.md): other texts must stay unparsed for equal results.
_TIME = "(?: [0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?)"
_GENERAL_SHAPES = (
    "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}" + _TIME + "?",
    "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}" + _TIME + "?",
    "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}",
    r"[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}",
    "[0-9]{8}",
)
_SHORT_YEAR_SHAPE = "[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}" + _TIME
# A date, a clock time and its marker in either order, whatever follows: "2024-05-01 3:05 PM", "2024/05/01 오후 3:05:10".
_MARKED_DATE = r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\s+"
_CLOCK = "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"
_MARKED_SHAPES = (_MARKED_DATE + _CLOCK + r"\s+[AaPp][Mm]", _MARKED_DATE + r"(?:오전|오후)\s+" + _CLOCK)
# Where the components are in a text of any of these shapes: year, month, day, then a time to the end, or a marked time.
_DATE_PARTS = "([0-9]{4}|[0-9]{2}(?=/))[-/.]?([0-9]{1,2})[-/.]?([0-9]{1,2})"
_TIME_PARTS = r"[ T]([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?\z"
_MARKED_PARTS = r"\s+(?:(오전|오후)\s+)?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s+([AaPp])[Mm])?"
# year, month, day, hour, minute, second, marker; a missing number is 0, as a cast of empty text costs an exception
_ORDERED = "$1|0$2|0$3|0$4$8|0$5$9|0$6$10|$7$11"


def _parse_shapes(s: Column, whole: Sequence[str], marked: Sequence[str] = (), short_year: bool = False) -> Column:
    """The timestamp of a stripped text of one of the shapes (``whole`` texts, or texts that begin as ``marked`` ones); null for
    other texts and for impossible dates and times.

    One regex replacement looks ahead for the shapes and puts the components into one order (empty for other texts), one
    split takes them apart: a small expression, so that several time columns beside each other still make generated methods
    that the JVM compiles.
    """
    shape = "|".join([*marked, "(?:" + "|".join(whole) + r")\z"])
    pattern = rf"(?s)^(?:(?={shape}){_DATE_PARTS}(?:{_TIME_PARTS}|{_MARKED_PARTS})?.*|.*)\z"
    parts = F.split(F.regexp_replace(s, F.lit(pattern), F.lit(_ORDERED)), "[|]", -1)
    part = [F.get(parts, F.lit(i)) for i in range(7)]
    # a null year, that of a text of no shape, makes the result null before anything else is looked at
    year, hour = F.nullif(part[0], F.lit("")).cast("int"), part[3].cast("int")
    if short_year:
        year = F.when(F.length(part[0]) == 2, year + F.when(year < TWO_DIGIT_PIVOT_YEAR - 2000, F.lit(2000)).otherwise(F.lit(1900))).otherwise(year)
    if marked:
        year = F.when((part[6] == "") | hour.between(1, 12), year)
        hour = F.when(part[6] == "", hour).otherwise(hour % 12 + F.when(part[6].isin("P", "p", "오후"), F.lit(12)).otherwise(F.lit(0)))
    return F.try_make_timestamp_ntz(year, part[1].cast("int"), part[2].cast("int"), hour, part[4].cast("int"), part[5].cast("decimal(8,6)"))


def parse_datetime(c: Column | str, two_digit_year: bool = False) -> Column:
    """Parse the explicit format list (no free-form inference, D8) without exceptions.

    Accepted (month/day/hour/minute/second with 1 or 2 digits):
    ``yyyy-M-d``, ``yyyy/M/d`` each optionally followed by `` H:m`` or `` H:m:s``;
    ``yyyy-M-d'T'H:m:s``; ``yyyy.M.d``; ``yyyyMMdd``; and with ``two_digit_year``
    also ``yy/M/d H:m[:s]`` where years 00..68 are 20yy and 69..99 are 19yy (D9).
    Invalid calendar values (Feb 30, hour 24, ...) give null.
    """
    shapes = (*_GENERAL_SHAPES, _SHORT_YEAR_SHAPE) if two_digit_year else _GENERAL_SHAPES
    return _parse_shapes(strip(col_of(c)), shapes, short_year=two_digit_year)


def parse_with_formats(c: Column | str, formats: Sequence[str]) -> Column:
    """Compatibility wrapper: the permit list when it contains two-digit years, else general."""
    return parse_datetime(c, any("yy" in f and "yyyy" not in f for f in formats))


def parse_ts_formats(c: Column | str, formats: Sequence[str] = PERMIT_FORMATS,
                     general: Sequence[str] = GENERAL_FORMATS) -> Column:
    """Permit timestamps (``yy/MM/dd HH:mm`` etc.), then the general list."""
    return parse_with_formats(c, tuple(formats) + tuple(general))


def excel_serial_to_ts(x: Column | str) -> Column:
    """N3 numeric branch: serial days since 1899-12-30 inside (1000, 200000)."""
    x = col_of(x).cast("double")
    lo, hi = EXCEL_SERIAL_RANGE
    micros = F.round(x * F.lit(86400000000.0)).cast("long")
    ts = F.timestamp_add("MICROSECOND", micros, F.to_timestamp_ntz(F.lit(EXCEL_EPOCH)))
    return F.when((x > lo) & (x < hi), ts)


def parse_ts_mixed(c: Column | str, numeric: bool = False,
                   general: Sequence[str] = GENERAL_FORMATS,
                   accept_text_serial: bool = False) -> Column:
    """Spreadsheet timestamps of mixed shape.

    * numeric columns: serial days (see :func:`excel_serial_to_ts`);
    * ``date time AM|PM`` and ``date 오전|오후 time`` (prefix match; 12-hour
      clock, hour 1..12; when the prefix matches but is invalid -> null);
    * otherwise the explicit general format list (D8).
    ``accept_text_serial`` applies the serial rule to numeric-looking text (D10).
    """
    c = col_of(c)
    if numeric:
        return excel_serial_to_ts(c)
    s = strip(c)
    out = _parse_shapes(s, _GENERAL_SHAPES, _MARKED_SHAPES)
    if accept_text_serial:
        out = F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?$") & ~s.rlike(r"^[0-9]{8}$"),
                     excel_serial_to_ts(s.try_cast("double"))).otherwise(out)
    return out


def parse_date_flex(c: Column | str, general: Sequence[str] = GENERAL_FORMATS) -> Column:
    """Exactly eight digits -> ``yyyyMMdd`` (invalid -> null), else the general list."""
    return F.to_date(parse_datetime(c, False))


def publication_slot(ts: Column | str, slots: Sequence[str] = BASE_TIMES,
                     lag_minutes: int = PUBLICATION_LAG_MIN) -> Column:
    """Latest slot whose time + lag <= ts; before the first -> previous day 2300.

    Returns ``struct(base_date 'yyyyMMdd', base_time 'HHmm')``.
    """
    u = col_of(ts).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(lag_minutes)} MINUTES")
    hhmm = format_ntz(u, "HHmm")
    sl = F.array_max(F.filter(F.array(*[F.lit(x) for x in slots]), lambda x: x <= hhmm))
    day = F.when(sl.isNull(), F.date_sub(F.to_date(u), 1)).otherwise(F.to_date(u))
    return F.struct(format_ntz(day, "yyyyMMdd").alias("base_date"),
                    F.coalesce(sl, F.lit(slots[-1])).alias("base_time"))


def parse_ts_by_type(df, col: str, text_parser=None) -> Column:
    """Dispatch on the column's type (the reference passes datetimes through and applies
    the serial-day rule only to numeric cells, D10): timestamp/date -> as is (no zone);
    numeric -> serial days; text -> ``text_parser`` (default :func:`parse_ts_mixed`)."""
    dtype = dict(df.dtypes)[col]
    c = F.col(f"`{col}`")
    if dtype.startswith("timestamp") or dtype == "date":
        return c.cast("timestamp_ntz")
    if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal"):
        return excel_serial_to_ts(c)
    return (text_parser or parse_ts_mixed)(c)
