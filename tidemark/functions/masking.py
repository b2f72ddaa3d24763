"""Display masking of personal data (N16, N17), as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col_of


def _mask_part(p: Column) -> Column:
    p = F.trim(p)
    n = F.length(p)
    return (F.when(n <= 1, p)
            .when(n == 2, F.concat(F.substring(p, 1, 1), F.lit("*")))
            .otherwise(F.concat(F.substring(p, 1, 1), F.repeat(F.lit("*"), n - 2),
                                F.substring(p, -1, 1))))


def mask_name(c: Column | str) -> Column:
    """Keep first and last character of every comma part; 2 chars -> first + '*'."""
    c = col_of(c)
    masked = F.concat_ws(", ", F.transform(F.split(c, ","), _mask_part))
    return F.when(c.isNull() | (c == ""), c).otherwise(masked)


def mask_phone(c: Column | str) -> Column:
    """Middle block -> ``****``; comma lists -> ``****``; short -> fixed mask.

    Spaces are removed first in both branches (fix D22).
    """
    c = col_of(c)
    p = F.replace(c, F.lit(" "), F.lit(""))
    parts = F.split(p, "-")
    return (F.when(c.isNull() | (c == ""), c)
            .when(c.contains(","), F.lit("****"))
            .when(F.size(parts) == 3,
                  F.concat(F.element_at(parts, 1), F.lit("-****-"), F.element_at(parts, 3)))
            .when(F.length(p) >= 10,
                  F.concat(F.substring(p, 1, 3), F.lit("****"), F.substring(p, 8, 1 << 30)))
            .otherwise(F.lit("***-****-****")))
