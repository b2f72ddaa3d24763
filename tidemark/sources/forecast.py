"""Landed forecast JSON (optionally wrapped in ``response``) -> long feed rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "struct<fcstDate:string,fcstTime:string,category:string,fcstValue:string,seq:long>"
_BODY = f"struct<totalCount:long,items:struct<item:array<{_ITEM}>>>"
FORECAST_JSON_SCHEMA = f"response struct<body:{_BODY}>, body {_BODY}"


def read_forecast_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Unwrap ``response.body`` or ``body``; ``totalCount = 0`` yields no rows, a page without
    ``totalCount`` the items it has.

    ``multi_line`` = one JSON document per file (API payloads); False = JSON lines.
    Items keep an optional ``seq`` field; ``_seq`` is (file, position) order.
    """
    raw = spark.read.schema(FORECAST_JSON_SCHEMA).option("multiLine", multi_line).json(path)
    body = F.coalesce(F.col("response.body"), F.col("body"))
    items = F.when(F.coalesce(body["totalCount"], F.lit(1)) > 0, body["items"]["item"])
    return (raw.select(F.col("_metadata.file_name").alias("_file"), F.posexplode(items).alias("_pos", "it"))
            .select("it.fcstDate", "it.fcstTime", "it.category", "it.fcstValue", "it.seq",
                    F.struct(F.col("_file"), F.col("_pos")).alias("_seq")))
