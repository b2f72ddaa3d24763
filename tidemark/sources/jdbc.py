"""JDBC source and mirror sink.

Reads are partitioned on a numeric/date column so executors pull slices in
parallel; the mirror is a full replace (``overwrite`` drops and re-creates,
which lets the schema follow the curated table).  Only whitelisted tables may
be mirrored.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
# Curated tables that may be mirrored to the SQL database.
MIRROR_TABLES = ("trial_schedule", "fuel_usage", "fuel_price", "lng_usage", "fuel_plan", "pjtmethod",
                 "ptwlist", "mapping", "out", "ra", "pjtlist", "milestone", "shipbbs", "date", "weather",
                 "message")


def read_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Whole table or an explicit column list; parallel when a partition column is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column and lower is not None and upper is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    df = r.load()
    return df.select(*columns) if columns else df


def mirror_target(table: str, prefix: str = "") -> str:
    stem = table.rsplit("/", 1)[-1].removesuffix(".parquet")
    if stem not in MIRROR_TABLES:
        raise ValueError(f"{stem} is not a mirrored table")
    return prefix + stem.lower()


def mirror_jdbc(df: DataFrame, url: str, table: str, prefix: str = "",
                properties: Mapping[str, str] | None = None, batch_size: int = 10000) -> str:
    """K2: full replace of the whitelisted target table."""
    target = mirror_target(table, prefix)
    w = df.write.format("jdbc").option("url", url).option("dbtable", target).option("batchsize", batch_size)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.mode("overwrite").save()
    return target


def mirror_all(spark: SparkSession, tables: Mapping[str, DataFrame], url: str, prefix: str = "",
               properties: Mapping[str, str] | None = None) -> DataFrame:
    """K3 / C14 (export_all): mirror every table, failures isolated; result (table, rows, ok, msg)."""
    rows = []
    for name, df in tables.items():
        try:
            n = df.count()
            mirror_jdbc(df, url, name, prefix, properties)
            rows.append((name, n, True, ""))
        except Exception as e:  # noqa: BLE001 - per-table isolation
            rows.append((name, None, False, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "table string, rows long, ok boolean, msg string")
