"""K5: job status rows (append) and the latest status per job."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .curated import path_exists

STATUS_SCHEMA = "job string, ok boolean, ts timestamp_ntz, summary string, error string"


def append_status(spark: SparkSession, root: str, job: str, ok: bool, summary: str = "",
                  error: str = "", ts: dt.datetime | None = None) -> None:
    """Append one row; the time is UTC unless given, whatever the zone of the driver."""
    row = [(job, ok, ts or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), summary, error)]
    spark.createDataFrame(row, STATUS_SCHEMA).write.mode("append").parquet(f"{root}/_job_status")


def latest_status(status: DataFrame, job: str = "job", ts: str = "ts",
                  tiebreak: str | None = None) -> DataFrame:
    """Last payload per job (``max_by`` over the timestamp: partial aggregation, no sort)."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    rest = [c for c in status.columns if c != job]
    return (status.groupBy(job).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_l"))
            .select(job, "_l.*"))


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """All status rows; none if no job has reported yet."""
    if not path_exists(spark, f"{root}/_job_status"):
        return spark.createDataFrame([], STATUS_SCHEMA)
    return spark.read.schema(STATUS_SCHEMA).parquet(f"{root}/_job_status")
