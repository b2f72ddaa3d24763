"""What has changed in a landing folder since the last look (S7 with W4), from file listings alone."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .curated import prune_versions, publish, read_curated
from .files import file_manifest

SEEN = "section string, file_name string, modification_time timestamp_ntz, length long, path string"


def scan_landing(spark: SparkSession, path: str, root: str, table: str = "_seen_files", glob: str | None = None,
                 recursive: bool = False) -> DataFrame:
    """section, file_name, length, modification_time and state of every file now or at the last scan.

    ``state``: 'new', 'changed' (another time or length), 'same' or 'gone'.  The listing, which never opens a file, is kept as a
    curated table, so the next scan, in this process or another, compares with it; a file is known by its path.
    """
    work_dir(spark)
    # one listing: what is compared is what is recorded
    now = file_manifest(spark, path, glob, recursive).checkpoint(eager=True)
    seen = read_curated(spark, root, table, SEEN)
    publish(now, root, table, refuse_empty=False)
    prune_versions(spark, root, table, 3)  # the one just compared with stays readable
    before = seen.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in ("section", "file_name", "modification_time", "length")])
    both = now.join(before, F.col("path") == F.col("_path"), "full")
    same = F.col("modification_time").eqNullSafe(F.col("_modification_time")) & (F.col("length") == F.col("_length"))
    state = (F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "gone").when(same, "same").otherwise("changed"))
    return both.select(*[F.coalesce(c, f"_{c}").alias(c) for c in ("section", "file_name", "length", "modification_time")], state.alias("state"))
