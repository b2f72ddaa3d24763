"""Landing files, manifests and documents."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
PERMIT_FILE_GLOBS = ("*ptwlist*.xlsx", "*ptwlist*.xls", "밀폐구역*.xlsx", "밀폐구역*.xls")
VISIT_FILE_GLOBS = ("outside_*.xlsx", "사외작업자 출입관리 정보_*.xlsx")


#: Order of landed rows for keep-last merges: stored rows first, then by file time, file, block and row.
FILE_ORDER = ("_batch", "_mtime", "_file", "_block", "_seq")


def glob_regex(globs: Sequence[str]) -> str:
    """Case-insensitive regex equivalent of any-of-globs on a base name (``*``, ``?``)."""
    def one(g: str) -> str:
        return "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in g.lower())
    return "(?i)^(?:" + "|".join(one(g) for g in globs) + ")$"


def match_files(names: Column | str, globs: Sequence[str]) -> Column:
    """Base name matches one of the globs (case-insensitive) and does not start with '_'."""
    n = F.col(names) if isinstance(names, str) else names
    base = F.element_at(F.split(n, "/"), -1)
    return (~base.startswith("_")) & F.lower(base).rlike(glob_regex(globs))


def with_file_order(df: DataFrame) -> DataFrame:
    """Order columns right after a file scan: ``_mtime``, ``_file``, ``_block`` and ``_seq`` (see ``FILE_ORDER``).

    ``_seq`` is a long like that of every other source, so a load can be merged with a stored table; it orders the rows of
    one block, the other columns order blocks and files.
    """
    return (df.withColumn("_file", F.col("_metadata.file_name"))
            .withColumn("_mtime", F.col("_metadata.file_modification_time"))
            .withColumn("_block", F.col("_metadata.file_block_start"))
            .withColumn("_seq", F.monotonically_increasing_id()))


def read_landing(spark: SparkSession, path: str, fmt: str = "csv", glob: str | None = None,
                 header: bool = True, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Raw tabular files -> all-string columns (no inference) + order columns.
    ``_``-prefixed files are hidden by Spark's file index.  ``multi_line`` reads CSV cells that hold
    line ends; such files cannot be split, so it is off by default."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", header).option("inferSchema", False).option("encoding", encoding) \
             .option("multiLine", multi_line)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    if fmt != "csv":
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns], "_metadata")
    return with_file_order(df)


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per text document: ``file_name``, ``stem``, ``text`` (whole file)."""
    # ``text()`` has its own ``wholetext=False`` default that would override an option.
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob) if glob else \
        spark.read.text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return df.select(name.alias("file_name"),
                     F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


def file_manifest(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Name, folder, modification time and size of every file (content is never read)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.load(path).select("path", "modificationTime", "length")
    parts = F.split(F.col("path"), "/")
    return df.select(F.element_at(parts, -2).alias("section"), F.element_at(parts, -1).alias("file_name"),
                     F.col("modificationTime").cast("timestamp_ntz").alias("modification_time"),
                     F.col("length"), F.col("path"))
