"""Session helpers: a configured SparkSession and the shared work folder."""
from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_WORK: dict[str, str] = {}


def get_spark(app: str = "tidemark", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a session with the settings the operators assume.

    On a cluster the master and sizing come from ``spark-submit``; locally we
    default to ``local[*]`` and few shuffle partitions.  AQE stays on so join
    strategy, partition coalescing and skew splitting are decided at run time.
    """
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, published tables and stream state.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the
    master is local (tests) a private temp folder is made; it goes when the process ends.
    """
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_WORK:
        _LOCAL_WORK[key] = tempfile.mkdtemp(prefix="tidemark-work-")
        atexit.register(shutil.rmtree, _LOCAL_WORK[key], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_LOCAL_WORK[key])
    return _LOCAL_WORK[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidemark`` importable in Python workers (needed by ``mapInPandas`` functions).

    The package is zipped in memory once per application, written into the shared work
    folder (Hadoop FS API, so it also works for hdfs:// or object-store folders) and added
    with ``addPyFile`` — Spark then distributes it to every executor.
    """
    import io
    import zipfile
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = f"{work_dir(spark)}/tidemark-py-{uuid.uuid4().hex[:8]}.zip"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(key)
