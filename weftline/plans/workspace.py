"""Where intermediate tables go, and how this package gets to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests).

    On a cluster executors share no temporary folder: without the setting this raises.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _fallback[app]


#: Bytes of an Arrow batch that Python workers get at once; a longer row is a batch of its own.
ARROW_BATCH = 8 << 20


def ship(spark: SparkSession) -> None:
    """Makes a session ready for Python workers.

    Sends this package to them, once an application; they need not have it
    installed. Lowers the session's Arrow batches to ARROW_BATCH bytes, so that
    rows of long texts do not add up in a worker's memory.
    """
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(batch, None)
    if now is not None and not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= ARROW_BATCH:
        spark.conf.set(batch, f"{ARROW_BATCH}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


class Scratch:
    """Tables of one operator call, under the shared folder.

    `table` writes a frame and reads it back, which cuts the lineage: a lost
    executor costs the current job's tasks only. `drop` removes a table that
    no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def append(self, df: DataFrame, name: str, compression: str = "zstd") -> None:
        """Adds a frame's rows to a table, which the caller reads when it is whole."""
        df.write.mode("append").option("compression", compression).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, by: str, buckets: int | None = None) -> DataFrame:
        """df as a table bucketed by a column, which later joins and groups by it read without a shuffle.

        buckets: as many as shuffle partitions at least.
        """
        n = max(buckets or 0, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        entry = f"weftline_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(n, by).option("compression", "none").option("path", self.path(name)).saveAsTable(entry)
        out = self.spark.table(entry)
        out.schema  # resolved: the plan holds the files and the buckets, and needs no entry in the catalog
        self.spark.sql(f"DROP TABLE {entry}")
        return out

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
