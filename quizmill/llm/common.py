"""Session settings, shared scratch tables and table reading used by every operator of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay small because texts can be very long; shuffle files go as soon as a written table replaces them.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}
#: Rows of one long column up to which a side may be broadcast (about 16 MB); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def settle(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to the session and return it. Python workers find this package where the driver found it; on a
    cluster whose executors lack that path, ship the package with --py-files."""
    home, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), home]))
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Shelf:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    ``put`` writes and rereads a table, ``drop`` deletes one that is no longer read. What is left goes when the
    driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = settle(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.drop, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for table in tables:
            path = table if isinstance(table, str) else table._shelf_path
            try:
                jvm = self.spark.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch
                return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty); extra columns, whatever their names, stay out of the operators' way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keep_ids(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_ROWS, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is in ids (its one column): broadcast up to ``limit`` ids, else a shuffled join."""
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_semi")
