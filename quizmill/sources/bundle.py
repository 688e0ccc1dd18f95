"""Bundles: a directory of JSON-lines tables, partitioned files, with a manifest written last as the commit marker."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ASSET, FORMAT_VERSION, GROUP, QUESTION

SCHEMAS = {"questions": QUESTION, "groups": GROUP, "assets": ASSET}


class BundleError(Exception):
    """A bundle that can't be written or read as a whole."""


def write_bundle(path: str, questions: DataFrame, groups: DataFrame, assets: DataFrame, report: DataFrame) -> None:
    """Refuses a directory that has a table already; a repeated asset id in one run is an error. Manifest last."""
    spark = questions.sparkSession
    if not assets.groupBy("run_id", "id").count().where("count > 1").isEmpty():
        raise BundleError("an asset id is stored twice in one run")
    tables = {"questions": questions, "groups": groups, "assets": assets, "report": report}
    try:
        for name, df in tables.items():
            order = [c for c in ("run_id", "item_seq") if c in df.columns]
            (df.sortWithinPartitions(*order) if order else df).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}")
    except AnalysisException as error:
        raise BundleError(f"{path} is not empty") from error
    counts = [spark.read.text(f"{path}/{name}").select(F.count(F.lit(1)).alias(name)) for name in SCHEMAS]
    manifest = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three tables of one row
    manifest.select(F.lit(FORMAT_VERSION).alias("format_version"), *SCHEMAS).write.mode("errorifexists").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables by name; groups and assets may be missing, a bad line stops the read, without a manifest there is no bundle."""
    out = {}
    try:
        out["manifest"] = spark.read.json(f"{path}/manifest")
        out["questions"] = spark.read.schema(QUESTION).json(f"{path}/questions", mode="FAILFAST")
        out["report"] = spark.read.json(f"{path}/report")
    except AnalysisException as error:
        raise BundleError(f"{path} has no manifest, questions or report") from error
    for name in ("groups", "assets"):
        try:
            out[name] = spark.read.schema(SCHEMAS[name]).json(f"{path}/{name}", mode="FAILFAST")
        except AnalysisException:
            out[name] = spark.createDataFrame([], SCHEMAS[name])
    return out
