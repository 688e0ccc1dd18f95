"""Row rules over a stream of questions; rules across a run need its end and stay with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import status
from ..operators.rules import with_issues
from ..schemas import QUESTION


def reviewed(spark: SparkSession, path: str) -> DataFrame:
    """A streaming table over JSON lines of questions as they arrive: run_id, id, status, issues."""
    found = with_issues(spark.readStream.schema(QUESTION).json(path))
    return found.select("run_id", "item_seq", "id", status(F.col("issues")).alias("status"), "issues")
