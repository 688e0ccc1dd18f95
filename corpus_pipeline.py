"""A cleaning pipeline over documents: each stage is written and read again before the next.

Quality resampling, n-gram Jaccard join, suffix-array dedup, benchmark decontamination, best-fit packing. Every stage but
the last takes and returns the columns of documents, whatever further ones there are and however they are named; stages
decide by doc_id, so rows without one don't pass the first. Null and empty texts are texts without content, texts of any
length are read whole, and each stage returns no rows for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.llm.common import BROADCAST_ROWS, Shelf, keep_ids, table
from quizmill.llm.decontaminate import contamination
from quizmill.llm.near_dup import near_duplicates
from quizmill.llm.packing import pack
from quizmill.llm.quality import resample
from quizmill.llm.suffix_dedup import remove_repeats

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; of repeated rows all or none. Without usable labels all stay."""
    drawn = resample(docs, table(spark, sf_dir, "labels")).where("kept and doc_id is not null")
    return keep_ids(docs, Shelf(spark, "pipeline").put(drawn.select("doc_id").distinct()))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; of rows with one doc_id the one whose
    text, then whose other columns as JSON, come first. Null and empty texts are groups of their own."""
    groups = Shelf(spark, "pipeline").put(near_duplicates(docs).select("doc_id", "component_id"))
    first = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = keep_ids(docs, first.select("doc_id"))
    return kept if first.where("rows > 1").isEmpty() else first_rows(kept)


def first_rows(docs: DataFrame) -> DataFrame:
    """One row of each doc_id; ranks are cut before the shuffle too, so a doc_id of many rows doesn't fill a task."""
    ordered = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("first"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("first", F.to_json("row")))
    return ordered.withColumn("place", place).where("place = 1").select("row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that start more than once; a character cut in two is replaced. Null
    texts come out empty; repeated rows lose what they repeat."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, carry=others)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    values = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*((values[c] if c in values else F.col("carried").getField(c)).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; all of them if it has no items with words."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    found = Shelf(spark, "pipeline").put(found)
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; null and empty texts are their end token alone."""
    return pack(docs, public_tokenizers.path(TOKENIZER)).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicate_groups),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]
#: Sampling noise, byte spans and packing can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    shelf = Shelf(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
