"""The subpackage's queries: thin digests of each operator's own results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import licences, rules
from .alignment import align, link_statistics
from .common import table
from .decontaminate import contamination
from .language import fit_languages, predict_languages
from .licences import scan_licences
from .near_dup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .periodic import periodic_runs
from .quality import resample
from .rules import let, quality_rules
from .shards import assign_shards
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity, tag_toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(remainder(3) != 1))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    score = F.col("score")
    return tag_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(score >= 0.7, 1).otherwise(0).alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = fit_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), [1.0] * 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def planted(doc_id: Column, text: Column) -> Column:
    """The texts op11 reads: where h = crc32(doc_id) is divisible by 10, words from the a-th on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))), " "))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    r = lambda x: F.struct((x["length"] / x["period"]).alias("exponent"), (-x["start"]).alias("a"), (-x["period"]).alias("b"), x.alias("run"))  # noqa: E731  doubles tell fractions of texts under 2**26 words apart
    best = F.array_max(F.transform("runs", r))["run"]
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    found = periodic_runs(docs).withColumn("best", best)
    milli = F.expr("1000 * best.length div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.array_join("failed", ",").alias("failed"), "kept")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    aligned = align(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return link_statistics(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links", "times"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": licences.oracle_sql(), "op12_quality_rules": rules.oracle_sql()}
