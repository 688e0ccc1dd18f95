"""Status, counts, previews and the run report, as aggregates over the bank's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, plain_text
from ..schemas import ITEM
from .rules import iter_blocks


def status(issues: Column) -> Column:
    return F.when(F.exists(issues, lambda i: i["severity"].isin("warning", "error")), F.lit("needs_review")).otherwise(F.lit("imported"))


def results(questions: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """run_id, item_seq, ordinal, question_id, status, issues of ``with_issues`` rows, and of failed ones (run_id, item_seq, ordinal)."""
    own = questions.select("run_id", "item_seq", F.col("source.ordinal").alias("ordinal"), F.col("id").alias("question_id"), status(F.col("issues")).alias("status"), "issues")
    if failed is None:
        return own
    return own.unionByName(failed.select("run_id", "item_seq", "ordinal", F.lit(None).cast("string").alias("question_id"), F.lit("failed").alias("status"), F.lit(None).alias("issues")), allowMissingColumns=True)


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("run_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("imported", "needs_review", "failed")))


def severity_counts(issues: DataFrame) -> DataFrame:
    """issues: run_id, severity (issues of items and of the run alike)."""
    return issues.groupBy("run_id").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("info", "warning", "error")))


def summary(found: DataFrame, groups: DataFrame, images: DataFrame) -> DataFrame:
    """Headline counts per run with results: imported (clean or to review), review, skipped, groups, images, warnings, errors.

    One shuffle of tagged rows, added up before it.
    """
    some = lambda s: F.coalesce(F.size(F.filter(F.col("issues"), lambda i: i["severity"] == s)), F.lit(0)).alias(f"{s}s")
    rows = found.select("run_id", "status", some("warning"), some("error"))
    tag = lambda df, what: df.select("run_id", F.lit(what).alias("status"), F.lit(0).alias("warnings"), F.lit(0).alias("errors"))
    rows = rows.union(tag(groups, "group")).union(tag(images, "image"))
    n = lambda *of: F.count_if(F.col("status").isin(*of))
    out = rows.groupBy("run_id").agg(n("imported", "needs_review").alias("imported"), n("needs_review").alias("review"), n("failed").alias("skipped"), n("group").alias("groups"), n("image").alias("images"), F.sum("warnings").alias("warnings"), F.sum("errors").alias("errors"))
    return out.where("imported + skipped > 0")


def manifest_counts(questions: DataFrame, groups: DataFrame, assets: DataFrame) -> DataFrame:
    """Questions (failed ones have no row), groups and assets per run, from one shuffle of tagged rows."""
    tag = lambda df, name: df.select("run_id", F.lit(name).alias("what"))
    rows = tag(questions, "questions").union(tag(groups, "groups")).union(tag(assets, "assets"))
    return rows.groupBy("run_id").agg(*(F.count_if(F.col("what") == x).alias(x) for x in ("questions", "groups", "assets")))


def runs_with_nothing(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs that emitted no item: one failed row of ordinal 1 each."""
    return runs.join(items.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.lit(0).alias("item_seq"), F.lit(1).alias("ordinal"), F.array(F.struct(F.lit("error").alias("severity"), F.lit("no_questions_found").alias("code"))).alias("issues"))


def previews(questions: DataFrame, found: DataFrame) -> DataFrame:
    """run_id, item_seq, id, stem_text, choices (id, text, is_correct), status; a question without a result is imported.

    Questions are cut down to what is shown before they are shuffled; found is joined by id, the last result of an id wins.
    """
    last = found.groupBy("run_id", "question_id").agg(F.max_by("status", "item_seq").alias("status")).withColumnRenamed("question_id", "id")
    return _shown(questions).join(last, ["run_id", "id"], "left").withColumn("status", F.coalesce("status", F.lit("imported")))


def _shown(questions: DataFrame, *more: Column) -> DataFrame:
    right = or_empty(F.col("interaction.correct_option_ids"))
    options = F.when(F.col("interaction.kind") == "choice", or_empty(F.col("interaction.options"), ITEM)).otherwise(F.array().cast(f"array<{ITEM}>"))
    choices = F.transform(options, lambda i: F.struct(i["id"].alias("id"), plain_text(i["content"]).alias("text"), F.array_contains(right, i["id"]).alias("is_correct")))
    return questions.select("run_id", "item_seq", "id", plain_text(F.col("stem")).alias("stem_text"), choices.alias("choices"), *more)


#: What a preview shows of a question itself.
SHOWN = ("id", "ordinal", "label", "type", "group_id", "stem", "stem_text", "choices")


def shown_questions(questions: DataFrame) -> DataFrame:
    """run_id, item_seq and SHOWN; choices have their printed labels."""
    right = or_empty(F.col("interaction.correct_option_ids"))
    options = F.when(F.col("interaction.kind") == "choice", or_empty(F.col("interaction.options"), ITEM)).otherwise(F.array().cast(f"array<{ITEM}>"))
    choices = F.transform(options, lambda i: F.struct(i["id"].alias("id"), i["label"].alias("label"), plain_text(i["content"]).alias("text"), F.array_contains(right, i["id"]).alias("is_correct")))
    return questions.select("run_id", "item_seq", "id", "source.ordinal", "source.label", "type", "group_id", "stem", plain_text(F.col("stem")).alias("stem_text"), choices.alias("choices"))


def reviewed_previews(questions: DataFrame) -> DataFrame:
    """``previews`` of ``with_issues`` rows by their own issues: one shuffle by (run_id, id), no join."""
    last = Window.partitionBy("run_id", "id").orderBy("item_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _shown(questions, status(F.col("issues")).alias("status")).withColumn("status", F.last("status").over(last))


def item_text(item: Column) -> Column:
    """What an item is called where there is room for one line: its first text or verbatim block, else its id."""
    first = F.get(F.filter(item["content"], lambda b: b["kind"].isin("text", "verbatim")), F.lit(0))["text"]
    return F.coalesce(first, item["id"])


def preview_images(questions: DataFrame, assets: DataFrame) -> DataFrame:
    """Image blocks in order with their asset's file name, or null."""
    names = assets.groupBy("run_id", F.col("id").alias("asset_id")).agg(F.max_by("filename", "item_seq").alias("filename"))
    return iter_blocks(questions).where("kind = 'image'").select("run_id", "item_seq", "pos", "place", "asset_id").join(names, ["run_id", "asset_id"], "left")


def group_previews(groups: DataFrame) -> DataFrame:
    return groups.select("run_id", "item_seq", "id", "kind", "title", plain_text(F.col("context")).alias("context_text"), "question_ids")


def attach_notes(notes: DataFrame, items: DataFrame) -> DataFrame:
    """Notes on a document go to the first item at or after them that did not fail; notes after the last such item are lost.

    notes: run_id, noted_at, code; items: run_id, item_seq, failed. One window per run over both, no join by range.
    """
    null = lambda t: F.lit(None).cast(t)
    own = items.select("run_id", F.col("item_seq").alias("seq"), null("string").alias("code"), F.when(~F.col("failed"), F.col("item_seq")).alias("target"))
    rows = notes.select("run_id", F.col("noted_at").alias("seq"), "code", null("int").alias("target")).union(own)
    later = Window.partitionBy("run_id").orderBy(F.col("seq"), F.col("code").isNull()).rowsBetween(0, Window.unboundedFollowing)
    found = rows.withColumn("item_seq", F.first("target", ignorenulls=True).over(later))
    return found.where("code is not null and item_seq is not null").select("run_id", "item_seq", F.col("seq").alias("noted_at"), "code")
