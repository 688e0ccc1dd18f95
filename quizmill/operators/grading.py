"""Answers: emptiness, correctness and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, same_selection, strip


def is_correct() -> Column:
    """Of a row with ``interaction`` and ``answer`` (kind, selected, order, values): graded by kind; other kinds are false.

    Selections are equal if equally long and each is a right one; an order must equal; each blank's value (missing: empty) must equal an
    accepted one but for case and outer white space.
    """
    norm = lambda c: F.lower(strip(c))
    given = lambda b: norm(F.coalesce(F.element_at(F.col("answer.values"), b["id"]), F.lit("")))
    blanks = F.forall(F.coalesce(F.col("interaction.blanks"), F.array()), lambda b: F.exists(or_empty(b["accepted"]), lambda x: norm(x) == given(b)))
    same_kind = lambda k: (F.col("interaction.kind") == k) & (F.col("answer.kind") == k)
    return (
        F.when(same_kind("choice"), same_selection(or_empty(F.col("answer.selected")), or_empty(F.col("interaction.correct_option_ids"))))
        .when(same_kind("ordering"), or_empty(F.col("answer.order")) == or_empty(F.col("interaction.correct_order")))
        .when(same_kind("fill_in_blank"), blanks)
        .otherwise(F.lit(False))
    )


def is_answered() -> Column:
    values = F.map_values(F.coalesce(F.col("answer.values"), F.create_map().cast("map<string,string>")))
    return F.when(F.col("answer.kind") == "choice", F.size(or_empty(F.col("answer.selected"))) > 0).when(F.col("answer.kind") == "ordering", F.lit(True)).otherwise(F.exists(values, lambda v: strip(v) != ""))


def empty_answer() -> Column:
    """The answer a question starts with: an order starts as displayed, all else empty; ungraded kinds as a choice."""
    kind = F.col("interaction.kind")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(kind.isin("ordering", "fill_in_blank"), kind).otherwise(F.lit("choice")).alias("kind"), none.alias("selected"),
        F.when(kind == "ordering", F.transform("interaction.items", lambda i: i["id"])).otherwise(none).alias("order"), F.create_map().cast("map<string,string>").alias("values"),
    )


def graded(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (run_id, id, a learner's columns, answer) with ``answered`` and ``correct``; one to an unknown question is neither.

    An equi-join by (run_id, id) that carries only what is right, without what is shown.
    """
    right = F.when(F.col("interaction").isNotNull(), F.struct(*(F.col(f"interaction.{c}").alias(c) for c in ("kind", "correct_option_ids", "correct_order", "blanks")))).alias("interaction")
    joined = answers.join(questions.select("run_id", "id", right), ["run_id", "id"], "left")
    flags = {"answered": F.coalesce(is_answered() & F.col("interaction").isNotNull(), F.lit(False)), "correct": F.coalesce(is_correct(), F.lit(False))}
    return joined.withColumns(flags).drop("interaction", "answer")


def scores(answers: DataFrame, key: str = "learner_id") -> DataFrame:
    """answers: ``key``, submitted, is_correct. Submitted and correct ones per key."""
    return answers.groupBy(key).agg(F.count_if("submitted").alias("submitted"), F.count_if(F.col("submitted") & F.col("is_correct")).alias("correct"))
