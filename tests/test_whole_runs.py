"""What whole runs shuffle, write and leave on disk."""

from __future__ import annotations

import glob
import tempfile
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quizmill.operators import normalize, run
from quizmill.plans import authored, bindings, reporting, runs
from quizmill.plans.bindings import written
from quizmill.sources import authoring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    return runs._run(spark, SF)


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The session's setting is as it was, also after writes inside of others."""
    files = lambda: {*glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data")}
    before, setting = files(), spark.conf.get(bindings._CLEANUP, None)
    with bindings._shuffles_go(spark):
        written(spark.range(1000).repartition(3, "id").groupBy("id").count())
        assert spark.conf.get(bindings._CLEANUP) == "true"
    assert spark.conf.get(bindings._CLEANUP, None) == setting
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:  # they go in the background
        time.sleep(0.1)
    assert not files() - before


def test_no_made_question_is_kept_or_shuffled(spark):
    """Rows of the bank are renamed and kept; interactions are made of them where they are read."""
    kept = []
    settings = runs._settings(spark, SF) | {"keep": lambda df: kept.append(df) or df}
    found = run.assemble_run(*runs._rows(spark, SF), **settings)
    assert kept and not any({"interaction", "stem"} & {*df.columns} for df in kept)
    plan = found.questions._jdf.queryExecution().optimizedPlan().toString()
    assert "AS interaction" in plan.split("Join")[0]


def test_made_late_or_early_questions_are_the_same(spark, made):
    early, *_ = normalize.normalize_run(*runs._tables(spark, SF)[:3], written)
    late = made.questions.select(*early.columns)
    assert late.exceptAll(early).isEmpty() and early.exceptAll(late).isEmpty()


def test_a_preview_meets_in_one_shuffle(made):
    """Issues, images and questions of an item meet where their run does: one exchange lies under both groupings."""
    named = run.Run(made.questions, made.groups, made.assets.withColumn("filename", F.lit("x")), made.failed, made.issues)
    plan = run.preview_documents(named)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange")[0].count("ObjectHashAggregate") >= 4
    short = run.preview_documents(named, {"issue": lambda i: i["code"], "image": lambda i: i["asset_id"], "question": lambda q: q["id"], "group": lambda g: g["id"]})
    name = lambda rows, one: F.transform(rows, one)
    code = lambda found: F.array_sort(F.transform(found, lambda i: i["code"]))
    whole = run.preview_documents(named).select(
        "run_id", name("questions", lambda q: F.struct(q["id"], F.transform(q["images"], lambda m: m["asset_id"]), code(q["issues"]), q["status"])).alias("q"),
        name("failed", lambda f: F.struct(f["ordinal"], code(f["issues"]))).alias("f"), name("groups", lambda g: g["id"]).alias("g"), code("run_issues").alias("i"),
    )
    cut = short.select(
        "run_id", name("questions", lambda q: F.struct(q["question"], q["images"], F.array_sort(q["issues"]), q["status"])).alias("q"), name("failed", lambda f: F.struct(f["ordinal"], F.array_sort(f["issues"]))).alias("f"), F.col("groups").alias("g"), F.array_sort("run_issues").alias("i"),
    )
    assert [tuple(r) for r in whole.orderBy("run_id").collect()] == [tuple(r) for r in cut.orderBy("run_id").collect()]


def test_good_and_failed_questions_are_parsed_once(spark):
    """Both kinds are rows of one table: no union of two plans that each read and parse all documents."""
    plan = entry.queries()["authoring_items"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("Scan parquet") == 1


@pytest.mark.parametrize("made_by", [authored.documents, reporting._documents])
def test_lines_are_dealt_once_to_make_documents(spark, made_by):
    """They are grouped by the key by which they were numbered, where they are."""
    assert made_by(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_missing_images_meet_their_items_where_they_are_numbered(spark):
    """Items are dealt once, by document, to be told of missing files and to be numbered."""
    kept = []
    authoring.read_items(authored.documents(spark, SF), authored.files(spark, SF), keep=lambda df: kept.append(df) or (written(df) if len(kept) == 1 else df))
    top = kept[1]._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert top.count("Exchange ") == 1 and "Join" not in top
