"""Plans that grow with their input: what is made once, and what is joined, shuffled and written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quizmill.functions import rows as tables
from quizmill.functions import text
from quizmill.operators import normalize, rules
from quizmill.plans import authored, bindings, runs
from quizmill.plans import pages as page_queries
from quizmill.plans.bindings import written
from quizmill.sources import authoring, jsonlines

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", str(10**8))
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["severity_counts", "issue_messages", "rule_choice_options", "rule_choice_answers", "rule_answer_count", "rule_matching", "rule_drag_drop", "rule_blanks", "rule_ordering"])
def test_interactions_are_made_once(spark, name):
    """The bank's lists are split where the interaction is made, not in each filter and issue that reads it."""
    plan = optimized(entry.queries()[name](spark, SF))
    assert 0 < plan.count("split(") <= 12 and not [line for line in plan.splitlines() if "Filter" in line and "split(" in line]


@pytest.mark.parametrize("name", ["status_counts", "needs_review_summary", "preview_questions"])
def test_no_issue_is_made_to_be_cut_away(spark, name):
    """Where nothing is wrong, an empty array is written down, not the first none of an issue made for it."""
    assert "slice(array(named_struct(" not in optimized(entry.queries()[name](spark, SF))


def test_lists_with_nulls(spark):
    """The short ways of ``repeats`` and ``unknown`` give what going through the list gives."""
    lists = [None, [], ["a"], ["a", "a"], [None], [None, None], ["a", None, "a", None], ["b", "a", "b", "b"]]
    rows = spark.createDataFrame([(a, b) for a in lists for b in lists], "a array<string>, b array<string>")
    long = F.filter("a", lambda x, i: F.array_position(F.slice("a", 1, i), x) > 0), F.filter("a", lambda r: ~F.array_contains("b", r))
    assert rows.select(text.repeats(F.col("a")), text.unknown(F.col("a"), F.col("b"))).collect() == rows.select(*long).collect()


@pytest.mark.parametrize("name", ["authoring_groups", "authoring_items"])
def test_groups_of_a_document_are_found_in_its_row(spark, name):
    """What a group owns takes no join and no broadcast: documents grow large, whatever the planner takes them for."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_questions_are_parsed_once_when_they_can_be_read(spark, monkeypatch):
    """Only narrow rows are kept: what reading comes upon, and numbers; no parsed question is written."""
    kept = []
    items = authoring.read_items(authored.documents(spark, SF), authored.files(spark, SF), keep=lambda df: kept.append(df.columns) or df)
    assert len(kept) == 2 and not any("interaction" in columns for columns in kept)
    assert "interaction" in items.questions.columns


def test_whole_runs_shuffle_no_wide_rows_to_make_their_input(spark):
    """The bank that a whole run reads is numbered and written once; its tables are projections of it."""
    for table in runs._tables(spark, SF):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_not_sorted_to_rename_them(spark):
    questions, groups, assets, _, _ = runs._tables(spark, SF)
    done, *_ = normalize.normalize_run(questions, groups, assets, written)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_documents_made_of_small_keys_are_spread(spark):
    """Keys of a few bytes are not coalesced into one task that makes all documents."""
    assert runs._authored(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_bank_is_numbered_before_its_texts_are_made(spark):
    """What is shuffled and sorted to number a run's questions are columns of the table, no text made of them."""
    plan = bindings.flat_bank(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "single_choice" in plan.split("Window")[0] and "single_choice" not in plan.split("Window")[1]


def test_lists_that_the_bank_does_not_know_are_split(spark):
    flat = spark.createDataFrame([("r", 1, "q1", None, "matching", "matching", ids, refs, 1, None, 0) for ids, refs in (("a,b", "b,a"), ("x,y", "y"), ("a", None))], bindings.flat_bank(spark, SF).schema)
    found = bindings.bank(spark, SF, flat=flat).select("interaction.left.id", "interaction.pairs.right_id").collect()
    assert [tuple(r) for r in found] == [(["a", "b"], ["b", "a"]), (["x", "y"], ["y"]), (["a"], [])]


def test_rules_are_not_gone_through_to_be_numbered(spark):
    """A lambda's input is interpreted: issues are numbered of a column made before, across a generator."""
    plan = optimized(rules.with_issues(bindings.bank(spark, SF)))
    numbered = [line for line in plan.splitlines() if "transform(_found" in line]
    assert numbered and not any("duplicate_option_ids" in line for line in numbered)


def test_some_unknown_is_unknown_that_lists_any(spark):
    lists = [None, [], ["a"], ["a", "a"], [None], ["a", None], ["b", "a"]]
    rows = spark.createDataFrame([(a, b) for a in lists for b in lists], "a array<string>, b array<string>")
    some, found = F.coalesce(text.some_unknown(F.col("a"), F.col("b")), F.lit(False)), F.coalesce(F.size(text.unknown(F.col("a"), F.col("b"))) > 0, F.lit(False))
    assert rows.where(some != found).count() == 0


def test_grading_joins_only_what_is_right(spark):
    """Options and their contents take no part in the join of answers."""
    plan = entry.queries()["graded_runs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "interaction.content" not in plan and "AS options" not in plan.split("Join")[0]


def test_a_document_makes_only_what_is_asked_for(spark):
    """Assets and groups need no question's lines in order: only lines and objects are kept; questions keep classified items once, without a second copy of their lines."""
    kept = []
    found = page_queries.pages.read_document(page_queries._content(spark, SF), keep=lambda df: kept.append(df.columns) or df)
    assert found.assets and found.groups and len(kept) == 2
    assert found.questions and found.questions and len(kept) == 3
    assert "content" in kept[2] and not {"text", "stripped", "body"} & set(kept[2])


def test_strings_with_nothing_to_escape_are_quoted(spark):
    """They are what the JSON writer makes of them, and only the others go through it."""
    values = ["", "a b", 'q"', "back\\slash", "tab\t", "line\n", "line at the end\n", "\x7f", "é", "/", "~#[]!", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert rows.where(~jsonlines._string(F.col("v")).eqNullSafe(jsonlines._json(F.col("v")))).count() == 0
    assert "rlike" in optimized(entry.queries()["question_lines"](spark, SF)).lower()


def test_a_task_sorts_a_share_of_the_lines(spark, monkeypatch):
    """Numbering lines and settling ids: tasks grow in number with the table, not in rows, and families are dealt once for both kinds."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100, raising=False)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    done = entry.queries()["normalize_ids"](spark, SF)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and plan.count(f", {n}), REPARTITION_BY_NUM") == plan.count("Exchange ") > 0
    assert max(done.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]) <= 200
    final = done.select("id", "remapped")
    final.collect()
    assert "ReusedExchange" in final._jdf.queryExecution().executedPlan().toString()


def test_whole_runs_settle_ids_in_as_many_tasks(spark):
    questions, groups, assets, _, _ = runs._tables(spark, SF)
    kept = []
    normalize.normalize_run(questions, groups, assets, lambda df: kept.append(df) or df, 37)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "_family" in plan and plan.count(", 37), REPARTITION_BY_NUM") >= 2


def test_families_are_sorted_once(spark):
    """Both windows over a family go by one sort, in each branch."""
    ids = spark.createDataFrame([("r", 1, "x")], "run_id string, item_seq int, raw string")
    plan = normalize.unique_ids(ids, "raw", F.lit("q"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2


def test_ids_are_the_same_in_any_number_of_tasks(spark):
    raw = ["x", "x-dup2", "x", " ", "y", "x ", "q4", "y-dup2-dup2", "y", "y-dup2", "z", "z", None, "z-dupe", "q4-dup2", "", "y"]
    df = spark.createDataFrame([(f"r{r}", i, x) for r in range(5) for i, x in enumerate(raw[r:] + raw[:r], 1)], "run_id string, item_seq int, id string")
    want = []
    for r in range(5):
        taken = set()
        for i, x in enumerate(raw[r:] + raw[:r], 1):
            first = one = (x or "").strip() or f"q{i}"
            n = 2
            while one in taken:
                one, n = f"{first}-dup{n}", n + 1
            taken.add(one)
            want.append((f"r{r}", i, one, not (x or "").strip(), one != first))
    for parts in (None, 1, 7):
        found = normalize.unique_ids(df, "id", F.concat(F.lit("q"), "item_seq"), parts=parts).select("run_id", "item_seq", "id", "assigned", "remapped")
        assert sorted(map(tuple, found.collect())) == want
