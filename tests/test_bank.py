import glob
import json
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quizmill.functions import text
from quizmill.operators import grading, layout, lines, messages, normalize, report, rules
from quizmill.plans import authored, documents, lines_of_bundles, pages, queries, reporting, runs  # noqa: F401, the others register their queries
from quizmill.schemas import ASSET, GROUP
from quizmill.sources import authoring, bundle, registry
from quizmill.streaming.ingest import reviewed
from quizmill.plans.bindings import bank, bank_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(map(tuple, df.select(columns).collect()))
    want = Counter(con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall())
    assert got == want


def test_every_query_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize(("raw", "want"), [("B", "b"), ("A, C", "a,c"), ("A and C", "a,c"), ("AC", "a,c"), ("see appendix", ""), ("C C", "c"), ("a network bridge", "a")])
def test_answer_letters(spark, raw, want):
    assert spark.range(1).select(F.array_join(text.answer_letters(F.lit(raw)), ",")).first()[0] == want


def test_list_functions(spark):
    lit = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(text.repeats(lit("a", "b", "a", "a")), text.unknown(lit("z", "z", "a"), lit("a", "b")), text.same_selection(lit("x", "x"), lit("x", "y")), text.strip(F.lit("  a\t"))).first()
    assert list(row) == [["a", "a"], ["z", "z"], True, "a"]


@pytest.mark.parametrize(("ids", "want"), [(["a", "a", "a-dup2"], ["a", "a-dup2", "a-dup2-dup2"]), (["a", "a-dup2", "a"], ["a", "a-dup2", "a-dup3"]), (["x", "x", " x ", ""], ["x", "x-dup2", "x-dup3", "q4"])])
def test_unique_ids(spark, ids, want):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(ids, 1)], "run_id string, item_seq int, raw string")
    assert [r.id for r in normalize.unique_ids(df, "raw", F.concat(F.lit("q"), "item_seq")).orderBy("item_seq").collect()] == want


@pytest.mark.parametrize(
    ("rows", "roles", "issues"),
    [
        (["1. q", "A. x", "B. y", "Answer: A", "more"], ["stem", "option", "option", "answer", "explanation"], ["unmarked_text_after_answer"]),
        (["1. q", "A. x", "Answer: A", "B. y"], ["stem", "option", "answer", "option"], ["option_after_answer_key"]),
        (["1. q", "Explanation: e", "A. x"], ["stem", "explanation", "explanation"], []),
        (["1. q", "Answer: A", "Answer: zz"], ["stem", "answer", "answer"], ["multiple_answer_keys", "unparsed_answer_key"]),
    ],
)
def test_classifier(spark, rows, roles, issues):
    got = lines.classify(lines.flow(lines.segment(positioned(spark, rows)))).orderBy("line_no").collect()
    assert [r.role for r in got] == roles
    assert [x.code for r in got for x in r.line_issues] == issues


LINE = "doc_id long, page int, line_no int, x0 double, y0 double, y1 double, mono boolean, text string, spans array<struct<text: string, x0: double, x1: double>>"


def positioned(spark, rows):
    """Lines of one document, ten points apart; those that start with a bar are monospace."""
    made = [(t.removeprefix("|"), t.startswith("|")) for t in rows]
    return spark.createDataFrame([(1, 1, i, 72.0, 10.0 * i, 10.0 * i + 10, m, t, [(t, 72.0, 72.0 + 6.0 * len(t))]) for i, (t, m) in enumerate(made)], LINE)


def assembled(spark, rows):
    return lines.assemble_questions(lines.classify(lines.flow(lines.segment(positioned(spark, rows))))).orderBy("item_seq").collect()


def test_white_space_and_digits_of_unicode(spark):
    rows = ["\t1. abc", "A.\u00a0x", "B. B. y ", "C.  ", "Answer: B", "Explanation:  why  not ", "Question\u00a0\u0662: next"]
    first, second = assembled(spark, rows)
    assert (first.source.label, [b.text for b in first.stem]) == ("1.", ["abc"])
    assert [(o.id, o.label, [b.text for b in o.content]) for o in first.interaction.options] == [("a", "A.", ["x"]), ("b", "B.", ["B. y \nC.  "])]
    assert first.interaction.correct_option_ids == ["b"] and [b.text for b in first.explanation] == ["why  not "]
    assert (second.id, second.source.label, [i.code for i in second.issues]) == ("q2", "Question\u00a0\u0662:", ["no_options_detected"])


def test_types_go_by_blocks(spark):
    types = lambda *rows: [r.type for r in assembled(spark, rows)]
    assert types("1. q", "A. True", "B. False", "Answer: A") == ["true_false"]
    assert types("1. q", "A. True", "or so", "B. False", "Answer: A") == ["single_choice"]
    assert types("1. q", "A. True", "|cli", "or so", "B. False", "Answer: A") == ["true_false"]
    assert types("1. pick (choose two)", "A. x", "B. y") == ["multiple_choice"]
    assert types("1. pick (choose", "two)", "A. x", "B. y") == ["multiple_choice"]
    assert types("1. q", "A. x", "B. y", "Answer: A, B") == ["multiple_choice"]


def test_blocks_by_role(spark):
    question, = assembled(spark, ["1. q", "  more", "", "|cli", "|  out", "A. x", "B. y", "Answer: A", "because"])
    assert [(b.kind, b.text) for b in question.stem] == [("text", "q\n  more"), ("verbatim", "cli\n  out")]
    assert [b.text for b in question.explanation] == ["because"] and [i.code for i in question.issues] == ["unmarked_text_after_answer"]


def test_groups_from_lines(spark):
    rows = ["junk", "1. alone", "Scenario 7: A. not an option", "A. nope", "|cli", "2. first", "A. x", "3. second", "CASE  study", "4. last"]
    found = lines.segment(positioned(spark, rows))
    groups = lines.assemble_groups(found, lines.flow(found)).orderBy("item_seq").collect()
    assert [(g.id, g.kind, g.title, g.question_ids) for g in groups] == [("g1", "scenario", rows[2], ["q2", "q3"]), ("g2", "case_study", rows[8], ["q4"])]
    assert [[(b.kind, b.text) for b in g.context] for g in groups] == [[("text", "A. nope"), ("verbatim", "cli")], []]
    questions = assembled(spark, rows)
    assert [(q.id, q.group_id, q.item_seq) for q in questions] == [("q1", None, 1), ("q2", "g1", 3), ("q3", "g1", 4), ("q4", "g2", 6)]
    assert [r.args for r in lines.document_notes(found).collect()] == [["1", "1"]]


def test_images_and_tables_in_the_flow(spark):
    found = lines.segment(positioned(spark, ["1. q", "A. x", "B. y", "Explanation: e"]))
    objects = spark.createDataFrame([(1, 1, 1, 1, "image", 5.0, "q1-img1", None), (1, 1, 1, 2, "image", 10.0, "q1-img2", None), (1, 1, 1, 3, "table", 35.0, None, [["c", "d"]])], "doc_id long, slice_no int, page int, obj_no int, obj_kind string, y_center double, asset_id string, rows array<array<string>>")
    question = lines.assemble_questions(lines.classify(lines.flow(found, objects))).first()
    assert [(b.kind, b.asset_id) for b in question.stem] == [("text", None), ("image", "q1-img1")]
    assert [(b.kind, b.text, b.asset_id) for b in question.interaction.options[0].content] == [("text", "x", None), ("image", None, "q1-img2")]
    assert [(b.kind, b.text, b.rows) for b in question.explanation] == [("text", "e", None), ("table", None, [["c", "d"]])]


def test_own_patterns(spark):
    cfg = lines.ParserConfig(question_labels=(r"#\d+",), option=r"^\*\s*([a-z])\s(.*)$")
    rows = lines.assemble_questions(lines.classify(lines.flow(lines.segment(positioned(spark, ["#1 what", "1. plain", "* p one"]), cfg)), cfg), cfg).collect()
    assert [(r.source.label, [b.text for b in r.stem], [o.id for o in r.interaction.options]) for r in rows] == [("#1", ["what\n1. plain"], ["p"])]


def brute_clusters(boxes, gap):
    found = []
    for x0, y0, x1, y1 in boxes:
        if x1 > x0 and y1 > y0:
            meets = [c for c in found if x0 - gap < c[2] and c[0] < x1 + gap and y0 - gap < c[3] and c[1] < y1 + gap]
            found = [c for c in found if c not in meets] + [tuple(f(b[i] for b in [(x0, y0, x1, y1), *meets]) for i, f in enumerate((min, min, max, max)))]
    return found


def test_clusters_are_those_of_one_pass(spark):
    rnd = random.Random(3)
    pages = {p: [(x := rnd.uniform(0, 300), y := rnd.uniform(0, 300), x + rnd.choice([0, 9, 40]), y + rnd.choice([5, 30])) for _ in range(25)] for p in range(6)}
    rows = [(1, p, i, list(b)) for p, boxes in pages.items() for i, b in enumerate(boxes)]
    rnd.shuffle(rows)
    got = layout.cluster_rects(spark.createDataFrame(rows, "doc_id long, page int, rect_no int, bbox array<double>")).orderBy("page", "cluster_no").collect()
    assert {p: [tuple(r.bbox) for r in got if r.page == p] for p in pages} == {p: brute_clusters(b, 12.0) for p, b in pages.items()}


def test_a_run_with_a_hot_id(spark):
    ids = ["x"] * 500 + ["x-dup3", "y", "x", "x-dup3"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(ids, 1)], "run_id string, item_seq int, raw string")
    got = [r.id for r in normalize.unique_ids(df, "raw", F.lit("q")).orderBy("item_seq").collect()]
    taken, want = set(), []
    for x in ids:
        one, n = x, 2
        while one in taken:
            one, n = f"{x}-dup{n}", n + 1
        taken.add(one)
        want.append(one)
    assert got == want


def test_verbatim_rounds_half_to_even(spark):
    rows = [("r", 1, i, x, 10.0 * i, 10.0 * i + 10, [(t, x, x + 10.0 * len(t))]) for i, (x, t) in enumerate([(0.0, "ab"), (25.0, "c"), (35.0, "d")])]
    df = spark.createDataFrame(rows, "run string, page int, pos int, x0 double, y0 double, y1 double, spans array<struct<text: string, x0: double, x1: double>>")
    assert lines.verbatim(df, ("run",)).first().text == "ab\n  c\n    d"


def test_blank_grading(spark):
    df = spark.sql("""select named_struct('kind', 'fill_in_blank', 'blanks', array(named_struct('id', 'b1', 'accepted', array('startup-config'))), 'correct_option_ids', array(''), 'correct_order', array('')) as interaction,
      named_struct('kind', 'fill_in_blank', 'values', map('b1', ' Startup-Config '), 'selected', array(''), 'order', array('')) as answer""")
    assert df.select(grading.is_correct(), grading.is_answered()).first() == (True, True)


DOC = {
    "groups": [{"id": "s1", "kind": "nonsense", "context": "ctx", "questions": ["2", "x"]}],
    "questions": [
        {"type": "single_choice", "stem": "What?", "options": [{"text": "yes", "correct": True}, {"id": "n", "content": [{"cli": "show run"}]}]},
        {"type": "ordering", "stem": [{"text": "sort"}, "these"], "items": [{"text": "one"}, {"text": "two"}]},
        {"type": "matching", "left": [{"text": "l"}], "right": [{"text": "r"}], "pairs": [{"left": "l1", "right": "r1"}, {"left": "l1"}]},
        {"type": "fill_in_blank", "blanks": [{"accepted": ["x"]}]},
        {"type": "unheard"},
        {"type": "single_choice", "options": []},
        {"type": "single_choice", "stem": [{"sound": 1}], "options": [{"text": "a"}]},
    ],
}


def test_authoring(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    docs = authoring.read_documents(spark, str(tmp_path))
    found = authoring.questions(docs).orderBy("ordinal").collect()
    assert [r.error for r in found] == [None, None, None, None, "type", "interaction", "content"]
    assert [o.id for o in found[0].interaction.options] == ["a", "n"] and found[0].interaction.correct_option_ids == ["a"]
    assert found[0].interaction.options[1].content[0].kind == "verbatim"
    assert found[1].interaction.correct_order == ["item1", "item2"] and [b.text for b in found[1].stem] == ["sort", "these"]
    assert found[2].interaction.pairs == [("l1", "r1")] and found[3].interaction.blanks[0].id == "b1"
    group = authoring.groups(docs, authoring.questions(docs)).first()
    good, _, failed = authoring.items(docs)
    assert [(r.item_seq, r.id) for r in good.orderBy("item_seq").collect()] == [(1, "q1"), (3, "q2"), (4, "q3"), (5, "q4")] and sorted(r.item_seq for r in failed.collect()) == [6, 7, 8]
    assert (group.group_id, group.kind, group.question_ids) == ("s1", "scenario", ["q2"])
    assert {r.id: r.group_id for r in authoring.with_groups(authoring.questions(docs), docs).collect()}["q2"] == "s1"


def test_bundle_round_trip_and_stream(spark, tmp_path):
    questions = bank(spark, SF).limit(200).cache()
    groups = bank_groups(spark, SF).selectExpr("run_id", "item_seq", "id", "kind", "title", "cast(null as array<struct<kind: string>>) as context", "question_ids")
    assets = spark.createDataFrame([], ASSET)
    path = str(tmp_path / "b")
    bundle.write_bundle(path, questions, groups.drop("context"), assets, spark.range(1))
    back = bundle.read_bundle(spark, path)
    assert sorted(map(str, back["questions"].collect())) == sorted(map(str, questions.collect()))
    assert back["manifest"].first().questions == 200 and back["groups"].schema.simpleString().startswith("struct<run_id") and GROUP
    with pytest.raises(bundle.BundleError):
        bundle.write_bundle(path, questions, groups.drop("context"), assets, spark.range(1))
    with pytest.raises(bundle.BundleError):
        bundle.read_bundle(spark, str(tmp_path / "none"))
    stream = reviewed(spark, f"{path}/questions").writeStream.format("memory").queryName("reviewed").trigger(availableNow=True).start()
    stream.awaitTermination()
    want = rules.with_issues(questions).where("size(issues) > 0").count()
    assert spark.table("reviewed").where("status = 'needs_review'").count() == want


@pytest.mark.parametrize("raw", ["plain", "it's", 'say "x"', """it's "x\"""", "back\\slash", "a\tb\nc\rd", ""])
def test_quoting_equals_repr(spark, raw):
    assert spark.range(1).select(messages.quoted(F.lit(raw)), messages.quoted_list(F.array(F.lit(raw), F.lit("b")))).first() == (repr(raw), repr([raw, "b"]))


def test_sentences_of_own_rules(spark):
    row = spark.range(1).select(messages.sentence(F.lit("mine"), F.array(F.lit("x"))), messages.sentence(F.lit("unknown_group"), F.array().cast("array<string>"))).first()
    assert row == ("mine: ['x']", "question references unknown group ''")


def test_notes_reach_the_next_item_that_did_not_fail(spark):
    items = spark.createDataFrame([("r", 1, True), ("r", 2, False), ("r", 3, True), ("s", 1, False)], "run_id string, item_seq int, failed boolean")
    notes = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "lost"), ("s", 0, "c")], "run_id string, noted_at int, code string")
    assert {(r.code, r.run_id, r.item_seq) for r in report.attach_notes(notes, items).collect()} == {("a", "r", 2), ("b", "r", 2), ("c", "s", 1)}


def test_registry(spark, tmp_path):
    (tmp_path / "a.JSON").write_text(json.dumps(DOC))
    assert registry.open_documents(spark, str(tmp_path / "a.JSON")).count() == 1
    assert registry.open_documents(spark, str(tmp_path), "json").count() == 1
    for path, name in (("a.pdf", None), ("a.txt", None), ("a.json", "xml")):
        with pytest.raises(registry.UnsupportedFormatError):
            registry.open_documents(spark, path, name)
    names = spark.createDataFrame([("a.JPEG", "image/jpeg"), ("a", "application/octet-stream"), ("a.gif", "image/gif")], "name string, want string")
    assert names.where(normalize.served_type(F.col("name")) != F.col("want")).isEmpty()
