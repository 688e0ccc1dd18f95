"""Bundles as lines: round trips, places of bad lines, models, stored files and the manifest as commit."""

import json

import pytest
from pyspark.sql import functions as F

from quizmill.plans.bindings import bank
from quizmill.schemas import ASSET, GROUP, QUESTION
from quizmill.sources import jsonlines
from quizmill.sources.bundle import BundleError

SF = "/root/testdata/sf0.001"
LINE = {
    "id": "q1", "source": {"ordinal": 1, "label": None, "pages": [1, 2]}, "type": "single_choice", "group_id": None,
    "stem": [{"kind": "text", "text": "Wh\"y\\ \t é 中?\n"}, {"kind": "verbatim", "text": "  R1# x\n", "language_hint": None}, {"kind": "image", "asset_id": "a1", "caption": "c"}, {"kind": "table", "rows": [["", "b"], []]}],
    "interaction": {"kind": "choice", "options": [{"id": "a", "label": "A.", "content": []}, {"id": "b", "label": None, "content": [{"kind": "text", "text": ""}]}], "correct_option_ids": ["b"]}, "explanation": [],
}
GROUP_LINE = {"id": "g1", "kind": "case_study", "title": None, "context": [{"kind": "text", "text": "x"}], "question_ids": ["q1"]}


def dumped(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("".join(x + end for x in lines).encode())


def changed(line=LINE, **fields):
    return dumped(line | fields)


def problems(spark, *lines, model=jsonlines.QUESTION_MODEL):
    made = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    return [list(r.problems) for r in jsonlines.check_lines(made, model).orderBy("line_no").collect()]


def test_lines_round_trip(spark, tmp_path):
    """What is read and written again is the same text: only the fields of each kind, nulls kept, nothing escaped that need not be."""
    write(tmp_path / "in/questions.jsonl", [dumped(LINE)])
    rows = jsonlines.read_lines(spark, str(tmp_path / "in"), jsonlines.QUESTION_MODEL, QUESTION)
    assert rows.select(jsonlines.question_line(F.col("interaction"))).first()[0] == dumped(LINE)
    write(tmp_path / "g/groups.jsonl", [dumped(GROUP_LINE)])
    assert jsonlines.read_lines(spark, str(tmp_path / "g"), jsonlines.GROUP_MODEL, GROUP).select(jsonlines.group_line()).first()[0] == dumped(GROUP_LINE)


def test_every_kind_of_question_fits_its_model(spark):
    lines = bank(spark, SF).select(F.lit("f").alias("file"), F.lit(1).alias("line_no"), jsonlines.question_line(F.col("interaction")).alias("line"))
    found = jsonlines.check_lines(lines, jsonlines.QUESTION_MODEL)
    assert found.where("size(problems) > 0").isEmpty() and found.count() == bank(spark, SF).count()


def test_models(spark):
    option = {"id": "a", "label": None, "content": [{"kind": "text", "text": "x", "surprise": 1}]}
    got = problems(
        spark, changed(surprise=1, stem=[{"kind": "text", "text": "x", "more": {}}]), changed(source={"ordinal": 0, "pages": [1.5, "2"]}), changed(type="unheard", id=5), dumped({k: v for k, v in LINE.items() if k not in ("stem", "explanation")}),
        changed(interaction={"kind": "choice", "options": [option], "correct_option_ids": None}), changed(interaction={"kind": "none"}), changed(interaction={"kind": "ordering", "items": [], "correct_order": [], "options": []}), changed(group_id=7, explanation=None),
    )
    assert got == [
        ["surprise: unknown key", "stem[0].more: unknown key"], ["source.ordinal: must be a whole number of 1 or more", "source.pages[0]: must be a whole number", "source.pages[1]: must be a whole number"],
        ["id: must be a string", "type: must be one of " + ", ".join(jsonlines.QUESTION_TYPES)], ["stem: missing"],
        ["interaction.options[0].content[0].surprise: unknown key", "interaction.correct_option_ids: must be a list"], ["interaction.kind: must be one of choice, ordering, matching, drag_and_drop, fill_in_blank"],
        ["interaction.options: unknown key"], ["group_id: must be a string", "explanation: must be a list"],
    ]
    asset = {"id": "a", "kind": "embedded", "media_type": "image/png", "filename": "a.png", "origin": {"page": 1, "bbox": [0, 1.5, 2, 3]}, "sha256": ""}
    assert problems(spark, dumped(asset), changed(asset, origin={"page": 1, "bbox": None}), changed(asset, origin={"page": 1, "bbox": ["x"]}, kind="other"), model=jsonlines.ASSET_MODEL) == [
        [], [], ["kind: must be one of embedded, page_crop", "origin.bbox[0]: must be a number"],
    ]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_numbers_through_blocks(spark, tmp_path, end):
    """Files of many blocks: numbers are those of each file, blank lines counted."""
    lines = {f"f{k}.jsonl": [f"{k}-{i}" * (i % 7) for i in range(4000)] for k in range(3)}
    for name, rows in lines.items():
        write(tmp_path / name, rows, end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for limit in (100_000, 0):
            found = jsonlines.numbered_lines(spark, str(tmp_path), limit)
            got = {(r.file.rsplit("/", 1)[-1], r.line_no): r.line for r in found.collect()}
            assert found.rdd.getNumPartitions() >= 4 and got == {(name, i): x for name, rows in lines.items() for i, x in enumerate(rows, 1)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_bad_line_stops_the_read_or_is_listed(spark, tmp_path):
    write(tmp_path / "b/one.jsonl", [dumped(GROUP_LINE), "", dumped(GROUP_LINE)])
    write(tmp_path / "b/two.jsonl", [dumped(GROUP_LINE), "  ", changed(GROUP_LINE, surprise=1, title=2), "{"])
    with pytest.raises(BundleError, match=r"^two\.jsonl:3: surprise: unknown key; title: must be a string$"):
        jsonlines.read_lines(spark, str(tmp_path / "b"), jsonlines.GROUP_MODEL, GROUP)
    rows = jsonlines.read_lines(spark, str(tmp_path / "b"), jsonlines.GROUP_MODEL, GROUP, flag=True)
    assert [(r.file[-9:], r.line_no, r.id, r.problems) for r in rows.orderBy("file", "line_no").collect()] == [
        ("one.jsonl", 1, "g1", []), ("one.jsonl", 3, "g1", []), ("two.jsonl", 1, "g1", []), ("two.jsonl", 3, None, ["surprise: unknown key", "title: must be a string"]), ("two.jsonl", 4, None, ["line: is not JSON"]),
    ]


def tables(spark):
    write_order = bank(spark, SF).repartition(7)
    groups = spark.createDataFrame([("r", 1, "g1", "scenario", None, [], ["q1"])], GROUP)
    assets = spark.createDataFrame([("r", 1, "a1", "embedded", "image/png", "a1.png", (2, None), "ab")], ASSET)
    return write_order, groups, assets, spark.createDataFrame([(1, "x")], "n int, status string")


SOURCE = {"format": "json", "filename": "bank.json", "sha256": "ab", "size_bytes": 12, "page_count": None}


def test_bundle_in_source_order_with_manifest(spark, tmp_path):
    path = str(tmp_path / "bundle")
    questions, groups, assets, report = tables(spark)
    made = jsonlines.write_bundle(path, questions, groups, assets, report, SOURCE, "1", "2026-01-01T00:00:00Z")
    n = questions.count()
    assert made == json.loads(next((tmp_path / "bundle/manifest").glob("part-*")).read_text()) == {
        "bundle_format_version": "1.0", "importer_version": "1", "created_at": "2026-01-01T00:00:00Z", "source": SOURCE, "question_count": n, "group_count": 1, "asset_count": 1,
    }
    got = [json.loads(x) for f in sorted((tmp_path / "bundle/questions").glob("part-*")) for x in f.read_text().splitlines()]
    want = [json.loads(r[0]) for r in bank(spark, SF).orderBy("run_id", "item_seq").select(jsonlines.question_line(F.col("interaction"))).collect()]
    assert got == want and all("rows" not in b for q in got for b in q["explanation"])
    (asset,) = jsonlines.read_lines(spark, f"{path}/assets", jsonlines.ASSET_MODEL, ASSET).collect()
    assert (asset.id, asset.origin.page, asset.origin.bbox) == ("a1", 2, None)
    with pytest.raises(BundleError, match="not empty"):
        jsonlines.write_bundle(path, questions, groups, assets, report, SOURCE, "1", "")


def test_bundles_that_are_not_written(spark, tmp_path):
    questions, groups, assets, report = tables(spark)
    with pytest.raises(BundleError, match="duplicate asset id 'a1'"):
        jsonlines.write_bundle(str(tmp_path / "a"), questions, groups, assets.union(assets), report, SOURCE, "1", "")
    assert not (tmp_path / "a").exists()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        jsonlines.write_bundle(str(tmp_path / "b"), questions, groups.withColumn("item_seq", F.expr("1 div (item_seq - 1)").cast("int")), assets, report, SOURCE, "1", "")
    assert not (tmp_path / "b/manifest").exists()


def test_stored_files(spark):
    stored = spark.createDataFrame([("r", "a.v1.png"), ("r", "a.png"), ("r", "b"), ("s", "c.png"), ("r", "ab.png"), ("r", "b.png")], "run_id string, filename string")
    wanted = spark.createDataFrame([("r", x) for x in ("a", "a.v1", "b", "b.png", "c", "a.", "ab.png")], "run_id string, name string")
    assert {r.name: r.filename for r in jsonlines.find_stored(wanted, stored).collect()} == {"a": "a.png", "a.v1": "a.v1.png", "b": "b", "b.png": "b.png", "c": None, "a.": None, "ab.png": "ab.png"}
    made = spark.createDataFrame([("x/y.png",), ("..\\..\\evil.bin",), ("../assets2/x",), ("/b/assets",)], "f string").select(jsonlines.asset_path(F.lit("/b/assets"), F.col("f")))
    assert [r[0] for r in made.collect()] == ["/b/assets/x/y.png", None, None, None]
