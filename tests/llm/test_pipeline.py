"""The pipeline's stages against brute force on a small table."""

import re

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [("documents", docs)]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append((name, docs))
    return found


def rows(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_columns_and_order(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == COLUMNS for _, df in stages[:-1])


def test_quality_keeps_labelled_good_texts(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows(stages[0][1]), rows(stages[1][1])
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.98 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad)


def test_one_of_each_group(stages):
    from .test_operators import brute_components

    before, after = rows(stages[1][1]), rows(stages[2][1])
    assert set(after) == {i for i, (_, c) in brute_components(list(before.items())).items() if c == i}


def test_repeats_go(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    from .test_operators import brute_removed

    want = brute_removed(list(before.items()), 200)
    assert set(before) == set(after)
    for i, (size, gone, _, _) in zip(before, want, strict=True):
        if not gone:
            assert after[i] == before[i]
        else:
            assert len(after[i].encode()) <= size - gone + 12


def test_contaminated_texts_go(spark, stages):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").encode().lower())
    windows = {tuple(w[k : k + 10]) for w in (words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) for k in range(max(1, len(w) - 9))}
    before, after = rows(stages[3][1]), rows(stages[4][1])
    clean = {i for i, t in before.items() if not any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t))))}
    assert set(after) == clean


def test_all_that_is_left_is_packed(spark, stages):
    assert {r.doc_id for r in stages[5][1].select("doc_id").collect()} == set(rows(stages[4][1]))
    assert corpus_pipeline.run(spark, SF).count() == stages[5][1].count()


AWKWARD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (3, "a different text"), (4, "some words " * 30000), (5, "e\u00e9" * 300), (6, "e\u00e9" * 300), (None, "one two"), (None, None)]


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["awkward", "empty"])
def test_stages_on_awkward_tables(spark, tmp_path, rows):
    """Nulls in every column, empty and long texts, repeated rows, one id with two texts, clashing names; no rows at all."""
    kind = "doc_id long, text string, lang string, kept boolean, n long, carried string, spans string, row string, hit boolean, words int"
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, t in rows], kind)
    for name, columns in (("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([] if not rows else [(1, 1) if name == "labels" else (1, "one two"), (None, None)], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    assert all(df.columns == docs.columns for df in list(out.values())[:-1])
    got = {name: sorted((r.doc_id or 0, r.text or "") for r in df.collect()) for name, df in list(out.items())[:-1]}
    ids = {name: [i for i, _ in some] for name, some in got.items()}
    if not rows:
        assert not any(got.values()) and out["best-fit packing"].count() == 0
        return
    assert set(ids["quality classifier"]) <= {1, 2, 3, 4, 5, 6}
    assert ids["n-gram Jaccard join"] == [1, 2, 3, 4, 5] and (3, "a different text") in got["n-gram Jaccard join"]
    assert ids["suffix-array dedup"] == sorted(i or 0 for i, _ in rows) and {t for i, t in got["suffix-array dedup"] if i in (5, 6)} == {""}
    assert ids["benchmark decontamination"] == [0, 0, 1, 2, 4, 5, 6]
    assert {r.doc_id for r in out["best-fit packing"].collect()} == {i for i, _ in rows}
