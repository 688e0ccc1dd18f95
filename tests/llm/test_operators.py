"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward input."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quizmill.llm import decontaminate, language, licences, near_dup, neighbours, packing, quality, registry, shards, suffix_dedup, toxicity
from quizmill.llm.bytesets import mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHING = ("token", "n", "score", "kept", "gram", "label", "shard", "words", "length", "at")


def table(spark, texts, schema="doc_id long, text string"):
    df = spark.createDataFrame(texts, schema)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [words(rnd, rnd.choice([3, 8, 40, 120, 300])) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 90):  # near copies of growing distance, and exact ones
        t = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 2, 4, 8])):
            t[rnd.randrange(len(t))] = "changed"
        out.append((i, " ".join(t)))
    common = words(rnd, 60)
    out += [(90 + i, f"{words(rnd, 30)}\n{common}\n{words(rnd, 30)}") for i in range(12)]
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "ONE TWO"), (205, words(rnd, 30000)), (206, "ab " * 3000), (207, "ab " * 3000), (208, "é" * 500)]
    return [*out, out[0], out[50], (200, None)]


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("limits", [(10**6, 2048), (0, 3)])
def test_near_duplicates(spark, texts, limits, monkeypatch):
    if limits[1] == 3:
        monkeypatch.setattr(near_dup, "HOT_LEAST", 2)
    got = near_dup.near_duplicates(table(spark, texts), broadcast_rows=limits[0], block=limits[1]).collect()
    want = brute_components(texts)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_rtree_loses_no_pair():
    rnd = np.random.default_rng(3)
    centre = rnd.poisson(2, 128)
    points = np.maximum(0, centre + rnd.integers(-1, 2, (300, 128))).astype(np.float64)
    sizes = points.sum(axis=1)
    tree = near_dup.RTree(points, sizes)
    for i in range(0, 300, 17):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(axis=1) >= near_dup.needed(sizes, sizes[i]))
        assert sorted(tree.search(points[i], sizes[i])) == want.tolist()


@pytest.mark.parametrize("n", [1, 31, 40, 127, 129, 1000, 1025, 9000, 40000])
def test_count_vectors_bound_overlaps(n):
    """Minima of count vectors are never below the overlap, also of vectors added up, and tell unrelated sets apart."""
    rnd = np.random.default_rng(n)
    one, two = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    mixed = np.concatenate([one[: n - n // 10], two[: n // 4]])
    groups = int(min(near_dup.groups_of(np.array([len(one), len(mixed)]))))
    a, b, c = (near_dup.vectors(pa.array([near_dup.count_vector(x)], pa.binary()), groups)[0] for x in (one, two, mixed))
    assert np.minimum(a, c).sum() >= n - n // 10
    assert a.sum() >= n and (n < 100 or np.minimum(a, b).sum() < near_dup.needed(n, n))
    assert max(near_dup.groups_of(np.arange(1, 30000) * 4 // 3) / near_dup.groups_of(np.arange(1, 30000))) <= 2


def test_a_family_of_unlinked_texts_makes_few_candidates(spark, monkeypatch):
    """400 texts of which each shares three fifths of its words with all others: no links, and hardly a pair goes on."""
    rnd = random.Random(12)
    template = words(rnd, 120, 10**6)
    rows = [(i, f"{template} {words(rnd, 80, 10**6)}") for i in range(400)] + [(1000, f"{template} a b c"), (1001, f"{template} d e f")]
    seen = []
    verify = near_dup._verify
    monkeypatch.setattr(near_dup, "_verify", lambda shelf, docs, pairs, limit: (seen.append(pairs.count()), verify(shelf, docs, pairs, limit))[1])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows} | {1001: 1000}
    assert sum(seen) < 3 * len(rows)


def brute_removed(texts, length):
    rows = [(t or "").encode() for _, t in texts]
    uses = Counter(b[k : k + length] for b in rows for k in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if uses[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_suffix_dedup(spark, texts, limit):
    rnd = random.Random(9)
    some = [*texts] + [(300 + i, rnd.choice(["q" * 400, "rs" * 300, "xyz " * 60, "z" * 199, "z" * 200]) + rnd.choice(["", "tail", "é"])) for i in range(30)]
    got = suffix_dedup.remove_repeats(table(spark, some), group_limit=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *x) for (i, _), x in zip(some, brute_removed(some, 200), strict=True))


@pytest.mark.parametrize("limit", [20_000, 1])
def test_suffix_dedup_tells_rows_apart(spark, limit):
    """Rows without an id and rows of one id: each is judged by its own text, and is a repeat of the others."""
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(690))
    rows = [(1, long), (None, long), (None, "x" + long[:250]), (7, "fifteen letters"), (7, long), (7, long), (None, None), (None, "short")]
    got = suffix_dedup.remove_repeats(table(spark, rows), group_limit=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *x) for (i, _), x in zip(rows, brute_removed(rows, 200), strict=True))
    assert {r.n_removed for r in got if r.n_bytes in (690, 15)} == {690, 0}


def test_items_without_an_id(spark):
    """Their windows hit words like any other's; they are not among the items."""
    item = " ".join(f"w{i}" for i in range(10))
    docs = table(spark, [(1, f"x {item} y"), (2, "w1 w2"), (None, f"{item} {item}"), (3, "a b c")])
    found = decontaminate.contamination(docs, table(spark, [(None, item), (None, item), ("k", "b c")], "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found} == {1: (12, 10, [], True), 2: (2, 0, [], False), None: (20, 20, [], True), 3: (3, 2, ["k"], True)}


def test_decontamination(spark, texts):
    bench = [(1, " ".join(texts[3][1].split()[5:30])), (2, "One two"), (3, None), (4, ""), (5, texts[10][1]), (5, texts[10][1]), (6, "changed"), (7, "Ünïcode WORDS " + words(random.Random(1), 12))]
    docs = [*texts, (400, "x " + bench[7 - 0][1].replace(" ", "--") + " y")]
    for limit in (10**6, 0):
        got = decontaminate.contamination(table(spark, docs), table(spark, bench, "item_id long, text string"), broadcast_rows=limit).collect()
        pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        windows = {}
        for i, t in bench:
            w = pattern.findall((t or "").encode().lower())
            n = min(10, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
        want = {}
        for i, t in docs:
            w = pattern.findall((t or "").encode().lower())
            hit, items = set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if found := windows.get(tuple(w[k : k + n])):
                        hit |= set(range(k, k + n))
                        items |= found
            want[i] = (len(w), len(hit), sorted(items), bool(hit))
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == want
        assert len(got) == len(want)
    plan = registry.op9_benchmark_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_the_tokenizers():
    odd = ["", "It's 12,3 don't 'sfoo ,'s x", "é,É—,“q” áb 9٣ \x1cqa\x7fb <|endoftext|> ÷× ×a", "naïve-café… x\u0085y ①2", "ﬁ İ Ǆ ßẞ", "​zero﻿", "a" * 300 + "!" * 50 + "1" * 20, "tab\tnew\nline\r\x0b\x0c end", "日本語 русский"]
    ids = packing.WordIds(tokenizer_path())
    got, bounds = ids.encode(pa.array(odd))
    for i, text in enumerate(odd):
        assert got[bounds[i] : bounds[i + 1]].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    texts = ["hi <|endoftext|> x", "a<|endoftext|>b, C<|startoftext|>D!<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>x", "é<|endoftext|>É it's", "<|endoftext|", "|> plain <|endoftext|>", "<|end oftext|> 12<|endoftext|>34"]
    fresh, ids = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    for _ in range(2):  # new and remembered
        got, bounds = ids.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert got[bounds[i] : bounds[i + 1]].tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert 49407 in got


def test_packing(spark, texts):
    capacity = 64
    rows = packing.pack(table(spark, texts), tokenizer_path(), capacity=capacity, with_ids=True).toPandas()
    ids = packing.WordIds(tokenizer_path())
    want = Counter()
    for i, t in texts:
        whole = [*ids.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(whole), capacity)):
            part = np.array(whole[s : s + capacity], "<u4").tobytes()
            want[i, p, s, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter(rows[["doc_id", "piece", "start", "length", "ids_crc32", "ids"]].itertuples(index=False, name=None)) == want
    bins = []
    for length in sorted(rows.length, reverse=True):
        fits = [b for b in bins if b[0] >= length]
        best = min(fits) if fits else [capacity]
        if not fits:
            bins.append(best)
        best[0] -= length
    assert rows.sequence_id.nunique() == len(bins)
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == (group.length.cumsum() - group.length).tolist()
        assert group.length.sum() <= capacity


def test_shards(spark, texts):
    some = [(i, t) for i, t in texts] + [(1000 + i, "x") for i in range(3000)]
    rows = shards.assign_shards(table(spark, some), [1.0, 2.0, 1.0]).toPandas()
    assert len(rows) == len(some)
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    share = rows[rows.doc_id >= 1000].groupby("shard").size() / 3000
    assert abs(share[1] - 0.5) < 0.05
    assert ((rows.grown_shard == rows["shard"]) | (rows.grown_shard == 3)).all()
    by_text = {i: t or "" for i, t in some}
    assert all(r.text_crc32 == zlib.crc32(by_text[r.doc_id].encode()) and r["size"] == len(by_text[r.doc_id].encode()) + 16 for _, r in rows.iterrows())


def test_licences(spark):
    mit = licences.KNOWN["MIT"][3]
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,")), (2, "text\nReleased under the MIT Licence!\nmore"), (3, None), (4, ""), (5, mit[:-20]), (2, "text\nReleased under the MIT Licence!\nmore")]
    got = {r.doc_id: (r.licence, r.line_licences) for r in licences.scan_licences(table(spark, rows)).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "MIT"), 3: (None, ""), 4: (None, ""), 5: (None, "")}


def test_whole_licences_in_their_usual_forms(spark):
    mit, isc = licences.KNOWN["MIT"][3].removeprefix("The MIT License "), licences.KNOWN["ISC"][1]
    isc_wrapped = isc.replace("above copyright notice", "above\ncopyright notice").replace("WITH REGARD", "\nWITH REGARD")
    mit_wrapped = mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    full = {name: (licences.TEXTS / f"{name}.txt").read_text() for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "CC0-1.0", "Zlib", "Unlicense")}
    rows = [
        ("MIT", "MIT License\n\nCopyright (c) 2021 A. Author\n\n" + mit_wrapped),
        ("MIT", "Copyright A. Author\n\n" + mit_wrapped),
        ("ISC", "Copyright (c) 2019, A. Author <a@example.org>\n\n" + isc_wrapped),
        ("ISC", "ISC License\n\n© 2019 A. Author\nAll rights reserved.\n\n" + isc_wrapped),
        *full.items(),
        ("Apache-2.0", full["Apache-2.0"].split("APPENDIX")[0].replace("http:", "https:")),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + full["BSD-3-Clause"].replace("the University", "Example, Inc.").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("REGENTS", "COPYRIGHT HOLDERS")),
        (None, full["BSD-2-Clause"] + " and more"), (None, isc_wrapped.replace("any purpose", "no purpose")), (None, "MIT License"), (None, "Copyright 2020 A. Author"),
    ]
    got = {r.doc_id: r.licence for r in licences.scan_licences(table(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_licence_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(registry.oracle_sql()["op8_license_scan"]).fetchall()
    got = registry.op8_license_scan(spark, "/root/testdata/sf0.001").select("doc_id", "digest", "licence", "line_licences").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_licence_query_and_its_sql_on_whole_licences(spark):
    """Query and SQL agree on whole licences in many forms, on rows that share an id, and on texts near to a licence."""
    import duckdb

    full, rnd = licences.full_texts(), random.Random(3)
    texts = [t for _, t in full] + [t for known in licences.KNOWN.values() for t in known]
    forms = [
        lambda t: "Copyright (c) 2020 Someone\n\n" + t, lambda t: "Copyright Someone\nAll rights reserved.\n" + t, lambda t: t.upper(), lambda t: "MIT License\n\n" + t,
        lambda t: t.replace("license", "licence").replace("the copyright holders", "the copyright owners"), lambda t: t.replace("http:", "https:").replace("1. ", "* "), lambda t: t + " and more",
        lambda t: t.replace(" ", "\n", 40), lambda t: t[: len(t) // 2], lambda t: "copyright notice\n" + t, lambda t: t.replace("the University", "Example, Inc.").replace("REGENTS", "COPYRIGHT HOLDERS"),
        lambda t: "some prose\n" + t + "\nmore prose", lambda t: "# " + t.replace("\n", "\n# "),
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, rnd.choice(forms)(rnd.choice(forms)(t))) for i, t in enumerate(texts * 3)]
    rows += [(1, "other text"), (1, "SPDX-License-Identifier: MIT"), (None, texts[0]), (None, None), (2000, ""), (2001, "https https https")]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = licences.scan_licences(table(spark, rows)).select("doc_id", "digest", "licence", "line_licences").collect()
    want = con.sql("select doc_id, digest, licence, line_licences from (" + registry.oracle_sql()["op8_license_scan"] + ")").fetchall()
    assert Counter(map(tuple, got)) == Counter(want)
    named = {r.doc_id: r.licence for r in got if r.doc_id is not None and 1 < r.doc_id < len(full)}
    assert named == {i: name for i, (name, _) in enumerate(full) if i > 1} and sum(r.licence is not None for r in got) > 60


def test_possible_licences_lose_none(spark):
    """The words that a text must hold never rule out a text whose form is known."""
    spelt = ["Licenced under the Apache Licence, Version 2.0.", "SPDX-Licence-Identifier: MIT", "LICENSED UNDER CC BY 4.0!", "nothing of the kind", ""]
    known = [t for group in licences.KNOWN.values() for t in group]
    docs = spark.createDataFrame([(t,) for t in spelt + known], "text string").select("text", F.lower("text").alias("low"), licences.canonical(F.col("text")).alias("form"))
    forms = [r.form for r in docs.collect()[len(spelt) :]]
    got = docs.select("text", licences.possible(F.col("low"), forms).alias("told"), F.col("form").isin(forms).alias("listed")).collect()
    assert all(r.told for r in got if r.listed) and not any(r.told for r in got if r.text in spelt[3:])
    assert sum(r.listed for r in got) == len(known) + 3


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    points = rnd.standard_normal((900, 16))
    points[300:350] = points[7]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (2080, [1.0] * 3)]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=200, group=16).toPandas()
    assert set(got.query_id) == set(range(0, 900, 20))
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert g[["score", "vec_id"]].values.tolist() == sorted(g[["score", "vec_id"]].values.tolist(), key=lambda x: (-x[0], x[1]))
        score = points @ points[q]
        assert np.allclose(score[g.vec_id], g.score, rtol=1e-12)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(900), -score))[:20]) & set(g.vec_id))
    assert hits / (20 * 45) >= 0.9


def exact_share(got, points, queries, k):
    hits = 0
    for q in queries:
        score = points @ points[q]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(points)), -score))[:k]) & set(got[got.query_id == q].vec_id))
    return hits / (k * len(queries))


@pytest.mark.parametrize("norms", ["outlier", "lognormal"])
def test_neighbours_of_uneven_norms(spark, norms):
    rnd = np.random.default_rng(6)
    points = rnd.standard_normal((3000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    if norms == "outlier":
        points[11] *= 100
    else:
        points *= rnd.lognormal(0, 1, (3000, 1))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=1000, group=64).toPandas()
    assert set(got.groupby("query_id").size()) == {20} and got.query_id.nunique() == 150
    assert exact_share(got, points, range(0, 3000, 20), 20) >= 0.95


def test_short_queries_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "fit_reach", lambda ids, sample, tops, k: np.full(len(tops), -1.0))  # visits nothing
    points = np.random.default_rng(7).standard_normal((300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=100, group=8).toPandas()
    assert exact_share(got, points, range(0, 300, 20), 20) == 1


def test_few_or_no_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.nearest(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_language_held_out(spark):
    rows = registry.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()
    odd = table(spark, [(1, None), (2, ""), (3, "12 ## 3"), (4, "a"), (5, "日本")])
    model = (["de", "en"], np.zeros((2, language.BUCKETS), np.float32), np.log([0.5, 0.5]))
    assert [r.lang_pred for r in language.predict_languages(odd, model).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in language.predict_languages(odd, ([], np.zeros((0, language.BUCKETS)), np.zeros(0))).collect()} == {"und"}


def test_language_model_counts(spark):
    df = spark.createDataFrame([(1, "aba", "x"), (2, "b  b", "y"), (3, None, "y"), (4, "z", None)], "doc_id long, text string, lang string")
    langs, matrix, prior = language.fit_languages(df)
    assert langs == ["x", "y"] and np.allclose(np.exp(prior), 0.5)
    grams = np.concatenate([g for g, _ in language.gram_buckets(pa.array(["aba"]))])
    counts = np.bincount(grams, minlength=language.BUCKETS) + 0.5
    assert np.allclose(matrix[0], np.log(counts / counts.sum()), atol=1e-4)


def test_toxicity_held_out(spark):
    rows = registry.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert held[held.predicted == 1].toxic.mean() > 0.9 and held[held.toxic == 1].predicted.mean() > 0.85
    assert rows.score.between(0, 1).all()


def test_marginals_are_those_of_all_labellings():
    rnd = np.random.default_rng(2)
    emit, trans, gap = rnd.standard_normal(6), rnd.standard_normal((6, 2, 2)), rnd.integers(0, 6, 6)
    row = np.array([0, 0, 0, 2, 2, 3])
    got, _, total = toxicity.marginals(emit, trans, gap, row, 5)
    weight = {}
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        weight[code] = np.exp(sum(e * v for e, v in zip(emit, y, strict=True)) + sum(trans[gap[i], y[i - 1], y[i]] for i in range(1, 6) if row[i] == row[i - 1]))
    z = sum(weight.values())
    want = [sum(w for code, w in weight.items() if (code >> i) & 1) / z for i in range(6)]
    assert np.allclose(got, want) and np.isclose(total, np.log(z))


def test_toxicity_spans_and_empty_labels(spark):
    docs = table(spark, [(1, "you are scum, scum"), (2, None), (3, "")])
    model = {"lexicon": np.sort(toxicity._words(pa.array(["scum"]))[0]), "weight": np.array([5.0, 0.0]), "trans": np.zeros((6, 2, 2)), "scale": np.array([-3.0, 3.0, 3.0, 0.0])}
    got = {r.doc_id: r for r in toxicity.tag_toxicity(docs, model).collect()}
    assert [(s.start, s.stop) for s in got[1].spans] == [(8, 12), (14, 18)] and got[1].score > 0.9 and got[2].score == got[3].score
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.tag_toxicity(docs, toxicity.fit_toxicity(docs, none)).count() == 3


def test_quality(spark):
    rnd = random.Random(4)
    docs = [(i, words(rnd, 60, 50)) for i in range(200)] + [(200 + i, " | ".join(f"#{rnd.randrange(9)}$" for _ in range(60))) for i in range(40)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 240, 3)] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.resample(table(spark, docs), labels).toPandas().set_index("doc_id").sort_index()
    assert rows.kept.loc[0:199].all() and not rows.kept.loc[200:239].any()
    rows = quality.resample(table(spark, docs), labels, keep=17).toPandas()
    best = rows.sort_values("key", ascending=False).head(17)
    assert set(rows[rows.kept].doc_id) == set(best.doc_id)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(table(spark, docs), none).where("kept").count() == len(docs)


def test_word_repeats_stop_at_the_start_of_a_text():
    def patterns(texts):
        (buckets, bounds), = list(quality._families(pa.array(texts)))[1]
        return [(buckets[a:b] - quality.BUCKETS).tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    assert patterns(["a b c"]) == [[0, 0, 0]] and patterns(["x x x y x x x x x"]) == [[0, 8, 12, 6, 3, 9, 12, 14, 15]]
    for texts in (["x x x x x", "a b c d"], ["x x", "a", "", "x x x", "a a b"]):
        assert patterns(texts) == [patterns([t])[0] for t in texts]
    assert patterns([""]) == [[]] and patterns(["a"]) == [[0]]


def test_kth_largest(spark):
    rnd = random.Random(8)
    values = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(1e6, 1), 3.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert quality.kth_largest(df, "v", k, bins=8, small=16) == sorted(values, reverse=True)[k - 1]


def test_empty_tables(spark):
    docs = table(spark, [])
    assert near_dup.near_duplicates(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert decontaminate.contamination(docs, table(spark, [], "item_id long, text string")).count() == 0
    assert decontaminate.contamination(table(spark, [(1, "a b")]), table(spark, [], "item_id long, text string")).collect()[0].n_words == 2
    assert packing.pack(docs, tokenizer_path()).count() == 0
    assert shards.assign_shards(docs, [1.0, 1.0]).count() == 0
    assert licences.scan_licences(docs).count() == 0
    assert quality.resample(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert language.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))[0] == []


def test_null_ids(spark):
    docs = table(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (None, None)])
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == {(None, None), (1, 1)}
    assert suffix_dedup.remove_repeats(docs).count() == 3
    assert packing.pack(docs, tokenizer_path()).count() == 3
    assert shards.assign_shards(docs, [1.0, 1.0]).count() == 3
    found = decontaminate.contamination(docs, table(spark, [("x1", "a b"), (None, "a b")], "item_id string, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in found) == [(0, 0, 0, []), (0, 6, 2, ["x1"]), (1, 6, 2, ["x1"])]


def test_one_id_with_two_texts_is_searched_row_by_row(spark):
    docs = table(spark, [(1, "a b x"), (1, "c a d"), (1, "a b x")])
    found = decontaminate.contamination(docs, table(spark, [(7, "a b")], "item_id long, text string")).collect()
    assert sorted((r.n_words, r.n_hit) for r in found) == [(3, 0), (3, 2)]


def test_shards_are_those_of_an_independent_draw(spark):
    def draw(key, j, start=42):
        """The hash of key, then shard, each the seed of the next; a null key leaves the seed."""
        if key is not None:
            start = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=start)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", j), seed=start) >> 12) + 0.5) / (1 << 52)
        return -1 / math.log(u), j

    ids = [None, 0, -1, 2**62, *range(1, 400)]
    rows = shards.assign_shards(table(spark, [(i, "x") for i in ids]), [1.0] * 40).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {i: tuple(max(draw(i, j) for j in range(n))[1] for n in (40, 41)) for i in ids}


def test_language_scores_are_those_of_counts_by_hand(spark):
    """Grams and posteriors from strings, with none of the operator's code but its hash of a gram into a bucket."""

    def grams(text):
        marked = re.sub(r"[^a-z\x80-\xff]+", " ", f" {text} ".encode().lower().decode("latin1")).encode("latin1")
        for k in language.ORDERS:
            for i in range(len(marked) - k + 1):
                h = k
                for b in marked[i : i + k]:
                    h = (h * 257 + b) % (1 << 64)
                yield int(mix(np.array([h], np.uint64))[0]) % language.BUCKETS

    learn = [("xx", "The cat, 12 sat"), ("xx", "the Mat"), ("yy", "le chat été"), ("yy", "la natte"), ("zz", "der Hund"), ("xx", None), (None, "der der")]
    ask = ["the hat", "été là", "Der 9 hunde", "chat", "the cat sat " * 30000, "12 !", "", None, "chat"]
    counts = {x: Counter(g for lang, t in learn if lang == x and t for g in grams(t)) for x in ("xx", "yy", "zz")}
    texts = {x: sum(lang == x and t is not None for lang, t in learn) for x in counts}
    model = language.fit_languages(table(spark, [(i, t, x) for i, (x, t) in enumerate(learn)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.predict_languages(table(spark, list(enumerate(ask))), model).collect()}
    for i, text in enumerate(ask):
        if not re.search(r"[a-zé]", text or "", re.I):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        seen = Counter(grams(text))
        logs = {x: math.log((texts[x] + 1) / (sum(texts.values()) + 3)) + sum(n * math.log((c[g] + 0.5) / (c.total() + 0.5 * language.BUCKETS)) for g, n in seen.items()) for x, c in counts.items()}
        best = max(logs, key=logs.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)
    tied = language.fit_languages(table(spark, [(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string"))
    assert language.predict_languages(table(spark, [(1, "same"), (1, "same")]), tied).select("lang_pred").collect() == [("a",), ("a",)]
    assert language.predict_languages(table(spark, []), tied).count() == 0


def test_resampling_is_an_independent_gumbel_draw(spark):
    """Scores, noise and the k kept from strings, with none of the operator's code but its hash of a gram into a bucket."""

    def families(text):
        low, said = text.encode().lower(), text.lower().split()
        hashed = []
        for k in quality.ORDERS:
            for i in range(len(low) - k + 1):
                h = k
                for b in low[i : i + k]:
                    h = (h * 257 + b) % (1 << 64)
                hashed.append(int(mix(np.array([h], np.uint64))[0]) % quality.BUCKETS)
        again = [i > 0 and said[i] == said[i - 1] for i in range(len(said))]
        return hashed, [sum(again[i - j] << (3 - j) for j in range(4) if i >= j) for i in range(len(said))]

    rnd = random.Random(2)
    docs = {i: " ".join(rnd.choice("aa bb Cc dd aa".split()) for _ in range(rnd.choice([0, 1, 3, 9]))) for i in range(60)}
    good = {i: int(i % 3 == 0) for i in range(0, 60, 2)}
    score = dict.fromkeys(docs, 0.0)
    for f, size in ((0, quality.BUCKETS), (1, quality.REPEATS)):
        grams = {i: families(t)[f] for i, t in docs.items()}
        raw, target = (Counter(g for i in some for g in grams[i]) for some in (docs, [i for i in good if good[i]]))
        ratio = lambda g, r=raw, t=target, s=size: math.log((t[g] + 0.5) / (t.total() + 0.5 * s)) - math.log((r[g] + 0.5) / (r.total() + 0.5 * s))
        for i, found in grams.items():
            score[i] += sum(map(ratio, found)) / max(len(found), 1)
    noise = {i: -math.log(-math.log(((xxhash.xxh64_intdigest(struct.pack("<i", 17), seed=xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)) >> 12) + 0.5) / (1 << 52))) for i in docs}
    key = {i: 2.0 * score[i] + noise[i] for i in docs}
    rows = quality.resample(table(spark, list(docs.items())), spark.createDataFrame(list(good.items()), "doc_id long, quality int"), keep=20, sharpness=2.0).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx(score, abs=1e-9) and {r.doc_id: r.key for r in rows} == pytest.approx(key, abs=1e-9)
    assert {r.doc_id for r in rows if r.kept} == set(sorted(key, key=key.get)[-20:])


def test_resampling_keeps_equal_keys_together(spark):
    docs = table(spark, [(1, "aa bb"), (1, "aa bb"), (2, "aa bb"), (3, "long words " * 40000)])
    labels = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    rows = quality.resample(docs, labels, keep=1).collect()
    assert len(rows) == 4 and len({(r.key, r.kept) for r in rows if r.doc_id == 1}) == 1


def test_toxicity_on_awkward_rows(spark):
    learn = table(spark, [(i, f"you are a {'vile brute' if i % 2 else 'kind friend'} w{i % 7}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(learn, labels)
    docs = table(spark, [(1, None), (2, ""), (3, "so vile brute"), (3, "so vile brute"), (None, "kind friend"), (5, "kind friend " * 40000 + "vile brute")])
    rows = toxicity.tag_toxicity(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert toxicity.tag_toxicity(table(spark, []), model).count() == 0
