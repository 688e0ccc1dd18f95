"""Periodic runs, quality rules and tokenizer alignment against brute-force versions, and on awkward input."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quizmill.llm import alignment, periodic, registry, rules

CLASHING = ("words", "runs", "n_words", "m", "one", "links", "times", "row", "link", "start", "groups")
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    word = lambda n: f"w{rnd.randrange(n)}"
    out = [(i, " ".join(word(rnd.choice([2, 30, 400])) for _ in range(rnd.choice([1, 4, 9, 60, 250])))) for i in range(60)]
    for i in range(60, 90):  # periodic stretches inside prose, some next to one another
        text = [word(500) for _ in range(40)]
        for _ in range(rnd.choice([1, 2, 3])):
            unit = [word(3) for _ in range(rnd.randrange(1, 9))]
            at = rnd.randrange(len(text))
            text[at:at] = (unit * 9)[: len(unit) * rnd.randrange(3, 8) + rnd.randrange(len(unit))]
        out.append((i, " ".join(text)))
    out += [(100, None), (101, ""), (102, " \t\n\x0b\r "), (103, "one two"), (104, "a " * 6), (105, "a " * 5), (106, "ab\n" * 12), (107, "x y z\n\nx y z\n x y z\n"), (108, "é ü　中文   ß İ ſ K 😀 " * 3)]
    out += [(109, "".join(chr(c) for c in range(1, 128))), (110, "<|endoftext|> </s> <s> <unk> <0x41> x"), (111, "▁a b"), (112, "the of and #*$%&|<> " * 20), (113, "The THE the. of\t" * 30), (None, "no id at all " * 8), (114, "\x00 a \x1f b\x85c")]
    out += [(115, " ".join(word(40) for _ in range(5000))), (116, " ".join(word(2) for _ in range(1500))), (117, "same " * 20000), (118, " ".join(["x y"] * 40 + ["x y z"] * 40)), (119, "\n".join(["same line", "other line"] * 30))]
    out.append((120, "\n".join(f"the number{k} of all words{k * k} is" for k in range(20))))
    return [*out, out[3], out[70], (100, None), (3, "another text of the same id")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=6, exponent=4):
    """By the definition: each maximal stretch at each period, kept if no smaller period holds in it."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, text):
    w = words_of(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_periodic_runs(spark, rows):
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(table(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        runs = [(0, len(w), 1)] if i == 117 else brute_runs(w)
        want[i, len(w), tuple(runs), collapsed(w, runs)] += 1
    assert got == want


def test_op11_query(spark, rows, tmp_path):
    docs = [*rows, *((i, rows[i % 90][1]) for i in range(200, 320))]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in registry.op11_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in docs:
        w = brute_planted(i, t)
        runs = [(0, len(w), 1)] if i == 117 else brute_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[i, len(runs), *strongest, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs))] += 1
    assert got == want
    assert sum(x[1] > 0 for x in got if x[0] is not None and x[0] >= 200) > 10


def test_runs_of_random_words():
    """Small alphabets and stretches of one period beside another; also with every word frequent, and with every word rare."""
    rnd = random.Random(4)
    for _ in range(150):
        texts = [[rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.choice([0, 3, 17, 60, 130]))] for _ in range(4)]
        for w in texts:
            if len(w) > 20:
                q, at = rnd.randrange(1, 9), rnd.randrange(10)
                w[at + q :] = [w[at + k % q] for k in range(len(w) - at - q)][: len(w)]
        first = np.cumsum([0, *map(len, texts)])[:-1]
        assert periodic.find_runs(np.array([x for w in texts for x in w], np.int64), first) == [brute_runs(w) for w in texts]


@pytest.mark.parametrize("share", [1, 40, 4000])
def test_lag_counts(share):
    """Counts are exact where all words are frequent, some, and none."""
    rnd = np.random.default_rng(share)
    words = rnd.integers(0, share, 3000)
    first, longest = np.array([0, 0, 1000]), np.array([0, 250, 500])
    count, base = periodic.lag_counts(words, np.repeat([1, 2], [1000, 2000]), first, longest)
    for d, (a, b) in enumerate([(0, 0), (0, 1000), (1000, 3000)]):
        own = words[a:b]
        assert count[base[d] + 1 : base[d + 1]].tolist() == [(own[:-q] == own[q:]).sum() for q in range(1, longest[d] + 1)]


def brute_rules(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    stop = sum(any(x in (s, s.capitalize(), s.upper()) for s in rules.STOP_WORDS) for x in w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), stop, len(lines), len(lines) - len(set(lines)), len(covered)


def verdict(n, chars, symbols, stop, lines, dup, repeated):
    base = [name for name, bad in (("short", n < 50), ("repeats_itself", 100 * repeated > 50 * n)) if bad]
    more = [("word_length", not 300 * n <= 100 * chars <= 1000 * n), ("symbols", 100 * symbols > 10 * n), ("stop_words", 100 * stop < 6 * n), ("repeated_lines", 100 * dup > 40 * lines)]
    return bool(base), [*base, *(name for name, bad in more if bad)]


def test_quality_rules(spark, rows):
    got = Counter((r.doc_id, *(r[m] for m in rules.MEASURES), r.base_failed, tuple(r.failed), r.kept) for r in rules.quality_rules(table(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        m = brute_rules(t)
        at_once, failed = verdict(*m)
        want[i, *m, at_once, tuple(failed), not failed] += 1
    assert got == want
    assert len({name for key in got for name in key[-2]}) == 6 and any(key[-1] for key in got)


def test_quality_rules_are_one_projection(spark, rows):
    plan = rules.quality_rules(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Window|Generate|Aggregate", plan.replace("aggregate(", ""))


def test_other_tables_of_rules(spark):
    docs = table(spark, [(1, "a b c"), (2, "a"), (3, None)])
    none = rules.quality_rules(docs, [], []).collect()
    assert all(r.kept and not r.base_failed and r.failed == [] for r in none)
    own = [rules.Rule("long", "n_words", "one", at_most=200), rules.Rule("none", "n_lines", "n_words", at_least=50, at_most=200)]
    assert {r.doc_id: r.failed for r in rules.quality_rules(docs, own, []).collect()} == {1: ["long", "none"], 2: [], 3: []}


def test_op12_sql(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = con.execute(rules.oracle_sql())
    names = [d[0] for d in made.description]
    want = Counter(made.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in registry.op12_quality_rules(spark, str(tmp_path)).collect()) == want


@pytest.fixture(scope="module")
def tokens():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    back = alignment.byte_characters()
    names = {i: name for name, i in a.get_vocab().items()}

    def encode(text):
        raw = (" " + (text or "")).encode()
        one = [(i, bytes(back[c] for c in names[i])) for i in a.encode(raw.decode(), add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        fits = text and b"".join(x for _, x in one) == raw == b"".join(x for _, x in two)
        return (one, two) if fits else ([], [])

    return encode


def brute_alignment(tokens, texts):
    """Spans of both sides by running sums; links by comparing each pair of spans; then counts over all texts."""
    out, counts = [], Counter()
    for text in texts:
        sides = []
        for side in tokens(text):
            at, spans = 0, []
            for i, raw in side:
                spans.append((at, at + len(raw), i))
                at += len(raw)
            sides.append(spans)
        a, b = sides
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = []
        for s, e in zip([0, *common], common):
            groups.append("|".join(",".join(str(i) for _, _, i in side[bisect_left(side, (s,)) : bisect_left(side, (e,))]) for side in sides))
        j, links = 0, []
        for s, e, i in a:
            while j < len(b) and b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links.append((i, b[k][2]))
                k += 1
        counts.update(set(links))
        out.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(n_a, n_b, len(groups), len(links), ";".join(groups), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links)) for n_a, n_b, groups, links in out]


@pytest.mark.parametrize("hot", [0, 40, alignment.HOT_PAIRS])
def test_alignment(spark, rows, tokens, hot):
    docs = [r for r in rows if r[0] not in (115, 117)]
    found = alignment.link_statistics(alignment.align(table(spark, docs), *PATHS), hot)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in found.collect())
    want = Counter((i, *x) for (i, _), x in zip(docs, brute_alignment(tokens, [t for _, t in docs]), strict=True))
    assert got == want
    by_id = {key[0]: key for key in got}
    assert by_id[111][1:] == (0, 0, 0, 0, "", 0, 0) and by_id[110][1] > 10 and by_id[108][3] > 0


def test_op13_query(spark, rows, tokens, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in registry.op13_tokenizer_alignment(spark, str(tmp_path)).collect())
    want = Counter()
    for (i, _), (*x, groups, best, total) in zip(rows, brute_alignment(tokens, [t for _, t in rows]), strict=True):
        want[i, *x, sha(groups) if groups else "", best, total] += 1
    assert got == want


def test_rank_file_encodes_alike():
    """Every code point that goes by the rank file, between letters, blanks, digits and after an apostrophe."""
    both = alignment.Pair(*PATHS)
    for c in map(chr, range(1, 0x280)):
        text = f" a{c}b {c}{c} 1{c}! {c}'s x{c}\n{c}  {c}"
        assert both.encode_a(text, text.encode()).tolist() == both.a.encode(text, add_special_tokens=False).ids


def test_other_rank_file_is_refused():
    with pytest.raises(ValueError, match="not the vocabulary"):
        alignment.Pair(*PATHS[:2], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_empty_tables(spark):
    empty = table(spark, [])
    assert periodic.periodic_runs(empty).collect() == [] and rules.quality_rules(empty).collect() == []
    assert alignment.link_statistics(alignment.align(empty, *PATHS)).collect() == []
    nothing = table(spark, [(1, None), (2, "")])
    assert [tuple(r) for r in alignment.link_statistics(alignment.align(nothing, *PATHS)).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, "", 0, 0) for i in (1, 2)]
