"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals make document scores and offsets.

1. A bounded sample of labelled documents gives, per hashed word, in how many toxic and clean texts it stands. Words
   clearly bound to toxic texts are the lexicon, whose every word is a feature; the sample's bound is its only one.
2. Tokens of the sample are labelled toxic where a lexicon word stands in a toxic text, other lexicon words clean. On
   them the field is fitted: a weight per word and a transition weight for both labels and the distance between
   neighbours in the chain. Words outside the lexicon are clean by construction and only add to distances.
3. Forward-backward over each whole text gives every lexicon word's marginal. The expected number of toxic words, in
   hinges, is calibrated on the sample's labels to the document's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import _LOWER, Rolling, flat, pieces, word_spans
from .common import Shelf

#: At most so many labelled rows, those with the least hash of their doc_id, are learned from.
LABELLED = 20_000
GAPS = (2, 4, 8, 16, 32)
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = flat(texts)
    data = _LOWER[data]
    start, end, row = word_spans(data, offsets, _WORD)
    return Rolling(data).ranges(start, end) if len(start) else np.zeros(0, np.uint64), start, end, row, offsets


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words, _, _, row, _ = _words(batch.column("text"))
        toxic = batch.column("toxic").to_numpy() == 1
        order = np.lexsort((row, words))
        words, row = words[order], row[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
        words, row = words[new], row[new]
        keys, which = np.unique(words, return_inverse=True)
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.bincount(which, toxic[row], len(keys)).astype(np.int64)), pa.array(np.bincount(which, ~toxic[row], len(keys)).astype(np.int64))], names=["word", "toxic", "clean"])


def _chains(lexicon: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Lexicon words of all texts: number in the lexicon, distance class to the one before, text, byte start and end."""
    words, start, end, row, offsets = _words(texts)
    at = np.minimum(np.searchsorted(lexicon, words), max(len(lexicon) - 1, 0))
    hit = np.flatnonzero(lexicon[at] == words) if len(lexicon) else np.zeros(0, np.int64)
    row = row[hit]
    gap = np.searchsorted(GAPS, np.diff(hit, prepend=hit[:1]), "right")
    return at[hit], gap, row, start[hit] - offsets[row], end[hit] - offsets[row]


def _padded(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each element in its row, elements a row, and order of rows by falling length."""
    n = np.bincount(row, minlength=rows)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), n, np.argsort(-n, kind="stable")


def marginals(emit: np.ndarray, trans: np.ndarray, gap: np.ndarray, row: np.ndarray, rows: int, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Forward-backward on all chains at once. emit: log-odds of toxic per element; trans: distance class x 2 x 2.

    Returns each element's probability of toxic, if asked each element's probabilities with the one before, and the
    summed log partition functions. Rows go in order of length, so each step works on the chains still going.
    """
    column, n, order = _padded(row, rows)
    starts = np.cumsum(n) - n
    longest = int(n.max(initial=0))
    alive = [order[: int((n > t).sum())] for t in range(longest)]
    score = np.stack([np.zeros(len(emit)), emit], axis=1)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    for t, rs in enumerate(alive):
        i = starts[rs] + t
        alpha[i] = score[i] if t == 0 else score[i] + np.logaddexp(*(alpha[i - 1, y, None] + trans[gap[i], y] for y in (0, 1)))
    for t in range(longest - 2, -1, -1):
        i = starts[alive[t + 1]] + t
        after = trans[gap[i + 1]] + (score[i + 1] + beta[i + 1])[:, None, :]
        beta[i] = np.logaddexp(after[:, :, 0], after[:, :, 1])
    total = np.logaddexp(*(alpha + beta).T)
    both = None
    if pairs:
        i = np.flatnonzero(column > 0)
        both = np.zeros((len(emit), 2, 2))
        both[i] = np.exp(alpha[i - 1][:, :, None] + trans[gap[i]] + (score[i] + beta[i])[:, None, :] - total[i, None, None])
    return np.exp(alpha[:, 1] + beta[:, 1] - total), both, float(total[starts[n > 0]].sum())


def fit_field(word: np.ndarray, gap: np.ndarray, row: np.ndarray, rows: int, label: np.ndarray, size: int, steps: int = 120, rate: float = 0.1, penalty: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights per word and transition weights, by Adam on the penalised log-likelihood of the labels."""
    weight, trans = np.zeros(size + 1), np.zeros((len(GAPS) + 1, 2, 2))
    state = [np.zeros(weight.size + trans.size) for _ in range(2)]
    column = _padded(row, rows)[0]
    inner = np.flatnonzero(column > 0)
    y = label.astype(int)
    want = np.zeros_like(trans)
    np.add.at(want, (gap[inner], y[inner - 1], y[inner]), 1)
    for step in range(1, steps + 1):
        p, both, _ = marginals(weight[word] + weight[-1], trans, gap, row, rows, pairs=True)
        slope = np.append(np.bincount(word, label - p, size), (label - p).sum())
        have = np.zeros_like(trans)
        np.add.at(have, gap[inner], both[inner])
        g = np.concatenate([slope, (want - have).ravel()]) / max(rows, 1) - penalty * np.concatenate([weight, trans.ravel()]) / max(rows, 1)
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        weight += move[: size + 1]
        trans += move[size + 1 :].reshape(trans.shape)
    return weight, trans


def hinges(expected: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(expected), np.clip(expected, 0, 1), np.clip(expected - 1, 0, 1), np.clip(expected - 2, 0, 2)], axis=1)


def fit_scale(expected: np.ndarray, toxic: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic weights of the hinges, by Newton's method."""
    x, w = hinges(expected), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(4), x.T @ (toxic - p) - penalty * w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict:
    """The model, from at most ``labelled`` rows of labels (doc_id, toxic) and their whole texts; null labels are left out.

    Equal texts count once. Without toxic or without clean rows the lexicon is empty and every score the share of toxic.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = shelf.put(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = shelf.put(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select(F.xxhash64("text").alias("doc_id"), "text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    model = {"lexicon": np.zeros(0, np.uint64), "weight": np.zeros(1), "trans": np.zeros((len(GAPS) + 1, 2, 2)), "scale": np.array([np.log((bad + 0.5) / (good + 0.5)), 0, 0, 0])}
    if bad and good:
        counts = rows.mapInArrow(_document_counts, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        odds = F.log((F.col("toxic") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(good + 1.0))
        chosen = counts.where((F.col("toxic") >= max(3, 0.01 * bad)) & (odds > 1.5)).select("word").collect()
        lexicon = np.sort(np.array([r[0] for r in chosen], np.int64).view(np.uint64))
        shared = spark.sparkContext.broadcast(lexicon)

        def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                word, gap, row, _, _ = _chains(shared.value, batch.column("text"))
                cut = np.searchsorted(row, np.arange(1, batch.num_rows))
                lists = lambda x: pa.array([y.tolist() for y in np.split(x, cut)], pa.list_(pa.int64()))
                yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), lists(word), lists(gap)], names=["doc_id", "toxic", "word", "gap"])

        seen = rows.mapInArrow(chains, "doc_id long, toxic int, word array<long>, gap array<long>").orderBy("doc_id").toPandas()
        n = seen.word.map(len).to_numpy()
        row = np.repeat(np.arange(len(seen)), n)
        word, gap = (np.concatenate([np.asarray(x, np.int64) for x in seen[c]] or [np.zeros(0, np.int64)]) for c in ("word", "gap"))
        toxic = seen.toxic.to_numpy() == 1
        weight, trans = fit_field(word, gap, row, len(seen), toxic[row].astype(float), len(lexicon))
        p, _, _ = marginals(weight[word] + weight[-1], trans, gap, row, len(seen))
        model |= {"lexicon": lexicon, "weight": weight, "trans": trans, "scale": fit_scale(np.bincount(row, p, len(seen)), toxic.astype(float))}
    shelf.drop(rows)
    return model


def _tag(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            word, gap, row, start, end = _chains(model["lexicon"], batch.column("text"))
            p, _, _ = marginals(model["weight"][word] + model["weight"][-1], model["trans"], gap, row, batch.num_rows)
            score = 1 / (1 + np.exp(-hinges(np.bincount(row, p, batch.num_rows)) @ model["scale"]))
            tagged = np.flatnonzero(p >= 0.5)
            cut = np.searchsorted(row[tagged], np.arange(1, batch.num_rows))
            spans = [[{"start": int(start[i]), "stop": int(end[i]), "p": float(p[i])} for i in part] for part in np.split(tagged, cut)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())])))], names=["doc_id", "score", "spans"])

    return run


def tag_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), spans: byte offsets (of the UTF-8 text) and marginals of words more likely toxic than not.

    Null and empty texts score as texts without a lexicon word; repeated rows come out as often as they came in; an
    empty table gives no rows; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tag(shared), "doc_id long, score double, spans array<struct<start: long, stop: long, p: double>>")
