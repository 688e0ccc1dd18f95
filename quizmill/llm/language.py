"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in numpy against a broadcast matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import flat, mix, pieces
from .common import settle

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Words become their bytes in lower case between single marks; digits, punctuation and white space are all one mark.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)


def gram_buckets(texts: pa.Array, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all n-grams of all texts, and the offsets of each text's own."""
    data, offsets = flat(texts)
    rows = len(offsets) - 1
    padded = np.full(len(data) + 2 * rows, 32, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * row + 1] = _CLASS[data]
    bounds = offsets + 2 * np.arange(rows + 1)
    keep = np.ones(len(padded), bool)  # runs of marks count once
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[bounds[:-1][bounds[:-1] < len(padded)]] = True
    lengths = np.add.reduceat(keep, bounds[:-1]) if rows else np.zeros(0, int)
    code = padded[keep].astype(np.uint64)
    bounds = np.append(0, np.cumsum(lengths))
    for k in orders:
        if len(code) < k:
            yield np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
            continue
        h = np.full(len(code) - k + 1, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + code[j : len(code) - k + 1 + j]
        inside = np.ones(len(h), bool)  # no n-gram spans two texts
        for b in bounds[1:-1]:
            inside[max(0, b - k + 1) : b] = False
        kept = np.append(0, np.cumsum(inside))
        yield (mix(h[inside]) & np.uint64(buckets - 1)).astype(np.int64), kept[np.minimum(bounds, len(h))]


def _counts(langs: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        docs = np.zeros(len(langs), np.int64)
        number = {x: i for i, x in enumerate(langs)}
        for batch in pieces(batches):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            docs += np.bincount(lang, minlength=len(langs))
            for grams, bounds in gram_buckets(batch.column("text")):
                each = np.repeat(lang, np.diff(bounds))
                total += np.bincount(each * BUCKETS + grams, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(np.append(lang, np.arange(len(langs)))), pa.array(np.append(bucket, np.full(len(langs), -1))), pa.array(np.append(total[lang, bucket], docs))], names=["lang", "bucket", "n"])

    return run


def _predict(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = model.value
        for batch in pieces(batches):
            total = np.tile(prior, (batch.num_rows, 1))
            for grams, bounds in gram_buckets(batch.column("text")):
                for c in range(len(langs)):
                    sums = np.append(0, np.cumsum(matrix[c][grams], dtype=np.float64))
                    total[:, c] += sums[bounds[1:]] - sums[bounds[:-1]]
            data, offsets = flat(batch.column("text"))
            ascii_letter = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z"))
            has = np.diff(np.append(0, np.cumsum(ascii_letter))[offsets]) > 0
            for r in np.flatnonzero(~has):
                has[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "ignore"))
            if langs:
                best = total.argmax(axis=1)
                with np.errstate(under="ignore"):
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            name = [langs[best[r]] if has[r] and langs else "und" for r in range(batch.num_rows)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(name, pa.string()), pa.array([float(score[r]) if name[r] != "und" or (has[r] and langs) else 0.0 for r in range(batch.num_rows)], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def fit_languages(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (language x bucket) and log-priors, from all rows of docs (doc_id, text, lang).

    Rows with null lang or text are left out. Each task counts into one matrix and Spark adds the counts; what reaches the driver is
    the model, BUCKETS numbers a language, whatever the corpus.
    """
    rows = docs.where("lang is not null and text is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    counts = rows.mapInArrow(_counts(langs), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas() if langs else None
    matrix, prior = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    if langs:
        grams = counts[counts.bucket >= 0]
        matrix[grams.lang, grams.bucket] = grams.n
        docs_of = counts[counts.bucket < 0]
        prior[docs_of.lang] = docs_of.n
    matrix += smoothing
    return langs, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32), np.log((prior + 1) / (prior.sum() + len(langs)))


def predict_languages(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language of each whole text and its posterior probability.

    Null texts and texts without a letter are 'und' with score 0, as is everything if nothing was learned. Repeated
    rows come out as often as they came in; an empty table gives no rows; other columns are ignored.
    """
    shared = settle(docs.sparkSession).sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
