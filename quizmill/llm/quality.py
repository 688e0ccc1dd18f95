"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k on their ratio.

Two families of n-grams are modelled: byte n-grams in lower case, hashed into BUCKETS, and 4-grams of whether each word
repeats the one before. A text's score is the sum over both of the mean log-ratio target / raw of its n-grams. Texts are
drawn without replacement, with log-weight SHARPNESS * score: those with the k largest sums of log-weight and Gumbel
noise, the noise a hash of the doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import _LOWER, _WHITE, Rolling, flat, mix, pieces, released, word_spans
from .common import Shelf

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
REPEATS = 16
SHARPNESS = 100.0
#: At most so many labelled rows, those with the least hash of their doc_id, make the target model and set k.
LABELLED = 20_000


def _families(texts: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Per family, parts of (buckets, offsets of each text's own)."""
    data, offsets = flat(texts)
    low = _LOWER[data].astype(np.uint64)
    parts = []
    for k in ORDERS:
        n = max(len(low) - k + 1, 0)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + low[j : n + j]
        inside = np.ones(n, bool)
        for b in offsets[1:-1]:
            inside[max(0, b - k + 1) : b] = False
        parts.append(((mix(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.append(0, np.cumsum(inside))[np.minimum(offsets, n)]))
    yield parts
    start, end, row = word_spans(_LOWER[data], offsets, ~_WHITE)
    words = Rolling(_LOWER[data]).ranges(start, end) if len(start) else np.zeros(0, np.uint64)
    same = np.append(False, (words[1:] == words[:-1]) & (row[1:] == row[:-1]))[: len(words)]
    pattern = np.zeros(len(words), np.int64)
    for j in range(4):  # flags of words further back count only within the text
        pattern[j:] += (same[: max(len(words) - j, 0)] & (row[: max(len(words) - j, 0)] == row[j:])) << (3 - j)
    yield [(BUCKETS + pattern, np.searchsorted(row, np.arange(len(offsets))))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS + REPEATS, np.int64), np.zeros(BUCKETS + REPEATS, np.int64)
    for batch in pieces(batches):
        good = np.array([x == 1 for x in batch.column("quality").to_pylist()])
        for parts in _families(batch.column("text")):
            for buckets, bounds in parts:
                raw += np.bincount(buckets, minlength=len(raw))
                target += np.bincount(buckets[np.repeat(good, np.diff(bounds))], minlength=len(raw))
    at = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def _score(ratio: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in pieces(batches):
            score = np.zeros(batch.num_rows)
            for parts in _families(batch.column("text")):
                total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for buckets, bounds in parts:
                    sums = np.append(0, np.cumsum(table[buckets]))
                    total += sums[bounds[1:]] - sums[bounds[:-1]]
                    n += np.diff(bounds)
                score += total / np.maximum(n, 1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def keep_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The lowest score that best parts labelled good texts from others (share of good kept less share of others kept)."""
    if not len(scores) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores)
    scores, good = scores[order], good[order]
    gain = np.append(0, np.cumsum(~good)) / (~good).sum() - np.append(0, np.cumsum(good)) / good.sum()
    gain[1:-1][scores[1:] == scores[:-1]] = -np.inf  # equal scores stay together
    best = int(np.argmax(gain[:-1]))
    return -np.inf if best == 0 else float((scores[best - 1] + scores[best]) / 2)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, small: int = 4096) -> float:
    """The k-th largest value, from counts in ever finer bins; at most ``bins`` counts or ``small`` values are gathered."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        if not low < high:
            return low
        width = (high - low) / bins
        inside = df.where(F.col(column).between(low, high))
        number = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        counts = sorted(((r["bin"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in counts:
            if k <= n:
                break
            k -= n
        low, high = lo, hi
        if n <= small:
            values = sorted((r[0] for r in df.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - 1]


def resample(docs: DataFrame, labels: DataFrame, keep: int | None = None, labelled: int = LABELLED, sharpness: float = SHARPNESS, seed: int = 17) -> DataFrame:
    """doc_id, score, key (log-weight and noise), kept: the Gumbel top-k of all documents.

    labels: doc_id, quality (1: target). ``keep`` is k; by default as many as score above the cut that best parts the
    labelled rows. Texts without n-grams, null ones included, score 0; keys equal to the k-th are all kept, so repeated
    rows stay together; without usable labels all texts weigh the same and all are kept; an empty table gives no rows.
    Rows without a doc_id get the noise of a null key. Other columns are ignored.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = shelf.put(known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    counts = texts.join(F.broadcast(known), "doc_id", "left").select("text", "quality").mapInArrow(released(_count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    table = np.zeros(BUCKETS + REPEATS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + REPEATS)):
        raw, target = np.full(BUCKETS + REPEATS, 0.5), np.full(BUCKETS + REPEATS, 0.5)
        raw[counts.bucket.to_numpy(np.int64)] += counts.raw.to_numpy(np.float64)
        target[counts.bucket.to_numpy(np.int64)] += counts.target.to_numpy(np.float64)
        if counts.target.sum():
            table[part] = np.log(target[part] / target[part].sum()) - np.log(raw[part] / raw[part].sum())
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    scored = texts.mapInArrow(released(_score(spark.sparkContext.broadcast(table))), "doc_id long, score double")
    scored = shelf.put(scored.withColumn("key", F.lit(sharpness) * F.col("score") - F.log(-F.log(u))))
    if keep is None:
        seen = scored.join(F.broadcast(known), "doc_id").select("score", "quality").toPandas()
        cut = keep_cut(seen.score.to_numpy(), seen.quality.to_numpy() == 1)
        keep = scored.where(F.col("score") >= F.lit(float(cut))).count()
    least = kth_largest(scored, "key", min(keep, n)) if keep and (n := scored.count()) else np.inf
    return scored.select("doc_id", "score", "key", (F.col("key") >= F.lit(float(least))).alias("kept"))
