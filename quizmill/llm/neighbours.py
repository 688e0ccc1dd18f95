"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, reranked by exact products.

Points are dealt into blocks by a hash of their id, queries into groups; each block meets each group in one task, which
hashes the block into TABLES tables of HASHES p-stable functions floor((a.x + b) / w). A query visits the buckets that
hold points in order of estimated success, the sum of squared distances to the cell walls crossed, up to a reach. The
candidates of all tables are merged and reranked by their exact products, and only the best of each block leave the task.

For inner products, points get one more coordinate that makes all norms of a range equal, so that the nearest has the
largest product. Norms are told apart by powers of two, and each range is scaled by its own largest norm, so that a few
long vectors don't squeeze the others into few cells. The reach is fitted on a bounded sample against brute force;
ranges that the sample has no rows of are searched whole, and queries left with fewer than k are searched exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf

TABLES, HASHES, WIDTH = 6, 3, 1.0
BLOCK, GROUP = 8192, 2048
#: Rows of the sample (those with the least hash of their id) on which the reach is fitted, and its queries.
SAMPLE, SAMPLE_QUERIES = 4096, 128
AIM = 0.985


class Hashes:
    """TABLES x HASHES p-stable functions over vectors of one length, drawn from a fixed seed."""

    def __init__(self, size: int, width: float) -> None:
        rng = np.random.default_rng(8191)
        self.a, self.b = rng.standard_normal((TABLES, size, HASHES)), rng.uniform(0, width, (TABLES, HASHES))
        self.width = width

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width


def _ranges(x: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The norm range of each vector, whose largest norms are ``tops`` in ascending order."""
    norms = np.linalg.norm(x, axis=1)
    return np.minimum(np.searchsorted(tops, norms * (1 - 1e-9)), len(tops) - 1)


def _augmented(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    x = x / norms[:, None]
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))], axis=1)


def _raised(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)


def _buckets(points: np.ndarray, queries: np.ndarray, tops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per table: the bucket of each point, each bucket's norm range, and each query's cost of visiting each bucket."""
    hashes = Hashes(points.shape[1] + 1, WIDTH)
    of = _ranges(points, tops)
    x, q = _augmented(points, tops[of]), _raised(queries)
    for t in range(TABLES):
        cells, bucket = np.unique(np.column_stack([np.floor(hashes.places(x, t)), of]), axis=0, return_inverse=True)
        place = hashes.places(q, t)
        cost = np.zeros((len(q), len(cells)))
        for h in range(HASHES):
            below = cells[:, h] - place[:, h, None]
            cost += np.maximum(0, np.maximum(below, -1 - below)) ** 2
        yield bucket.reshape(-1), cells[:, -1].astype(int), cost


def search_block(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, tops: np.ndarray, reach: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and products of its best k among the candidates of one block, itself left out.

    reach: the greatest cost of a bucket that is visited, for each norm range.
    """
    tables = [(bucket, cost <= reach[of]) for bucket, of, cost in _buckets(points, queries, tops)]
    out = []
    for i in range(len(queries)):
        seen = np.zeros(len(ids), bool)
        for bucket, visited in tables:
            seen |= visited[i][bucket]
        near = np.flatnonzero(seen & (ids != query_ids[i]))
        if len(near) > k:
            rough = points[near] @ queries[i]
            near = near[rough >= np.partition(rough, -k)[-k] - 1e-9 * tops[-1] * np.linalg.norm(queries[i])]
        # one order of additions for every pair, so that equal vectors have equal products
        score = np.multiply(points[near], queries[i]).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:k]
        out.append((ids[near][best], score[best]))
    return out


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(tops: np.ndarray, reach: np.ndarray, k: int) -> Callable:
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        ids = queries.column("query_id").to_numpy()
        if points.num_rows and queries.num_rows:
            found = search_block(points.column("vec_id").to_numpy(), _vectors(points, "vec"), ids, _vectors(queries, "vec"), tops, reach, k)
        n = [len(a) for a, _ in found]
        return pa.table({"query_id": np.repeat(ids[: len(n)], n), "vec_id": np.concatenate([np.zeros(0, np.int64), *(a for a, _ in found)]).astype(np.int64), "score": np.concatenate([np.zeros(0), *(s for _, s in found)])})

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (doubles): rows whose vectors are not null or zero, without null or non-finite components, of the
    table's commonest length (no product joins vectors of different lengths)."""
    vec = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null")
    rows = rows.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (common["n"] if common else 0))


def fit_reach(sample_ids: np.ndarray, sample: np.ndarray, tops: np.ndarray, k: int, aim: float = AIM) -> np.ndarray:
    """The least reach that finds ``aim`` of true neighbours, as the sample's queries say with two standard errors to spare;
    in norm ranges without sample rows, no limit."""
    q = min(SAMPLE_QUERIES, len(sample))
    order = np.argsort(sample_ids)
    true = [order[np.searchsorted(sample_ids, _exact(sample_ids, sample, i, k)[0], sorter=order)] for i in range(q)]
    least = [np.full(len(t), np.inf) for t in true]
    for bucket, _, cost in _buckets(sample, sample[:q], tops):
        least = [np.minimum(old, cost[i][bucket[t]]) for i, (old, t) in enumerate(zip(least, true, strict=True))]
    least = np.array(least)
    costs = np.sort(least.reshape(-1))
    reach = np.full(len(tops), np.inf)
    for cost in costs[int(aim * len(costs)) :]:
        found = (least <= cost).mean(axis=1)
        if found.mean() - 2 * found.std() / np.sqrt(q) >= aim:
            reach[np.unique(_ranges(sample, tops))] = cost * (1 + 1e-9)
            break
    return reach


def _exact(ids: np.ndarray, points: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    score = points @ points[i]
    score[ids == ids[i]] = -np.inf
    best = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
    return ids[best], score[best]


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product, ties to the smaller vec_id.

    ``is_query``: a condition on vec_id. Rows that ``usable`` leaves out take no part; a query never finds its own
    vec_id; rows come out fewer than k only where the table has no more; an empty table gives no rows; repeated rows of
    a vec_id count once. Tasks hold one block and one group, whatever the table's size.
    """
    spark = embeddings.sparkSession
    shelf = Shelf(spark, "neighbours")
    points = shelf.put(usable(embeddings).dropDuplicates(["vec_id"]))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = points.agg(F.count(F.lit(1)), F.max(norm)).first()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_norm = points.groupBy(F.floor(F.log2(F.lit(longest) / norm)).alias("octave"))  # a double has no more than 2,100
    tops = np.sort(np.array([r[0] for r in by_norm.agg(F.max(norm).alias("top")).select("top").collect()]))
    sample = points.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).toPandas()
    reach = fit_reach(sample.vec_id.to_numpy(), np.stack(sample.vec.to_numpy()), tops, min(k, max(1, len(sample) - 1)))
    blocks, groups = -(-n // block), -(-points.where(is_query).count() // group) or 1
    deal = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = points.select(deal(blocks, 1).alias("block"), every(groups).alias("group"), "vec_id", "vec").groupBy("block", "group")
    asked = points.where(is_query).select("vec_id", F.col("vec_id").alias("query_id"), "vec")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def search(queries: DataFrame, reach: np.ndarray) -> DataFrame:
        right = queries.select(every(blocks).alias("block"), deal(groups, 2).alias("group"), "query_id", "vec")
        found = left.cogroup(right.groupBy("block", "group")).applyInArrow(_search(tops, reach, k), schema)
        return shelf.put(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    found = search(asked, reach)
    enough = found.where(F.col("rank") == min(k, n - 1)).select("query_id")
    short = shelf.put(asked.join(enough, "query_id", "left_anti").select("query_id", "vec_id", "vec"))
    if n == 1 or short.isEmpty():
        return found
    exact = search(short, np.full(len(tops), np.inf))
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(exact)
