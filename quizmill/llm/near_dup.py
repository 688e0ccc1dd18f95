"""N-gram Jaccard join: count vectors in R-trees bound the overlap, surviving pairs are verified on whole texts.

A document is the set of its distinct five-word shingles; two documents link at Jaccard >= num/den (75/100). The
work runs in these steps, each a Spark job over tables in the shared folder:

1. One pass over the texts gives each document's set size, two 64-bit set digests and its *count vector*: shingles
   hashed into groups, counted, with more groups the larger the set. Equal sets fall into one class, of which only one
   representative goes on.
2. A set and any set linked with it share a shingle among the first quarter of each in one common order (the
   prefix-filter bound). In the order of hashes, those shingles deal representatives into buckets; each is verified
   against the bucket centre it meets most often, and the links give first components.
3. Of representatives in buckets of several components, the shingles in a fixed part of the space of hashes are looked
   at: a set that links with another component's misses at most a quarter of its shingles there, so those that share
   too few of that part with other components leave. The rest are dealt anew, over all their shingles, by an order in
   which shingles of one component come first and others go by how many representatives hold them. Most prefixes then
   hold nothing that another component has, as a shared passage or template comes last, and leave.
4. In each bucket left, count vectors are points of R-trees: the sum of coordinate minima against a node's corner
   bounds the overlap with everything below it, and only pairs of different components whose bound reaches the
   threshold survive, if they also share enough prefix shingles.
5. Surviving pairs are verified exactly on their texts, and components closed over all links.

Shingles that very many documents share are known after step 1 (at most HOT_SHARE of them); their rows are counted in
parts and never meet in one task, but for buckets of step 4, which beyond ``block`` rows are dealt as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import flat, mix, pieces, released, shingle_sets
from .common import BROADCAST_ROWS, Shelf, ids_and_text, keep_ids
from .components import components

#: Groups of a count vector: about as many as shingles, from FEW to MANY; beyond, one for every CROWD shingles.
FEW, MANY, CROWD = 32, 1024, 8
#: Shingles are put last in the prefix order when more than one in HOT_SHARE of all prefix entries is theirs, so at
#: most HOT_SHARE of them can exist and be broadcast (2 MB).
HOT_SHARE = 1 << 18
HOT_LEAST = 64
SALTS = 64
#: The part of the space of hashes that step 3 looks at first.
PART = np.uint64(3 << 61)
BLOCK = 2048
BLOCK_BYTES = 1 << 20
LEAF = 16
NUM, DEN = 75, 100


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """Elements of a set's prefix such that linked sets share one in their prefixes: n - ceil(n * NUM / DEN) + 1."""
    return n - -(-n * NUM // DEN) + 1


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of the count vectors of sets of n shingles, powers of two; linked sets have equal numbers or one twice the other."""
    wanted = np.maximum(np.minimum(n, MANY), -(-np.asarray(n) // CROWD)).clip(FEW)
    return 1 << np.ceil(np.log2(wanted)).astype(np.int64)


def count_vector(shingles: np.ndarray) -> bytes:
    """Group counts in one byte each, rounded up to a common scale held in the first two bytes (so never too low).

    A vector's two halves added are the vector of half as many groups.
    """
    groups = int(groups_of(len(shingles)))
    counts = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % groups, minlength=groups)
    scale = max(1, -(-int(counts.max(initial=0)) // 255))
    return np.uint16(scale).tobytes() + (-(-counts // scale)).astype(np.uint8).tobytes()


def vectors(column: pa.Array, groups: int) -> np.ndarray:
    """The column's count vectors as rows of ``groups`` counts; those of more groups are added up to so many."""
    data, offsets = flat(column)
    out = np.zeros((len(offsets) - 1, groups), np.int32)
    sizes = np.diff(offsets) - 2
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for some in np.split(rows, range(256, len(rows), 256)):
            raw = data[offsets[some][:, None] + np.arange(size + 2)]
            scale = raw[:, :2].copy().view(np.uint16).astype(np.int32)
            out[some] = (raw[:, 2:] * scale).reshape(len(some), size // groups, groups).sum(axis=1)
    return out


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of sizes a and b: o >= (a + b) * NUM / (NUM + DEN)."""
    return (a + b) * NUM / (NUM + DEN)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gathered, held = [], 0

    def repeated() -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(gathered or [np.zeros(0, np.uint64)]), return_counts=True)
        tokens, times = tokens[times > 1], times[times > 1]
        none = np.zeros(len(tokens), np.int64)
        return pa.record_batch([pa.array(np.ones(len(tokens), np.int32)), pa.array(tokens.view(np.int64)), pa.array(times), pa.array(none), pa.array(none), pa.nulls(len(tokens), pa.binary())], names=["kind", "a", "n", "s1", "s2", "vec"])

    for batch in pieces(batches):
        sets = shingle_sets(batch.column("text"))
        one = [mix(s).sum(dtype=np.uint64) for s in sets]
        two = [mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets]
        yield pa.record_batch(
            [pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array([count_vector(s) for s in sets], pa.binary())],
            names=["kind", "a", "n", "s1", "s2", "vec"],
        )
        gathered += [s[: prefix_length(len(s))] for s in sets if len(s)]
        held += sum(map(len, gathered[-len(sets) :]))
        if held > 4_000_000:
            yield repeated()
            gathered, held = [], 0
    yield repeated()


def _last(late: np.ndarray, sieve: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of the shingles are among ``late`` (sorted), whose leading bits are marked in ``sieve``."""
    last = sieve[(s >> np.uint64(44)).astype(np.int64)]
    if last.any():
        at = np.searchsorted(late, s[last])
        last[last] = late[np.minimum(at, len(late) - 1)] == s[last]
    return last


def _entries(hot: object, of: str) -> object:
    """Rows (token, rep, n, hot, label) of each text's shingles.

    ``of``: "prefix" in the order of hashes; "part", those below PART, with n the least of them that a set in a link
    shares, and a row of no other's token where that is none; or "whole".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = hot.value
        sieve = np.zeros(1 << 20, bool)
        sieve[(late >> np.uint64(44)).astype(np.int64)] = True
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            sizes = np.array([len(s) for s in sets])
            if of == "part":
                sets = [s[: np.searchsorted(s, PART)] for s in sets]
                sizes = np.array([len(s) for s in sets]) - (prefix_length(sizes) - 1)
                sets = [s if least > 0 else np.append(s, mix(np.array([i], np.int64).view(np.uint64))) for s, least, i in zip(sets, sizes, ids, strict=True)]
            tokens, lasts = [], []
            for s in sets:
                last = _last(late, sieve, s)
                if of == "prefix":
                    order = np.argsort(last, kind="stable")[: prefix_length(len(s))] if last.any() else slice(prefix_length(len(s)))
                    s, last = s[order], last[order]
                tokens.append(s)
                lasts.append(last)
            n = [len(s) for s in tokens]
            label = np.zeros(sum(n), np.int64) if of == "prefix" else np.repeat(batch.column("label").to_numpy(), n)
            yield pa.record_batch(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(ids, n)), pa.array(np.repeat(sizes, n)), pa.array(np.concatenate(lasts)), pa.array(label)],
                names=["token", "rep", "n", "hot", "label"],
            )

    return run


class RTree:
    """A packed R-tree over count vectors: leaves of LEAF points in order of size and first counts, LEAF nodes a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        lead = points[:, : points.shape[1] // 4].sum(axis=1)
        self.order = np.lexsort((lead, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, low = self.points, self.sizes
        while len(high) > LEAF:
            cut = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(low, cut)
            self.levels.append((high, low))

    def search(self, point: np.ndarray, size: float) -> np.ndarray:
        """Numbers of the points whose overlap with the query may reach the threshold."""
        nodes = np.arange(len(self.levels[-1][0]) if self.levels else 0)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            nodes = nodes[np.minimum(high[nodes], point).sum(axis=1) >= needed(low[nodes], size)]
            below = self.levels[depth - 1][1] if depth else self.sizes
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < len(below)]
        if not self.levels:
            nodes = np.arange(len(self.sizes))
        keep = np.minimum(self.points[nodes], point).sum(axis=1) >= needed(self.sizes[nodes], size)
        return self.order[nodes[keep]]


class Bucketed:
    """Rows of many buckets, with their count vectors by number of groups: of each number, and of twice as many added up."""

    def __init__(self, table: pa.Table) -> None:
        self.rep, self.n, self.label, self.own, self.split = (table.column(c).to_numpy() for c in ("rep", "n", "label", "own", "split"))
        self.groups = groups_of(self.n)
        vec = table.column("vec").combine_chunks()
        self.points, self.place = {}, {}
        for g in np.unique(self.groups):
            of = np.flatnonzero((self.groups == g) | (self.groups == 2 * g))
            place = np.full(len(self.n), -1)
            place[of] = np.arange(len(of))
            self.points[int(g)], self.place[int(g)] = vectors(vec.take(pa.array(of)), int(g)), place

    def pairs(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components among the rows a to b whose bounds allow a link; in a block of two parts, across them.

        One tree for each number of groups, over the points of so many and, added up, of twice as many.
        """
        groups = self.groups[a:b]
        for g in np.unique(groups):
            of = a + np.flatnonzero((groups == g) | (groups == 2 * g))
            point, size, asks = self.points[int(g)][self.place[int(g)][of]], self.n[of].astype(np.float64), self.groups[of] == g
            if len(of) <= 2 * LEAF:  # a tree of one leaf
                near = np.stack([np.minimum(point, one).sum(axis=1) for one in point]) >= needed(size[:, None], size)
                i, j = np.nonzero(near & asks[:, None])
            else:
                tree = RTree(point, size)
                found = [(k, tree.search(point[k], size[k])) for k in np.flatnonzero(asks)]
                i, j = np.repeat([k for k, _ in found], [len(x) for _, x in found]).astype(np.int64), np.concatenate([x for _, x in found])
            keep = (size[j] * DEN >= size[i] * NUM) & (size[i] * DEN >= size[j] * NUM)
            one, two = self.label[of[i]], self.label[of[j]]
            keep &= np.where(asks[j], two > one, two != one)
            if self.split[a]:
                keep &= self.own[of[i]] != self.own[of[j]]
            yield self.rep[of[i[keep]]], self.rep[of[j[keep]]]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order of bucket; a bucket that ends a batch waits for the next."""

    def work(table: pa.Table) -> pa.RecordBatch:
        key = table.column("token").to_numpy()
        block = table.column("block").to_numpy()
        cut = np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(block, prepend=block[:1] - 1) != 0))
        rows = Bucketed(table)
        found = [pair for a, b in zip(cut, [*cut[1:], len(key)], strict=True) for pair in rows.pairs(a, b)]
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
        if held.nbytes < BLOCK_BYTES:
            continue
        key, block = held.column("token").to_numpy(), held.column("block").to_numpy()
        whole = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1 if (key[0], block[0]) != (key[-1], block[-1]) else 0
        if whole:
            yield work(held.slice(0, whole))
            held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield work(held)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            groups, keep = np.minimum(groups_of(na), groups_of(nb)), np.zeros(batch.num_rows, bool)
            for g in np.unique(groups):
                rows = np.flatnonzero(groups == g)
                va, vb = (vectors(batch.column(c).take(pa.array(rows)), int(g)) for c in ("va", "vb"))
                keep[rows] = np.minimum(va, vb).sum(axis=1) >= needed(na[rows].astype(np.float64), nb[rows])
            yield pa.RecordBatch.from_struct_array(batch.select(["a", "b"]).to_struct_array().filter(pa.array(keep)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keep = []
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            for x, y in zip(shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_struct_array(batch.select(["a", "b"]).to_struct_array().filter(pa.array(keep)))


def _verify(shelf: Shelf, docs: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Of pairs (a table in the shared folder), those whose whole texts reach the threshold."""
    ids = shelf.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = keep_ids(docs, ids, limit)
    one, two = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    out = shelf.put(pairs.join(one, "a").join(two, "b").mapInArrow(released(_verified), "a long, b long"))
    shelf.drop(ids)
    return out


def _together(shelf: Shelf, entries: DataFrame, held: dict[str, Column], keep: Column) -> DataFrame:
    """Entries with the columns ``held``, aggregates over their token, where ``keep`` holds; a table in the shared folder.

    Each token's rows meet in one task, but for hot tokens, whose rows meet in SALTS parts and are then counted with
    partial sums; the hot tokens' aggregates, at most HOT_SHARE rows, are broadcast.
    """
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(F.lit(0))
    window = Window.partitionBy("token", "spread")
    met = entries.withColumn("spread", spread)
    for name, aggregate in held.items():
        met = met.withColumn(name, aggregate.over(window))
    met = shelf.put(met.where(keep | F.col("hot")).drop("spread"))
    hot = met.where("hot").drop(*held)
    counted = hot.groupBy("token").agg(*(aggregate.alias(name) for name, aggregate in held.items()))
    return met.where("not hot").unionByName(hot.join(F.broadcast(counted), "token").where(keep))


def near_duplicates(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of Jaccard >= 0.75, itself included.

    docs: doc_id, text; other columns are ignored. Null or empty texts have no shingles and link with nothing; repeated
    rows come out as often as they came in; an empty table gives no rows. doc_id names one text; rows without a
    doc_id come out alone, with component_id null. ``broadcast_rows`` and ``block`` set when ids are shuffled
    instead of broadcast and how large one bucket's block is; results don't depend on them.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "near-dup")
    docs = ids_and_text(docs)
    seen = shelf.put(docs.mapInArrow(released(_sketch), "kind int, a long, n long, s1 long, s2 long, vec binary"))
    rows = seen.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "s1", "s2", "vec")
    classes = shelf.put(rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    total = rows.select(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot = seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("a").collect()
    late = spark.sparkContext.broadcast(np.sort(np.array([x[0] for x in hot], np.int64).view(np.uint64)))
    schema = "token long, rep long, n long, hot boolean, label long"
    points = rows.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "s1", "s2"], "left_semi").select("doc_id", "n", "vec").dropDuplicates(["doc_id"])
    points = shelf.put(points)
    side = lambda x, key: points.select(F.col("doc_id").alias(key), F.col("n").alias(f"n{x}"), F.col("vec").alias(f"v{x}"))

    # first links: to the centre met most often
    reps = keep_ids(docs, classes.select(F.col("rep").alias("doc_id")), broadcast_rows)
    times, several = F.count(F.lit(1)), F.col("times") > 1
    shared = _together(shelf, reps.mapInArrow(released(_entries(late, "prefix")), schema).drop("label"), {"times": times, "centre": F.min(F.struct("rep", "n"))}, several)
    met = shared.where("rep <> centre.rep and 100 * least(n, centre.n) >= 75 * greatest(n, centre.n)").groupBy("rep", F.col("centre.rep").alias("centre")).agg(times.alias("times"))
    stars = met.groupBy("rep").agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("centre"))
    stars = shelf.put(stars.select(F.col("centre").alias("a"), F.col("rep").alias("b")).join(side("a", "a"), "a").join(side("b", "b"), "b").mapInArrow(released(_bounded), "a long, b long"))
    first = _verify(shelf, docs, stars, broadcast_rows)
    labels = components(shelf, first)

    # what the centres leave: representatives that meet other components, dealt by all their shingles
    ends = {"low": F.min("label"), "high": F.max("label")}
    mixed = F.col("low") < F.col("high")
    named = shared.select("token", "rep", "hot").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = shelf.put(_together(shelf, named, ends, mixed).select(F.col("rep").alias("doc_id"), "label").distinct())
    labelled = lambda some: docs.join(F.broadcast(some) if some.count() <= broadcast_rows else some, "doc_id")
    part = _together(shelf, labelled(open_).mapInArrow(released(_entries(late, "part")), schema), ends, mixed | (F.col("n") <= 0))
    rest = shelf.put(part.groupBy("rep", "label").agg(times.alias("times"), F.max("n").alias("n")).where("times >= n").select(F.col("rep").alias("doc_id"), "label"))
    whole = labelled(rest)
    tokens = _together(shelf, whole.mapInArrow(released(_entries(late, "whole")), schema), ends | {"times": times}, mixed)
    own = Window.partitionBy("rep")
    prefix = F.col("n") - F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}") + 1
    place = F.dense_rank().over(own.orderBy("times", "token"))  # rows that repeat a doc_id share places
    tokens = tokens.withColumn("place", place).withColumn("met", F.max("place").over(own)).where(F.col("place") <= prefix - (F.col("n") - F.col("met")))
    dealt = _together(shelf, tokens.select("token", "rep", "n", "label", "hot"), ends | {"times": times}, mixed)
    blocks = F.ceil(F.col("times") / F.lit(block)).cast("int")
    part = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct((F.least(part, other) * blocks + F.greatest(part, other)).alias("block"), (part != other).alias("split")))
    dealt = dealt.select("token", "rep", "n", "label", part.alias("own"), F.explode(each).alias("part")).select("*", "part.*").drop("part")
    dealt = dealt.join(points.select(F.col("doc_id").alias("rep"), "vec"), "rep")
    met = dealt.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(released(_index), "a long, b long").groupBy("a", "b").agg(times.alias("shared"))
    # what two sets share beyond their common prefix shingles lies behind the prefix of one of them
    sized = met.join(side("a", "a").drop("va"), "a").join(side("b", "b").drop("vb"), "b")
    behind = F.greatest(*(F.expr(f"({NUM} * {x} + {DEN - 1}) div {DEN} - 1") for x in ("na", "nb")))
    found = shelf.put(sized.where((F.col("shared") + behind) * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM).select("a", "b"))
    second = _verify(shelf, docs, found, broadcast_rows)
    final = components(shelf, first.union(second))

    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("label"))
    return rows.drop("vec").join(named, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
