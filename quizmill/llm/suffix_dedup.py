"""Suffix-array dedup: remove every byte covered by a 200-byte string that also starts anywhere else.

The collection's suffix order and common prefixes are built column by column, one symbol of each member inserted per
round. Whole documents would need as many rounds as the longest text has bytes, so the collection is first cut, without
loss, into short aligned members:

1. Every window of LENGTH bytes picks an anchor, the leftmost least hash among its GRAM-byte grams. Equal windows pick
   equal grams at equal offsets, so two windows can only be equal if their anchors' grams are; unmatched anchors go.
2. An anchor's context holds all windows that can have picked it (at most 2 * LENGTH - GRAM bytes). Equal contexts are
   counted before any shuffle of their bytes, first within each text: all their windows repeat. The other contexts of
   a gram are its members.
3. Members of a gram are aligned at the anchor. From the last column to the first, each round inserts one symbol per
   member: a stable sort by the new symbol keeps the members in the order of their suffixes, and the common prefixes of
   neighbours follow from range minima over the old ones (the positional form of the transform, in which only aligned
   suffixes exist). Where neighbours share LENGTH symbols or more, that column starts a repeated string.
4. The starts found become byte spans per document, which are merged and cut out.

Rounds run over arrays in memory, in blocks of whole grams; a gram with more than ``group_limit`` members is matched
by 128-bit window digests, counted by Spark, instead. Grams only propose; repeats are decided on symbols, or on two
independent 64-bit digests of the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytesets import Rolling, flat, mix, pieces, released
from .common import Shelf

LENGTH = 200
GROUP_LIMIT = 20_000
BLOCK_BYTES = 4 << 20
_SWAP = np.random.default_rng(77).permutation(256).astype(np.uint8)


def gram_length(length: int) -> int:
    return max(1, length // 2)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key in each run of ``width`` keys, by doubling."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def anchor_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost least hash in each run of ``width`` hashes, each once."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    found = []
    step = 1 << 22
    for a in range(0, len(hashes) - width + 1, step):  # positions need 23 bits of a key
        part = hashes[a : a + step + width - 1]
        keys = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        found.append(a + (np.unique(_least(keys, width) & np.uint64((1 << 24) - 1))).astype(np.int64))
    return np.unique(np.concatenate(found))


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > stops[:-1]
    return starts[new], stops[np.append(new[1:], True)]


def _anchors(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = gram_length(length)
        for batch in pieces(batches):
            data, offsets = flat(batch.column("text"))
            grams = Rolling(data).grams(k)
            other = Rolling(_SWAP[data])
            at, row = [], []
            for r in np.flatnonzero(np.diff(offsets) >= length):
                a, b = offsets[r], offsets[r + 1]
                p = anchor_positions(grams[a : b - k + 1], length - k + 1) + a
                at.append(p)
                row.append(np.full(len(p), r))
            if not at:
                continue
            at, row = np.concatenate(at), np.concatenate(row)
            low, high = np.maximum(at - (length - k), offsets[row]), np.minimum(at + length, offsets[row + 1])
            context = other.ranges(low, high) * np.uint64(0x9E3779B97F4A7C15) + (at - low).astype(np.uint64)
            ids = batch.column("doc_id").to_numpy()
            gram, own = grams[at], offsets[row]
            order = np.lexsort((at, context, gram, row))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(row[order]) != 0) | (gram[order][1:] != gram[order][:-1]) | (context[order][1:] != context[order][:-1])
            first = order[new]
            times = np.diff(np.append(np.flatnonzero(new), len(order)))
            yield pa.record_batch([pa.array(gram[first].view(np.int64)), pa.array(context[first].view(np.int64)), pa.array(ids[row[first]]), pa.array((at - own)[first]), pa.array((offsets[row + 1] - own)[first]), pa.array(times)], names=["gram", "context", "doc_id", "at", "size", "times"])
            again = order[np.repeat(times > 1, times)]  # contexts that repeat within their text, as periodic ones do
            if len(again):
                start, stop = _merged(low[again] + row[again], high[again] + row[again])  # texts one apart, so that none join
                inside = np.searchsorted(offsets + np.arange(len(offsets)), start, "right") - 1
                start, stop = start - inside, stop - inside
                spread = mix(np.arange(len(start), dtype=np.uint64) + ids[inside].astype(np.uint64)).view(np.int64)
                none = np.zeros(len(start), np.int64)
                yield pa.record_batch([pa.array(spread), pa.array(none), pa.array(ids[inside]), pa.array(start - offsets[inside]), pa.array(stop - offsets[inside]), pa.array(none)], names=["gram", "context", "doc_id", "at", "size", "times"])

    return run


def repeated_starts(symbols: np.ndarray, group: np.ndarray, length: int, columns: int) -> np.ndarray:
    """Columns (of the first ``columns``) at which each member shares its next ``length`` symbols with another of its group.

    symbols: members x width, 0 where a member has no symbol. Returns booleans, members x columns.
    """
    m, width = symbols.shape
    out = np.zeros((m, columns), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(m, np.int32)  # with the member before, in order
    base = np.unique(group, return_inverse=True)[1].astype(np.int64) * 257
    for column in range(width - 1, -1, -1):
        new = symbols[order, column].astype(np.int64)
        key = base[order] + new
        place = np.argsort(key, kind="stable")
        sorted_key = key[place]
        same = np.zeros(m, bool)
        same[1:] = sorted_key[1:] == sorted_key[:-1]
        fresh = np.zeros(m, np.int32)
        q = np.flatnonzero(same)
        if len(q):
            low, high = place[q - 1] + 1, place[q] + 1  # least of the old common prefixes between the two
            bounds = np.empty(2 * len(q), np.int64)
            bounds[::2], bounds[1::2] = low, high
            padded = np.append(common, 0)
            fresh[q] = np.minimum.reduceat(padded, bounds)[::2] + 1
            fresh[q[new[place[q]] == 0]] = 0
        order, common = order[place], fresh
        if column < columns:
            joined = common >= length
            both = joined.copy()
            both[:-1] |= joined[1:]
            out[order[both], column] = True
    return out


def _members(length: int, block: int) -> Callable:
    """Rows arrive in order of gram; blocks hold whole grams. Yields doc_id, start, stop of spans of single contexts."""

    def work(table: pa.Table) -> pa.RecordBatch:
        k = gram_length(length)
        reach, width = length - k, 2 * length - k
        data, offsets = flat(table.column("bytes"))
        left = table.column("before").to_numpy()
        symbols = np.zeros((table.num_rows, width), np.uint16)
        row = np.repeat(np.arange(table.num_rows), np.diff(offsets))
        symbols[row, np.arange(len(data)) - offsets[row] + (reach - left)[row]] = data.astype(np.uint16) + 1
        starts = repeated_starts(symbols, table.column("gram").to_numpy(), length, reach + 1)
        starts &= (table.column("times").to_numpy() == 1)[:, None]
        member, column = np.nonzero(starts)
        first = np.ones(len(member), bool)
        first[1:] = (np.diff(member) != 0) | (np.diff(column) != 1)
        last = np.append(first[1:], True) if len(first) else first
        begin = table.column("at").to_numpy()[member] - reach + column
        return pa.record_batch([pa.array(table.column("doc_id").to_numpy()[member[first]]), pa.array(begin[first]), pa.array(begin[last] + length)], names=["doc_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if held.num_rows * 2 * length < block:
                continue
            gram = held.column("gram").to_numpy()
            if gram[0] != gram[-1]:
                whole = int(np.flatnonzero(gram != gram[-1])[-1]) + 1
                yield work(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    return run


def _digests(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[r].as_py(), np.uint8)
                one, two = Rolling(data).grams(length), Rolling(_SWAP[data]).grams(length)
                column = np.arange(len(one)) - batch.column("before")[r].as_py()
                same = lambda c, n=len(one), r=r: pa.array(np.full(n, batch.column(c)[r].as_py(), np.int64))
                yield pa.record_batch([same("gram"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), same("times"), same("doc_id"), pa.array(column), pa.array(column + batch.column("at")[r].as_py())], names=["gram", "one", "two", "times", "doc_id", "column", "start"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = flat(batch.column("text"))
        kept, removed, spans = [], [], []
        lists = batch.column("spans")
        for r in range(batch.num_rows):
            text = data[offsets[r] : offsets[r + 1]]
            found = lists[r].values if lists[r].is_valid else None
            if found is not None and len(found):
                a, b = _merged(found.field("start").to_numpy(), found.field("stop").to_numpy())
                ends, starts = np.append(a, len(text)), np.append(0, b)
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip(starts, ends, strict=True)))
                removed.append(int((b - a).sum()))
                spans.append(len(a))
            else:
                kept.append(text.tobytes())
                removed.append(0)
                spans.append(0)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), batch.column("carried")],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, block: int = BLOCK_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay): texts as UTF-8 without their repeated strings.

    ``carry``: further columns of docs to hand through, as fields of a column ``carried``.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in the same text or another; strings
    never cross texts and are judged on the input. Null and empty texts have no bytes and stay; texts under
    ``length`` bytes lose nothing; repeated rows repeat each other; an empty table gives no rows; extra columns are
    ignored. Each row is searched under a number of its own, written with its text once, so rows without a doc_id, or
    of one doc_id and different texts, are told apart. ``group_limit`` and ``block`` bound a task's memory and don't
    change results.
    """
    shelf = Shelf(docs.sparkSession, "suffix-dedup")
    k = gram_length(length)
    carried = F.struct(*(f"`{c}`" for c in carry) if carry else [F.lit(True).alias("row")]).alias("carried")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = shelf.put(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text, carried))
    texts = rows.select(F.col("row").alias("doc_id"), "text")  # from here on, doc_id is a row's number
    # rows of times 0 are spans (at to size) already known; others stand for all equal contexts in their text
    anchors = texts.mapInArrow(released(_anchors(length)), "gram long, context long, doc_id long, at long, size long, times long")
    grams = shelf.put(anchors.where("times > 0").groupBy("gram").agg(F.sum("times").alias("uses"), (F.min("context") < F.max("context")).alias("several")).where("uses > 1").drop("uses"))
    found = shelf.put(anchors.join(grams, "gram", "left").where("times = 0 or several is not null"))
    shelf.drop(grams)
    within, found = found.where("times = 0"), found.where("times > 0")
    contexts = shelf.put(found.where("several").groupBy("gram", "context").agg(F.sum("times").alias("times"), F.min(F.struct("doc_id", "at", "size")).alias("one")))
    low, high = F.greatest(F.col("at") - F.lit(length - k), F.lit(0)), F.least(F.col("at") + F.lit(length), F.col("size"))
    whole = lambda rows: rows.select("doc_id", low.alias("start"), high.alias("stop"))
    equal = within.select("doc_id", F.col("at").alias("start"), F.col("size").alias("stop")).union(whole(found.where("not several"))).union(whole(found.where("several").join(contexts.where("times > 1").select("gram", "context"), ["gram", "context"], "left_semi")))

    sliced = contexts.select("gram", "times", "one.*").join(texts, "doc_id").select(
        "gram", "times", "doc_id", "at", (F.col("at") - low).alias("before"), F.substring(F.col("text"), (low + 1).cast("int"), (high - low).cast("int")).alias("bytes")
    )
    crowded = shelf.put(contexts.groupBy("gram").count().where(F.col("count") > group_limit).select("gram"))
    crowds = crowded.count()
    members = shelf.put(sliced)
    few = members.join(crowded, "gram", "left_anti") if crowds else members
    spans = equal.union(few.repartition("gram").sortWithinPartitions("gram").mapInArrow(released(_members(length, block)), "doc_id long, start long, stop long"))
    if crowds:
        windows = shelf.put(members.join(crowded, "gram", "left_semi").mapInArrow(released(_digests(length)), "gram long, one long, two long, times long, doc_id long, column long, start long"))
        again = windows.groupBy("gram", "column", "one", "two").agg(F.sum("times").alias("uses")).where("uses > 1").drop("uses")
        spans = spans.union(windows.where("times = 1").join(again, ["gram", "column", "one", "two"], "left_semi").select("doc_id", "start", (F.col("start") + length).alias("stop")))
    per_doc = shelf.put(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    shelf.drop(contexts, members, crowded)
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").add(rows.schema["carried"])
    return rows.join(per_doc.withColumnRenamed("doc_id", "row"), "row", "left").drop("row").mapInArrow(released(_cut), schema)

