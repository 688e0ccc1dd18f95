"""Best-fit decreasing packing of tokenised documents into sequences of at most CAPACITY tokens.

Best fit decreasing only looks at lengths, of which there are at most CAPACITY. So Spark counts the pieces of each
length, the driver places the lengths (a problem whose size does not depend on the corpus), and tasks look up where
the n-th piece of its length went. The result is that of placing all pieces one by one, in order of length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import _LOWER, _WHITE, Rolling, flat, pieces, word_spans
from .common import Shelf

CAPACITY = 4096
END = 1
SALTS = 64
#: Pre-tokens remembered by a Python worker; beyond, it forgets all and starts anew.
CACHE = 2_000_000
_loaded: dict[str, WordIds] = {}


# What the tokenizer's pre-tokenizer tells apart, by byte: white space, letters, digits, others. Fixed values.
_KIND = np.full(256, 3, np.uint8)
_KIND[_WHITE] = 0
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
_ODD = np.zeros(256, bool)  # control characters, and the apostrophe of contractions
_ODD[[*range(0x09), *range(0x0E, 0x20), 0x7F, ord("'")]] = True


def _holding(data: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which bytes begin one of the texts."""
    found, raw = np.zeros(len(data), bool), data.tobytes()
    for text in texts:
        at = raw.find(text)
        while at >= 0:
            found[at] = True
            at = raw.find(text, at + 1)
    return found


def parts(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the spans that are tokenised apart, and whether a span is certainly one pre-token.

    Chunks between ASCII white space split into letter runs, single digits and runs of other characters. A chunk that
    holds an apostrophe, a control character or anything beyond ASCII but the letters U+00C0 to U+00FF stays whole, and so
    does one with a byte that is ``kept``.
    """
    begin, end, row = word_spans(data, offsets, ~_WHITE)
    after, before = np.append(data[1:], 0), np.append(0, data[:-1])
    letter = lambda x: (x >= 0x80) & (x <= 0xBF) & (x != 0x97) & (x != 0xB7)  # noqa: E731  second byte of such a letter
    odd = _ODD[data] | ((data >= 0x80) & ~((data == 0xC3) & letter(after)) & ~(letter(data) & (before == 0xC3)))
    total = np.append(0, np.cumsum(odd | kept))
    whole = total[end] > total[begin]
    kind = _KIND[data]
    edge = (kind != 0) & ((kind == 2) | (kind != np.append(0, kind[:-1])))
    step = np.zeros(len(data) + 1, np.int8)
    step[begin[whole]] += 1
    step[end[whole]] -= 1
    edge &= np.cumsum(step[:-1]) == 0
    edge[begin] = True
    start = np.flatnonzero(edge)
    chunk = np.searchsorted(begin, start, "right") - 1
    return start, np.minimum(np.append(start[1:], len(data)), end[chunk]), row[chunk], ~whole[chunk]


class WordIds:
    """Token ids by pre-token, remembered by its hash: the tokenizer merges nothing across pre-tokens.

    Ids are those of the tokenizer as loaded: an added token's text, such as <|endoftext|>, becomes that token. New pre-tokens are tokenised many at a time and told apart by the ids that end a word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.encode().translate(bytes(_LOWER)) for t in self.tokenizer.get_added_tokens_decoder().values()} - {b""})
        suffix = "</w>"
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _apart(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in words]

    def learn(self, keys: np.ndarray, words: list[str], single: np.ndarray) -> None:
        ids, lengths, order = [], [], []
        one = np.flatnonzero(single)
        for at in np.split(one, range(1000, len(one), 1000)):
            got = np.array(self.tokenizer.encode(" ".join(words[i] for i in at), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[got]) + 1
            if len(stop) == len(at) and (not len(got) or stop[-1] == len(got)):
                lengths.append(np.diff(stop, prepend=0))
            else:
                each = self._apart([words[i] for i in at])
                got = np.concatenate([np.zeros(0, np.uint32), *each])
                lengths.append(np.array([len(x) for x in each], np.int64))
            ids.append(got)
            order.append(at)
        rest = np.flatnonzero(~single)
        each = self._apart([words[i] for i in rest])
        length = np.concatenate([*lengths, np.array([len(x) for x in each], np.int64)])
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, *ids, *each])
        keys = keys[np.concatenate([*order, rest]).astype(np.int64)]
        by = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[by])
        self.keys, self.start, self.length = (np.insert(old, place, new[by]) for old, new in ((self.keys, keys), (self.start, start), (self.length, length)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the offsets of each text's own."""
        data, offsets = flat(texts)
        low = _LOWER[data]
        kept = _holding(low, self.added)
        if kept.any():  # the tokenizer looks for added tokens in the text as it is: such chunks keep their case
            begin, end, _ = word_spans(data, offsets, ~_WHITE)
            total = np.append(0, np.cumsum(kept))
            own = total[end] > total[begin]
            step = np.zeros(len(data) + 1, np.int8)
            step[begin[own]] += 1
            step[end[own]] -= 1
            low = np.where(np.cumsum(step[:-1]) > 0, data, low)
        data = low
        begin, end, row, single = parts(data, offsets, kept)
        rows = len(offsets) - 1
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if len(self.keys) > CACHE:
            self.forget()
        keys, first, which = np.unique(Rolling(data).ranges(begin, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(keys[new], [data[begin[i] : end[i]].tobytes().decode("utf-8", "replace") for i in first[new]], single[first[new]])
            at = np.searchsorted(self.keys, keys)
        at = at[which]
        length = self.length[at].astype(np.int64)
        stop = np.cumsum(length)
        place = np.repeat(self.start[at] - (stop - length), length) + np.arange(stop[-1])
        return self.ids[place], np.append(0, stop)[np.searchsorted(row, np.arange(rows + 1))]


def _pieces(path: str, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded[path] = _loaded.get(path) or WordIds(path)
        for batch in pieces(batches, limit=1 << 20):
            ids, bounds = words.encode(batch.column("text"))
            number, start, length, crc, own, doc = [], [], [], [], [], []
            for i, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                whole = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                for p, s in enumerate(range(0, len(whole), capacity)):
                    part = whole[s : s + capacity]
                    doc.append(i)
                    number.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    own.append(part.tobytes() if with_ids else None)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


class OpenBins:
    """A segment tree over capacities left: how many groups of equal bins are open with each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, np.int64)

    def add(self, left: int, change: int) -> None:
        node = self.size + left
        while node:
            self.tree[node] += change
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The least capacity left of an open bin that is ``need`` or more."""
        node = self.size + need
        if self.tree[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def place_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing by length. Rows (length, first, sequence, each, offset): from its ``first``-th piece on,
    pieces of this length go to sequences from ``sequence`` on, ``each`` in a row to one, from ``offset`` on."""
    bins: dict[int, list[tuple[int, int]]] = {}  # capacity left -> runs of sequences (first, how many)
    tree = OpenBins(capacity)
    rows, made = [], 0

    def open_run(left: int, first: int, n: int) -> None:
        if left and n:
            bins.setdefault(left, []).append((first, n))
            tree.add(left, 1)

    for length in sorted(counts, reverse=True):
        todo, done = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:  # new bins, filled one after another as best fit would
                each = capacity // length
                full, rest = divmod(todo, each)
                if full:
                    rows.append((length, done, made, each, 0))
                    open_run(capacity - each * length, made, full)
                    made, done = made + full, done + full * each
                if rest:
                    rows.append((length, done, made, rest, 0))
                    open_run(capacity - rest * length, made, 1)
                    made, done = made + 1, done + rest
                todo = 0
                continue
            first, n = bins[left].pop()
            tree.add(left, -1)
            each = left // length
            full, rest = divmod(todo, each)
            used = min(n, full)
            if used:
                rows.append((length, done, first, each, capacity - left))
                open_run(left - each * length, first, used)
                todo, done = todo - used * each, done + used * each
            if used < n and used == full and todo:  # the last pieces fill one bin in part
                rows.append((length, done, first + used, todo, capacity - left))
                open_run(left - todo * length, first + used, 1)
                done, todo, used = done + todo, 0, used + 1
            open_run(left, first + used, n - used)
    return rows


def _look_up(plan: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, each, offset = plan.value
        key = length * (1 << 40) + first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, own * (1 << 40) + rank, "right") - 1
            n = rank - first[at]
            out = {"sequence_id": sequence[at] + n // each[at], "offset": offset[at] + n % each[at] * own}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), pa.array(out["sequence_id"]), pa.array(out["offset"])], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian uint32, if ``with_ids``), sequence_id, offset.

    A document is its token ids and END; only longer ones are cut, every ``capacity`` ids. Null and empty texts are
    END alone; repeated rows are packed as often as they came in; an empty table gives no rows; other columns are
    ignored. ``tokenizer``: path of the tokenizer's file, which must be the same on all executors.

    Pieces of one length are ranked in SALTS parts, each starting after the counts of those before it (at most SALTS
    rows a length), so that no task ranks all of a common length.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = shelf.put(texts.mapInArrow(_pieces(tokenizer, capacity, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    counts = shelf.put(made.groupBy("length", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n")))
    rows = place_lengths({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    plan = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    shared = spark.sparkContext.broadcast([np.ascontiguousarray(x) for x in plan])
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = made.withColumn("salt", salt).withColumn("place", place).join(F.broadcast(bases), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place") - 1).drop("salt", "place", "base")
    return ranked.mapInArrow(_look_up(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
