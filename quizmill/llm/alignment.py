"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how often they meet.

Both encode a text with a space before it. The tokens of B are a static index of intervals: their sorted starts and ends.
Two bisections per token of A stab it and give the run of B tokens that it overlaps. A gap between two B tokens that no A
token spans is a boundary of groups. All texts of a batch lie on one line of bytes, so a batch is a handful of numpy calls.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .bytesets import pieces
from .common import Shelf, settle

#: Id pairs are one number: A's id times this, plus B's id. No vocabulary has so many ids.
PAIR = 1 << 20
#: Counts of at most so many id pairs, the most frequent, are sent to all tasks (18 MB); the rest are joined by shuffle.
HOT_PAIRS = 1 << 20
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>"
_loaded: dict[tuple[str, str, str | None], Pair] = {}


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 is itself, the others follow U+0100 in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Entries:
    """The texts of numbered entries, gathered by number from one buffer."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries) or b"\0", np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


class Pair:
    """The two tokenizers as loaded in a Python worker, with the bytes of their entries.

    ``a``: file of a byte-level BPE; special tokens' strings are plain text. ``b``: SentencePiece model. ``ranks``: A's
    vocabulary as a rank file; by it texts of code points below U+0280, on which both libraries split alike, are encoded
    several times faster to the same ids.
    """

    def __init__(self, a: str, b: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.fast = Tokenizer.from_file(a), None
        self.a.encode_special_tokens = True
        characters, names = byte_characters(), {i: name for name, i in self.a.get_vocab().items()}
        special = {i for i, token in self.a.get_added_tokens_decoder().items() if token.special}
        texts = {i: name.encode() if i in special else bytes(characters[c] for c in name) for i, name in names.items()}
        self.a_entries = Entries([texts.get(i, b"") for i in range(max(texts) + 1)])
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(text): int(i) for text, i in map(bytes.split, lines)}
            if known != {text: i for i, text in texts.items() if i not in special}:
                raise ValueError(f"{ranks} is not the vocabulary of {a}")
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_entries = Entries([piece(i) for i in range(self.b.vocab_size())])

    def encode_a(self, text: str, raw: bytes) -> np.ndarray:
        if self.fast is not None and (not raw or max(raw) < 0xCA):  # lead byte of U+0280
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none if it is null, empty, not UTF-8, or if the bytes of A's or B's tokens differ from space and text."""
        none = np.zeros(0, np.int64)
        out = [(none, none)] * len(texts)
        plain = {}
        for i, raw in enumerate(texts):
            if raw:
                try:
                    plain[i] = raw.decode()
                except UnicodeDecodeError:
                    continue
        for (i, text), b in zip(plain.items(), self.b.encode(list(plain.values()), num_threads=1), strict=True):
            raw, one, two = b" " + texts[i], self.encode_a(" " + text, texts[i]), np.array(b, np.int64)
            if all(e.size[ids].sum() == len(raw) and e.gather(ids).tobytes() == raw for e, ids in ((self.a_entries, one), (self.b_entries, two))):
                out[i] = one, two
        return out


def overlaps(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens side by side on one line of bytes: the first B token that each A token overlaps, the one after its
    last, and which B tokens end a group."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, "right")
    after = np.searchsorted(b_end - b_size, a_end, "left")
    spanned = np.zeros(len(b_size) + 1, np.int64)
    np.add.at(spanned, first, 1)
    np.add.at(spanned, after - 1, -1)
    return first, after, np.cumsum(spanned[:-1]) == 0


def _decimals(n: int) -> Entries:
    return Entries([b"%d " % i for i in range(n)])


def group_texts(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, decimals: Entries) -> tuple[np.ndarray, np.ndarray]:
    """All groups as ``a1,a2|b1;a3|b2,b3;`` in one buffer, and where each group ends. Ids are gathered as decimals with a
    blank after each, which becomes the mark between them."""
    side = np.repeat([0, 1], [len(a), len(b)])
    group = np.append(a_group, b_group)
    order = np.lexsort((side, group))
    ids, part = np.append(a, b)[order], (2 * group + side)[order]
    out = decimals.gather(ids).copy()
    end = np.cumsum(decimals.size[ids])
    last = np.append(part[1:] != part[:-1], True)[: len(part)]
    out[end - 1] = np.where(~last, ord(","), np.where(part % 2 == 0, ord("|"), ord(";")))
    return out, end[last & (part % 2 == 1)]


def _align(paths: tuple[str, str, str | None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded[paths] = _loaded.get(paths) or Pair(*paths)
        decimals = _decimals(max(len(both.a_entries.size), len(both.b_entries.size)))
        for batch in pieces(batches, limit=1 << 20):
            rows = batch.num_rows
            ids = both.encode(batch.column("text").cast(pa.binary()).to_pylist())
            n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
            a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in ids)]) for k in (0, 1))
            first, after, ends = overlaps(both.a_entries.size[a], both.b_entries.size[b])
            b_group = np.cumsum(ends) - ends
            row_of_group = np.repeat(np.arange(rows), n_b)[ends]
            text, stop = group_texts(a, b, b_group[first] if len(b) else first, b_group, decimals)
            n_groups = np.bincount(row_of_group, minlength=rows)
            bounds = np.append(0, np.append(0, stop)[np.cumsum(n_groups)])
            # the mark after a row's last group goes
            kept = np.ones(len(text), bool)
            kept[bounds[1:][n_groups > 0] - 1] = False
            bounds[1:] -= np.cumsum(n_groups > 0)
            each = after - first
            row = np.repeat(np.repeat(np.arange(rows), n_a), each)
            inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            pair = np.repeat(a, each) * PAIR + b[np.repeat(first, each) + inner]
            order = np.lexsort((pair, row))
            row, pair = row[order], pair[order]
            new = np.append(True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1]))[: len(row)]
            at = np.flatnonzero(new)
            lists = pa.array(np.searchsorted(row[at], np.arange(rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(np.bincount(row, minlength=rows)),
                    pa.LargeStringArray.from_buffers(rows, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text[kept])).cast(pa.string()),
                    pa.ListArray.from_arrays(lists, pa.array(pair[at])), pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(at, len(row))), pa.int32())),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"],
            )

    return run


def align(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (as ``a1,a2|b1;a3|b2,b3``), links (distinct id pairs, A's id times PAIR
    plus B's) and times (links of each pair) of each whole text; ``a``, ``b``, ``ranks`` as in Pair.

    Texts that are null, empty or not given back byte by byte by both tokenizers have no tokens: zeros and empty lists.
    Rows with a null or repeated doc_id come out as they came in; an empty table gives no rows; other columns are ignored.
    """
    settle(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_align((a, b, ranks)), SCHEMA)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """link, n (rows that hold it) and best (no pair of the same A id is in more rows). Counts are summed before the
    shuffle; the highest counts, one for each A id, are as many as A's vocabulary, whatever the corpus, and broadcast."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.expr(f"link div {PAIR}"))
    counts = Shelf(aligned.sparkSession, "alignment").put(counts)
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def _add_up(table: object, passed: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = table.value
        for batch in batches:
            lists = batch.column("links")
            pair, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            bounds = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
            at = np.minimum(np.searchsorted(link, pair), max(len(link) - 1, 0))
            hot = link[at] == pair if len(link) else np.zeros(len(pair), bool)
            at = at[hot]
            sums = []
            for value in (best[at], n[at]):
                each = np.zeros(len(pair), np.int64)
                each[hot] = value * times[hot]
                sums.append(pa.array(np.diff(np.append(0, np.cumsum(each))[bounds])))
            rest = pa.array(np.append(0, np.cumsum(~hot))[bounds], pa.int32())
            own = [pa.ListArray.from_arrays(rest, pa.array(x[~hot])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *sums, *own], names=[*passed, "n_best", "count_sum", "links", "times"])

    return run


def link_statistics(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The columns of ``aligned`` (those of align, or some that take their place) but links and times, and n_best and
    count_sum: of a text's links, how many belong to a pair that is best in count_pairs, and the sum of their pairs' n.

    The table is written once, so texts are encoded once. Pairs that stand in the most rows, a power of two as the
    threshold and at most ``hot_pairs`` of them, are looked up in a broadcast table; the rest, each in fewer rows than
    the threshold, meet their counts in a shuffled join.
    """
    spark = aligned.sparkSession
    shelf = Shelf(spark, "alignment")
    made = shelf.put(aligned.withColumn("row", F.monotonically_increasing_id()))
    pairs = shelf.put(count_pairs(made).withColumn("power", F.length(F.bin("n")) - 1))
    sizes = pairs.groupBy("power").count().orderBy(F.desc("power")).collect()  # 63 rows at most
    total, least = 0, 64
    for size in sizes:
        total += size["count"]
        if total > hot_pairs:
            break
        least = size["power"]
    hot = pairs.where(F.col("power") >= least).select("link", "n", "best").orderBy("link").toArrow()
    shared = spark.sparkContext.broadcast([hot.column(c).to_numpy() for c in ("link", "n", "best")])
    kept = [f for f in made.schema if f.name not in ("links", "times")]
    schema = StructType([*kept, *(StructField(c, LongType()) for c in ("n_best", "count_sum")), *(StructField(c, ArrayType(LongType())) for c in ("links", "times"))])
    summed = made.mapInArrow(_add_up(shared, [f.name for f in kept]), schema)
    if total <= hot_pairs:
        return summed.drop("row", "links", "times")
    summed = shelf.put(summed)
    rest = summed.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("link"), "x.times")
    met = rest.join(pairs.where(F.col("power") < least), "link").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    added = lambda column, more: (F.col(column) + F.coalesce(F.col(more), F.lit(0))).alias(column)
    return summed.join(met, "row", "left").select(*(f"`{f.name}`" for f in kept if f.name != "row"), added("n_best", "more_best"), added("count_sum", "more"))
