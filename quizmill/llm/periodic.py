"""Periodic runs of words: lags counted by FFT for frequent words and by pairs for rare ones, then scans for islands.

At lag q, a run of period q and at least ``exponent`` periods is an island of ``(exponent - 1) * q`` or more places whose
word stands again q places on. So per text the matches at each lag are counted exactly: words that stand often by the
autocorrelation of their places, the others by the differences of their places. Only a lag with enough matches, less
those that runs of its divisors explain, is scanned; the scan looks at every s-th place first, as an island of the least
length holds eight or more of them in a row, and goes through the places between only around such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import _WHITE, flat, pieces, word_spans
from .common import settle

MIN_LENGTH, MIN_EXPONENT = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """A number for each word, equal where the words' bytes are, and the words."""
    size = end - start
    stop = np.cumsum(size)
    own = data[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, stop).astype(np.int64)), pa.py_buffer(own)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), words


def lag_counts(words: np.ndarray, doc: np.ndarray, first: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each text's words stand again at each lag up to ``longest`` of it: one flat array, and where each text's part begins.

    ``first``: each text's first word; ``doc``: each word's text. A word is frequent in a text if its pairs would take
    longer than a Fourier transform of the text.
    """
    base = np.append(0, np.cumsum(longest + 1))
    count = np.zeros(base[-1], np.int64)
    if not len(words):
        return count, base
    order = np.lexsort((words, doc))  # stable: places ascend within a word
    key_doc, key = doc[order], words[order]
    new = np.append(True, (key[1:] != key[:-1]) | (key_doc[1:] != key_doc[:-1]))
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(order)))
    n = np.diff(np.append(first, len(words)))
    span = n + longest  # no lag of interest wraps around
    cost = span * np.log2(np.maximum(span, 2))
    frequent = times.astype(np.float64) ** 2 > np.maximum(cost[key_doc[begin]], 64.0 * 64)
    heavy = np.flatnonzero(frequent)
    owner = key_doc[begin[heavy]]
    for d in np.unique(owner):
        size = 1 << int(span[d] - 1).bit_length()
        power = np.zeros(size // 2 + 1)
        for g in heavy[slice(*np.searchsorted(owner, [d, d + 1]))]:
            places = np.zeros(size)
            places[order[begin[g] : begin[g] + times[g]] - first[d]] = 1
            spectrum = np.fft.rfft(places)
            power += spectrum.real**2 + spectrum.imag**2
        count[base[d] : base[d + 1]] += np.rint(np.fft.irfft(power, size)[: longest[d] + 1]).astype(np.int64)
    rest = np.repeat(~frequent, times)
    group = np.cumsum(new)[rest]
    place, limit, at = order[rest], longest[key_doc[rest]], base[key_doc[rest]]
    active, k = np.arange(len(place)), 1
    while len(active):
        active = active[active + k < len(place)]
        lag = place[np.minimum(active + k, len(place) - 1)] - place[active]
        near = (group[active] == group[np.minimum(active + k, len(place) - 1)]) & (lag <= limit[active])  # later ones are farther
        active, lag = active[near], lag[near]
        if len(active) * 4 > len(count):
            count += np.bincount(at[active] + lag, minlength=len(count))
        else:
            np.add.at(count, at[active] + lag, 1)
        k += 1
    return count, base


def islands(words: np.ndarray, a: int, b: int, q: int, least: int) -> Iterator[tuple[int, int]]:
    """Start and end of the maximal rows of ``least`` or more places in [a, b) whose word stands again q places on."""
    edge = np.diff(np.concatenate(([False], words[a:b] == words[a + q : b + q], [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for s, e in zip(start, end, strict=True):
        if e - s >= least:
            yield a + int(s), a + int(e)


def find_runs(words: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Each text's runs (start, length, smallest period) by start, then period. words: those of all texts in turn."""
    docs = len(first)
    stop = np.append(first[1:], len(words))
    n = stop - first
    longest = n // exponent
    count, base = lag_counts(words, np.repeat(np.arange(docs), n), first, longest)
    least_at = lambda q: np.maximum(min_length - q, (exponent - 1) * q)
    lag = np.arange(len(count)) - np.repeat(base[:-1], longest + 1)
    cell = np.flatnonzero((lag > 0) & (count >= least_at(lag)))
    cell = cell[np.argsort(lag[cell], kind="stable")]
    cuts = np.flatnonzero(np.diff(lag[cell], prepend=-1))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(docs)]
    known: set[tuple[int, int]] = set()  # a stretch once found has a smaller period
    for i, j in zip(cuts, np.append(cuts[1:], len(cell))[: len(cuts)], strict=True):
        q = int(lag[cell[i]])
        least = int(least_at(q))
        own = cell[i:j][count[cell[i:j]] >= least]
        if not len(own):
            continue
        which = np.searchsorted(base, own, "right") - 1
        step = max(1, least // 8)
        seen = -(-(n[which] - q) // step)  # places looked at in each text
        at = np.repeat(first[which] - step * (np.cumsum(seen) - seen), seen) + step * np.arange(seen.sum())
        text = np.repeat(which, seen)
        hit = words[at] == words[at + q]
        edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        rises, falls = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        turn = np.flatnonzero(text[1:] != text[:-1]) + 1  # rows of hits end where the next text begins
        turn = turn[hit[turn] & hit[turn - 1]]
        rises, falls = np.sort(np.append(rises, turn)), np.sort(np.append(falls, turn))
        long = falls - rises >= least // step
        for r, f in zip(rises[long], falls[long], strict=True):
            d = int(text[r])
            around = max(int(at[r]) - step + 1, int(first[d])), min(int(at[f - 1]) + step, int(stop[d]) - q)
            for s, e in islands(words, *around, q, least):
                if (s, e + q) in known:
                    continue
                known.add((s, e + q))
                length = e - s + q
                out[d].append((s - int(first[d]), length, q))
                own_count = count[base[d] : base[d + 1]]
                multiples = np.arange(2 * q, min(length, len(own_count)), q)
                own_count[multiples] -= length - multiples  # at these lags the run is an island of its own
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _runs(min_length: int, exponent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = flat(batch.column("text"))
            start, end, row = word_spans(data, offsets, ~_WHITE)
            words, _ = numbered(data, start, end)
            first = np.searchsorted(row, np.arange(batch.num_rows))
            found = find_runs(words, first, min_length, exponent)
            change = np.zeros(len(words) + 1, np.int32)
            flat_runs = [(r + int(first[d]), length, q) for d, runs in enumerate(found) for r, length, q in runs]
            if flat_runs:
                at, length, q = np.array(flat_runs, np.int64).T
                np.add.at(change, at + q, 1)
                np.add.at(change, at + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(np.append(first, len(words)))), _structs(found), _joined(data, start[kept], end[kept], row[kept], batch.num_rows)],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def _structs(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    values = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
    structs = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32()), structs)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The spans of each row with one space between, as texts."""
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    size = end - start + ~last
    stop = np.cumsum(size)
    out = np.full(stop[-1] if len(stop) else 0, 32, np.uint8)
    own = end - start
    before = np.cumsum(own) - own
    inner = np.arange(own.sum())
    out[np.repeat(stop - size - before, own) + inner] = data[np.repeat(start - before, own) + inner]
    bounds = np.append(0, stop)[np.searchsorted(row, np.arange(rows + 1))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string() if len(out) < 1 << 31 else pa.large_string())


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of each whole text.

    Words are maximal runs without ASCII white space. A run is a stretch with smallest period q, of ``min_length`` and
    ``exponent * q`` words at least, that no neighbouring word extends at period q. Collapsed: the words joined by one
    space, without those that a run contains after its first period. Null and empty texts have no words, no runs and an
    empty collapsed text; rows with a null or repeated doc_id come out as they came in; an empty table gives no rows;
    other columns are ignored. No shuffle: each text is read by one task, in time near its length times its square root.
    """
    settle(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_runs(min_length, exponent), SCHEMA)
