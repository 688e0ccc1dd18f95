"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is WINDOW consecutive words of a benchmark item. Fingerprints are the least hashes of each run of
WINDOW - GRAM + 1 hashed GRAM-word grams, so every shared span of WINDOW words shares one. Documents that share a
fingerprint go on; there hits are extended over all words of windows that match exactly, as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Shelf, keep_ids

WINDOW, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and all beyond ASCII, after lower-casing A-Z."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _worded(table: DataFrame, *keys: str) -> DataFrame:
    return table.select(*keys, words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))


def _fingerprints(worded: DataFrame, *keys: str) -> DataFrame:
    """keys, n_words, marks: the distinct least gram hashes of all windows (null with fewer than WINDOW words)."""
    hashed = worded.select(*keys, F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    at = lambda array, i, d: F.get(array, i + F.lit(d))
    grams = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - GRAM), lambda i: F.xxhash64(*(at(F.col("h"), i, d) for d in range(GRAM)))))
    run = WINDOW - GRAM + 1
    least = F.transform(F.sequence(F.lit(0), F.size("g") - run), lambda i: F.least(*(at(F.col("g"), i, d) for d in range(run))))
    return hashed.select(*keys, "n_words", grams.alias("g")).select(*keys, "n_words", F.when(F.col("g").isNotNull(), F.array_distinct(least)).alias("marks"))


def _windows(worded: DataFrame, key: str, length: int) -> DataFrame:
    """key, at, window: every run of ``length`` words, as one string.

    The outer form of explode keeps the optimiser from testing the whole array in a filter below, word by word.
    """
    each = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice("words", i + 1, length)).alias("window")))
    return worded.where(F.size("words") >= length).select(key, F.explode_outer(each).alias("w")).select(key, "w.at", "w.window")


def _runs(length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i + 1, length))))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings; those with occurring windows), contaminated.

    A word is hit if it lies in any occurrence of a window; an item of fewer than WINDOW words, but not none, is one
    window. Null and empty texts have no words, on either side; rows repeated as wholes come out once; extra columns
    are ignored; either table may be empty. Each row is searched under a key of its own, a digest of doc_id and text, so
    rows without a doc_id, or of one doc_id and different texts, stay apart. Item ids are taken as strings; items without
    one hit words as all others do, but are not listed in items. Benchmark fingerprints are broadcast up to ``broadcast_rows`` of them,
    shuffled beyond. Items under WINDOW words have no fingerprint: all runs of just their lengths are looked up.
    """
    shelf = Shelf(docs.sparkSession, "decontaminate")
    items = _worded(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), "item_id")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    row = F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))
    docs = docs.select(doc_id.alias("doc_id"), text.alias("text"), row.alias("row"))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect() if r[0])  # at most WINDOW numbers
    windows = None
    for n in lengths:
        part = items if n == WINDOW else items.where(F.size("words") == n)
        part = _windows(part, "item_id", n).select(F.lit(n).alias("length"), "window", "item_id").distinct()
        windows = part if windows is None else windows.union(part)
    worded = _worded(docs, "row", "doc_id")
    marks = _fingerprints(items, "item_id").select(F.explode_outer("marks").alias("mark")).distinct()
    marks = shelf.put(marks.withColumn("hit", F.lit(True)))
    near = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    seen = _fingerprints(worded, "row", "doc_id").select("row", "doc_id", "n_words", F.explode_outer("marks").alias("mark")).join(near, "mark", "left")
    seen = shelf.put(seen.groupBy("row", "doc_id", "n_words").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("near")))
    ids = seen.where("near").select("row")
    for n in lengths:
        if n < WINDOW:
            known = shelf.put(windows.where(F.col("length") == n).select(F.xxhash64("window").alias("h")).distinct())
            found = worded.where(F.size("words") >= n).select("row", F.explode_outer(F.array_distinct(_runs(n))).alias("h"))
            ids = ids.union(found.join(F.broadcast(known) if known.count() <= broadcast_rows else known, "h", "left_semi").select("row"))
    ids = shelf.put(ids.distinct())
    close = _worded(keep_ids(docs, ids, broadcast_rows, "row"), "row")
    hits = None
    for n in lengths:
        part = _windows(close, "row", n).select("row", "at", F.lit(n).alias("length"), "window")
        hits = part if hits is None else hits.union(part)
    if hits is None:
        return seen.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    windows = shelf.put(windows)
    hits = shelf.put(hits.join(F.broadcast(windows) if windows.count() <= broadcast_rows else windows, ["length", "window"]).select("row", "at", "length", "item_id"))
    covered = hits.select("row", "at", "length").distinct().select("row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("word")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = seen.join(covered, "row", "left").join(named, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
