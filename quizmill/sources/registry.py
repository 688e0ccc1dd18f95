"""Which reader takes a path: by the format's name if given, else by the suffix of the path in any case."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import authoring

#: Of a document: run_id (its path), sha256, size, and whatever else the format's operators read. From a path or folder.
Reader = Callable[[SparkSession, str], DataFrame]

# Fixed names and suffixes.
FORMATS = {"pdf": (".pdf",), "json": (".json",)}
READERS: dict[str, Reader] = {"json": authoring.read_documents}
#: What is wrong with a format's documents, by name: from the reader's rows to run_id, why. Others are taken as they are.
CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {"json": authoring.unreadable}


class UnsupportedFormatError(Exception):
    """No reader takes the path."""


def add_format(name: str, suffixes: Sequence[str], reader: Reader, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Makes a format known: its documents are those whose names end in one of ``suffixes`` (with the dot), read by ``reader``.

    A name that is known is refused, and so is a suffix that another format has. ``check`` names documents that can't be read.
    """
    lower = tuple(s.lower() for s in suffixes)
    taken = {s for known in FORMATS.values() for s in known} & set(lower)
    if name in FORMATS or taken:
        raise ValueError(f"format {name!r} or suffixes {sorted(taken)} are known already")
    FORMATS[name], READERS[name] = lower, reader
    if check:
        CHECKS[name] = check


def identities(documents: DataFrame, format_name: str) -> DataFrame:
    """run_id, format, filename, sha256, size_bytes, page_count (null without pages) and error (null: readable) of a reader's documents."""
    check = CHECKS.get(format_name)
    name = F.regexp_extract("run_id", "[^/]*$", 0)
    own = documents.select("run_id", F.lit(format_name).alias("format"), name.alias("filename"), "sha256", F.col("size").cast("long").alias("size_bytes"), (F.col("page_count") if "page_count" in documents.columns else F.lit(None)).cast("int").alias("page_count"))
    wrong = check(documents).select("run_id", F.col("why").alias("error")) if check else documents.select("run_id", F.lit(None).cast("string").alias("error")).limit(0)
    return own.join(wrong, "run_id", "left")


def suffix_of(path: Column) -> Column:
    """The last suffix of the file name, lower-cased; a name that only starts with a dot or ends with one has none."""
    return F.lower(F.regexp_extract(path, r"[^/]+?(\.[^./]+)$", 1))


def format_of(path: Column) -> Column:
    """The format by suffix, null if none has it."""
    suffix = suffix_of(path)
    return F.coalesce(*(F.when(suffix.isin(*suffixes), F.lit(name)) for name, suffixes in FORMATS.items()))


def open_documents(spark: SparkSession, path: str, format_name: str | None = None) -> DataFrame:
    """The documents at a path, file or folder; a folder needs ``format_name``. PDF pages come decoded, as span tables."""
    name = format_name or next((n for n, suffixes in FORMATS.items() if path.lower().endswith(suffixes)), None)
    if name not in READERS:
        raise UnsupportedFormatError(f"no reader for {path!r} as {name!r}; there are {sorted(READERS)}")
    return READERS[name](spark, path)
