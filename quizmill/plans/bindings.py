"""Deterministic inputs derived from the star-schema tables, said once for both engines in SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import tasks
from ..schemas import INTERACTION, ITEM

# Fixed definition of the derived bank: one run per order, one question per line.
BANK_SQL = """SELECT CAST(l_orderkey AS {string}) AS run_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS ordinal,
  concat('q', CAST(l_linenumber AS {string})) AS raw_id,
  CASE WHEN l_quantity >= 49 THEN NULL WHEN l_quantity >= 47 THEN '  ' ELSE concat(CAST(l_linenumber AS {string}), '.') END AS label,
  CASE l_partkey % 9 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'true_false' WHEN 3 THEN 'drag_and_drop' WHEN 4 THEN 'matching'
    WHEN 5 THEN 'ordering' WHEN 6 THEN 'fill_in_blank' WHEN 7 THEN 'scenario' ELSE 'case_study' END AS type,
  CASE WHEN l_suppkey % 10 = 0 OR l_partkey % 9 IN (0, 1, 2, 7, 8) THEN 'choice' WHEN l_partkey % 9 = 3 THEN 'drag_and_drop'
    WHEN l_partkey % 9 = 4 THEN 'matching' WHEN l_partkey % 9 = 5 THEN 'ordering' ELSE 'fill_in_blank' END AS kind,
  CASE l_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' WHEN 2 THEN 'a,b,c' WHEN 3 THEN 'a,b,a' ELSE 'a,b,c,d' END AS ids_csv,
  CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'b,a' WHEN 3 THEN 'c' WHEN 4 THEN 'z,z' ELSE 'c,b,a' END AS refs_csv,
  CASE WHEN l_discount < 0.01 THEN 0 ELSE 1 END AS stem_blocks,
  CASE l_returnflag WHEN 'R' THEN 'g1' WHEN 'A' THEN 'g2' ELSE NULL END AS group_id,
  CAST(l_partkey % 3 AS INT) AS image_shift
FROM lineitem"""

#: The lists of BANK_SQL.
LISTS = {"ids_csv": ("a", "a,b", "a,b,c", "a,b,a", "a,b,c,d"), "refs_csv": ("a", "b,a", "c", "z,z", "c,b,a")}

LINE_SQL = """CASE WHEN n = 1 AND doc_id % 11 = 0 THEN concat('Scenario 1: ', l) WHEN n = 1 AND doc_id % 7 = 0 THEN l
  WHEN n % 9 = 1 THEN concat(CAST(CAST(floor((n + 8) / 9.0) AS INT) AS {string}), '. ', l)
  WHEN n % 9 = 3 THEN concat('A. ', l) WHEN n % 9 = 4 THEN concat('B. ', l) WHEN n % 9 = 5 THEN concat('C. ', l) WHEN n % 9 = 6 THEN concat('D. ', l)
  WHEN n % 9 = 7 THEN concat('Answer: ', CASE (doc_id + n) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A, C' WHEN 2 THEN 'A and C' ELSE 'see appendix' END)
  WHEN n % 9 = 8 AND doc_id % 3 <> 0 THEN concat('Explanation: ', l) ELSE l END AS text,
(n % 9 = 0) AS mono, CAST(floor((n - 1) / 40.0) AS INT) + 1 AS page, 72.0E0 + 16.0E0 * ((n - 1) % 40) AS y0,
CASE WHEN n % 9 = 0 THEN 72.0E0 + 6.0E0 * (doc_id % 5) ELSE 72.0E0 END AS x0"""

#: Questions, groups, pictures and members of a bank whose runs repeat ids: as written, before they are normalised.
GIVEN_SQL = "CASE WHEN ordinal % 4 = 0 THEN ' ' WHEN ordinal % 3 = 0 THEN 'q1' ELSE raw_id END"
ASSET_SQL = "CASE WHEN ordinal % 5 = 0 THEN '' ELSE concat('a', CAST(ordinal % 2 AS {string})) END"
RAW_SQL = f"""SELECT run_id, ordinal, {GIVEN_SQL} AS given,
  {ASSET_SQL} AS asset FROM bank"""


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df.createOrReplaceTempView(name)
    return df


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir; one of its own only where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes = {"lock": threading.Lock(), "open": 0, "before": None}


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind; the setting is as before once no thread is inside any more."""
    with _writes["lock"]:
        if not _writes["open"]:
            _writes["before"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writes["open"] += 1
    try:
        yield
    finally:
        with _writes["lock"]:
            _writes["open"] -= 1
            if not _writes["open"]:
                spark.conf.unset(_CLEANUP) if _writes["before"] is None else spark.conf.set(_CLEANUP, _writes["before"])


def written(df: DataFrame) -> DataFrame:
    """df as a table in the cluster's shared folder, read again: plans over it stay short, and no lost executor takes it along.

    The folder is that of ``scratch``. Its tables go as the driver ends, the shuffle files of the write as it ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/bank-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        shutil.rmtree(path, ignore_errors=True)


def bank_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks to number the bank's lines in, and to settle their ids."""
    return tasks(_view(spark, sf_dir, "lineitem"))


def flat_bank(spark: SparkSession, sf_dir: str, parts: int | None = None, *more: str) -> DataFrame:
    """BANK_SQL: lines are numbered as they are read, narrow, and its texts made of the numbered ones, so that these are neither shuffled nor sorted.

    parts: how many tasks to number them in, for readers of the numbers; None: as Spark's settings have it, and not at all
    where nothing reads the numbers. more: columns of the table to have beside these; by l_orderkey, lines stay dealt as they are.
    """
    columns = _columns(BANK_SQL.format(string="STRING").removeprefix("SELECT ").removesuffix("FROM lineitem"))
    numbers = [c.rpartition(" AS ") for c in columns if " OVER " in c]
    lines = _view(spark, sf_dir, "lineitem")
    lines = lines.repartition(parts, "l_orderkey") if parts else lines
    rows = lines.withColumns({name: F.expr(number) for number, _, name in numbers})
    made = {name for *_, name in numbers}
    return rows.selectExpr(*(c.rpartition(" AS ")[2] if c.rpartition(" AS ")[2] in made else c for c in columns), *more)


def bank(spark: SparkSession, sf_dir: str, *more: str, flat: DataFrame | None = None) -> DataFrame:
    """The derived bank in the shape of schemas.QUESTION; each explanation ends with an image block of asset a<ordinal + shift - 1>.

    more: columns of ``flat_bank`` to have beside these. flat: its rows, where they are written already.
    """
    text = lambda x: F.struct(F.lit("text").alias("kind"), x.alias("text"), F.lit(None).cast("string").alias("language_hint"), F.lit(None).cast("string").alias("asset_id"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("array<array<string>>").alias("rows"))
    kind = lambda k, c: F.when(F.col("kind") == k, c)

    def each(csv: str, one: Callable[[Column], Column], to: str) -> Column:
        """One entry a name; those of the lists that BANK_SQL makes are constants, others are split."""
        names = F.transform(f"_{csv}", one).cast(to)
        for known in LISTS[csv]:
            names = F.when(F.col(csv) == known, F.array(*(one(F.lit(x)) for x in known.split(","))).cast(to)).otherwise(names)
        return F.when(F.col(csv).isNull(), F.array().cast(to)).otherwise(names)

    rows = (flat_bank(spark, sf_dir) if flat is None else flat).withColumns({f"_{csv}": F.when(~F.col(csv).isin(*known), F.split(csv, ",")) for csv, known in LISTS.items()})
    rows = rows.withColumn("_refs", each("refs_csv", lambda r: r, "array<string>"))
    refs = F.col("_refs")
    item = each("ids_csv", lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("label"), F.array(text(x)).alias("content")), f"array<{ITEM}>")
    pair = lambda a, b: each("refs_csv", lambda r: F.struct(r.alias(a), r.alias(b)), f"array<struct<{a}: string, {b}: string>>")
    blanks = each("ids_csv", lambda x: F.struct(x.alias("id"), refs.alias("accepted")), "array<struct<id: string, accepted: array<string>>>")
    inter = F.struct(
        F.col("kind").alias("kind"), kind("choice", item).alias("options"), kind("choice", refs).alias("correct_option_ids"), kind("ordering", item).alias("items"), kind("ordering", refs).alias("correct_order"),
        kind("matching", item).alias("left"), kind("matching", item).alias("right"), kind("matching", pair("left_id", "right_id")).alias("pairs"),
        kind("drag_and_drop", item).alias("tokens"), kind("drag_and_drop", item).alias("targets"), kind("drag_and_drop", pair("token_id", "target_id")).alias("placements"), kind("fill_in_blank", blanks).alias("blanks"),
    ).cast(INTERACTION)
    picture = F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("language_hint"), F.concat(F.lit("a"), F.col("ordinal") + F.col("image_shift") - 1).alias("asset_id"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("array<array<string>>").alias("rows"))
    words = text(F.concat(F.lit("stem of "), F.col("raw_id")))
    stem = F.when(F.col("stem_blocks") > 0, F.array(words)).otherwise(F.slice(F.array(words), 1, 0))
    return rows.select(
        "run_id", F.col("ordinal").alias("item_seq"), F.col("raw_id").alias("id"), F.struct("ordinal", "label", F.array().cast("array<int>").alias("pages")).alias("source"), "type", "group_id", stem.alias("stem"), inter.alias("interaction"), F.array(text(F.lit("why")), picture).alias("explanation"), *more
    )


def bank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g1 for orders of status F, g2 for all, before the questions; members q1 to q4."""
    orders = _view(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), "o_orderstatus")
    ids = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("g1"), F.lit("g2"))).otherwise(F.array(F.lit("g2")))
    return orders.select("run_id", F.lit(0).alias("item_seq"), F.explode(ids).alias("id"), F.lit("scenario").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<struct<kind: string, text: string, asset_id: string, rows: array<array<string>>>>").alias("context"), F.array(*(F.lit(f"q{i}") for i in range(1, 5))).alias("question_ids"))


def bank_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question stores the asset a<ordinal>."""
    return flat_bank(spark, sf_dir).select("run_id", F.col("ordinal").alias("item_seq"), F.concat(F.lit("a"), "ordinal").alias("id"), F.concat(F.lit("a"), "ordinal", F.lit(".png")).alias("filename"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _view(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l")).withColumn("n", F.col("p") + 1)
    made = docs.selectExpr("doc_id", "n AS line_no", *_columns(LINE_SQL.format(string="STRING")))
    span = F.struct("text", "x0", (F.col("x0") + 6.0 * F.length("text")).alias("x1"))
    return made.withColumns({"y1": F.col("y0") + 10.0, "spans": F.array(span)})


def _columns(sql: str) -> list[str]:
    out, depth, start = [], 0, 0
    quoted = False
    words = sql + ","
    for i, c in enumerate(words):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(words[start:i].strip())
            start = i + 1
    return out


BANK = "bank AS (SELECT *, string_split(ids_csv, ',') AS ids, CASE WHEN refs_csv IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(refs_csv, ',') END AS refs FROM (" + BANK_SQL.format(string="VARCHAR") + "))"
LINES = (
    "raw AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), "
    "lines AS (SELECT doc_id, n AS line_no, " + LINE_SQL.format(string="VARCHAR") + " FROM raw)"
)
