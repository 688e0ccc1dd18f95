"""Bundles as lines: encoded, written, read by file and line, checked against models; each query with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import jsonlines
from .bindings import BANK, bank, scratch
from .queries import query

LISTED = """'[' || array_to_string(list_transform(ids, lambda x: '{"id":"' || x || '","label":null,"content":[{"kind":"text","text":"' || x || '"}]}'), ',') || ']'"""
REFS = """'[' || array_to_string(list_transform(refs, lambda x: '"' || x || '"'), ',') || ']'"""


def _pairs(a: str, b: str) -> str:
    return f"""'[' || array_to_string(list_transform(refs, lambda x: '{{"{a}":"' || x || '","{b}":"' || x || '"}}'), ',') || ']'"""


@query(f"""WITH {BANK} SELECT run_id, ordinal AS item_seq, '{{"id":"' || raw_id || '","source":{{"ordinal":' || ordinal || ',"label":' || coalesce('"' || label || '"', 'null') || ',"pages":[]}},"type":"' || type
  || '","group_id":' || coalesce('"' || group_id || '"', 'null') || ',"stem":' || CASE WHEN stem_blocks > 0 THEN '[{{"kind":"text","text":"stem of ' || raw_id || '"}}]' ELSE '[]' END || ',"interaction":{{"kind":"' || kind || '",'
  || CASE kind WHEN 'choice' THEN '"options":' || {LISTED} || ',"correct_option_ids":' || {REFS} WHEN 'ordering' THEN '"items":' || {LISTED} || ',"correct_order":' || {REFS}
    WHEN 'matching' THEN '"left":' || {LISTED} || ',"right":' || {LISTED} || ',"pairs":' || {_pairs("left_id", "right_id")}
    WHEN 'drag_and_drop' THEN '"tokens":' || {LISTED} || ',"targets":' || {LISTED} || ',"placements":' || {_pairs("token_id", "target_id")}
    ELSE '"blanks":[' || array_to_string(list_transform(ids, lambda x: '{{"id":"' || x || '","accepted":' || {REFS.replace("lambda x: '\"' || x", "lambda y: '\"' || y")} || '}}'), ',') || ']' END
  || '}},"explanation":[{{"kind":"text","text":"why"}},{{"kind":"image","asset_id":"a' || (ordinal + image_shift - 1) || '","caption":null}}]}}' AS line FROM bank""")
def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived bank's questions as lines: of blocks and interactions only the fields of their kind."""
    return bank(spark, sf_dir).select("run_id", "item_seq", jsonlines.question_line(F.col("interaction")).alias("line"))


# Group lines with mistakes by the order's number, in files by number modulo 16.
MADE = """SELECT o_orderkey AS k, o_orderkey % 16 AS part, o_orderkey % 11 AS d, o_custkey AS c FROM orders"""
BAD = {
    1: ("line: is not JSON",), 2: ("line: must be an object",), 4: ("surprise: unknown key",), 5: ("kind: must be one of scenario, case_study", "context: missing"),
    6: ("context[1].kind: must be one of verbatim, table, image, text",), 7: ("a: unknown key", "b: unknown key", "context[0].language_hint: unknown key"), 8: ("title: must be a string", "question_ids[1]: must be a string"), 9: ("context[0].rows[1]: must be a list",),
}
SAID = " ".join(f"WHEN {d} THEN '{'; '.join(said)}'" for d, said in BAD.items()).replace("verbatim, table, image, text", "text, verbatim, image, table")


@query(f"""WITH made AS ({MADE}), n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) AS line_no FROM made)
SELECT part, line_no, CASE d WHEN 0 THEN 'g' || k END AS id, CASE d {SAID} ELSE '' END AS problems FROM n WHERE d IN (0, {", ".join(map(str, BAD))})""")
def bundle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of written files by file and number, with what is wrong with each; blank ones only count."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    k, c, d = F.col("k"), F.col("c"), F.col("d")
    whole = lambda middle, title='null', kind="scenario", members='"q1"': text('{"id":"g', k, f'","kind":"{kind}","title":{title}', middle, f',"question_ids":[{members}]}}')
    context = text(',"context":[{"kind":"text","text":"customer ', c, '"}]')
    lines = {
        1: text('{"id":"g', k), 2: text("[", k, "]"), 3: F.lit(" \t"), 4: whole(text(context, ',"surprise":{}')), 5: whole("", kind="odd"), 6: whole(',"context":[{"kind":"table","rows":[]},{"kind":"odd"}]'),
        7: whole(',"b":1,"context":[{"kind":"text","text":"x","language_hint":null}],"a":2'), 8: whole(context, title="5", members='"q1",2'), 9: whole(',"context":[{"kind":"table","rows":[["a"],"b"]}]'), 10: F.lit(""),
    }
    made = whole(context, title='"t"')
    for n, line in lines.items():
        made = F.when(d == n, line).otherwise(made)
    path = f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
    spark.sql(MADE).select("part", "k", made.alias("value")).repartition("part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(path)
    found = jsonlines.check_lines(jsonlines.numbered_lines(spark, path), jsonlines.GROUP_MODEL)
    part = F.regexp_extract("file", r"part=(\d+)/", 1).cast("long")
    shown = F.when(F.size("problems") == 0, F.try_variant_get("value", "$.id", "string"))
    return found.select(part.alias("part"), "line_no", shown.alias("id"), F.array_join("problems", "; ").alias("problems"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'a' || o_custkey || '.png' WHEN 1 THEN '../x' || o_custkey WHEN 2 THEN 'a/../b.c' || o_custkey WHEN 3 THEN '..' || chr(92) || 'y' ELSE '/etc/z' END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN '/bundle/assets/a' || o_custkey || '.png' WHEN 2 THEN '/bundle/assets/a/../b.c' || o_custkey END AS path FROM orders""")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where stored files lie, and no path for a name that leads out of their folder."""
    m, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    name = F.when(m == 0, F.concat(F.lit("a"), c, F.lit(".png"))).when(m == 1, F.concat(F.lit("../x"), c)).when(m == 2, F.concat(F.lit("a/../b.c"), c)).when(m == 3, F.lit("..\\y")).otherwise(F.lit("/etc/z"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), name.alias("name"))
    return rows.withColumn("path", jsonlines.asset_path(F.lit("/bundle/assets"), F.col("name")))


@query(f"""WITH {BANK}, w AS (SELECT DISTINCT run_id, 'a' || (ordinal + image_shift - 1) AS name FROM bank UNION SELECT DISTINCT run_id, 'a' || ordinal || '.v1.png' FROM bank),
f AS (SELECT run_id, 'a' || ordinal || CASE ordinal % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.v1.png' ELSE '' END AS filename FROM bank)
SELECT w.run_id, name, coalesce(min(filename) FILTER (filename = name), min(filename)) AS filename FROM w LEFT JOIN f ON w.run_id = f.run_id AND (filename = name OR starts_with(filename, name || '.')) GROUP BY ALL""")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by their whole name or by what stands before a dot."""
    rows = bank(spark, sf_dir).select("run_id", "item_seq", F.col("explanation")[1]["asset_id"].alias("shown"))
    own = F.concat(F.lit("a"), F.col("item_seq").cast("string"))
    wanted = rows.select("run_id", F.explode(F.array("shown", F.concat(own, F.lit(".v1.png")))).alias("name"))
    stored = rows.select("run_id", F.concat(own, F.when(F.col("item_seq") % 3 == 0, ".png").when(F.col("item_seq") % 3 == 1, ".v1.png").otherwise("")).alias("filename"))
    return jsonlines.find_stored(wanted, stored)
