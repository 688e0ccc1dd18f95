"""Registered queries over the derived inputs, each with the same question in DuckDB's SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_text
from ..operators import grading, layout, normalize, report, rules
from .bindings import BANK, LINES, bank, bank_assets, bank_groups, bank_tasks, doc_lines, flat_bank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def csv(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


# -- rules ------------------------------------------------------------------------------------------------------------
DUP = "list_filter(ids, lambda x, i: list_contains(ids[1:i - 1], x))"
LOST = "list_filter(refs, lambda r: NOT list_contains(ids, r))"
N, M = "CAST(len(ids) AS VARCHAR)", "CAST(len(refs) AS VARCHAR)"
PARTS = {
    "missing_label": [("missing_question_label", "label IS NULL OR trim(label) = ''", "''")],
    "empty_stem": [("empty_stem", "stem_blocks = 0", "''")],
    "type_mismatch": [("interaction_type_mismatch", "type NOT IN ('scenario', 'case_study') AND kind <> CASE WHEN type IN ('single_choice', 'multiple_choice', 'true_false') THEN 'choice' ELSE type END", "kind")],
    "choice_options": [("missing_options", "kind = 'choice' AND len(ids) < 2", N), ("duplicate_option_ids", f"kind = 'choice' AND len({DUP}) > 0", f"array_to_string({DUP}, ',')")],
    "choice_answers": [("missing_correct_answer", "kind = 'choice' AND len(refs) = 0", "''"), ("invalid_answer_reference", f"kind = 'choice' AND len({LOST}) > 0", f"array_to_string({LOST}, ',')")],
    "answer_count": [("answer_count_mismatch", "kind = 'choice' AND type = 'single_choice' AND len(refs) > 1", M), ("answer_count_mismatch", "kind = 'choice' AND type = 'true_false' AND len(ids) <> 2", N), ("answer_count_mismatch", "kind = 'choice' AND type = 'true_false' AND len(refs) > 1", M)],
    "ordering": [("invalid_ordering", f"kind = 'ordering' AND len({DUP}) > 0", f"array_to_string({DUP}, ',')"), ("missing_correct_answer", "kind = 'ordering' AND len(refs) = 0", "''"), ("invalid_ordering", "kind = 'ordering' AND len(refs) > 0 AND list_sort(refs) <> list_sort(ids)", "''")],
}
for _kind, _code, _name in (("matching", "invalid_matching_pairs", "matching"), ("drag_and_drop", "invalid_drag_drop_mapping", "drag_drop")):
    PARTS[_name] = [(_code, f"kind = '{_kind}' AND len({DUP}) > 0", f"array_to_string(list_concat({DUP}, {DUP}), ',')"), ("missing_correct_answer", f"kind = '{_kind}' AND len(refs) = 0", "''")] + 2 * [(_code, f"kind = '{_kind}' AND len({LOST}) > 0", f"array_to_string({LOST}, ',')")]
PARTS["blanks"] = [("missing_correct_answer", "kind = 'fill_in_blank' AND len(ids) = 0", "''"), ("duplicate_blank_ids", f"kind = 'fill_in_blank' AND len({DUP}) > 0", "array_to_string(ids, ',')")]
BARE = "SELECT run_id, ordinal, 'missing_correct_answer', unnest(ids) FROM bank WHERE kind = 'fill_in_blank' AND len(refs) = 0"


def _rule_sql(*names: str) -> str:
    parts = [f"SELECT run_id, ordinal AS item_seq, '{code}' AS code, {args} AS args FROM bank WHERE {when}" for name in names for code, when, args in PARTS[name]]
    return f"WITH {BANK} " + " UNION ALL ".join(parts + [BARE] * ("blanks" in names))


RULES = {"missing_label": rules.missing_label, "empty_stem": rules.empty_stem, "type_mismatch": rules.type_mismatch, "ordering": rules.ordering_answers, "matching": rules.matching_answers, "drag_drop": rules.drag_drop_answers, "blanks": rules.blank_answers}
CHOICE = {"choice_options": ("missing_options", "duplicate_option_ids"), "choice_answers": ("missing_correct_answer", "invalid_answer_reference"), "answer_count": ("answer_count_mismatch",)}


def _register_rules() -> None:
    for name in PARTS:
        def run(spark: SparkSession, sf_dir: str, name: str = name) -> DataFrame:
            found = rules.row_issues(bank(spark, sf_dir), [RULES.get(name, rules.choice_answers)])
            if name in CHOICE:
                found = found.where(F.col("code").isin(*CHOICE[name]))
            return found.select("run_id", "item_seq", "code", csv("args"))

        QUERIES[f"rule_{name}"] = run
        ORACLES[f"rule_{name}"] = _rule_sql(name)


_register_rules()
ALL_ISSUES = "issues AS (" + _rule_sql(*PARTS).removeprefix(f"WITH {BANK} ") + ")"
GROUPS = "groups AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, unnest(CASE WHEN o_orderstatus = 'F' THEN ['g1', 'g2'] ELSE ['g2'] END) AS id FROM orders)"
MEMBERS = "members AS (SELECT run_id, id AS group_id, unnest(['q1', 'q2', 'q3', 'q4']) AS member FROM groups)"
LATE = "SELECT run_id, ordinal AS item_seq, 'a' || CAST(ordinal + image_shift - 1 AS VARCHAR) AS asset_id, image_shift, max(ordinal) OVER (PARTITION BY run_id) AS last FROM bank"


@query(f"WITH {BANK}, {ALL_ISSUES}, n AS (SELECT run_id, item_seq, count(*) AS k FROM issues GROUP BY ALL), c AS (SELECT run_id, count(*) AS groups FROM ({'SELECT CAST(o_orderkey AS VARCHAR) AS run_id, unnest(CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN [1, 2] ELSE [2] END) FROM orders'}) GROUP BY 1) "
       "SELECT b.run_id, count(*) AS imported, count(n.k) AS review, CAST(0 AS BIGINT) AS skipped, CAST(coalesce(sum(n.k), 0) AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS errors, coalesce(max(c.groups), 0) AS groups, count(*) AS images "
       "FROM bank b LEFT JOIN n ON b.run_id = n.run_id AND b.ordinal = n.item_seq LEFT JOIN c ON b.run_id = c.run_id GROUP BY b.run_id")
def needs_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = rules.with_issues(bank(spark, sf_dir))
    return report.summary(report.results(questions), bank_groups(spark, sf_dir), bank_assets(spark, sf_dir))


@query(f"WITH {BANK}, k AS (SELECT run_id, ordinal, raw_id, row_number() OVER w AS k, first_value(ordinal) OVER w AS f FROM bank WINDOW w AS (PARTITION BY run_id, raw_id ORDER BY ordinal)) SELECT run_id, ordinal AS item_seq, raw_id || ',' || CAST(f AS VARCHAR) AS args FROM k WHERE k > 1")
def rule_duplicate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicate_ids(bank(spark, sf_dir)).select("run_id", "item_seq", csv("args"))


@query(f"WITH {BANK}, {GROUPS} SELECT b.run_id, ordinal AS item_seq, group_id AS args FROM bank b ANTI JOIN groups g ON b.run_id = g.run_id AND b.group_id = g.id WHERE group_id IS NOT NULL")
def rule_unknown_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unknown_groups(bank(spark, sf_dir), bank_groups(spark, sf_dir)).select("run_id", "item_seq", csv("args"))


@query(f"WITH {BANK}, {GROUPS} SELECT b.run_id, ordinal AS item_seq, group_id || ',' || raw_id AS args FROM bank b JOIN groups g ON b.run_id = g.run_id AND b.group_id = g.id WHERE raw_id NOT IN ('q1', 'q2', 'q3', 'q4')")
def rule_group_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.group_mismatches(bank(spark, sf_dir), bank_groups(spark, sf_dir)).select("run_id", "item_seq", csv("args"))


@query(f"WITH {BANK}, {GROUPS}, {MEMBERS} SELECT m.run_id, group_id || ',' || member AS args FROM members m ANTI JOIN bank b ON m.run_id = b.run_id AND m.member = b.raw_id")
def rule_missing_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_members(bank(spark, sf_dir), bank_groups(spark, sf_dir)).select("run_id", csv("args"))


@query(f"WITH {BANK}, late AS ({LATE}) SELECT run_id, item_seq, 'explanation,' || asset_id AS args FROM late WHERE image_shift = 2 OR (image_shift = 0 AND item_seq = 1)")
def rule_missing_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_assets(bank(spark, sf_dir), bank_assets(spark, sf_dir)).select("run_id", "item_seq", csv("args"))


# -- ids, reports, previews -------------------------------------------------------------------------------------------
@query(f"WITH {BANK}, k AS (SELECT run_id, ordinal AS item_seq, raw_id, row_number() OVER (PARTITION BY run_id, raw_id ORDER BY ordinal) AS k FROM bank) SELECT run_id, item_seq, raw_id || CASE WHEN k > 1 THEN '-dup' || CAST(k AS VARCHAR) ELSE '' END AS id, k > 1 AS remapped FROM k")
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = bank_tasks(spark, sf_dir)
    items = flat_bank(spark, sf_dir, parts).select("run_id", F.col("ordinal").alias("item_seq"), F.col("raw_id").alias("id"))
    return normalize.unique_ids(items, "id", F.concat(F.lit("q"), "item_seq"), parts=parts).select("run_id", "item_seq", "id", "remapped")


@query(f"WITH {BANK} SELECT run_id, ordinal AS item_seq, CASE WHEN image_shift = 1 THEN 'n' || CAST(ordinal AS VARCHAR) ELSE 'a' || CAST(ordinal + image_shift - 1 AS VARCHAR) END AS asset_id FROM bank")
def remap_asset_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    remaps = flat_bank(spark, sf_dir).select("run_id", F.col("ordinal").alias("item_seq"), F.concat(F.lit("a"), "ordinal").alias("old"), F.concat(F.lit("n"), "ordinal").alias("new"), F.lit(1).alias("seq"))
    return normalize.remap_questions(bank(spark, sf_dir), remaps).select("run_id", "item_seq", F.col("explanation")[1]["asset_id"].alias("asset_id"))


@query(f"WITH {BANK}, {ALL_ISSUES}, n AS (SELECT DISTINCT run_id, item_seq FROM issues) SELECT b.run_id, count(*) - count(n.run_id) AS imported, count(n.run_id) AS needs_review, CAST(0 AS BIGINT) AS failed FROM bank b LEFT JOIN n ON b.run_id = n.run_id AND b.ordinal = n.item_seq GROUP BY b.run_id")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_counts(report.results(rules.with_issues(bank(spark, sf_dir))))


@query(f"WITH {BANK}, {ALL_ISSUES} SELECT run_id, CAST(0 AS BIGINT) AS infos, count(*) AS warnings, CAST(0 AS BIGINT) AS errors FROM issues GROUP BY run_id")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(rules.row_issues(bank(spark, sf_dir)))


@query(f"WITH {BANK}, {GROUPS}, t AS (SELECT run_id, 'q' AS w FROM bank UNION ALL SELECT run_id, 'a' FROM bank UNION ALL SELECT run_id, 'g' FROM groups) SELECT run_id, count(*) FILTER (w = 'q') AS questions, count(*) FILTER (w = 'g') AS groups, count(*) FILTER (w = 'a') AS assets FROM t GROUP BY run_id")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.manifest_counts(bank(spark, sf_dir), bank_groups(spark, sf_dir), bank_assets(spark, sf_dir))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 1 AS ordinal FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def empty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("run_id"))
    return report.runs_with_nothing(runs, flat_bank(spark, sf_dir)).select("run_id", "ordinal")


@query(f"WITH {BANK}, {ALL_ISSUES}, r AS (SELECT b.run_id, b.ordinal, b.raw_id, EXISTS (SELECT 1 FROM issues i WHERE i.run_id = b.run_id AND i.item_seq = b.ordinal) AS bad FROM bank b), l AS (SELECT run_id, raw_id, arg_max(bad, ordinal) AS bad FROM r GROUP BY ALL) "
       "SELECT b.run_id, b.ordinal AS item_seq, b.raw_id AS id, CASE WHEN stem_blocks > 0 THEN 'stem of ' || b.raw_id ELSE '' END AS stem_text, CASE WHEN kind = 'choice' THEN array_to_string(list_transform(ids, lambda x: x || ':' || x || ':' || CASE WHEN list_contains(refs, x) THEN 'true' ELSE 'false' END), ',') ELSE '' END AS choices, "
       "CASE WHEN l.bad THEN 'needs_review' ELSE 'imported' END AS status FROM bank b JOIN l ON b.run_id = l.run_id AND b.raw_id = l.raw_id")
def preview_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = report.reviewed_previews(rules.with_issues(bank(spark, sf_dir)))
    return shown.withColumn("choices", F.array_join(F.transform("choices", lambda c: F.concat_ws(":", c["id"], c["text"], c["is_correct"].cast("string"))), ","))


@query(f"WITH {BANK}, late AS ({LATE}) SELECT run_id, item_seq, asset_id, CASE WHEN item_seq + image_shift - 1 BETWEEN 1 AND last THEN asset_id || '.png' END AS filename FROM late")
def preview_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.preview_images(bank(spark, sf_dir), bank_assets(spark, sf_dir)).select("run_id", "item_seq", "asset_id", "filename")


@query(f"WITH {BANK} SELECT run_id, ordinal AS item_seq, 'why' || chr(10) || '[image a' || CAST(ordinal + image_shift - 1 AS VARCHAR) || ']' AS text FROM bank")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).select("run_id", "item_seq", plain_text(F.col("explanation")).alias("text"))


SHOWN = "CASE kind WHEN 'matching' THEN list_concat(ids, ids) WHEN 'drag_and_drop' THEN list_concat(ids, ids) WHEN 'fill_in_blank' THEN CAST([] AS VARCHAR[]) ELSE ids END"


@query(f"WITH {BANK}, p AS (SELECT run_id, ordinal AS item_seq, list_concat(CASE WHEN stem_blocks > 0 THEN ['stem'] ELSE CAST([] AS VARCHAR[]) END, list_transform({SHOWN}, lambda x: 'item ''' || x || ''''), ['explanation', 'explanation']) AS places FROM bank) SELECT run_id, item_seq, CAST(generate_subscripts(places, 1) - 1 AS INT) AS pos, unnest(places) AS place FROM p")
def iter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.iter_blocks(bank(spark, sf_dir)).select("run_id", "item_seq", "pos", "place")


@query(f"WITH {BANK}, {GROUPS}, {MEMBERS} SELECT m.run_id, m.group_id, string_agg(b.raw_id, ',' ORDER BY b.ordinal) AS ids FROM members m JOIN bank b ON m.run_id = b.run_id AND m.member = b.raw_id GROUP BY ALL")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = bank_groups(spark, sf_dir).select("run_id", F.col("id").alias("group_id"), F.explode("question_ids").alias("id"))
    found = wanted.join(bank(spark, sf_dir).select("run_id", "id", "item_seq"), ["run_id", "id"])
    return found.groupBy("run_id", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "id"))), lambda s: s["id"]), ",").alias("ids"))


# -- grading ----------------------------------------------------------------------------------------------------------
def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question answered with its ids' first two (choices) or its ids in order."""
    ids = F.coalesce(F.transform(F.coalesce("interaction.options", "interaction.items"), lambda i: i["id"]), F.array().cast("array<string>"))
    answer = F.struct(F.col("interaction.kind").alias("kind"), F.slice(ids, 1, 2).alias("selected"), ids.alias("order"), F.create_map().cast("map<string,string>").alias("values"))
    return bank(spark, sf_dir).withColumn("answer", answer)


@query(f"WITH {BANK}, s AS (SELECT *, ids[1:2] AS given FROM bank WHERE kind = 'choice') SELECT run_id, ordinal AS item_seq, len(given) = len(refs) AND len(list_filter(given, lambda x: NOT list_contains(refs, x))) = 0 AS correct FROM s")
def grade_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).where("interaction.kind = 'choice'").select("run_id", "item_seq", grading.is_correct().alias("correct"))


@query(f"WITH {BANK} SELECT run_id, ordinal AS item_seq, ids = refs AS correct FROM bank WHERE kind = 'ordering'")
def grade_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).where("interaction.kind = 'ordering'").select("run_id", "item_seq", grading.is_correct().alias("correct"))


TURNS = "SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"


@query(f"WITH t AS ({TURNS}) SELECT conv_id, turn, turn % 3 <> 2 AS correct FROM t WHERE role = 'user' AND next = 'assistant' AND reply IS NOT NULL AND trim(reply) <> ''")
def grade_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as blanks that accept the assistant's reply; two thirds answer with it in upper case or with spaces around."""
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    turns = spark.sql(TURNS).where("role = 'user' AND next = 'assistant' AND reply IS NOT NULL AND trim(reply) <> ''")
    given = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), "reply", F.lit("\t"))).when(F.col("turn") % 3 == 1, F.col("reply")).otherwise(F.concat("reply", F.lit("!")))
    inter = F.struct(F.lit("fill_in_blank").alias("kind"), F.array(F.struct(F.lit("b1").alias("id"), F.array("reply").alias("accepted"))).alias("blanks"), *(F.array().cast("array<string>").alias(x) for x in ("correct_option_ids", "correct_order")))
    answer = F.struct(F.lit("fill_in_blank").alias("kind"), F.create_map(F.lit("b1"), given).alias("values"), *(F.array().cast("array<string>").alias(x) for x in ("selected", "order")))
    return turns.select("conv_id", "turn", inter.alias("interaction"), answer.alias("answer")).select("conv_id", "turn", grading.is_correct().alias("correct"))


@query("SELECT user_id AS learner_id, count(*) FILTER (event_type <> 'view') AS submitted, count(*) FILTER (event_type <> 'view' AND event_type = 'purchase') AS correct FROM events GROUP BY 1")
def score_by_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: all but views are submitted, purchases are right."""
    answers = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("learner_id"), (F.col("event_type") != "view").alias("submitted"), (F.col("event_type") == "purchase").alias("is_correct"))
    return grading.scores(answers)


# -- geometry ---------------------------------------------------------------------------------------------------------
BOX = "[x0, y0, x0 + 100.0E0, y0 + 10.0E0]"


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = doc_lines(spark, sf_dir).select("doc_id", "page", "line_no", F.array(F.col("x0"), F.col("y0"), F.col("x0") + 100.0, F.col("y0") + 10.0).alias("bbox"))
    pages = rows.select("doc_id", "page").distinct()
    top = 72.0 + 16.0 * (F.col("doc_id") % 30)
    return rows, pages.select("doc_id", "page", F.array(F.lit(71.0), top + 1.0, F.lit(180.0), top + 60.0).alias("bbox"))


@query(f"WITH {LINES} SELECT doc_id, page, CAST(line_no AS INT) AS line_no FROM lines WHERE NOT (x0 >= 69 AND y0 >= 71.0E0 + 16.0E0 * (doc_id % 30) AND x0 + 100 <= 182 AND y0 + 10 <= 134.0E0 + 16.0E0 * (doc_id % 30))")
def table_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tables = _boxes(spark, sf_dir)
    return layout.outside_tables(rows, tables).select("doc_id", "page", "line_no")


@query(f"WITH {LINES}, p AS (SELECT doc_id, page, count(*) AS n FROM lines GROUP BY ALL), b AS (SELECT doc_id, page, 100.0E0 AS x0, 60.0E0 AS y0, 100.0E0 + 10.0E0 * n AS x1, 60.0E0 + 15.0E0 * n AS y1 FROM p) SELECT doc_id, page, least(x1, 400.0E0) AS x1, least(y1, 500.0E0) AS y1 FROM b WHERE (x1 - x0) * (y1 - y0) >= 1500 AND (x1 - x0) * (y1 - y0) <= 0.85E0 * 400 * 500 "
       "AND NOT ((x0 + least(x1, 400.0E0)) / 2 BETWEEN 71 AND 180 AND (y0 + least(y1, 500.0E0)) / 2 BETWEEN 73.0E0 + 16.0E0 * (doc_id % 30) AND 132.0E0 + 16.0E0 * (doc_id % 30))")
def figure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tables = _boxes(spark, sf_dir)
    pages = rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    clusters = pages.select("doc_id", "page", F.array(F.lit(100.0), F.lit(60.0), 100.0 + 10.0 * F.col("n"), 60.0 + 15.0 * F.col("n")).alias("bbox"))
    found = layout.figures(clusters, pages.select("doc_id", "page", F.lit(400.0).alias("width"), F.lit(500.0).alias("height")), tables)
    return found.select("doc_id", "page", F.col("bbox")[2].alias("x1"), F.col("bbox")[3].alias("y1"))


@query(f"WITH {LINES} SELECT doc_id, page, CAST(line_no AS INT) AS line_no, trim(text) <> '' AND (mono OR line_no % 5 = 0) AS mono FROM lines")
def mono_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = doc_lines(spark, sf_dir).select("doc_id", "page", "line_no", "text", F.when(F.col("mono"), 8).otherwise(4).alias("flags"), F.when(F.col("line_no") % 5 == 0, "Courier-Bold").otherwise("Times").alias("font"))
    return layout.mono_lines(spans)


# Page rectangles meet from top to bottom wherever the next begins within the gap, so clusters are runs of one column.
@query(f"""WITH {LINES}, r AS (SELECT doc_id, page, line_no, x0, y0 + 12.0E0 * (line_no // 3) AS y0, x0 + 100.0E0 AS x1, y0 + 12.0E0 * (line_no // 3) + 10.0E0 AS y1 FROM lines),
n AS (SELECT *, CASE WHEN y0 - 12 < lag(y1) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS cluster_no FROM n)
SELECT doc_id, page, CAST(cluster_no AS INT) AS cluster_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c GROUP BY ALL""")
def cluster_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' boxes, with a wider gap after every third line, in the order of their numbers."""
    y0 = F.col("y0") + 12.0 * F.floor(F.col("line_no") / 3)
    rows = doc_lines(spark, sf_dir).select("doc_id", "page", F.col("line_no").alias("rect_no"), F.array(F.col("x0"), y0, F.col("x0") + 100.0, y0 + 10.0).alias("bbox"))
    return layout.cluster_rects(rows).select("doc_id", "page", "cluster_no", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS uses, min(doc_id) AS first_id, 'a' || CAST(min(doc_id) AS VARCHAR) || '.png' AS filename FROM documents GROUP BY 1")
def asset_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as payloads: equal ones share a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    found = docs.groupBy(F.sha2("data", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("uses"), F.min("doc_id").alias("first_id"))
    named = normalize.stored_assets(found.select(F.concat(F.lit("a"), F.col("first_id").cast("string")).alias("id"), F.lit("image/png").alias("media_type"), F.lit(None).cast("binary").alias("data"), F.col("sha256").alias("digest"), "uses", "first_id"))
    return named.select(F.col("digest").alias("sha256"), "uses", "first_id", "filename")

