"""Queries over positioned lines, from segments to assembled questions and groups, each with its SQL.

The SQL is written from the format's rules, not from the operators: labels are cut after leading white space, what
follows a marker is sought from its first place in the line, and only question slices are classified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_text
from ..operators import lines
from .bindings import LINES, doc_lines
from .queries import query

# Fixed patterns of the format, as DuckDB spells them.
GROUP_HEADER = r"(?i)^(case\s+study|scenario)\b"
LABEL = r"(?i)^question\s+\d+\s*[:.)]?|^\d{1,4}[.)]"
OPTION = r"(?i)^([A-H])[.)]\s+(.*)$"
ANSWER = r"(?i)^(?:correct\s+)?answers?\s*[:.]\s*(.*)$"
EXPLANATION = r"(?i)^explanation\s*[:.]?\s*(.*)$"

SEGMENTED = rf"""{LINES},
m AS (SELECT *, CASE WHEN mono THEN NULL WHEN regexp_matches(trim(text), '{GROUP_HEADER}') THEN 'group'
    WHEN regexp_matches(trim(text), '{LABEL}') THEN 'question' END AS boundary FROM lines),
s AS (SELECT *, CAST(count(boundary) OVER w AS INT) AS slice_no, CAST(count(*) FILTER (boundary = 'question') OVER w AS INT) AS ordinal,
    CAST(count(*) FILTER (boundary = 'group') OVER w AS INT) AS group_no, last_value(boundary IGNORE NULLS) OVER w AS slice_kind
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0, x0, line_no ROWS UNBOUNDED PRECEDING))"""

FLOWED = f"""{SEGMENTED},
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slice_no ORDER BY page, y0, x0, line_no) AS flow_pos,
  CASE WHEN mono THEN 'mono' ELSE 'text' END AS item FROM s WHERE slice_no > 0)"""

CLASSIFIED = rf"""{FLOWED},
c0 AS (SELECT *, CASE WHEN boundary = 'question' THEN ltrim(substr(ltrim(text), length(regexp_extract(ltrim(text), '{LABEL}')) + 1)) ELSE text END AS body
  FROM f WHERE slice_kind = 'question'),
c1 AS (SELECT *, CASE WHEN item = 'mono' THEN 'mono' WHEN trim(body) = '' THEN 'blank' WHEN regexp_matches(trim(body), '{EXPLANATION}') THEN 'explanation'
  WHEN regexp_matches(trim(body), '{ANSWER}') THEN 'answer' WHEN regexp_matches(trim(body), '{OPTION}') THEN 'option' ELSE 'plain' END AS mark FROM c0),
c2 AS (SELECT *, min(flow_pos) FILTER (mark = 'answer') OVER w AS a0, min(flow_pos) FILTER (mark = 'explanation') OVER w AS e0
  FROM c1 WINDOW w AS (PARTITION BY doc_id, slice_no)),
c3 AS (SELECT *, min(flow_pos) FILTER (mark = 'plain' AND flow_pos > a0) OVER (PARTITION BY doc_id, slice_no) AS t0 FROM c2),
c4 AS (SELECT *, least(coalesce(e0, 2147483647), coalesce(t0, 2147483647)) AS e FROM c3),
c5 AS (SELECT *, coalesce(count(*) FILTER (mark = 'option' AND flow_pos < e) OVER w, 0) AS option_no, count(*) FILTER (mark = 'answer') OVER w AS answer_no,
    CASE WHEN mark = 'answer' THEN list_transform(regexp_extract_all(upper(regexp_extract(trim(body), '{ANSWER}', 1)), '\b([A-H])\b', 1), lambda x: lower(x)) END AS letters
  FROM c4 WINDOW w AS (PARTITION BY doc_id, slice_no ORDER BY flow_pos ROWS UNBOUNDED PRECEDING)),
c6 AS (SELECT *, CASE WHEN mark = 'answer' THEN 'answer' WHEN flow_pos >= e THEN 'explanation' WHEN option_no > 0 THEN 'option' ELSE 'stem' END AS role,
  CASE WHEN mark = 'explanation' THEN regexp_extract(trim(body), '{EXPLANATION}', 1)
    WHEN mark = 'option' AND flow_pos < e THEN regexp_extract(trim(body), '{OPTION}', 2) END AS suffix FROM c5),
c AS (SELECT *, CASE WHEN mark = 'answer' OR trim(suffix) = '' THEN NULL WHEN suffix IS NULL THEN body
  WHEN strpos(text, suffix) > 1 THEN ltrim(substr(text, strpos(text, suffix))) ELSE text END AS content FROM c6)"""

BLOCKS = rf"""{CLASSIFIED},
k AS (SELECT doc_id, slice_no, role, CASE WHEN role = 'option' THEN option_no ELSE 0 END AS option_no, flow_pos, item, content, page, y0 FROM c WHERE trim(content) <> ''
  UNION ALL SELECT doc_id, slice_no, 'context', 0, flow_pos, item, text, page, y0 FROM f WHERE slice_kind = 'group' AND boundary IS NULL AND trim(text) <> ''),
k1 AS (SELECT *, CASE WHEN lag(item) OVER w = item THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id, slice_no, role, option_no ORDER BY flow_pos)),
k2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, slice_no, role, option_no ORDER BY flow_pos) AS block_no FROM k1),
k3 AS (SELECT *, CASE WHEN item = 'mono' AND lag(page) OVER w = page AND y0 - lag(y0) OVER w > 18 THEN chr(10) ELSE '' END AS gap
  FROM k2 WINDOW w AS (PARTITION BY doc_id, slice_no, role, option_no, block_no ORDER BY flow_pos)),
b AS (SELECT doc_id, slice_no, role, CAST(option_no AS INT) AS option_no, CAST(block_no AS INT) AS block_no, CASE WHEN min(item) = 'mono' THEN 'verbatim' ELSE 'text' END AS kind,
  CAST(count(*) AS INT) AS n_items, string_agg(gap || content, chr(10) ORDER BY flow_pos) AS text FROM k3 GROUP BY ALL)"""

QUESTIONS = rf"""{BLOCKS},
said AS (SELECT doc_id, slice_no, role, option_no, string_agg(text, chr(10) ORDER BY block_no) AS said, arg_min(text, block_no) FILTER (kind = 'text') AS first FROM b GROUP BY ALL),
o AS (SELECT c.doc_id, c.slice_no, c.option_no, lower(regexp_extract(trim(body), '{OPTION}', 1)) AS id,
    rtrim(left(trim(body), length(trim(body)) - length(suffix))) AS label, coalesce(said.said, '') AS said, lower(trim(coalesce(said.first, ''))) AS first
  FROM c LEFT JOIN said ON c.doc_id = said.doc_id AND c.slice_no = said.slice_no AND said.role = 'option' AND c.option_no = said.option_no
  WHERE mark = 'option' AND flow_pos < e),
os AS (SELECT doc_id, slice_no, count(*) AS n_options, string_agg(id || '|' || label || '|' || said, ';' ORDER BY option_no) AS options, list_sort(list(DISTINCT first)) AS firsts FROM o GROUP BY ALL),
ls AS (SELECT doc_id, slice_no, flow_pos, generate_subscripts(letters, 1) AS i, unnest(letters) AS letter FROM c WHERE mark = 'answer'),
l1 AS (SELECT doc_id, slice_no, letter, min(flow_pos * 100 + i) AS place FROM ls GROUP BY ALL),
cs AS (SELECT doc_id, slice_no, count(*) AS n_correct, string_agg(letter, ',' ORDER BY place) AS correct FROM l1 GROUP BY ALL),
h AS (SELECT doc_id, slice_no, max(ordinal) AS ordinal, max(group_no) AS group_no, max(CASE WHEN boundary = 'question' THEN regexp_extract(ltrim(text), '{LABEL}') END) AS label,
  string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages FROM c GROUP BY ALL),
q AS (SELECT h.doc_id, h.slice_no, 'q' || CAST(ordinal AS VARCHAR) AS id, ordinal, h.label, pages, CASE WHEN group_no > 0 THEN 'g' || CAST(group_no AS VARCHAR) END AS group_id,
  coalesce(n_options, 0) AS n_options, coalesce(options, '') AS options, coalesce(correct, '') AS correct, coalesce(st.said, '') AS stem, coalesce(ex.said, '') AS explanation,
  CASE WHEN n_options IS NULL THEN 'single_choice' WHEN n_options = 2 AND firsts = ['false', 'true'] THEN 'true_false'
    WHEN coalesce(n_correct, 0) > 1 OR regexp_matches(coalesce(st.said, ''), '(?i)\(choose\s+(two|three|four|\d+)\b') THEN 'multiple_choice' ELSE 'single_choice' END AS type
  FROM h LEFT JOIN os ON h.doc_id = os.doc_id AND h.slice_no = os.slice_no LEFT JOIN cs ON h.doc_id = cs.doc_id AND h.slice_no = cs.slice_no
  LEFT JOIN said st ON h.doc_id = st.doc_id AND h.slice_no = st.slice_no AND st.role = 'stem'
  LEFT JOIN said ex ON h.doc_id = ex.doc_id AND h.slice_no = ex.slice_no AND ex.role = 'explanation')"""


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.segment(doc_lines(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classify(lines.flow(_segmented(spark, sf_dir)))


@query(f"WITH {SEGMENTED} SELECT doc_id, CAST(line_no AS INT) AS line_no, boundary, slice_no, ordinal, group_no FROM s")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("doc_id", "line_no", "boundary", "slice_no", "ordinal", "group_no")


@query(f"""WITH {SEGMENTED} SELECT doc_id, slice_no, count(*) AS n_lines, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages
FROM s WHERE slice_no > 0 GROUP BY ALL""")
def slice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.slices(_segmented(spark, sf_dir)).select("doc_id", "slice_no", "n_lines", _listed("pages").alias("pages"))


def _listed(pages: str) -> Column:
    return F.array_join(F.array_sort(F.transform(pages, lambda p: p.cast("string"))), ",")


@query(f"WITH {SEGMENTED} SELECT doc_id, count(*) AS n_lines, count(DISTINCT page) AS n_pages FROM s WHERE slice_no = 0 GROUP BY 1")
def preamble_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.preamble(_segmented(spark, sf_dir)).select("doc_id", "n_lines", F.size("pages").cast("long").alias("n_pages"))


@query(f"WITH {SEGMENTED} SELECT doc_id, ordinal, group_no FROM s WHERE boundary = 'question'")
def group_of_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.slices(_segmented(spark, sf_dir)).where("kind = 'question'").select("doc_id", "ordinal", "group_no")


OBJECTS = """SELECT DISTINCT doc_id, page, page * 10 + k AS obj_no, 72.0E0 + 16.0E0 * ((doc_id + k * 7) % 40) - 8.0E0 * (k % 2) AS y_center
FROM lines CROSS JOIN (VALUES (0), (1), (2)) AS v(k)"""
OWNED = f"""o AS ({OBJECTS}),
own AS (SELECT o.doc_id, o.page, o.obj_no, o.y_center, coalesce(max(s.slice_no), -1) AS slice_no FROM o LEFT JOIN s ON s.doc_id = o.doc_id AND s.boundary IS NOT NULL
  AND (s.page < o.page OR (s.page = o.page AND s.y0 <= o.y_center)) GROUP BY ALL)"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_lines(spark, sf_dir).createOrReplaceTempView("lines")
    return spark.sql(OBJECTS)


@query(f"WITH {SEGMENTED}, {OWNED} SELECT doc_id, page, obj_no, slice_no FROM own")
def owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.own_objects(_segmented(spark, sf_dir), _objects(spark, sf_dir)).fillna(-1, ["slice_no"])


@query(f"WITH {FLOWED} SELECT doc_id, slice_no, CAST(flow_pos AS INT) AS flow_pos, CAST(line_no AS INT) AS line_no FROM f")
def flow_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.flow(_segmented(spark, sf_dir)).select("doc_id", "slice_no", "flow_pos", "line_no")


@query(f"""WITH {FLOWED}, {OWNED},
a AS (SELECT doc_id, slice_no, page, y0 AS y, 0 AS rank, x0, line_no AS src, item FROM f
  UNION ALL SELECT doc_id, slice_no, page, y_center, CASE WHEN obj_no % 2 = 0 THEN 1 ELSE 2 END, NULL, obj_no, CASE WHEN obj_no % 2 = 0 THEN 'image' ELSE 'table' END FROM own WHERE slice_no > 0)
SELECT doc_id, slice_no, CAST(row_number() OVER (PARTITION BY doc_id, slice_no ORDER BY page, y, rank, x0 NULLS FIRST, src) AS INT) AS flow_pos, item, CAST(src AS INT) AS src FROM a""")
def flow_with_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of even numbers are images, of odd ones tables."""
    found, objects = _segmented(spark, sf_dir), _objects(spark, sf_dir)
    owned = lines.own_objects(found, objects).join(objects, ["doc_id", "page", "obj_no"]).where("slice_no > 0")
    owned = owned.withColumn("obj_kind", F.when(F.col("obj_no") % 2 == 0, "image").otherwise("table"))
    return lines.flow(found, owned).select("doc_id", "slice_no", "flow_pos", "item", F.col("src").cast("int").alias("src"))


@query(f"WITH {CLASSIFIED} SELECT doc_id, CAST(line_no AS INT) AS line_no, mark, role FROM c")
def classify_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "line_no", "mark", "role")


@query(f"WITH {QUESTIONS} SELECT doc_id, slice_no, CAST(option_no AS INT) AS option_no, id AS option_id, label, said AS content FROM o")
def option_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options with their letters, printed labels and whole contents."""
    found = lines.assemble_questions(_classified(spark, sf_dir))
    each = found.select(F.col("run_id").alias("doc_id"), F.col("item_seq").alias("slice_no"), F.posexplode("interaction.options").alias("n", "o"))
    return each.select("doc_id", "slice_no", (F.col("n") + 1).alias("option_no"), F.col("o.id").alias("option_id"), "o.label", plain_text(F.col("o.content")).alias("content"))


@query(f"WITH {CLASSIFIED} SELECT doc_id, CAST(line_no AS INT) AS line_no, array_to_string(list_sort(list_distinct(letters)), ',') AS letters FROM c WHERE mark = 'answer'")
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("mark = 'answer'").select("doc_id", "line_no", F.array_join(F.array_sort("letters"), ",").alias("letters"))


@query(f"WITH {QUESTIONS} SELECT doc_id, slice_no, n_options, type FROM q")
def infer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.question_types(_classified(spark, sf_dir)).select("doc_id", "slice_no", "n_options", "type")


@query(rf"""WITH {CLASSIFIED}
SELECT doc_id, CAST(line_no AS INT) AS line_no, 'multiple_answer_keys' AS code, trim(body) AS args FROM c WHERE mark = 'answer' AND answer_no > 1
UNION ALL SELECT doc_id, CAST(line_no AS INT), 'unparsed_answer_key', regexp_extract(trim(body), '{ANSWER}', 1) FROM c WHERE mark = 'answer' AND len(letters) = 0
UNION ALL SELECT doc_id, CAST(line_no AS INT), 'option_after_answer_key', trim(body) FROM c WHERE mark = 'option' AND flow_pos < e AND flow_pos > a0
UNION ALL SELECT doc_id, CAST(line_no AS INT), 'unmarked_text_after_answer', '' FROM c WHERE flow_pos = t0 AND t0 < coalesce(e0, 2147483647)""")
def classify_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _classified(spark, sf_dir).select("doc_id", "line_no", F.explode("line_issues").alias("i"))
    return each.select("doc_id", "line_no", "i.code", F.array_join("i.args", ",").alias("args"))


@query(f"WITH {BLOCKS} SELECT * FROM b")
def prose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every role: stem, option, explanation and, of groups, context."""
    flowed = lines.flow(_segmented(spark, sf_dir))
    items = lines.union_all(lines.classify(flowed), lines.contexts(flowed))
    return lines.content_blocks(items).select("doc_id", "slice_no", "role", "option_no", "block_no", "block.kind", "n_items", "block.text")


@query(f"WITH {QUESTIONS} SELECT doc_id, slice_no AS item_seq, id, ordinal, label, pages, group_id, type, options, correct, stem, explanation FROM q")
def assembled_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.assemble_questions(_classified(spark, sf_dir))
    options = F.array_join(F.transform("interaction.options", lambda o: F.concat(o["id"], F.lit("|"), o["label"], F.lit("|"), plain_text(o["content"]))), ";")
    return found.select(
        F.col("run_id").alias("doc_id"), "item_seq", "id", "source.ordinal", "source.label", _listed("source.pages").alias("pages"), "group_id", "type", options.alias("options"),
        F.array_join("interaction.correct_option_ids", ",").alias("correct"), plain_text(F.col("stem")).alias("stem"), plain_text(F.col("explanation")).alias("explanation"),
    )


@query(rf"""WITH {BLOCKS},
heads AS (SELECT doc_id, slice_no, group_no, trim(text) AS title, CASE WHEN lower(regexp_extract(trim(text), '{GROUP_HEADER}')) LIKE '%case%' OR regexp_matches(trim(text), '(?i)^scenario\b.*case') THEN 'case_study' ELSE 'scenario' END AS kind FROM s WHERE boundary = 'group'),
mem AS (SELECT doc_id, group_no, string_agg('q' || CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS members FROM s WHERE boundary = 'question' AND group_no > 0 GROUP BY ALL),
ctx AS (SELECT doc_id, slice_no, string_agg(text, chr(10) ORDER BY block_no) AS context FROM b WHERE role = 'context' GROUP BY ALL)
SELECT heads.doc_id, heads.slice_no AS item_seq, 'g' || CAST(heads.group_no AS VARCHAR) AS id, kind, title, coalesce(context, '') AS context, coalesce(members, '') AS members
FROM heads LEFT JOIN mem ON heads.doc_id = mem.doc_id AND heads.group_no = mem.group_no LEFT JOIN ctx ON heads.doc_id = ctx.doc_id AND heads.slice_no = ctx.slice_no""")
def assembled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's kind goes by its whole header, which a scenario's title may hold the word case in."""
    found = _segmented(spark, sf_dir)
    rows = lines.assemble_groups(found, lines.flow(found))
    return rows.select(F.col("run_id").alias("doc_id"), "item_seq", "id", "kind", "title", plain_text(F.col("context")).alias("context"), F.array_join("question_ids", ",").alias("members"))


@query(f"""WITH {LINES}, v AS (SELECT doc_id, page, line_no, text, x0, min(x0) OVER (PARTITION BY doc_id, page) AS b FROM lines WHERE mono)
SELECT doc_id, page, string_agg(repeat(' ', CAST(round_even((x0 - b) / 6.0, 0) AS INT)) || text, chr(10) || chr(10) ORDER BY line_no) AS text FROM v GROUP BY ALL""")
def verbatim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monospace lines of a page as one run of six-point characters; they are nine lines apart, so blank lines part them."""
    rows = doc_lines(spark, sf_dir).where("mono").withColumn("pos", F.col("line_no")).withColumn("page_no", F.col("page"))
    return lines.verbatim(rows, ("doc_id", "page_no")).select("doc_id", F.col("page_no").alias("page"), "text")
