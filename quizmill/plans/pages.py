"""Decoded pages to items: made spans, tables, images and drawings over the lines of documents, each query with its SQL.

The SQL is written from the format's rules on what was made, not from the operators: clusters are runs of one column of
boxes, owners are joined by position, and notes go to the item with the least later time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_text
from ..operators import pages
from .bindings import LINES, doc_lines, written
from .documents import ANSWER, BLOCKS, CLASSIFIED, FLOWED, LABEL, QUESTIONS, SEGMENTED, _listed
from .queries import query

# Fixed definition of the made pages, in both engines' SQL: {list} makes a list, {string} names the type.
# Lines of up to two spans, a page's table over three lines, images, and a column of drawings, on some pages with a border.
MADE_SPANS = """SELECT doc_id, page, line_no, k AS span_no, CASE WHEN k = 0 THEN substr(text, 1, 5) ELSE substr(text, 6) END AS text,
  CASE WHEN NOT mono OR (k = 1 AND doc_id % 6 = 0) THEN 'Times' WHEN line_no % 2 = 0 THEN 'Courier-Bold' ELSE 'Plain' END AS font,
  CASE WHEN mono AND line_no % 2 = 1 AND NOT (k = 1 AND doc_id % 6 = 0) THEN 12 ELSE 4 END AS flags,
  {list}(x0 + 30.0E0 * k, y0, x0 + 30.0E0 * k + 6.0E0 * length(CASE WHEN k = 0 THEN substr(text, 1, 5) ELSE substr(text, 6) END), y0 + 10.0E0) AS bbox
FROM lines CROSS JOIN (VALUES (0), (1)) AS v(k)"""
MADE_PAGES = "SELECT doc_id, page, 400.0E0 AS width, 720.0E0 AS height FROM lines GROUP BY doc_id, page"
MADE_TABLES = """SELECT doc_id, page, 1 AS table_no, {list}(70.0E0, 70.5E0 + 16.0E0 * ((doc_id * 3 + page) % 30), 20000.0E0, 118.5E0 + 16.0E0 * ((doc_id * 3 + page) % 30)) AS bbox,
  (doc_id + page) % 3 = 0 AS filled, {list}({list}(concat('a', CAST(doc_id AS {string})), NULL), {list}(CAST(page AS {string}), 'x')) AS cells FROM made_pages WHERE (doc_id + page) % 3 < 2"""
MADE_IMAGES = """SELECT doc_id, page, k AS image_no, {list}(80.0E0, 75.25E0 + 16.0E0 * ((doc_id * 5 + page + 7 * k) % 38), 180.0E0, 135.25E0 + 16.0E0 * ((doc_id * 5 + page + 7 * k) % 38)) AS bbox,
  doc_id * 10 + k AS xref, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'jb2' ELSE 'webp' END AS ext, CASE WHEN doc_id % 7 = 0 THEN 'broken' END AS error
FROM made_pages CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE (doc_id + page + k) % 4 = 0"""
MADE_DRAWINGS = """SELECT doc_id, page, k AS rect_no, {list}(CASE k WHEN 9 THEN 0.0E0 ELSE 200.0E0 END, CASE k WHEN 8 THEN 300.0E0 WHEN 9 THEN 0.0E0 ELSE 80.0E0 + 90.0E0 * k END,
  CASE k WHEN 8 THEN 260.0E0 WHEN 9 THEN 400.0E0 ELSE 210.0E0 + 25.0E0 * ((doc_id + k) % 3) END,
  CASE k WHEN 8 THEN 300.0E0 WHEN 9 THEN 720.0E0 ELSE 150.0E0 + 90.0E0 * k + 10.0E0 * ((doc_id + k * page) % 3) END) AS bbox
FROM made_pages CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(k) WHERE k < 9 OR (doc_id + page) % 5 = 0"""
MADE_NOTES = """SELECT doc_id, page, 1 AS note_no, 'warning' AS severity, 'table_detection_failed' AS code, {list}(CAST(page AS {string}), 'made up') AS args FROM made_pages WHERE (doc_id + page) % 4 = 1"""
MADE = {"made_pages": MADE_PAGES, "made_spans": MADE_SPANS, "made_tables": MADE_TABLES, "made_images": MADE_IMAGES, "made_drawings": MADE_DRAWINGS, "made_notes": MADE_NOTES}
#: Slices that fail, of documents of which some have none.
FAILS = "(doc_id * 7 + slice_no) % 9 = 0"

DUCK = {name: sql.format(list="list_value", string="VARCHAR") for name, sql in MADE.items()}
PAGE_LINES = f"""{LINES.replace("lines AS (", "lines0 AS (", 1)},
made_pages AS ({DUCK["made_pages"].replace("FROM lines", "FROM lines0")}), made_tables AS ({DUCK["made_tables"]}), made_images AS ({DUCK["made_images"]}),
made_drawings AS ({DUCK["made_drawings"]}), made_notes AS ({DUCK["made_notes"]}), tb AS (SELECT * FROM made_tables WHERE filled),
lines AS (SELECT doc_id, line_no, text, mono AND NOT (doc_id % 6 = 0 AND trim(substr(text, 6)) <> '') AS mono, page, y0, x0 FROM lines0 l WHERE trim(text) <> ''
  AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = l.doc_id AND tb.page = l.page AND x0 >= bbox[1] - 2 AND y0 >= bbox[2] - 2 AND x0 + greatest(30, 6 * length(text)) <= bbox[3] + 2 AND y0 + 10 <= bbox[4] + 2))"""
PAGE_SEGMENTED = SEGMENTED.replace(LINES, PAGE_LINES)
PAGE_OBJECTS = f"""{PAGE_SEGMENTED},
d0 AS (SELECT *, bbox[2] AS top, bbox[4] AS low FROM made_drawings WHERE rect_no < 8 AND (doc_id + page) % 5 <> 0),
d1 AS (SELECT *, CASE WHEN top - 12 < lag(low) OVER (PARTITION BY doc_id, page ORDER BY rect_no) THEN 0 ELSE 1 END AS new FROM d0),
d2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY rect_no) AS no FROM d1),
d3 AS (SELECT doc_id, page, no, min(bbox[1]) AS x0, min(top) AS y0, max(bbox[3]) AS x1, max(low) AS y1 FROM d2 GROUP BY ALL),
d4 AS (SELECT doc_id, page, no, [x0, y0, x1, least(y1, 720)] AS bbox FROM d3 WHERE (x1 - x0) * (y1 - y0) BETWEEN 1500 AND 0.85E0 * 400 * 720),
ob AS (SELECT doc_id, page, image_no AS no, 0 AS rank, bbox, xref, ext, error, NULL AS cells FROM made_images
  UNION ALL SELECT doc_id, page, no, 1, bbox, NULL, NULL, NULL, NULL FROM d4 WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = d4.doc_id AND tb.page = d4.page
    AND (d4.bbox[1] + d4.bbox[3]) / 2 BETWEEN tb.bbox[1] AND tb.bbox[3] AND (d4.bbox[2] + d4.bbox[4]) / 2 BETWEEN tb.bbox[2] AND tb.bbox[4])
  UNION ALL SELECT doc_id, page, table_no, 2, bbox, NULL, NULL, NULL, array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), chr(9))), chr(10)) FROM tb),
o0 AS (SELECT *, (bbox[2] + bbox[4]) / 2 AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY rank // 2, CASE WHEN rank < 2 THEN (bbox[2] + bbox[4]) / 2 END, rank, no) AS obj_no FROM ob),
sk AS (SELECT doc_id, slice_no, min(page) AS page, arg_min(y0, line_no) AS y0, max(boundary) AS kind, max(ordinal) AS ordinal, max(group_no) AS group_no FROM s WHERE boundary IS NOT NULL GROUP BY ALL),
o1 AS (SELECT o0.doc_id, o0.page, o0.obj_no, max(sk.slice_no) AS slice_no FROM o0 JOIN sk ON sk.doc_id = o0.doc_id AND (sk.page < o0.page OR (sk.page = o0.page AND sk.y0 <= o0.y)) GROUP BY ALL),
o2 AS (SELECT o0.*, o1.slice_no, sk.kind AS slice_kind, sk.ordinal, sk.group_no, row_number() OVER (PARTITION BY o0.doc_id, o1.slice_no, rank < 2 ORDER BY o0.page, o0.y, o0.obj_no) AS asset_no
  FROM o0 JOIN o1 ON o0.doc_id = o1.doc_id AND o0.page = o1.page AND o0.obj_no = o1.obj_no JOIN sk ON sk.doc_id = o1.doc_id AND sk.slice_no = o1.slice_no),
obj AS (SELECT *, CASE WHEN rank < 2 THEN (CASE slice_kind WHEN 'question' THEN 'q' || CAST(ordinal AS VARCHAR) ELSE 'g' || CAST(group_no AS VARCHAR) END) || '-img' || CAST(asset_no AS VARCHAR) END AS asset_id FROM o2)"""
PAGE_FLOWED = f"""{PAGE_OBJECTS},
f0 AS (SELECT doc_id, slice_no, page, y0 AS y, 0 AS rank, x0, line_no AS src, CASE WHEN mono THEN 'mono' ELSE 'text' END AS item, text, boundary, slice_kind, ordinal, group_no, y0, NULL AS shown FROM s WHERE slice_no > 0
  UNION ALL SELECT doc_id, slice_no, page, y, 1 + rank // 2, NULL, obj_no, CASE WHEN rank < 2 THEN 'image' ELSE 'table' END, '', NULL, slice_kind, ordinal, group_no, NULL, CASE WHEN rank < 2 THEN '[image ' || asset_id || ']' ELSE cells END FROM obj),
f AS (SELECT *, src AS line_no, row_number() OVER (PARTITION BY doc_id, slice_no ORDER BY page, y, rank, x0 NULLS FIRST, src) AS flow_pos FROM f0)"""


def _with_objects(sql: str) -> str:
    """The SQL from classes to questions, with images and tables as blocks of their own that lines don't join."""
    changes = {
        "item, content, page, y0 FROM c WHERE trim(content) <> ''": "item, coalesce(shown, content) AS content, page, y0 FROM c WHERE trim(content) <> '' OR shown IS NOT NULL",
        "item, text, page, y0 FROM f WHERE slice_kind = 'group' AND boundary IS NULL AND trim(text) <> ''": "item, coalesce(shown, text), page, y0 FROM f WHERE slice_kind = 'group' AND boundary IS NULL AND (trim(text) <> '' OR shown IS NOT NULL)",
        "CASE WHEN lag(item) OVER w = item THEN 0": "CASE WHEN lag(item) OVER w = item AND item IN ('text', 'mono') THEN 0",
        "CASE WHEN min(item) = 'mono' THEN 'verbatim'": "CASE WHEN min(item) IN ('image', 'table') THEN min(item) WHEN min(item) = 'mono' THEN 'verbatim'",
        "ORDER BY CAST(page AS VARCHAR)) AS pages FROM c": "ORDER BY CAST(page AS VARCHAR)) FILTER (item IN ('text', 'mono')) AS pages FROM c",
    }
    for old, new in changes.items():
        sql = sql.replace(old, new)
    return sql


PAGE_BLOCKS = PAGE_FLOWED + _with_objects(BLOCKS[len(FLOWED) :])
PAGE_QUESTIONS = PAGE_FLOWED + _with_objects(QUESTIONS[len(FLOWED) :])
ISSUES = rf"""iss AS (SELECT doc_id, slice_no, 0 AS stage, asset_no AS pos, 0 AS n, CASE WHEN xref IS NULL THEN 'info:figure_cropped:' || CAST(page AS VARCHAR) || ',200'
    ELSE 'warning:image_extraction_failed:' || CAST(xref AS VARCHAR) || ',' || CAST(page AS VARCHAR) || ',' || error END AS issue FROM obj WHERE rank = 1 OR error IS NOT NULL
  UNION ALL SELECT doc_id, slice_no, 1, flow_pos, 1, 'warning:multiple_answer_keys:' || trim(body) FROM c WHERE mark = 'answer' AND answer_no > 1
  UNION ALL SELECT doc_id, slice_no, 1, flow_pos, 2, 'warning:unparsed_answer_key:' || regexp_extract(trim(body), '{ANSWER}', 1) FROM c WHERE mark = 'answer' AND len(letters) = 0
  UNION ALL SELECT doc_id, slice_no, 1, flow_pos, 3, 'warning:option_after_answer_key:' || trim(body) FROM c WHERE mark = 'option' AND flow_pos < e AND flow_pos > a0
  UNION ALL SELECT doc_id, slice_no, 1, flow_pos, 4, 'warning:unmarked_text_after_answer:' FROM c WHERE flow_pos = t0 AND t0 < coalesce(e0, 2147483647)
  UNION ALL SELECT doc_id, slice_no, 2, 0, 0, 'warning:no_options_detected:' FROM c GROUP BY ALL HAVING count(*) FILTER (mark = 'option' AND flow_pos < e) = 0),
il AS (SELECT doc_id, slice_no, string_agg(issue, ';' ORDER BY stage, pos, n) AS issues FROM iss GROUP BY ALL)"""


def _content(spark: SparkSession, sf_dir: str) -> pages.Pages:
    doc_lines(spark, sf_dir).createOrReplaceTempView("lines")
    found = {}
    for name, sql in MADE.items():
        found[name] = spark.sql(sql.format(list="array", string="STRING"))
        found[name].createOrReplaceTempView(name)
    rows = F.when(F.col("filled"), F.col("cells")).otherwise(F.array())
    tables = found["made_tables"].withColumn("rows", rows).drop("cells", "filled")
    return pages.Pages(found["made_spans"], tables, found["made_images"], found["made_drawings"], found["made_pages"], found["made_notes"])


def _document(spark: SparkSession, sf_dir: str) -> pages.Document:
    return pages.read_document(_content(spark, sf_dir), keep=written)


def _said(issues: Column) -> Column:
    return F.array_join(F.transform(issues, lambda i: F.concat_ws(":", i["severity"], i["code"], F.array_join(i["args"], ","))), ";")


@query(f"""WITH {PAGE_SEGMENTED} SELECT doc_id, CAST(line_no AS INT) AS line_no, page, mono, text, boundary, slice_no FROM s""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of visible text outside of tables, joined from their spans and cut into slices."""
    content = _content(spark, sf_dir)
    found = pages.lines.segment(pages.page_lines(content.spans, pages.page_tables(content.tables)))
    return found.select("doc_id", "line_no", "page", "mono", "text", "boundary", "slice_no")


@query(f"""WITH {PAGE_QUESTIONS}, {ISSUES}
SELECT q.doc_id, q.slice_no AS item_seq, id, ordinal, label, pages, group_id, type, options, correct, stem, explanation, coalesce(issues, '') AS issues
FROM q LEFT JOIN il ON q.doc_id = il.doc_id AND q.slice_no = il.slice_no""")
def page_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of pages, images and tables in their stems, options and explanations, with the issues of images and lines."""
    found = _document(spark, sf_dir).questions
    options = F.array_join(F.transform("interaction.options", lambda o: F.concat(o["id"], F.lit("|"), o["label"], F.lit("|"), plain_text(o["content"]))), ";")
    return found.select(
        F.col("run_id").alias("doc_id"), "item_seq", "id", "source.ordinal", "source.label", _listed("source.pages").alias("pages"), "group_id", "type", options.alias("options"),
        F.array_join("interaction.correct_option_ids", ",").alias("correct"), plain_text(F.col("stem")).alias("stem"), plain_text(F.col("explanation")).alias("explanation"), _said(F.col("issues")).alias("issues"),
    )


@query(f"""WITH {PAGE_BLOCKS}, {ISSUES},
ctx AS (SELECT doc_id, slice_no, string_agg(text, chr(10) ORDER BY block_no) AS context, string_agg(kind, ',' ORDER BY block_no) AS kinds FROM b WHERE role = 'context' GROUP BY ALL)
SELECT sk.doc_id, sk.slice_no AS item_seq, 'g' || CAST(group_no AS VARCHAR) AS id, coalesce(context, '') AS context, coalesce(kinds, '') AS kinds, coalesce(issues, '') AS issues
FROM sk LEFT JOIN ctx ON sk.doc_id = ctx.doc_id AND sk.slice_no = ctx.slice_no LEFT JOIN il ON sk.doc_id = il.doc_id AND sk.slice_no = il.slice_no WHERE kind = 'group'""")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages: their context with images and tables, the kinds of its blocks, and the issues of its images."""
    found = _document(spark, sf_dir).groups
    kinds = F.array_join(F.transform("context", lambda b: b["kind"]), ",")
    return found.select(F.col("run_id").alias("doc_id"), "item_seq", "id", plain_text(F.col("context")).alias("context"), kinds.alias("kinds"), _said(F.col("issues")).alias("issues"))


@query(f"""WITH {PAGE_OBJECTS} SELECT doc_id, slice_no AS item_seq, asset_id AS id, CASE WHEN xref IS NULL OR error IS NOT NULL THEN 'page_crop' ELSE 'embedded' END AS kind,
  CASE WHEN xref IS NULL OR error IS NOT NULL THEN 'image/png' ELSE CASE lower(ext) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jb2' THEN 'image/x-jbig2' ELSE 'image/' || lower(ext) END END AS media_type,
  page, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM obj WHERE rank < 2""")
def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _document(spark, sf_dir).assets
    return found.select(F.col("run_id").alias("doc_id"), "item_seq", "id", "kind", "media_type", "page", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


# Times are numbers: page by page, in a page by slice, preambles and lost groups between them. A slice is done on the page of the next.
@query(rf"""WITH {PAGE_BLOCKS}, {ISSUES},
sl AS (SELECT s.doc_id, s.slice_no, max(s.boundary) AS kind, max(s.ordinal) AS ordinal, max(s.group_no) AS group_no, min(s.page) AS page,
  max(CASE s.boundary WHEN 'group' THEN trim(text) WHEN 'question' THEN regexp_extract(ltrim(text), '{LABEL}') END) AS label FROM s WHERE slice_no > 0 GROUP BY ALL),
s1 AS (SELECT *, {FAILS} AS failed, coalesce(lead(page) OVER w, 1000000) * 1000000.0E0 + slice_no AS done FROM sl WINDOW w AS (PARTITION BY doc_id ORDER BY slice_no)),
s2 AS (SELECT *, coalesce(bool_or(kind = 'group' AND NOT failed) OVER (PARTITION BY doc_id, group_no), false) AND group_no > 0 AS grouped,
  CASE kind WHEN 'question' THEN done ELSE coalesce(min(CASE kind WHEN 'group' THEN done END) OVER (PARTITION BY doc_id ORDER BY slice_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 2E12) END AS given FROM s1),
it AS (SELECT *, NOT failed AND (kind = 'group' OR NOT grouped) AS takes FROM s2 WHERE NOT (kind = 'group' AND failed)),
pre AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT CAST(page AS VARCHAR), ', ' ORDER BY CAST(page AS VARCHAR)) AS pages FROM s WHERE slice_no = 0 GROUP BY 1),
nt AS (SELECT pre.doc_id, coalesce(done, 2E12) - 0.5 AS t, 'info:preamble_skipped:' || CAST(n AS VARCHAR) || ',' || pages AS note FROM pre LEFT JOIN s1 ON s1.doc_id = pre.doc_id AND slice_no = 1
  UNION ALL SELECT doc_id, done + 0.25, 'error:extraction_error:group,' || label || ',ValueError: made up' FROM s1 WHERE kind = 'group' AND failed
  UNION ALL SELECT doc_id, page * 1000000.0E0, severity || ':' || code || ':' || array_to_string(args, ',') FROM made_notes),
n1 AS (SELECT nt.doc_id, t, note, arg_min(it.slice_no, given) AS slice_no FROM nt LEFT JOIN it ON it.doc_id = nt.doc_id AND takes AND given > t GROUP BY ALL),
n2 AS (SELECT doc_id, slice_no, string_agg(note, ';' ORDER BY t) AS notes FROM n1 GROUP BY ALL),
mem AS (SELECT doc_id, group_no, string_agg('q' || CAST(ordinal AS VARCHAR), ',' ORDER BY slice_no) AS members FROM it WHERE kind = 'question' AND grouped AND NOT failed GROUP BY ALL),
al AS (SELECT it.doc_id, it.slice_no, CASE WHEN failed THEN 'failed' ELSE kind END AS kind, CASE WHEN NOT failed THEN CASE kind WHEN 'group' THEN 'g' || CAST(it.group_no AS VARCHAR) ELSE 'q' || CAST(ordinal AS VARCHAR) END END AS id,
    CASE kind WHEN 'question' THEN ordinal END AS ordinal, CASE WHEN kind = 'question' AND grouped AND NOT failed THEN 'g' || CAST(it.group_no AS VARCHAR) END AS group_id, CASE kind WHEN 'group' THEN coalesce(members, '') END AS members,
    CASE WHEN failed THEN 'error:extraction_error:question,' || label || ',ValueError: made up' ELSE concat_ws(';', issues, notes) END AS issues
  FROM it LEFT JOIN il ON it.doc_id = il.doc_id AND it.slice_no = il.slice_no LEFT JOIN n2 ON it.doc_id = n2.doc_id AND it.slice_no = n2.slice_no LEFT JOIN mem ON it.doc_id = mem.doc_id AND it.group_no = mem.group_no
  UNION ALL SELECT p.doc_id, 1, 'failed', NULL, 1, NULL, NULL, concat_ws(';', 'error:no_questions_found:', notes) FROM (SELECT DISTINCT doc_id FROM made_pages) p ANTI JOIN it ON it.doc_id = p.doc_id LEFT JOIN n2 ON n2.doc_id = p.doc_id AND n2.slice_no IS NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slice_no) AS INT) AS item_seq, kind, id, ordinal, group_id, members, issues FROM al""")
def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of documents in which some slices failed, and where the documents' notes went."""
    content = _content(spark, sf_dir)
    document = pages.read_document(content, keep=written)
    failures = pages.lines.slices(document.segmented).where(FAILS).select("doc_id", "slice_no", F.lit("ValueError: made up").alias("error"))
    found = pages.document_items(document, content.pages, content.notes, failures)
    return found.select(F.col("run_id").alias("doc_id"), "item_seq", "kind", "id", "ordinal", "group_id", F.array_join("members", ",").alias("members"), _said(F.col("issues")).alias("issues"))
