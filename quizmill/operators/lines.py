"""Positioned lines to typed questions: segmentation, flow, markers, blocks and assembly, all keyed by doc_id and slice.

A document must fit one task (its lines are ordered together); documents spread over the cluster. Every window here is
partitioned by doc_id or by doc_id and more, so that the chain up to the blocks needs one shuffle.

Lines: doc_id, page, line_no, x0, y0, mono, text, and for verbatim text y1 and spans array<struct<text, x0, x1>>.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_letters, lstrip, rstrip, strip
from ..schemas import BLOCK, INTERACTION


@dataclass(frozen=True)
class ParserConfig:
    """Patterns and thresholds. Fixed values of the format; override by constructing another."""

    question_labels: tuple[str, ...] = (r"^question\s+\d+\s*[:.)]?", r"^\d{1,4}[.)]")
    group_headers: tuple[str, ...] = (r"^case\s+study\b.*", r"^scenario\b.*")
    option: str = r"^([A-H])[.)]\s+(.*)$"
    answer: str = r"^(?:correct\s+)?answers?\s*[:.]\s*(.*)$"
    explanation: str = r"^explanation\s*[:.]?\s*(.*)$"
    choose_hint: str = r"\(choose\s+(two|three|four|\d+)\b"
    mono_hints: tuple[str, ...] = ("courier", "mono", "consolas")
    min_figure_area: float = 1500.0
    max_page_share: float = 0.85
    cluster_gap: float = 12.0
    blank_line_gap: float = 1.8


DEFAULT = ParserConfig()
ORDER = ("page", "y0", "x0", "line_no")
NEVER = 2**31 - 1


def anchored(pattern: str) -> str:
    """The pattern from the start of a text, in any case; digits, white space and word ends as Unicode has them."""
    return rf"(?iUd)\A(?:{pattern})"


def _any(patterns: tuple[str, ...], text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, anchored(p), 0), F.lit("")) for p in patterns))


def segment(lines: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Adds boundary (question, group or null), label, slice_no (0: preamble), slice_kind, ordinal, group_no, group_kind."""
    marked = lines.withColumn("stripped", strip(F.col("text")))
    marked = marked.withColumn("_header", _any(cfg.group_headers, F.col("stripped"))).withColumn("_label", _any(cfg.question_labels, F.col("stripped")))
    plain = ~F.col("mono")
    marked = marked.withColumn("boundary", F.when(plain & F.col("_header").isNotNull(), "group").when(plain & F.col("_label").isNotNull(), "question"))
    kind = F.when(F.lower("_header").contains("case"), "case_study").otherwise("scenario")
    marked = marked.withColumn("label", F.when(F.col("boundary") == "group", F.col("stripped")).when(F.col("boundary") == "question", F.col("_label")))
    marked = marked.withColumn("group_kind", F.when(F.col("boundary") == "group", kind)).drop("_header", "_label")
    upto = Window.partitionBy("doc_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.count_if(F.coalesce(c, F.lit(False))).over(upto).cast("int")
    numbers = {"slice_no": run(F.col("boundary").isNotNull()), "ordinal": run(F.col("boundary") == "question"), "group_no": run(F.col("boundary") == "group")}
    return marked.withColumns(numbers | {"slice_kind": F.last("boundary", ignorenulls=True).over(upto)})


def slices(segmented: DataFrame) -> DataFrame:
    """One row per slice after the preamble: kind, label, ordinal, group_no, lines, distinct pages in order."""
    rows = segmented.where("slice_no > 0").groupBy("doc_id", "slice_no").agg(
        F.max("boundary").alias("kind"), F.max("label").alias("label"), F.max("ordinal").alias("ordinal"), F.max("group_no").alias("group_no"),
        F.max("group_kind").alias("group_kind"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_set("page")).alias("pages"),
    )
    return rows.withColumn("ordinal", F.when(F.col("kind") == "question", F.col("ordinal")))


def preamble(segmented: DataFrame) -> DataFrame:
    """Documents with lines before the first boundary: how many, on which pages."""
    return segmented.where("slice_no = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_set("page")).alias("pages"))


def own_objects(segmented: DataFrame, objects: DataFrame) -> DataFrame:
    """As-of: each object (doc_id, page, obj_no, y_center) goes to the last slice begun at or above it, else the one carried over."""
    edges = segmented.where("boundary is not null").select("doc_id", "page", F.col("y0").alias("y"), F.lit(0).alias("rank"), "slice_no", F.lit(None).cast("int").alias("obj_no"))
    points = objects.select("doc_id", "page", F.col("y_center").alias("y"), F.lit(1).alias("rank"), F.lit(None).cast("int").alias("slice_no"), "obj_no")
    w = Window.partitionBy("doc_id").orderBy("page", "y", "rank", "slice_no").rowsBetween(Window.unboundedPreceding, 0)
    return edges.union(points).withColumn("slice_no", F.last("slice_no", ignorenulls=True).over(w)).where("obj_no is not null").select("doc_id", "page", "obj_no", "slice_no")


def flow(segmented: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Lines and objects in reading order: flow_pos within (doc_id, slice_no); item: text, mono, image or table.

    objects: doc_id, slice_no, page, obj_no, obj_kind, y_center, and what their blocks show (asset_id, rows).
    """
    rows = segmented.where("slice_no > 0").withColumns({"y": F.col("y0"), "rank": F.lit(0), "src": F.col("line_no"), "item": F.when(F.col("mono"), "mono").otherwise("text")})
    own = Window.partitionBy("doc_id", "slice_no")
    if objects is not None:
        rank = F.when(F.col("obj_kind") == "image", 1).otherwise(2)
        kept = [c for c in ("asset_id", "rows") if c in objects.columns]
        placed = objects.select("doc_id", "slice_no", "page", F.col("y_center").alias("y"), rank.alias("rank"), F.col("obj_no").alias("src"), F.col("obj_kind").alias("item"), F.lit(False).alias("mono"), *kept)
        whole = {c: F.coalesce(c, F.max(c).over(own)) for c in ("slice_kind", "ordinal", "group_no")}
        rows = rows.unionByName(placed, allowMissingColumns=True).withColumns(whole)
    return rows.withColumn("flow_pos", F.row_number().over(own.orderBy("page", "y", "rank", "x0", "src")))


def classify(flowed: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Question slices' items with mark, role (stem, option, explanation, answer), option_no, letters, content and issues.

    Explanation is where everything else ends up: from the first explanation marker, or the first unmarked text after
    an answer key, on. Before it an item belongs to the last option begun, or the stem. ``content`` is what an item
    shows (null: nothing); what follows a marker is sought from the first place where it stands in the line.
    """
    # the label's own characters are not content
    body = F.when(F.col("boundary") == "question", lstrip(F.expr("substr(text, locate(stripped, text) + length(label))"))).otherwise(F.col("text"))
    df = flowed.where("slice_kind = 'question'").withColumn("body", body).withColumn("_body", strip(F.col("body")))
    rest = {name: F.regexp_extract("_body", anchored(pattern), group) for name, pattern, group in (("_explains", cfg.explanation, 0), ("_explained", cfg.explanation, 1), ("_answers", cfg.answer, 0), ("_answer", cfg.answer, 1), ("_opens", cfg.option, 0), ("_letter", cfg.option, 1), ("_opened", cfg.option, 2))}
    df = df.withColumns(rest)
    mark = (
        F.when(F.col("item") == "mono", "mono").when(F.col("item") != "text", "object").when(F.col("_body") == "", "blank")
        .when(F.col("_explains") != "", "explanation").when(F.col("_answers") != "", "answer").when(F.col("_opens") != "", "option").otherwise("plain")
    )
    all_, upto = (Window.partitionBy("doc_id", "slice_no"), Window.partitionBy("doc_id", "slice_no").orderBy("flow_pos").rowsBetween(Window.unboundedPreceding, 0))
    first = lambda c, w: F.min(F.when(c, F.col("flow_pos"))).over(w)
    df = df.withColumn("mark", mark)
    df = df.withColumns({"a0": first(F.col("mark") == "answer", all_), "e0": first(F.col("mark") == "explanation", all_)})
    df = df.withColumn("t0", first((F.col("mark") == "plain") & (F.col("flow_pos") > F.col("a0")), all_))
    far = F.lit(NEVER)
    df = df.withColumn("e", F.least(F.coalesce("e0", far), F.coalesce("t0", far)))
    opens = (F.col("mark") == "option") & (F.col("flow_pos") < F.col("e"))
    df = df.withColumns({"option_no": F.count_if(opens).over(upto).cast("int"), "answer_no": F.count_if(F.col("mark") == "answer").over(upto)})
    df = df.withColumn("role", F.when(F.col("mark") == "answer", "answer").when(F.col("flow_pos") >= F.col("e"), "explanation").when(F.col("option_no") > 0, "option").otherwise("stem"))
    df = df.withColumn("letters", F.when(F.col("mark") == "answer", answer_letters(F.col("_answer"))))
    df = df.withColumn("option_id", F.when(opens, F.lower("_letter"))).withColumn("option_label", F.when(opens, rstrip(F.expr("left(_body, length(_body) - length(_opened))"))))
    suffix = F.when(F.col("mark") == "explanation", F.col("_explained")).when(F.col("option_id").isNotNull(), F.col("_opened"))
    at = F.position(suffix, F.col("text"))
    cut = F.when(at > 1, lstrip(F.expr("substr(text, _at)"))).otherwise(F.col("text"))
    df = df.withColumn("_suffix", suffix).withColumn("_at", at)
    content = F.when(F.col("mark").isin("answer", "object"), F.lit(None)).when(F.col("_suffix").isNull(), F.col("body")).when(strip(F.col("_suffix")) != "", cut)
    issue = lambda code, when, *args: F.when(when, F.struct(F.lit(code).alias("code"), F.array(*args).cast("array<string>").alias("args")))
    issues = F.filter(
        F.array(
            issue("multiple_answer_keys", (F.col("mark") == "answer") & (F.col("answer_no") > 1), "_body"),
            issue("unparsed_answer_key", (F.col("mark") == "answer") & (F.size("letters") == 0), "_answer"),
            issue("option_after_answer_key", opens & (F.col("flow_pos") > F.col("a0")), "_opens"),
            issue("unmarked_text_after_answer", (F.col("flow_pos") == F.col("t0")) & (F.col("t0") < F.coalesce("e0", far))),
        ),
        lambda x: x.isNotNull(),
    )
    return df.withColumns({"content": content, "line_issues": issues}).drop("_suffix", "_at", *rest)


def assembled_from(classified: DataFrame) -> DataFrame:
    """Of ``classify`` rows, what ``assemble_questions`` reads: to be written, lines stand there once, with their spans only where these are shown."""
    kept = ("doc_id", "slice_no", "flow_pos", "item", "page", "x0", "y0", "y1", "ordinal", "group_no", "label", "role", "option_no", "option_id", "option_label", "letters", "content", "line_issues", "asset_id", "rows")
    spans = [F.when(F.col("item") == "mono", F.col("spans")).alias("spans")] if "spans" in classified.columns else []
    return classified.select(*(c for c in kept if c in classified.columns), *spans)


def contexts(flowed: DataFrame) -> DataFrame:
    """Group slices' items as content of the role context; the header line is all label and shows nothing."""
    shown = F.when((F.col("boundary").isNull()) & F.col("item").isin("text", "mono"), F.col("text"))
    return flowed.where("slice_kind = 'group'").withColumns({"role": F.lit("context"), "option_no": F.lit(0), "content": shown})


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _verbatim(run: Column, cfg: ParserConfig) -> Column:
    """Exact text of a monospace run: an array of lines (page, x0, y0, y1, spans) in order."""
    seen = lambda s: F.transform(F.filter(s, lambda x: x["text"] != ""), lambda x: (x["x1"] - x["x0"]) / F.length(x["text"]))
    width = F.coalesce(_median(F.flatten(F.transform(run, lambda r: F.coalesce(seen(r["spans"]), F.array().cast("array<double>"))))), F.lit(1.0))
    height = _median(F.transform(run, lambda r: r["y1"] - r["y0"]))
    base = F.array_min(F.transform(run, lambda r: r["x0"]))
    blanks = lambda d, w: F.repeat(F.lit(" "), F.greatest(F.lit(0), F.bround(d / w).cast("int")))
    # width, height and base once per run, as the one element of an array
    sizes = F.array(F.struct(width.alias("w"), height.alias("h"), base.alias("b")))

    def text(z: Column) -> Column:
        def line(r: Column, i: Column) -> Column:
            last = F.get(run, i - 1)
            gap = (last["page"] == r["page"]) & (r["y0"] - last["y0"] > F.lit(cfg.blank_line_gap) * z["h"])
            before = lambda j: F.when(j == 0, r["x0"]).otherwise(F.get(r["spans"], j - 1)["x1"])
            body = F.array_join(F.transform(r["spans"], lambda s, j: F.concat(blanks(s["x0"] - before(j), z["w"]), s["text"])), "")
            return F.concat(F.when(F.coalesce(gap, F.lit(False)), F.lit("\n")).otherwise(F.lit("")), blanks(r["x0"] - z["b"], z["w"]), F.coalesce(body, F.lit("")))

        return F.array_join(F.transform(run, line), "\n")

    return F.get(F.transform(sizes, text), F.lit(0))


def verbatim(lines: DataFrame, keys: tuple[str, ...], cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Exact text of monospace runs (``keys`` name a run): indents in character widths, blank lines at wide gaps.

    lines: keys, page, pos, x0, y0, y1, spans array<struct<text, x0, x1>>. One shuffle by the keys; a run must fit a task.
    """
    runs = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "page", "x0", "y0", "y1", "spans"))).alias("_run"))
    return runs.select(*keys, _verbatim(F.col("_run"), cfg).alias("text"))


def content_blocks(items: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Blocks of each (doc_id, slice_no, role, option_no): block_no, n_items, block (schemas.BLOCK).

    items: ``classify`` or ``contexts``. Consecutive prose joins by newlines into one text block, consecutive monospace
    lines into one verbatim block, images and tables stand alone; items that show nothing are as if they weren't there.
    """
    shows = F.col("item").isin("image", "table") | ((strip(F.col("content")) != "") & (F.col("role") != "answer"))
    kept = items.where(shows)
    for name, kind in (("asset_id", "string"), ("rows", "array<array<string>>"), ("y1", "double"), ("spans", "array<struct<text: string, x0: double, x1: double>>")):
        if name not in kept.columns:
            kept = kept.withColumn(name, F.lit(None).cast(kind))
    option = F.when(F.col("role") == "option", F.col("option_no")).otherwise(0)
    kept = kept.withColumn("option_no", option)
    w = Window.partitionBy("doc_id", "slice_no", "role", "option_no").orderBy("flow_pos")
    new = F.coalesce(F.lag("item").over(w) != F.col("item"), F.lit(True)) | F.col("item").isin("image", "table")
    runs = kept.withColumn("_new", new).withColumn("block_no", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    one = F.struct("flow_pos", "item", "content", "page", "x0", "y0", "y1", "spans", "asset_id", "rows")
    runs = runs.groupBy("doc_id", "slice_no", "role", "option_no", "block_no").agg(F.array_sort(F.collect_list(one)).alias("_run"))
    head = F.col("_run")[0]
    text = F.when(head["item"] == "mono", _verbatim(F.col("_run"), cfg)).when(head["item"] == "text", F.array_join(F.transform("_run", lambda r: r["content"]), "\n"))
    kind = F.when(head["item"] == "mono", "verbatim").otherwise(head["item"])
    null = F.lit(None).cast("string")
    block = F.struct(kind.alias("kind"), text.alias("text"), null.alias("language_hint"), head["asset_id"].alias("asset_id"), null.alias("caption"), head["rows"].alias("rows")).cast(BLOCK)
    return runs.select("doc_id", "slice_no", "role", "option_no", "block_no", F.size("_run").alias("n_items"), block.alias("block"))


def _in_order(entry: Column, when: Column, *order: str) -> Column:
    """An aggregate: the entries of rows where ``when`` holds, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(*order, entry.alias("x"))))), lambda s: s["x"])


def _slice_content(blocks: DataFrame) -> DataFrame:
    role = lambda r: F.col("role") == r
    pieces = F.array_sort(F.collect_list(F.when(role("option"), F.struct("option_no", "block_no", "block"))))
    return blocks.groupBy("doc_id", "slice_no").agg(*(_in_order(F.col("block"), role(r), "block_no").alias(r) for r in ("stem", "explanation", "context")), pieces.alias("pieces"))


def _infer(options: Column, correct: Column, stem: Column, cfg: ParserConfig) -> Column:
    """The type of a choice question by its options' first texts, its answers and the hint in its stem."""
    first = lambda o: F.lower(strip(F.coalesce(F.get(F.filter(o["content"], lambda b: b["kind"] == "text"), F.lit(0))["text"], F.lit(""))))
    texts = F.array_sort(F.array_distinct(F.transform(options, first)))
    said = F.array_join(F.transform(F.filter(stem, lambda b: b["kind"] == "text"), lambda b: b["text"]), " ")
    two = (F.size(options) == 2) & (texts == F.array(F.lit("false"), F.lit("true")))
    several = (F.size(correct) > 1) | said.rlike(f"(?iUd){cfg.choose_hint}")
    return F.when(F.size(options) == 0, "single_choice").when(two, "true_false").when(several, "multiple_choice").otherwise("single_choice")


def assemble_questions(classified: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """QUESTION rows of question slices (run_id: doc_id, item_seq: slice_no) and issues array<struct<code, args, page>>.

    A question's id is q<ordinal>, its group g<number of the last group header before it>. ``pages`` are those of its
    lines. Issues stand in reading order; a question without options gets no_options_detected last.
    """
    flagged = classified.where("size(line_issues) > 0").select("doc_id", "slice_no", "flow_pos", "page", F.posexplode("line_issues").alias("n", "i"))
    flagged = flagged.groupBy("doc_id", "slice_no").agg(_in_order(F.struct("i.code", "i.args", "page"), F.lit(True), "flow_pos", "n").alias("found"))
    heads = classified.groupBy("doc_id", "slice_no").agg(
        F.max("ordinal").alias("ordinal"), F.max("group_no").alias("group_no"), F.max("label").alias("label"), F.array_sort(F.collect_set(F.when(F.col("item").isin("text", "mono"), F.col("page")))).alias("pages"),
        _in_order(F.struct("option_no", "option_id", "option_label"), F.col("option_id").isNotNull(), "flow_pos").alias("opened"),
        F.array_distinct(F.flatten(_in_order(F.col("letters"), F.col("letters").isNotNull(), "flow_pos"))).alias("correct"),
    )
    rows = heads.join(_slice_content(content_blocks(classified, cfg)), ["doc_id", "slice_no"], "left").join(flagged, ["doc_id", "slice_no"], "left")
    none = F.array().cast(f"array<{BLOCK}>")
    mine = lambda o: F.transform(F.filter("pieces", lambda p: p["option_no"] == o["option_no"]), lambda p: p["block"])
    options = F.transform("opened", lambda o: F.struct(o["option_id"].alias("id"), o["option_label"].alias("label"), F.coalesce(mine(o), none).alias("content")))
    rows = rows.withColumns({"options": options, "stem": F.coalesce("stem", none), "explanation": F.coalesce("explanation", none)})
    rows = rows.withColumn("type", _infer(F.col("options"), F.col("correct"), F.col("stem"), cfg))
    kind = "array<struct<code: string, args: array<string>, page: int>>"
    bare = F.when(F.size("options") == 0, F.array(F.struct(F.lit("no_options_detected").alias("code"), F.array().cast("array<string>").alias("args"), F.coalesce(F.get("pages", F.lit(0)), F.lit(1)).alias("page"))))
    issues = F.concat(F.coalesce("found", F.array().cast(kind)), F.coalesce(bare.cast(kind), F.array().cast(kind)))
    fields = {name: F.lit(None) for name in ("items", "correct_order", "left", "right", "pairs", "tokens", "targets", "placements", "blanks")}
    fields = {"kind": F.lit("choice"), "options": F.col("options"), "correct_option_ids": F.col("correct")} | fields
    group = F.when(F.col("group_no") > 0, F.concat(F.lit("g"), "group_no"))
    return rows.select(
        F.col("doc_id").alias("run_id"), F.col("slice_no").alias("item_seq"), F.concat(F.lit("q"), "ordinal").alias("id"), F.struct("ordinal", "label", "pages").alias("source"), "type", group.alias("group_id"),
        "stem", F.struct(*(c.alias(n) for n, c in fields.items())).cast(INTERACTION).alias("interaction"), "explanation", issues.alias("issues"),
    )


def assemble_groups(segmented: DataFrame, flowed: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """GROUP rows of group slices: id g<n>, the header as title, the rest of the slice as context, the questions up to
    the next header as members. They come before their members by item_seq, the slice's number."""
    found = slices(segmented)
    member = F.struct(F.col("ordinal").alias("at"), F.concat(F.lit("q"), F.col("ordinal").cast("string")).alias("id"))
    by_group = found.where("group_no > 0").groupBy("doc_id", "group_no").agg(
        F.max(F.when(F.col("kind") == "group", F.struct("slice_no", "group_kind", "label"))).alias("head"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "question", member))), lambda m: m["id"]).alias("question_ids"),
    )
    heads = by_group.select("doc_id", "head.slice_no", F.concat(F.lit("g"), "group_no").alias("id"), F.col("head.group_kind").alias("kind"), F.col("head.label").alias("title"), "question_ids")
    context = _slice_content(content_blocks(contexts(flowed), cfg)).select("doc_id", "slice_no", "context")
    return heads.join(context, ["doc_id", "slice_no"], "left").select(
        F.col("doc_id").alias("run_id"), F.col("slice_no").alias("item_seq"), "id", "kind", "title", F.coalesce("context", F.array().cast(f"array<{BLOCK}>")).alias("context"), "question_ids"
    )


def document_notes(segmented: DataFrame) -> DataFrame:
    """The note on lines before the first boundary, at the document's first item (run_id, item_seq, code, args)."""
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")
    return preamble(segmented).select(F.col("doc_id").alias("run_id"), F.lit(1).alias("item_seq"), F.lit("preamble_skipped").alias("code"), F.array(F.col("n_lines").cast("string"), pages).alias("args"))


def question_types(classified: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Per question slice: n_options, correct_ids (in order, each once), type, and whether no options were found."""
    rows = assemble_questions(classified, cfg)
    n = F.size("interaction.options").cast("long")
    return rows.select(F.col("run_id").alias("doc_id"), F.col("item_seq").alias("slice_no"), n.alias("n_options"), F.col("interaction.correct_option_ids").alias("correct_ids"), "type", (n == 0).alias("no_options_detected"))


def figure_assets(objects: DataFrame) -> DataFrame:
    """Images of slices with their asset ids: <owner>-img<n>, numbered within the slice by page and y.

    objects: doc_id, slice_no, owner (the slice's item id), page, obj_no, y_center.
    """
    w = Window.partitionBy("doc_id", "slice_no").orderBy("page", "y_center", "obj_no")
    return objects.withColumn("asset_id", F.concat("owner", F.lit("-img"), F.row_number().over(w).cast("string")))


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
