"""From boxes on pages to questions: spans, drawings, images and tables of decoded pages to a document's items.

A page's spans become lines, its drawings clusters and then figures; images, figures and tables go to the slice they stand
in, images get the ids of assets there, and slices become questions and groups. What can't be read is a row: page notes,
images that are cropped instead, and slices that failed go through the document as issues and failed items.

Each step is keyed by doc_id, by page before the lines are joined into slices; a document must fit a task, as in ``lines``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from . import layout, lines
from .lines import DEFAULT, ParserConfig

#: Resolution at which figures are cropped. Fixed value of the format.
CROP_DPI = 200
#: Content types by the suffix under which an image was stored. Fixed values of the format.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpx": "image/jpx", "jb2": "image/x-jbig2", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff"}
ISSUES = "array<struct<severity: string, code: string, args: array<string>, page: int>>"


@dataclass(frozen=True)
class Pages:
    """Decoded pages. Boxes are arrays x0, y0, x1, y1 with the origin at the top left; numbers of things give their order."""

    spans: DataFrame  #: doc_id, page, line_no, span_no, text, font, flags, bbox
    tables: DataFrame  #: doc_id, page, table_no, bbox, rows array<array<string>> (null cells are empty; without rows: none)
    images: DataFrame  #: doc_id, page, image_no, bbox, xref, ext, error (null: the stored bytes could be read)
    drawings: DataFrame  #: doc_id, page, rect_no, bbox
    pages: DataFrame  #: doc_id, page, width, height; every page, empty ones too
    notes: DataFrame | None = None  #: doc_id, page, note_no, severity, code, args: what a page's reader had to say


@dataclass(frozen=True)
class Document:
    """What a document's pages hold; item_seq is the number of the slice. Questions and groups are made when they are asked for."""

    segmented: DataFrame
    objects: DataFrame  #: ``slice_objects``
    cfg: ParserConfig = DEFAULT
    dpi: int = CROP_DPI
    keep: Callable[[DataFrame], DataFrame] = lambda df: df

    @cached_property
    def _images(self) -> DataFrame:
        return image_assets(self.objects, self.dpi)

    @cached_property
    def assets(self) -> DataFrame:
        """run_id, item_seq, asset_no, id, kind, media_type, page, bbox, xref."""
        return self._images.drop("issue")

    def _flowed(self, kind: str) -> DataFrame:
        own = F.col("slice_kind") == kind
        return lines.flow(self.segmented.where(own), self.objects.where(own))

    def _with_images(self, items: DataFrame, issues: Column) -> DataFrame:
        noted = self._images.where("issue is not null").groupBy("run_id", "item_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_no", "issue"))), lambda x: x["issue"]).alias("of_images"))
        return items.join(noted, ["run_id", "item_seq"], "left").withColumn("issues", F.concat(F.coalesce("of_images", F.array().cast(ISSUES)), issues)).drop("of_images")

    @cached_property
    def questions(self) -> DataFrame:
        """schemas.QUESTION and issues (ISSUES)."""
        own = F.transform("issues", lambda i: F.struct(F.lit("warning").alias("severity"), i["code"].alias("code"), i["args"].alias("args"), i["page"].cast("int").alias("page")))
        classified = self.keep(lines.assembled_from(lines.classify(self._flowed("question"), self.cfg)))
        return self._with_images(lines.assemble_questions(classified, self.cfg), own)

    @cached_property
    def groups(self) -> DataFrame:
        """schemas.GROUP and issues."""
        return self._with_images(lines.assemble_groups(self.segmented, self._flowed("group"), self.cfg), F.array().cast(ISSUES))


def page_tables(tables: DataFrame) -> DataFrame:
    """Tables that have rows, their missing cells as empty texts."""
    cells = F.transform("rows", lambda row: F.transform(row, lambda cell: F.coalesce(cell, F.lit(""))))
    return tables.where(F.size("rows") > 0).withColumn("rows", cells)


def page_lines(spans: DataFrame, tables: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Lines with something to see that no table holds: doc_id, page, line_no, x0, y0, y1, mono, text, spans.

    A line's box is the union of its spans' boxes, empty spans included; those don't count otherwise.
    """
    seen = F.col("text") != ""
    one = F.when(seen, F.struct("span_no", "text", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1")))
    side = lambda i, f: f(F.col("bbox")[i])
    visible = F.when(strip(F.col("text")) != "", layout.mono_span(F.col("flags"), F.col("font"), cfg))
    rows = spans.groupBy("doc_id", "page", "line_no").agg(
        F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["text"].alias("text"), s["x0"].alias("x0"), s["x1"].alias("x1"))).alias("spans"),
        F.array(side(0, F.min), side(1, F.min), side(2, F.max), side(3, F.max)).alias("bbox"), F.coalesce(F.bool_and(visible), F.lit(False)).alias("mono"),
    )
    rows = rows.withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), "")).where(strip(F.col("text")) != "")
    box = F.col("bbox")
    return layout.outside_tables(rows, tables).select("doc_id", "page", "line_no", box[0].alias("x0"), box[1].alias("y0"), box[3].alias("y1"), "mono", "text", "spans")


def page_objects(content: Pages, tables: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Images, figures and tables: doc_id, page, obj_no (in the page's order), obj_kind, y_center, bbox, xref, ext, error, rows.

    Images come before tables, by the height of their centres; figures are clusters of drawings and have no xref.
    """
    figures = layout.figures(layout.cluster_rects(content.drawings, cfg.cluster_gap), content.pages, tables, cfg)
    kinds = (
        content.images.select("doc_id", "page", F.col("image_no").alias("no"), F.lit(0).alias("rank"), "bbox", "xref", "ext", "error"),
        figures.select("doc_id", "page", F.col("cluster_no").alias("no"), F.lit(1).alias("rank"), "bbox"),
        tables.select("doc_id", "page", F.col("table_no").alias("no"), F.lit(2).alias("rank"), "bbox", "rows"),
    )
    y = (F.col("bbox")[1] + F.col("bbox")[3]) / 2
    found = lines.union_all(*kinds).withColumns({"y_center": y, "obj_kind": F.when(F.col("rank") < 2, "image").otherwise("table")})
    order = Window.partitionBy("doc_id", "page").orderBy("obj_kind", F.when(F.col("rank") < 2, F.col("y_center")), "rank", "no")
    return found.withColumn("obj_no", F.row_number().over(order)).drop("rank", "no")


def slice_objects(segmented: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects with slice_no, slice_kind and, for images, asset_no and asset_id; those before the first slice are left out."""
    owned = lines.own_objects(segmented, objects).where("slice_no > 0").join(objects, ["doc_id", "page", "obj_no"])
    owner = F.when(F.col("kind") == "question", F.concat(F.lit("q"), "ordinal")).otherwise(F.concat(F.lit("g"), "group_no"))
    owned = owned.join(lines.slices(segmented).select("doc_id", "slice_no", F.col("kind").alias("slice_kind"), owner.alias("owner")), ["doc_id", "slice_no"])
    images, tables = owned.where("obj_kind = 'image'"), owned.where("obj_kind = 'table'")
    return lines.union_all(lines.figure_assets(images).withColumn("asset_no", F.expr("cast(substring_index(asset_id, '-img', -1) as int)")), tables)


def image_assets(objects: DataFrame, dpi: int = CROP_DPI) -> DataFrame:
    """Assets of ``slice_objects`` with their issue (null: none): stored images as they are, the others cropped from their page as PNG.

    A figure is noted as cropped; a stored image that could not be read is a warning.
    """
    stored = F.col("xref").isNotNull() & F.col("error").isNull()
    known = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    media = F.coalesce(F.element_at(known, F.lower("ext")), F.concat(F.lit("image/"), F.lower("ext")))
    page = F.col("page").cast("string")
    issue = lambda severity, code, *args: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.array(*args).alias("args"), F.col("page").cast("int").alias("page"))
    cropped = issue("info", "figure_cropped", page, F.lit(str(dpi)))
    unread = issue("warning", "image_extraction_failed", F.col("xref").cast("string"), page, F.col("error"))
    return objects.where("obj_kind = 'image'").select(
        F.col("doc_id").alias("run_id"), F.col("slice_no").alias("item_seq"), "asset_no", F.col("asset_id").alias("id"), F.when(stored, "embedded").otherwise("page_crop").alias("kind"),
        F.when(stored, media).otherwise("image/png").alias("media_type"), "page", "bbox", "xref", F.when(F.col("xref").isNull(), cropped).when(F.col("error").isNotNull(), unread).alias("issue"),
    )


def read_document(content: Pages, cfg: ParserConfig = DEFAULT, dpi: int = CROP_DPI, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Document:
    """Questions, groups and assets of the pages. An item's issues are those of its images, then those of its lines.

    Lines with their slices, the objects of slices and, where questions are asked for, the classified items of question
    slices are read by several steps: ``keep`` is given each of them once, to write it somewhere and read it again; by
    default they are computed anew wherever they are read.
    """
    tables = page_tables(content.tables)
    segmented = keep(lines.segment(page_lines(content.spans, tables, cfg), cfg))
    return Document(segmented, keep(slice_objects(segmented, page_objects(content, tables, cfg))), cfg, dpi, keep)


def document_items(document: Document, pages: DataFrame, notes: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """A document's items in order, whatever failed: run_id, item_seq (1, 2, ...), kind (question, group, failed), id,
    ordinal, group_id, members (of groups) and issues (ISSUES).

    failures: doc_id, slice_no, error of slices that could not be assembled. A question among them is a failed item and
    no member of its group. A group among them is lost: its questions stand alone, later groups keep their numbers, and
    the error is a note of the document. notes: as in Pages. Notes go to the next item that takes some: a group, or a
    question outside of groups that did not fail; an item is done when the next slice begins, a group when the next
    group is, so a page's notes go to no item done on an earlier page. Notes after the last such item are lost, unless
    the document has no item at all: then one failed item says so and carries them.
    """
    found = lines.slices(document.segmented)
    none = F.array().cast(ISSUES)
    if failures is None:
        found = found.withColumn("error", F.lit(None).cast("string"))
    else:  # the first of several errors of one slice
        found = found.join(failures.groupBy("doc_id", "slice_no").agg(F.min("error").alias("error")), ["doc_id", "slice_no"], "left")
    by_doc, by_group = Window.partitionBy("doc_id").orderBy("slice_no"), Window.partitionBy("doc_id", "group_no")
    failed = F.col("error").isNotNull()
    found = found.withColumns({
        "head": F.coalesce(F.max((F.col("kind") == "group") & ~failed).over(by_group), F.lit(False)) & (F.col("group_no") > 0),
        "done_page": F.lead(F.get("pages", F.lit(0))).over(by_doc),  # null: at the end of the document
    })
    is_group = F.col("kind") == "group"
    # a group is handed out as the next group's slice is done
    after = F.first(F.when(is_group, F.struct("done_page", "slice_no")), ignorenulls=True).over(by_doc.rowsBetween(1, Window.unboundedFollowing))
    at = F.when(is_group, after).otherwise(F.struct("done_page", "slice_no"))
    far = F.lit(lines.NEVER)
    moment = lambda page, step, slice_no: F.struct(F.coalesce(page, far).cast("int").alias("page"), F.lit(step).alias("step"), F.coalesce(slice_no, far).cast("int").alias("slice_no"))
    found = found.withColumn("at", at).withColumn("at", moment(F.col("at.done_page"), 1, F.col("at.slice_no")))
    # a question's group is lost with its header; so is a question's place in it with the question
    group_id = F.when(F.col("head"), F.concat(F.lit("g"), "group_no"))
    what = F.when(is_group, "group").otherwise("question")
    error = F.struct(F.lit("error").alias("severity"), F.lit("extraction_error").alias("code"), F.array(what, "label", "error").alias("args"), F.get("pages", F.lit(0)).cast("int").alias("page"))
    shown = found.where(~(is_group & failed)).select(
        "doc_id", "slice_no", F.when(failed, "failed").otherwise(what).alias("kind"), F.when(~failed, F.when(is_group, F.concat(F.lit("g"), "group_no")).otherwise(F.concat(F.lit("q"), "ordinal"))).alias("id"),
        "ordinal", "group_no", F.when(~is_group & ~failed, group_id).alias("group_id"), F.when(failed, error).alias("error"), ((is_group | ~F.col("head")) & ~failed).alias("takes"), "at",
    )

    # notes of pages as they are read, of the lines before the first slice as that is done, of lost groups in their turn
    first = found.where("slice_no = 1").select("doc_id", F.col("done_page").alias("_page"))
    note = lambda severity, code, args, page: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), args.alias("args"), page.cast("int").alias("page"))
    listed = F.array(F.col("n_lines").cast("string"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "))
    before = lines.preamble(document.segmented).join(first, "doc_id", "left")
    events = [
        before.select("doc_id", moment(F.col("_page"), 1, F.lit(0)).alias("at"), F.lit(0).alias("no"), note("info", "preamble_skipped", listed, F.lit(None)).alias("note")),
        # after the group before it is handed out, so that this one is not given the note
        found.where(is_group & failed).select("doc_id", moment(F.col("done_page"), 1, F.col("slice_no")).alias("at"), F.lit(1).alias("no"), error.alias("note")),
    ]
    if notes is not None:
        events.append(notes.select("doc_id", moment(F.col("page"), 0, F.lit(0)).alias("at"), F.col("note_no").alias("no"), F.struct("severity", "code", "args", F.col("page").cast("int").alias("page")).alias("note")))
    takers = shown.where("takes").select("doc_id", "at", F.lit(0).alias("no"), F.col("slice_no").alias("taker"))
    timeline = lines.union_all(takers, *events)
    # one moment may hand out a group and note the next: the one handed out comes first
    ahead = Window.partitionBy("doc_id").orderBy("at", "no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    taken = timeline.withColumn("taker", F.first("taker", ignorenulls=True).over(ahead)).where("note is not null")
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("at", "no", "note"))), lambda x: x["note"])
    given = taken.groupBy("doc_id", F.col("taker").alias("slice_no")).agg(gathered.alias("notes"))

    own = document.questions.select(F.col("run_id").alias("doc_id"), F.col("item_seq").alias("slice_no"), "issues").unionByName(document.groups.select(F.col("run_id").alias("doc_id"), F.col("item_seq").alias("slice_no"), "issues"))
    members = shown.where("group_id is not null").groupBy("doc_id", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice_no", "id"))), lambda m: m["id"]).alias("members"))
    rows = shown.join(own, ["doc_id", "slice_no"], "left").join(given, ["doc_id", "slice_no"], "left").join(members, ["doc_id", "group_no"], "left")
    issues = F.when(F.col("kind") == "failed", F.array("error")).otherwise(F.concat(F.coalesce("issues", none), F.coalesce("notes", none)))
    listed_members = F.when(F.col("kind") == "group", F.coalesce("members", F.array().cast("array<string>")))
    rows = rows.select("doc_id", "slice_no", "kind", "id", "ordinal", "group_id", listed_members.alias("members"), issues.cast(ISSUES).alias("issues"))

    empty = pages.select("doc_id").distinct().join(shown.select("doc_id").distinct(), "doc_id", "left_anti")
    nothing = F.array(F.struct(F.lit("error").alias("severity"), F.lit("no_questions_found").alias("code"), F.array().cast("array<string>").alias("args"), F.lit(None).cast("int").alias("page"))).cast(ISSUES)
    unused = given.where("slice_no is null").drop("slice_no")
    lost = empty.join(unused, "doc_id", "left").select(
        "doc_id", F.lit(1).alias("slice_no"), F.lit("failed").alias("kind"), F.lit(1).alias("ordinal"), F.concat(nothing, F.coalesce("notes", none)).cast(ISSUES).alias("issues")
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("slice_no"))
    out = lines.union_all(rows, lost).withColumn("item_seq", place)
    return out.select(F.col("doc_id").alias("run_id"), "item_seq", "kind", "id", "ordinal", "group_id", "members", "issues")
