"""Page geometry: monospace tests, containment and figures. Boxes are arrays x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .lines import DEFAULT, ParserConfig


def mono_span(flags: Column, font: Column, cfg: ParserConfig = DEFAULT) -> Column:
    hinted = F.exists(F.array(*(F.lit(h) for h in cfg.mono_hints)), lambda h: F.contains(F.lower(font), h))
    return (flags.bitwiseAND(8) != 0) | hinted


def mono_lines(spans: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """A line is monospace if it has visible spans and all of them are. spans: doc_id, page, line_no, text, flags, font."""
    seen = strip(F.col("text")) != ""
    return spans.groupBy("doc_id", "page", "line_no").agg(F.coalesce(F.bool_and(F.when(seen, mono_span(F.col("flags"), F.col("font"), cfg))), F.lit(False)).alias("mono"))


def outside_tables(lines: DataFrame, tables: DataFrame, slack: float = 2.0) -> DataFrame:
    """Lines (doc_id, page, bbox) that lie in no table's box, widened by ``slack``: an equi-join by page, then ranges."""
    a, b = lines.alias("a"), tables.select("doc_id", "page", "bbox").alias("b")
    low = [F.col("a.bbox")[i] >= F.col("b.bbox")[i] - slack for i in (0, 1)]
    high = [F.col("a.bbox")[i] <= F.col("b.bbox")[i] + slack for i in (2, 3)]
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & low[0] & low[1] & high[0] & high[1], "left_anti")


def cluster_rects(rects: DataFrame, gap: float = DEFAULT.cluster_gap) -> DataFrame:
    """Rectangles of a page within ``gap`` merged, one pass in order. rects: doc_id, page, rect_no, bbox.

    Each rectangle joins all clusters it meets so far into one, which goes last. The pass depends on order and is not
    a transitive closure, so a page's boxes, in order, are folded in one expression; a page must fit a row.
    """
    at = lambda b, i: F.get(b, F.lit(i))
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("rect_no", "bbox"))), lambda s: s["bbox"])
    solid = F.filter(boxes, lambda b: (at(b, 2) > at(b, 0)) & (at(b, 3) > at(b, 1)))

    def join(found: Column, box: Column) -> Column:
        meets = lambda c: (at(box, 0) - gap < at(c, 2)) & (at(c, 0) < at(box, 2) + gap) & (at(box, 1) - gap < at(c, 3)) & (at(c, 1) < at(box, 3) + gap)
        grown = F.aggregate(F.filter(found, meets), box, lambda a, c: F.array(F.least(at(a, 0), at(c, 0)), F.least(at(a, 1), at(c, 1)), F.greatest(at(a, 2), at(c, 2)), F.greatest(at(a, 3), at(c, 3))))
        return F.concat(F.filter(found, lambda c: ~meets(c)), F.array(grown))

    folded = F.aggregate(solid, F.array().cast("array<array<double>>"), join)
    pages = rects.groupBy("doc_id", "page").agg(folded.alias("found"))
    return pages.select("doc_id", "page", F.posexplode("found").alias("n", "bbox")).select("doc_id", "page", (F.col("n") + 1).alias("cluster_no"), "bbox")


def figures(clusters: DataFrame, pages: DataFrame, tables: DataFrame, cfg: ParserConfig = DEFAULT) -> DataFrame:
    """Clusters neither too small nor nearly the page, whose centre is in no table, clipped to the page (width, height)."""
    box = lambda i: F.col("bbox")[i]
    area = (box(2) - box(0)) * (box(3) - box(1))
    kept = clusters.join(pages, ["doc_id", "page"]).where((area >= cfg.min_figure_area) & (area <= cfg.max_page_share * F.col("width") * F.col("height")))
    kept = kept.withColumn("bbox", F.array(F.greatest(box(0), F.lit(0.0)), F.greatest(box(1), F.lit(0.0)), F.least(box(2), F.col("width")), F.least(box(3), F.col("height")))).drop("width", "height")
    a, b = kept.alias("a"), tables.select("doc_id", "page", "bbox").alias("b")
    mid = lambda i: (F.col("a.bbox")[i] + F.col("a.bbox")[i + 2]) / 2
    inside = [mid(i).between(F.col("b.bbox")[i], F.col("b.bbox")[i + 2]) for i in (0, 1)]
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & inside[0] & inside[1], "left_anti")
