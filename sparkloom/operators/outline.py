"""Documents as outlines: running lines in the margins, labels that run into text, numbering, and the tree of headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import mask_digits
from sparkloom.operators.layout import DEEPEST, LARGER, heading_levels
from sparkloom.session import written

# Margins as shares of a page, lines at each end that may be running ones, the share of pages that repeat them, and what numbers a page or a section.
MARGIN, OUTER, EDGE_LINES, RUNNING_SHARE, SHORT = 0.12, 0.08, 2, 0.4, 60
PAGE_NUMBER = r"(?i)^(?:page\s+)?[-–]?\s*\d{1,4}\s*[-–]?(?:\s*(?:of|/)\s*\d{1,4})?$"
SECTION, LETTERED = r"^(\d+(?:\.\d+)*)\.?\s", r"(?i)^(?:Part|Chapter|Appendix|Annex|Section)\b"
MOST_TITLE = 200


def without_margins(lines: DataFrame, pages: DataFrame, body: DataFrame) -> DataFrame:
    """lines (doc, page, line, text, top, bottom, size) without running headers, footers and page numbers.

    Only the two outermost lines at each end of a page (doc, page, height), and only within MARGIN of it, may be such. They
    go if they number the page, if their text stands there on RUNNING_SHARE of the pages, at least three (two of two), or, if
    short, in the outer OUTER and not set like a heading (body: doc, body), if it does but for its numbers.
    """
    end = lambda column, name: F.row_number().over(Window.partitionBy("doc", "page").orderBy(column, name))
    held = lines.join(pages.select("doc", "page", "height"), ["doc", "page"]).withColumns({"_a": end(F.col("top"), F.col("line")), "_z": end(F.desc("top"), F.desc("line")), "_exact": F.lower("text"), "_masked": mask_digits(F.col("text"))})
    inside = (F.col("top") < MARGIN * F.col("height")) | (F.col("bottom") > (1 - MARGIN) * F.col("height"))
    held = held.withColumn("_edge", ((F.col("_a") <= EDGE_LINES) | (F.col("_z") <= EDGE_LINES)) & inside)
    count = pages.groupBy("doc").agg(F.count("*").alias("_pages"))
    threshold = F.when(F.col("_pages") > 2, F.greatest(F.lit(3), F.ceil(RUNNING_SHARE * F.col("_pages")))).otherwise(2)
    edges = held.where("_edge").join(count, "doc").withColumn("_least", threshold)
    on = lambda text, least: edges.groupBy("doc", text, "_pages", "_least").agg(F.countDistinct("page").alias("n")).where((F.col("n") >= F.col("_least")) & (F.col("_pages") >= least)).select("doc", text)
    marked = held.join(on("_exact", 2).withColumn("_e", F.lit(True)), ["doc", "_exact"], "left").join(on("_masked", 3).withColumn("_m", F.lit(True)), ["doc", "_masked"], "left").join(body, "doc", "left")
    outer = (F.col("top") < OUTER * F.col("height")) | (F.col("bottom") > (1 - OUTER) * F.col("height"))
    masked = F.col("_m") & outer & (F.length("text") <= SHORT) & (F.col("size") < LARGER * F.col("body"))
    running = F.col("text").rlike(PAGE_NUMBER) | F.coalesce(F.col("_e"), F.lit(False)) | F.coalesce(masked, F.lit(False))
    return marked.where(~(F.col("_edge") & running)).select(*lines.columns)


def numbering(title: Column) -> tuple[Column, Column]:
    """A heading's number (3.2), null without one, and whether it is lettered or named (Appendix B, Part two)."""
    number = F.nullif(F.regexp_extract(title, SECTION, 1), F.lit(""))
    return number, number.isNull() & title.rlike(LETTERED)


def run_in_labels(blocks: DataFrame) -> DataFrame:
    """blocks (doc, page, place, kind, text, size, body) where a heading of body size that ends in a colon begins the paragraph
    after it on its page; one without such a paragraph is a paragraph itself. A joined block has its label's place."""
    label = (F.col("kind") == "heading") & F.col("text").endswith(":") & (F.col("size") < LARGER * F.col("body"))
    w = Window.partitionBy("doc").orderBy("page", "place")
    held = blocks.withColumn("_label", label)
    joins = F.coalesce(F.lag("_label").over(w) & (F.col("kind") == "para") & (F.lag("page").over(w) == F.col("page")), F.lit(False))
    held = held.withColumn("_g", F.sum((~joins).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("place", "text", "size")))  # a label and its paragraph
    out = held.groupBy("doc", "page", "_g").agg(parts.alias("p"), F.min("place").alias("place"), F.bool_or("_label").alias("_label"), F.max_by("kind", "place").alias("kind"), F.max("body").alias("body"))
    kind = F.when(F.col("_label"), "para").otherwise(F.col("kind"))
    return out.select("doc", "page", "place", kind.alias("kind"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), F.get("p", F.lit(0))["size"].alias("size"), "body")


def outline(headings: DataFrame) -> DataFrame:
    """(doc, place, page, level, title, parent, path, until) of headings (doc, place, page, text, size, body), in a tree.

    parent is the place of the heading above, path the titles from the top down to this one, until the place of the next
    heading that isn't below this one (null: the document's end). No level is left out, so the heading above one of level k
    is the last before it of level k - 1, and so on up: a stack, read off windows. Headings are written first, as they are
    met for their levels and for their titles.
    """
    headings = written(headings)
    title = F.substring(F.trim("text"), 1, MOST_TITLE)
    number, lettered = numbering(F.col("text"))
    levels = heading_levels(headings.select("doc", "place", "size", "body", number.alias("number"), lettered.alias("lettered")))
    held = headings.select("doc", F.col("place").cast("long").alias("place"), "page", title.alias("title")).join(levels, ["doc", "place"])
    w = Window.partitionBy("doc").orderBy("place")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    for k in range(1, DEEPEST + 1):
        own = F.col("level") == k
        held = held.withColumns({f"_p{k}": F.last(F.when(own, F.struct("place", "title")), ignorenulls=True).over(before), f"_n{k}": F.first(F.when(F.col("level") <= k, F.col("place")), ignorenulls=True).over(after)})
    above = F.filter(F.array(*[F.when(F.col("level") > k, F.col(f"_p{k}")) for k in range(1, DEEPEST)]), lambda x: x.isNotNull())
    until = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_n{k}")) for k in range(1, DEEPEST + 1)])
    held = held.withColumn("_above", above)
    parent = F.when(F.col("level") > 1, F.try_element_at("_above", F.lit(-1))["place"])
    return held.select("doc", "place", "page", "level", "title", parent.alias("parent"), F.concat(F.transform("_above", lambda x: x["title"]), F.array("title")).alias("path"), until.alias("until"))


def nested(tree: DataFrame) -> DataFrame:
    """(doc, outline): the headings of each document as Markdown bullets with their pages, in order."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("title"), F.lit(" ("), F.col("page").cast("string"), F.lit(")"))
    listed = tree.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))).alias("s"))  # a document's headings
    return listed.select("doc", F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("outline"))
