"""Headings as a tree and running lines in the margins; the twins walk the headings one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import layout, outline
from sparkloom.query_sets.answers import _PAGE_LINES, _page_lines
from sparkloom.registry import ORACLES, register

#: Headings of all texts, some numbered, some lettered, in five sizes.
_HEADS = f"""{_PAGE_LINES}, heads AS (SELECT p.doc, p.line AS place, p.page, CASE WHEN p.line % 7 = 5 THEN 'Appendix B ' || p.text WHEN p.line % 3 = 1 THEN (p.line % 4)::VARCHAR || ' ' || p.text WHEN p.line % 3 = 2 THEN (p.line % 4)::VARCHAR || '.' || (p.line % 2)::VARCHAR || CASE WHEN p.line % 5 = 0 THEN '.1' ELSE '' END || ' ' || p.text ELSE p.text END AS text,
  CASE WHEN k.kind = 'size' THEN 14 + (p.line % 4) * 0.9 ELSE p.size END::DOUBLE AS size, b.body FROM pl p JOIN ({ORACLES["headings"]}) k ON k.doc = p.doc AND k.line = p.line JOIN ({ORACLES["body_size"]}) b ON b.doc = p.doc WHERE k.kind IS NOT NULL)"""
#: Their levels, heading after heading: large ones by groups of sizes, others by the headings before.
_WALK = r"""sz AS (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY size DESC) AS i FROM (SELECT DISTINCT doc, size FROM heads WHERE size >= 1.18 * body)),
 cl AS (SELECT doc, i, size, size AS anchor, 1 AS rank FROM sz WHERE i = 1 UNION ALL SELECT s.doc, s.i, s.size, CASE WHEN s.size >= 0.92 * anchor THEN anchor ELSE s.size END, CASE WHEN s.size >= 0.92 * anchor THEN rank ELSE rank + 1 END FROM cl JOIN sz s ON s.doc = cl.doc AND s.i = cl.i + 1),
 hn AS (SELECT h.doc, place, page, left(trim(text), 200) AS title, nullif(regexp_extract(text, '^(\d+(?:\.\d+)*)\.?\s', 1), '') AS number, regexp_matches(text, '(?i)^(?:Part|Chapter|Appendix|Annex|Section)\b') AS lettered, least(3, c.rank) AS big, 1 + coalesce((SELECT max(least(3, rank)) FROM cl x WHERE x.doc = h.doc), 0) AS below, row_number() OVER (PARTITION BY h.doc ORDER BY place) AS i
  FROM heads h LEFT JOIN cl c ON c.doc = h.doc AND c.size = h.size),
 walk AS (SELECT doc, 0::BIGINT AS i, []::VARCHAR[] AS nums, []::BIGINT[] AS lvls, NULL::BIGINT AS section, 0::BIGINT AS level, NULL::BIGINT AS place, []::VARCHAR[] AS path, []::BIGINT[] AS up FROM (SELECT DISTINCT doc FROM heads) UNION ALL
  SELECT doc, i, list_append(nums, coalesce(number, '')), list_append(lvls, lv), CASE WHEN number IS NOT NULL OR lettered OR big IS NOT NULL THEN lv ELSE section END, least(lv, level + 1), at_, list_append(path[1:least(lv, level + 1) - 1], title), list_append(up[1:least(lv, level + 1) - 1], at_)
  FROM (SELECT h.doc, h.i, h.place AS at_, w.nums, w.lvls, w.section, w.level, w.path, w.up, h.number, h.lettered, h.big, h.title, least(6, CASE WHEN h.big IS NOT NULL THEN h.big WHEN h.number IS NOT NULL THEN coalesce(w.lvls[list_max(list_filter(range(1, len(w.nums) + 1), lambda k: contains(h.number, '.') AND w.nums[k] = regexp_replace(h.number, '\.[^.]*$', '')))] + 1, h.below + length(h.number) - length(replace(h.number, '.', '')))
    WHEN h.lettered THEN h.below ELSE coalesce(w.section + 1, h.below) END)::BIGINT AS lv FROM walk w JOIN hn h ON h.doc = w.doc AND h.i = w.i + 1))"""


def _heads(spark, sf_dir):
    found = layout.headings(_page_lines(spark, sf_dir)).where("kind is not null")
    line = F.col("line")
    number = lambda n: (line % n).cast("string")
    titled = F.when(line % 7 == 5, F.concat(F.lit("Appendix B "), "text")).when(line % 3 == 1, F.concat(number(4), F.lit(" "), "text"))
    titled = titled.when(line % 3 == 2, F.concat(number(4), F.lit("."), number(2), F.when(line % 5 == 0, ".1").otherwise(""), F.lit(" "), "text")).otherwise(F.col("text"))
    size = F.when(F.col("kind") == "size", 14 + (line % 4) * 0.9).otherwise(F.col("size")).cast("double")
    return found.select("doc", F.col("line").alias("place"), "page", titled.alias("text"), size.alias("size"), "body")


@register("outline_levels", f"WITH RECURSIVE {_HEADS}, {_WALK} SELECT doc, place, level FROM walk WHERE i > 0")
def _levels(spark, sf_dir):
    number, lettered = outline.numbering(F.col("text"))
    heads = _heads(spark, sf_dir)
    return layout.heading_levels(heads.select("doc", "place", "size", "body", number.alias("number"), lettered.alias("lettered")))


@register("outline_tree", f"""WITH RECURSIVE {_HEADS}, {_WALK} SELECT w.doc, w.place, h.page, w.level, h.title, array_to_string(w.path, ' > ') AS path, w.up[w.level - 1] AS parent, (SELECT min(n.place) FROM walk n WHERE n.doc = w.doc AND n.i > w.i AND n.level <= w.level) AS until
 FROM walk w JOIN hn h ON h.doc = w.doc AND h.place = w.place WHERE w.i > 0""")  # fmt: skip
def _tree(spark, sf_dir):
    return outline.outline(_heads(spark, sf_dir)).withColumn("path", F.array_join("path", " > "))


_PLAIN_HEADS = f"""{_PAGE_LINES}, heads AS (SELECT p.doc, p.line AS place, p.page, CASE WHEN p.line % 3 > 0 THEN (p.line % 4)::VARCHAR || CASE WHEN p.line % 3 = 2 THEN '.1' ELSE '' END || ' x' ELSE 'x' END AS text, p.size::DOUBLE AS size, b.body
  FROM pl p JOIN ({ORACLES["headings"]}) k ON k.doc = p.doc AND k.line = p.line JOIN ({ORACLES["body_size"]}) b ON b.doc = p.doc WHERE k.kind IS NOT NULL)"""


@register("heading_levels", f"WITH RECURSIVE {_PLAIN_HEADS}, {_WALK} SELECT doc, place, level FROM walk WHERE i > 0")
def _plain_levels(spark, sf_dir):
    found = layout.headings(_page_lines(spark, sf_dir)).where("kind is not null")
    number = F.when(F.col("line") % 3 > 0, F.concat((F.col("line") % 4).cast("string"), F.when(F.col("line") % 3 == 2, ".1").otherwise("")))
    return layout.heading_levels(found.select("doc", F.col("line").alias("place"), "size", "body", number.alias("number")))


_MARGIN_LINES = f"""{_PAGE_LINES}, ml AS (SELECT doc, page, line, CASE WHEN line % 9 = 0 AND doc % 3 = 0 THEN 'Chapter ' || (page + 1) || ' of it' WHEN line % 9 = 8 AND doc % 3 = 1 THEN 'Confidential' WHEN line % 9 = 0 AND doc % 3 = 2 AND page % 2 = 0 THEN 'Page ' || (page + 1) WHEN line % 9 = 4 THEN 'Confidential' ELSE text END AS text,
  top, top + 10 AS bottom, size FROM pl), mp AS (SELECT doc, page, 116.0 AS height FROM ml GROUP BY 1, 2), mn AS (SELECT doc, count(*) AS pages FROM mp GROUP BY 1), bs AS ({ORACLES["body_size"]})"""


@register("margin_lines", f"""WITH {_MARGIN_LINES}, e AS (SELECT ml.*, height, pages, body, (row_number() OVER (PARTITION BY ml.doc, ml.page ORDER BY top, line) <= 2 OR row_number() OVER (PARTITION BY ml.doc, ml.page ORDER BY top DESC, line DESC) <= 2) AND (top < 0.12 * height OR bottom > 0.88 * height) AS edge, lower(text) AS t, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS m FROM ml JOIN mp USING (doc, page) JOIN mn USING (doc) JOIN bs USING (doc)),
 f AS (SELECT *, (SELECT count(DISTINCT x.page) FROM e x WHERE x.doc = e.doc AND x.edge AND x.t = e.t) AS same, (SELECT count(DISTINCT x.page) FROM e x WHERE x.doc = e.doc AND x.edge AND x.m = e.m) AS alike, CASE WHEN pages > 2 THEN greatest(3, ceil(0.4 * pages)) ELSE 2 END AS least FROM e)
SELECT doc, page, line, text FROM f WHERE NOT (edge AND (regexp_matches(text, '(?i)^(?:page\\s+)?[-–]?\\s*\\d{{1,4}}\\s*[-–]?(?:\\s*(?:of|/)\\s*\\d{{1,4}})?$') OR (pages >= 2 AND same >= least) OR (pages >= 3 AND alike >= least AND (top < 0.08 * height OR bottom > 0.92 * height) AND length(text) <= 60 AND size < 1.18 * body)))""")  # fmt: skip
def _margins(spark, sf_dir):
    line, doc, page = F.col("line"), F.col("doc"), F.col("page")
    text = F.when((line % 9 == 0) & (doc % 3 == 0), F.concat(F.lit("Chapter "), (page + 1).cast("string"), F.lit(" of it"))).when((line % 9 == 8) & (doc % 3 == 1), "Confidential")
    text = text.when((line % 9 == 0) & (doc % 3 == 2) & (page % 2 == 0), F.concat(F.lit("Page "), (page + 1).cast("string"))).when(line % 9 == 4, "Confidential").otherwise(F.col("text"))
    given = _page_lines(spark, sf_dir)
    lines = given.select("doc", "page", "line", text.alias("text"), "top", (F.col("top") + 10).alias("bottom"), "size")
    pages = lines.select("doc", "page").distinct().withColumn("height", F.lit(116.0))
    return outline.without_margins(lines, pages, layout.body_size(given)).select("doc", "page", "line", "text")


