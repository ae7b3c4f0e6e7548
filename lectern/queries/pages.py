"""Queries on page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.plans import pdf_text
from lectern.queries import texts as T
from lectern.queries import views as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


MODAL_SQL = f"""{V.BLOCKS_SQL},
z AS (SELECT doc_id, round_even(size * 2, 0) / 2 AS z, i FROM blocks WHERE length(text) >= 40 AND size > 0),
m AS (SELECT doc_id, z, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS r FROM z GROUP BY doc_id, z),
modal AS (SELECT p.page_id AS doc_id, coalesce(m.z, 12.0)::DOUBLE AS body_size FROM pages p LEFT JOIN m ON m.doc_id = p.page_id AND r = 1)"""

ORDER_SQL = f"""{MODAL_SQL},
f AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (x1 - x0 < 330 AND (x0 + x1) / 2 < 300) AS l, count(*) FILTER (x1 - x0 < 330 AND (x0 + x1) / 2 >= 300) AS r, min(y0) FILTER (x1 - x0 < 330) AS top
  FROM blocks GROUP BY doc_id),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY doc_id ORDER BY
    CASE WHEN f.n < 6 OR f.l < 3 OR f.r < 3 THEN 0 WHEN x1 - x0 < 330 THEN CASE WHEN (x0 + x1) / 2 < 300 THEN 1 ELSE 2 END WHEN y0 < f.top - 4 THEN 0 ELSE 3 END, y0, x0, i) AS nth
  FROM blocks b JOIN f USING (doc_id))"""

KIND_SQL = rf"""{ORDER_SQL},
k AS (
  SELECT o.doc_id, o.nth, o.i, o.text, CASE
    WHEN text = '' THEN NULL WHEN y1 <= 64 AND length(text) <= 80 THEN 'header'
    WHEN y0 >= 736 AND (regexp_matches(text, '^\s*[-–—]?\s*\d+\s*[-–—]?\s*$') OR length(text) <= 80) THEN 'footer'
    WHEN y0 >= 640 AND size < body_size * 0.85 THEN 'footnote'
    WHEN size < body_size * 0.8 AND (x0 > 432 OR x1 < 168) AND length(text) <= 200 THEN 'sidenote'
    WHEN regexp_matches(text, '(?i)^(chapter|book|prologue|epilogue|part|glossary|map|contents|foreword|preface)\b') OR regexp_full_match(text, '\d+') THEN 'heading'
    WHEN regexp_full_match(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '\p{{Lu}}+') AND length(text) <= 60 THEN 'heading'
    WHEN size >= body_size * 1.15 AND (length(text) <= 80 OR (len(string_split(text, ' ')) <= 8 AND regexp_matches(text, '^\p{{Lu}}') AND NOT ends_with(text, '.'))) THEN 'heading'
    ELSE 'body' END AS kind
  FROM o JOIN modal USING (doc_id))"""


@query(f"WITH {KIND_SQL} SELECT doc_id, nth, kind, text FROM k")
def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = layout.classified(V.layout_pages(spark, sf_dir)).select("doc_id", F.posexplode_outer("parts").alias("nth", "p")).where("nth is not null")
    return made.select("doc_id", (F.col("nth") + 1).cast("long").alias("nth"), "p.kind", "p.text")


@query(f"WITH {MODAL_SQL} SELECT doc_id, body_size FROM modal")
def modal_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.classified(V.layout_pages(spark, sf_dir)).select("doc_id", "body_size")


@query(f"WITH {ORDER_SQL} SELECT doc_id, nth, x0, y0 FROM o")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.layout_pages(spark, sf_dir)
    made = pages.select("doc_id", F.posexplode_outer(layout.reading_order(F.filter("blocks", lambda b: b["type"] == 0), F.col("width"))).alias("nth", "b")).where("nth is not null")
    return made.select("doc_id", (F.col("nth") + 1).cast("long").alias("nth"), "b.bbox.x0", "b.bbox.y0")


@query(f"WITH {V.BLOCKS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id) SELECT page_id AS doc_id, CASE WHEN page_id % 4 = 0 AND coalesce(n, 0) > 0 THEN (page_id % 500) * 400 / 480000.0::DOUBLE ELSE 0.0 END AS fraction FROM pages LEFT JOIN n ON n.doc_id = page_id")
def image_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.layout_pages(spark, sf_dir).select("doc_id", layout.image_fraction(F.col("blocks"), F.col("width"), F.col("height")).alias("fraction"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
s AS (SELECT doc_id, unnest([left(w[1], 1), substr(w[1], 2)] || w[2:]) AS t, generate_subscripts([left(w[1], 1), substr(w[1], 2)] || w[2:], 1) - 1 AS k FROM d),
x AS (SELECT doc_id, k, CASE WHEN k % 4 = 3 THEN ' ' || t ELSE t END AS t, CASE WHEN k = 0 THEN 24.0 ELSE 14.0 END AS size, CASE WHEN k % 3 = 0 THEN 0.5 ELSE 5.0 END AS gap FROM s),
l AS (SELECT *, lag(t) OVER w AS p, lag(size) OVER w AS ps, lag(gap) OVER w AS g FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
j AS (SELECT doc_id, k, CASE WHEN k = 0 THEN t WHEN regexp_full_match(trim(p), '\p{L}{1,2}') AND regexp_matches(ltrim(t), '^\p{Ll}') AND ps > size * 1.1 THEN ltrim(t) WHEN ends_with(p, ' ') OR starts_with(t, ' ') OR g < 1 THEN t ELSE ' ' || t END AS t FROM l)
SELECT doc_id, string_agg(t, '' ORDER BY k) AS text FROM j GROUP BY doc_id""")
def span_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents as spans of a line, the first letter large and on its own."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    texts = F.concat(F.array(F.left(words[0], F.lit(1)), F.substring(words[0], 2, 1 << 30)), F.slice(words, 2, 1 << 30))

    def span(t, k):
        x0 = k * 10.0
        box = F.struct(x0.alias("x0"), F.lit(0.0).alias("y0"), (x0 + 10.0 - F.when(k % 3 == 0, 0.5).otherwise(5.0)).alias("x1"), F.lit(1.0).alias("y1"))
        return F.struct(F.when(k % 4 == 3, F.concat(F.lit(" "), t)).otherwise(t).alias("text"), F.when(k == 0, 24.0).otherwise(14.0).alias("size"), box.alias("bbox"))

    spans = V.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.transform(texts, span).alias("spans"))
    return spans.select("doc_id", layout.span_text(F.col("spans")).alias("text"))


@query(rf"""
WITH {KIND_SQL},
h AS (SELECT doc_id, nth, kind, text FROM k WHERE kind IN ('heading', 'body')),
a AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) AS letters FROM h GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS blocks FROM blocks GROUP BY doc_id)
SELECT page_id AS doc_id, CASE WHEN coalesce(letters, 0) < 25 AND page_id % 4 = 0 AND coalesce(blocks, 0) > 0 AND (page_id % 500 * 400 >= 120000 OR n IS NULL) THEN 'skipped' WHEN n IS NULL THEN 'empty' ELSE 'kept' END AS state
FROM pages LEFT JOIN a ON a.doc_id = page_id LEFT JOIN c ON c.doc_id = page_id""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_parts(V.layout_pages(spark, sf_dir)).select("doc_id", "state")


#: The segments of kept pages, fifty pages a book, under the names that the SQL on lines of books uses.
PAGES_SQL = rf"""{KIND_SQL},
hb AS (SELECT doc_id, nth, kind, text FROM k WHERE kind IN ('heading', 'body')),
mh AS (SELECT *, kind = 'heading' AND regexp_full_match(text, '\d+') AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY nth) = 'heading', false) AS merges FROM hb),
mg AS (SELECT *, sum(CASE WHEN merges THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY nth) AS seg FROM mh),
sg AS (SELECT doc_id AS page_id, seg, min(kind) AS kind, string_agg(text, ' ' ORDER BY nth) AS text FROM mg GROUP BY doc_id, seg),
sa AS (SELECT page_id, count(*) AS n, sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))) AS letters FROM sg GROUP BY page_id),
sb AS (SELECT doc_id AS page_id, count(*) AS blocks FROM blocks GROUP BY doc_id),
st AS (
  SELECT page_id, CASE WHEN coalesce(letters, 0) < 25 AND page_id % 4 = 0 AND coalesce(blocks, 0) > 0 AND (page_id % 500 * 400 >= 120000 OR n IS NULL) THEN 'skipped' WHEN n IS NULL THEN 'empty' ELSE 'kept' END AS state
  FROM pages LEFT JOIN sa USING (page_id) LEFT JOIN sb USING (page_id)),
lines AS (SELECT page_id // 50 AS doc_id, page_id % 50 + 1 AS page, (page_id % 50 + 1) * 1000000 + seg AS pos, kind, text FROM sg JOIN st USING (page_id) WHERE state = 'kept')"""


@query(rf"""
WITH {T.PARAS_SQL.replace(V.LINES_SQL, PAGES_SQL)},
body AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY para) || chr(10) AS text FROM paras GROUP BY doc_id),
rep AS (SELECT page_id // 50 AS doc_id, count(*) AS n, string_agg(concat(page_id % 50 + 1, ' (1 image)'), ', ' ORDER BY page_id % 50) FILTER (state = 'skipped') AS skipped FROM st GROUP BY ALL)
SELECT doc_id, concat('# source: ', doc_id, chr(10), '# pages: ', n, chr(10), '# skipped_image_pages: ', coalesce(skipped, 'none'), chr(10), '# ocr_pages: none', chr(10), '# tts: skip lines starting with #', chr(10), chr(10), body.text) AS text
FROM body JOIN rep USING (doc_id)""")
def convert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan from page layouts to texts: fifty web pages are the pages of one book."""
    pages = V.layout_pages(spark, sf_dir).withColumn("page", (F.col("doc_id") % 50 + 1).cast("int")).withColumn("doc_id", F.floor(F.col("doc_id") / 50))
    return pdf_text.convert(pages).texts
