"""Views of the driver's tables as books, pages, scripts and voices, once for Spark and once as SQL of equal arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


RAW_SQL = """
raw AS (
  SELECT doc_id, trim(x) AS raw, pos FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)
  WHERE trim(x) <> '')"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pos, raw``: the non-empty lines of documents."""
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "x"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("x").alias("raw")).where("raw <> ''")


#: Headings, running heads, ellipses, quotes and cut-off ends put into the lines, in this priority.
LINE_CASE = """CASE WHEN pos % 7 = 0 THEN 'RUNNING HEAD' WHEN pos % 40 = 5 THEN concat('CHAPTER ', pos) WHEN pos % 11 = 3 THEN concat(raw, '. . .')
  WHEN pos % 5 = 1 THEN concat('“', raw, '”') WHEN pos % 13 = 2 THEN left(raw, length(raw) - 1) ELSE raw END"""
KIND_CASE = "CASE WHEN pos % 7 <> 0 AND pos % 40 = 5 THEN 'heading' ELSE 'body' END"

LINES_SQL = f"""{RAW_SQL},
lines AS (
  SELECT * FROM (SELECT doc_id, pos, pos // 7 AS page, pos AS seg, {KIND_CASE} AS kind, {LINE_CASE} AS text FROM raw) WHERE trim(text) <> '')"""


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pos, page, seg, kind, text``: documents as books of seven lines a page."""
    page = F.floor(F.col("pos") / 7).cast("long").alias("page")
    return raw_lines(spark, sf_dir).select("doc_id", "pos", page, F.col("pos").alias("seg"), F.expr(KIND_CASE).alias("kind"), F.expr(LINE_CASE).alias("text")).where("trim(text) <> ''")


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`book_lines` as a table, for operators that read segments more than once: as in a run over stored pages."""
    return shared.written(book_lines(spark, sf_dir), "lines")


WIDTH, HEIGHT = 600.0, 800.0
_TAGS = r"<(h1|p|li|div)[^>]*>([^<]*)"

#: Geometry of the i-th block of a page by its tag.
X0 = "CASE WHEN tag = 'h1' THEN 60.0 WHEN tag = 'li' THEN 5.0 WHEN tag = 'div' THEN 40.0 WHEN i % 2 = 0 THEN 40.0 ELSE 320.0 END"
X1 = "CASE WHEN tag = 'h1' THEN 540.0 WHEN tag = 'li' THEN 150.0 WHEN tag = 'div' THEN 560.0 WHEN i % 2 = 0 THEN 280.0 ELSE 560.0 END"
SIZE = "CASE WHEN tag = 'h1' THEN 20.0 WHEN tag = 'li' THEN 8.0 WHEN tag = 'div' THEN 7.0 ELSE 12.0 + i % 3 END"

BLOCKS_SQL = rf"""
tags AS (
  SELECT page_id AS doc_id, unnest(regexp_extract_all(coalesce(html, ''), '{_TAGS}', 1)) AS tag, unnest(regexp_extract_all(coalesce(html, ''), '{_TAGS}', 2)) AS t,
         generate_subscripts(regexp_extract_all(coalesce(html, ''), '{_TAGS}', 1), 1) - 1 AS i
  FROM pages),
blocks AS (
  SELECT doc_id, i, tag, ({X0})::DOUBLE AS x0, ({X1})::DOUBLE AS x1, (10 + (i * 37 + doc_id * 11) % 780)::DOUBLE AS y0, (40 + (i * 37 + doc_id * 11) % 780)::DOUBLE AS y1,
         ({SIZE})::DOUBLE AS size, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text
  FROM tags)"""


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page, width, height, blocks``: the tags of web pages as blocks of a page, and an image on every fourth."""
    pages = table(spark, sf_dir, "pages", "page_id", "html").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.coalesce("html", F.lit("")).alias("html"))
    # tags and texts are zipped before the lambda: a column used inside one is evaluated for every element
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(_TAGS), F.lit(2)).alias("t"))
    both = pages.withColumn("found", found)
    y = "CAST(10 + (i * 37 + doc_id * 11) % 780 AS double)"
    box = f"named_struct('x0', CAST({X0} AS double), 'y0', {y}, 'x1', CAST({X1} AS double), 'y1', {y} + 30)"
    line = f"named_struct('spans', array(named_struct('text', trim(regexp_replace(x.t, '\\\\s+', ' ')), 'size', CAST({SIZE} AS double), 'bbox', {box})))"
    text = f"transform(found, (x, i) -> named_struct('type', 0, 'bbox', {box}, 'lines', array({line})))".replace("WHEN tag =", "WHEN x.tag =")
    image = "named_struct('type', 1, 'bbox', named_struct('x0', 50D, 'y0', 100D, 'x1', CAST(50 + doc_id % 500 AS double), 'y1', 500D), 'lines', slice(element_at(text, 1).lines, 1, 0))"
    made = both.withColumn("text", F.expr(text))
    return made.withColumn("blocks", F.expr(f"CASE WHEN doc_id % 4 = 0 AND size(text) > 0 THEN concat(text, array({image})) ELSE text END")).select("doc_id", "page", "width", "height", "blocks")


SCRIPT_SQL = """
script AS (SELECT conv_id AS book_id, turn + 1 AS position, role AS speaker_id, coalesce(text, '') AS dialogue FROM conversations)"""


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, position, speaker_id, dialogue``: conversations as scripts."""
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("position"), F.col("role").alias("speaker_id"), F.coalesce("text", F.lit("")).alias("dialogue"))


VOICES_SQL = """
voices AS (
  SELECT concat('v', lpad(s_suppkey::VARCHAR, 9, '0')) AS voice_id, s_nationkey::VARCHAR AS speaker_id, CASE s_suppkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender,
         sha256(s_name) AS sha256
  FROM supplier)"""


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``voice_id, speaker_id, gender, sha256``: suppliers as a voice library."""
    gender = F.when(F.col("s_suppkey") % 3 == 0, "female").when(F.col("s_suppkey") % 3 == 1, "male").otherwise("unknown")
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").select(F.concat(F.lit("v"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("voice_id"), F.col("s_nationkey").cast("string").alias("speaker_id"), gender.alias("gender"), F.sha2("s_name", 256).alias("sha256"))


def pieces_sql(source: str, keys: str, limits: tuple[int, ...] = (300,)) -> str:
    """Views ``cut(keys, lim, n, piece, rest)`` and ``unbroken(keys)`` of a view ``source(keys, lim, text)``.

    Pieces one after the other: all that is left if it fits; else up to the last mark, with a quote or
    without, from a third of the limit on that white space follows; else up to the last white space.
    """

    def longest(lim: int) -> str:
        mark = rf"regexp_extract(left(rest, {lim + 1}), '(?s)^(.{{{{{lim // 3},{lim - 1}}}}}[.!?;:,])\s', 1)".replace("{{", "{").replace("}}", "}")
        quote = rf"regexp_extract(left(rest, {lim + 1}), '(?s)^(.{{{{{lim // 3},{lim - 2}}}}}[.!?;:,][”\"''])\s', 1)".replace("{{", "{").replace("}}", "}").replace('\\"', '"')
        space = rf"regexp_extract(left(rest, {lim + 1}), '(?s)^(.{{{{0,{lim - 1}}}}}\S)\s', 1)".replace("{{", "{").replace("}}", "}")
        return f"CASE WHEN length({mark}) >= length({quote}) AND {mark} <> '' THEN {mark} WHEN {quote} <> '' THEN {quote} ELSE {space} END"

    which = " ".join(f"WHEN lim = {x} THEN {longest(x)}" for x in limits)
    return rf"""
cut({keys}, lim, n, piece, rest) AS (
  SELECT {keys}, lim, -1, '', regexp_replace(text, '^\s+|\s+$', '', 'g') FROM {source} WHERE text IS NOT NULL
  UNION ALL
  SELECT {keys}, lim, n + 1, p, regexp_replace(substr(rest, length(p) + 1), '^\s+', '')
  FROM (SELECT *, CASE WHEN length(rest) <= lim THEN rest ELSE CASE {which} END END AS p FROM cut WHERE rest <> '') WHERE p <> ''),
unbroken AS (SELECT {keys} FROM cut GROUP BY ALL HAVING min(length(rest)) > 0)"""
