"""Queries on text: cleaning, comparison, running lines, stitching, hyphens, pieces, chunks, speech and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import alignment, chunking, cleanup, hyphens, layout, locate, scripts
from lectern.queries import views as V
from lectern.sources import shared

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


SPOKEN = r"regexp_replace(regexp_replace(regexp_replace(translate(nfc_normalize(text), chr(160) || '‘’“”', ' ''''\"\"'), '\.\s*\.\s*\.[.\s]*|…', '...', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')".replace('\\"', '"')
FORM = r"translate(regexp_replace({}, '\s+', '', 'g'), '‘’“”', '''''\"\"')".replace('\\"', '"')


@query(r"""
WITH d AS (
  SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 17 = 4 THEN '# ' || x WHEN (i - 1) % 19 = 6 THEN concat(' --- page ', i - 1, ' ---') ELSE x END), chr(10)) AS text
  FROM documents),
k AS (
  SELECT doc_id, regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
         lambda x: NOT regexp_matches(x, '^\s*#') AND NOT regexp_full_match(x, '\s*--- page \d+ ---\s*')), chr(10)), '^\s+|\s+$', '', 'g') AS text
  FROM d)
SELECT doc_id, text FROM k WHERE text <> ''""")
def clean_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 17 == 4, F.concat(F.lit("# "), x)).when(i % 19 == 6, F.concat(F.lit(" --- page "), i.cast("string"), F.lit(" ---"))).otherwise(x))
    return V.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.clean_source(F.array_join(marked, "\n")).alias("text")).where("text is not null")


@query(f"WITH {V.LINES_SQL} SELECT doc_id, pos, {SPOKEN} AS spoken, {FORM.format('text')} AS form FROM lines")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.book_lines(spark, sf_dir).select("doc_id", "pos", T.spoken_form(F.col("text")).alias("spoken"), T.comparison_form(F.col("text")).alias("form"))


@query("SELECT doc_id, sha256(to_json(text)::VARCHAR) AS digest FROM documents WHERE text IS NOT NULL")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.digest(F.col("text")).alias("digest"))


@query(rf"""
WITH {V.LINES_SQL}, p AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY pos) AS text FROM lines GROUP BY doc_id, page),
n AS (SELECT doc_id, page, length(text) AS n, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters FROM p)
SELECT doc_id, page, letters, letters < 25 OR letters / n < 0.35 AS garbage FROM n""")
def garbage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.book_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY pos)").alias("text"))
    return pages.select("doc_id", "page", T.letters(F.col("text")).alias("letters"), T.is_garbage(F.col("text")).alias("garbage"))


@query(rf"""
WITH {V.RAW_SQL},
s AS (SELECT doc_id, pos // 7 AS page, pos, CASE WHEN pos % 6 < 2 THEN 'heading' ELSE 'body' END AS kind, CASE pos % 6 WHEN 0 THEN 'CHAPTER' WHEN 1 THEN pos::VARCHAR ELSE raw END AS text FROM raw),
l AS (SELECT *, kind = 'heading' AND regexp_full_match(text, '\d+') AND coalesce(lag(kind) OVER (PARTITION BY doc_id, page ORDER BY pos) = 'heading', false) AS joins FROM s),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY pos) AS nth FROM l)
SELECT doc_id, page, nth::BIGINT AS nth, min(kind) AS kind, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, page, nth""")
def heading_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = F.when(F.col("pos") % 6 < 2, "heading").otherwise("body"), F.when(F.col("pos") % 6 == 0, "CHAPTER").when(F.col("pos") % 6 == 1, F.col("pos").cast("string")).otherwise(F.col("raw"))
    parts = V.raw_lines(spark, sf_dir).select("doc_id", F.floor(F.col("pos") / 7).cast("long").alias("page"), "pos", kind.alias("kind"), text.alias("text"))
    pages = parts.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "text"))).alias("p"))
    return pages.select("doc_id", "page", F.posexplode_outer(layout.merge_headings(F.col("p"))).alias("nth", "m")).where("nth is not null").select("doc_id", "page", (F.col("nth") + 1).cast("long").alias("nth"), "m.kind", "m.text")


PAGE_NUMBER = r"^\s*[-–—]?\s*\d+\s*[-–—]?\s*$"
RUNNING_SQL = rf"""{V.LINES_SQL},
e AS (
  SELECT doc_id, page, CASE WHEN regexp_matches(text, '{PAGE_NUMBER}') THEN '<page>' ELSE trim(text) END AS line,
         row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS z
  FROM lines),
c AS (SELECT doc_id, line, count(DISTINCT page) AS pages FROM e WHERE a <= 2 OR z <= 2 GROUP BY doc_id, line),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM lines GROUP BY doc_id),
running AS (SELECT doc_id, line, pages FROM c JOIN n USING (doc_id) WHERE pages >= greatest(3, n * 4 // 10))"""


@query(f"WITH {RUNNING_SQL} SELECT doc_id, line, pages FROM running")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.running_lines(V.line_table(spark, sf_dir))


KEPT_SQL = rf"""{RUNNING_SQL},
kept AS (SELECT * FROM lines l WHERE NOT regexp_matches(text, '{PAGE_NUMBER}') AND NOT EXISTS (SELECT 1 FROM running r WHERE r.doc_id = l.doc_id AND r.line = trim(l.text)))"""


@query(f"WITH {KEPT_SQL} SELECT doc_id, page, pos, text FROM kept")
def strip_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.strip_running(V.line_table(spark, sf_dir)).select("doc_id", "page", "pos", "text")


PARAS_SQL = rf"""{KEPT_SQL},
s AS (
  SELECT *, lag(page) OVER w < page AND lag(kind) OVER w = 'body' AND kind = 'body'
         AND (regexp_matches(text, '^\s*\p{{Ll}}') OR regexp_matches(lag(text) OVER w, '-\s*$') OR NOT regexp_matches(rtrim(lag(text) OVER w), '[.!?"”''][”"'']?$')) AS goes_on
  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM s),
j AS (SELECT doc_id, para::BIGINT AS para, min(page) AS page, min(kind) AS kind, string_agg(trim(text), ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, para),
paras AS (SELECT * FROM (SELECT doc_id, para, page, kind, {SPOKEN} AS text FROM j) WHERE text <> '')"""


@query(f"WITH {PARAS_SQL} SELECT doc_id, para, page, kind, text FROM paras")
def stitch_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleanup.strip_running(V.line_table(spark, sf_dir))
    return cleanup.normalised(cleanup.stitch(kept)).select("doc_id", "para", "page", "kind", "text")


@query(f"WITH {PARAS_SQL} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY para) || chr(10) AS text FROM paras GROUP BY doc_id")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleanup.strip_running(V.line_table(spark, sf_dir))
    return cleanup.clean_text(cleanup.normalised(cleanup.stitch(kept)))


@query(rf"""
WITH {KEPT_SQL}, f AS (SELECT doc_id, min(page) AS first FROM kept GROUP BY doc_id),
m AS (SELECT DISTINCT l.doc_id, l.page, -1 AS seg, 'heading' AS kind, concat('--- page ', l.page, ' ---') AS text FROM lines l JOIN f USING (doc_id) WHERE l.page > f.first)
SELECT doc_id, page, seg::BIGINT AS seg, kind, text FROM kept UNION ALL SELECT doc_id, page, seg, kind, text FROM m""")
def page_break_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.line_table(spark, sf_dir)
    return cleanup.page_breaks(cleanup.strip_running(lines), lines.select("doc_id", "page").distinct())


PAUSE = r"""CASE WHEN (regexp_matches(trim({t}), '(?i)^(chapter|part|book|prologue|epilogue)\b') AND length({t}) < 120) OR coalesce(regexp_matches({n}, '(?i)^(chapter|part|book|prologue|epilogue)\b'), false) THEN 900
  WHEN {n} IS NULL THEN 350 ELSE 150 END"""


@query(rf"""
WITH {V.LINES_SQL}, n AS (SELECT doc_id, pos, text, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM lines)
SELECT doc_id, pos, ({PAUSE.format(t='text', n='next')})::INTEGER AS pause_after_ms FROM n""")
def pause_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.pauses(V.book_lines(spark, sf_dir), "doc_id", "pos").select("doc_id", "pos", "pause_after_ms")


@query(rf"""
WITH {PARAS_SQL}, nx AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY para) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS position FROM paras)
SELECT doc_id AS book_id, position, 'narrator' AS speaker_id, text AS dialogue, CASE WHEN kind = 'heading' THEN 'Chapter heading.' ELSE 'Neutral narration.' END AS direction,
       ({PAUSE.format(t='text', n='next')})::INTEGER AS pause_after_ms
FROM nx""")
def script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: books to numbered script rows with pauses, from the scan to positions."""
    lines = V.line_table(spark, sf_dir)
    paras = shared.written(cleanup.normalised(cleanup.stitch(cleanup.strip_running(lines))), "paragraphs")  # pauses and numbers look at them anew
    paused = scripts.pauses(paras.withColumnRenamed("doc_id", "book_id"), "book_id", "para")
    direction = F.when(F.col("kind") == "heading", "Chapter heading.").otherwise("Neutral narration.")
    return scripts.numbered(paused, "book_id", "para").select("book_id", "position", F.lit("narrator").alias("speaker_id"), F.col("text").alias("dialogue"), direction.alias("direction"), "pause_after_ms")


#: A line up to the third letter of its first long word, and the rest.
BREAK = r"^([^\n]*?[a-z]{3})([a-z]{3,}[^\n]*)$"
COMPOUNDS = ", ".join(f"'{t}'" for t in hyphens.COMPOUND_TAILS)


@query(rf"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+(?:-[a-z'']+)?')) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word), t AS (SELECT sum(n) AS t FROM c),
x AS (SELECT word, log10(n / t * 1e9) AS z FROM c, t),
p AS (SELECT DISTINCT left(word, 3) AS left, substr(word, 4) AS right FROM c WHERE regexp_full_match(word, '[a-z]{{4,}}') UNION SELECT DISTINCT left(word, 4), 'colored' FROM c WHERE regexp_full_match(word, '[a-z]{{4,}}'))
SELECT p."left", p."right",
       CASE WHEN p."right" NOT IN ({COMPOUNDS}) AND coalesce(a.z, 0) >= 3.5 AND (coalesce(b.z, 0) < 2.5 OR coalesce(a.z, 0) >= coalesce(b.z, 0) + 0.5) THEN p."left" || p."right" ELSE p."left" || '-' || p."right" END AS joined
FROM p LEFT JOIN x a ON a.word = p."left" || p."right" LEFT JOIN x b ON b.word = p."left" || '-' || p."right" """)
def hyphen_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = hyphens.corpus_lexicon(V.table(spark, sf_dir, "documents", "text"))
    long = lexicon.where(F.col("word").rlike("^[a-z]{4,}$")).select("word")
    broken = long.select(F.left("word", F.lit(3)).alias("left"), F.substring("word", 4, 1 << 30).alias("right"))
    compound = long.select(F.left("word", F.lit(4)).alias("left"), F.lit("colored").alias("right"))
    return hyphens.resolve(broken.union(compound).distinct(), lexicon)


@query(rf"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+(?:-[a-z'']+)?')) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word), t AS (SELECT sum(n) AS t FROM c),
x AS (SELECT word, log10(n / t * 1e9) AS z FROM c, t), {V.RAW_SQL},
b AS (SELECT doc_id, pos, raw, regexp_extract(raw, '{{BREAK}}', 1) AS head, regexp_extract(raw, '{{BREAK}}', 2) AS rest FROM raw),
p AS (SELECT *, regexp_extract(head, '([A-Za-z'']+)$', 1) AS l, regexp_extract(rest, '^([A-Za-z'']+)', 1) AS r FROM b)
SELECT doc_id, pos, CASE WHEN head = '' THEN raw WHEN lower(r) NOT IN ({COMPOUNDS}) AND coalesce(u.z, 0) >= 3.5 AND (coalesce(v.z, 0) < 2.5 OR coalesce(u.z, 0) >= coalesce(v.z, 0) + 0.5) THEN head || rest ELSE head || '-' || rest END AS text
FROM p LEFT JOIN x u ON u.word = lower(l || r) LEFT JOIN x v ON v.word = lower(l || '-' || r)""".replace("{{BREAK}}", BREAK).replace("{BREAK}", BREAK))
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line broken within its first long word, and joined again by the corpus's own lexicon."""
    lexicon = hyphens.corpus_lexicon(V.table(spark, sf_dir, "documents", "text"))  # of a corpus, so it stays a table
    head, rest = F.regexp_extract("raw", BREAK, 1), F.regexp_extract("raw", BREAK, 2)
    lines = F.when(head == "", F.array("raw")).otherwise(F.array(F.concat(head, F.lit("-")), rest))
    return hyphens.joined(V.raw_lines(spark, sf_dir), F.array(lines), "t", lexicon, heads=False).select("doc_id", "pos", F.col("t")[0].alias("text"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(p) AS text, (generate_subscripts(p, 1) - 1)::INTEGER AS para FROM d""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return chunking.paragraphs(docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n"))))


@query(rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, 300 AS lim, text FROM documents), {V.pieces_sql("d", "k")}
SELECT doc_id, n::INTEGER AS piece, piece AS text FROM d JOIN cut USING (k) WHERE n >= 0 AND k NOT IN (FROM unbroken)
UNION ALL SELECT doc_id, NULL, NULL FROM d WHERE k NOT IN (SELECT k FROM cut WHERE n >= 0) OR k IN (FROM unbroken)""")
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pieces(V.table(spark, sf_dir, "documents", "doc_id", "text"))


CHUNK = 1500
_KEYWORDS = "(?:chapter|book|part|prologue|epilogue)"


@query(rf"""
WITH RECURSIVE {V.LINES_SQL}, s AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS source FROM lines GROUP BY doc_id),
step(doc_id, source, n, a, z, heading, text, error) AS (
  SELECT doc_id, source, -1, 0, 0, false, '', NULL::VARCHAR FROM s
  UNION ALL
  SELECT doc_id, source, n + 1, z, CASE WHEN h <> '' THEN z + length(h) WHEN e = 0 THEN length(source) WHEN b <> '' THEN z + length(b) ELSE z + e END, h <> '',
         CASE WHEN h <> '' THEN regexp_extract(h, '(?is)^\s*({_KEYWORDS}\b[^\n]{{0,110}})', 1) WHEN e = 0 THEN rest WHEN b <> '' THEN b ELSE left(rest, e) END,
         CASE WHEN h = '' AND e = 0 THEN concat('no white space in {CHUNK} characters from ', z) END
  FROM (
    SELECT *, regexp_extract(left(rest, e), '(?is)^(.*?\n\n){_KEYWORDS}\b', 1) AS b
    FROM (
      SELECT *, CASE WHEN length(rest) <= {CHUNK} THEN length(rest) WHEN length(regexp_extract(left(rest, {CHUNK}), '(?s)^(.*)\n\n', 1)) >= {CHUNK // 3} THEN length(regexp_extract(left(rest, {CHUNK}), '(?s)^(.*)\n\n', 1)) + 2
                ELSE length(regexp_extract(left(rest, {CHUNK}), '(?s)^.*\s')) END AS e
      FROM (SELECT *, substr(source, z + 1) AS rest, regexp_extract(substr(source, z + 1), '(?i)^\s*{_KEYWORDS}\b[^\n]{{0,110}}(?:\n|$)') AS h FROM step WHERE z < length(source) AND error IS NULL)))),
kept AS (SELECT * FROM step WHERE n >= 0 AND regexp_matches(text, '\S'))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS chunk, a::BIGINT AS "start", z::BIGINT AS "end", heading, text, error FROM kept""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.book_lines(spark, sf_dir).groupBy("doc_id").agg(F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY pos)").alias("text"))
    return chunking.chunk_text(lines, CHUNK)


@query(rf"""
WITH {V.RAW_SQL}, q AS (SELECT doc_id, pos, regexp_replace(raw, '["''‘’“”]', '', 'g') AS bare FROM raw)
SELECT doc_id, pos, (pos % 9) AS "start", (pos % 9 + length(bare) + 2)::BIGINT AS "end" FROM q WHERE pos % 5 = 1""")
def quote_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech in whole lines of which every fifth is quoted, after a few characters."""
    bare = F.regexp_replace("raw", "[\"'‘’“”]", "")
    line = F.when(F.col("pos") % 5 == 1, F.concat(F.repeat(F.lit("."), (F.col("pos") % 9).cast("int")), F.lit("“"), bare, F.lit("”"), bare)).otherwise(bare)
    return V.raw_lines(spark, sf_dir).select("doc_id", "pos", F.explode_outer(alignment.quotes(line)).alias("s")).where("s is not null").select("doc_id", "pos", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query()
def quote_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech in whole texts, by the quotes they have and others from every fifth line to the end of the next: few texts have any."""
    marked = lambda x, i: F.when(i % 5 == 1, F.concat(F.lit("“"), x)).when(i % 5 == 2, F.concat(x, F.lit("”"))).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), marked), "\n")
    docs = V.table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.explode_outer(alignment.quotes(text)).alias("s")).where("s is not null").select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
seg AS (SELECT doc_id, unnest(range(0, n, 100)) AS a, n FROM n), s AS (SELECT doc_id, a, least(a + 100, n) AS b FROM seg),
q AS (SELECT doc_id, unnest(range(35, greatest(n - 69, 35), 90)) AS a FROM n)
SELECT s.doc_id, s.a AS "start", greatest(s.a, q.a) AS speech_start, least(s.b, q.a + 70) AS speech_end FROM s JOIN q ON s.doc_id = q.doc_id AND q.a < s.b AND s.a < q.a + 70""")
def emit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 100 characters against speech of 70 in every 90: the parts of each that are speech."""
    n = V.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    segments = n.where("n > 0").select("doc_id", "n", F.explode(F.expr("sequence(0L, n - 1, 100L)")).alias("start")).select("doc_id", "start", F.least(F.col("start") + 100, "n").alias("end"))
    speech = n.where("n >= 105").select("doc_id", F.explode(F.expr("sequence(35L, n - 70, 90L)")).alias("start")).select("doc_id", "start", (F.col("start") + 70).alias("end"))
    return alignment.overlaps(segments, speech, "doc_id").select("doc_id", "start", "speech_start", "speech_end")


@query(rf"""
WITH {V.RAW_SQL}, q AS (SELECT doc_id, pos, trim(regexp_replace(raw, '["''‘’“”]', '', 'g')) AS bare FROM raw), l AS (SELECT * FROM q WHERE regexp_matches(bare, '[\p{{L}}\p{{N}}]')),
r AS (
  SELECT doc_id, pos, 1 AS k, 'narrator' AS speaker_id, repeat('.', (pos % 9)::BIGINT) AS text FROM l WHERE pos % 5 = 1 AND pos % 9 > 0
  UNION ALL SELECT doc_id, pos, 2, 'ines', concat('“', bare, '”') FROM l WHERE pos % 5 = 1
  UNION ALL SELECT doc_id, pos, 3, 'narrator', bare FROM l)
SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id, pos ORDER BY k) - 1)::INTEGER AS nth, speaker_id, sha256(text) AS text_sha256 FROM r""")
def emit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line given whole to a speaker, though only a part of every fifth is speech: what is glued to it goes to the narrator."""
    bare = F.trim(F.regexp_replace("raw", "[\"'‘’“”]", ""))
    lines = V.raw_lines(spark, sf_dir).withColumn("bare", bare).where(F.col("bare").rlike(r"[\p{L}\p{N}]"))
    spoken = F.concat(F.repeat(F.lit("."), (F.col("pos") % 9).cast("int")), F.lit("“"), "bare", F.lit("” "), "bare")
    text = F.when(F.col("pos") % 5 == 1, spoken).otherwise(F.col("bare"))
    one = F.struct(F.col("text"), F.lit("ines").alias("speaker_id"), F.lit("Level.").alias("direction"), F.lit("").alias("reaction"), F.lit(False).alias("uncertain"))
    made = alignment.align_chunks(lines.select("doc_id", "pos", text.alias("text")).withColumn("segments", F.array(one)))
    return made.select("doc_id", "pos", F.posexplode_outer("rows").alias("nth", "r")).select("doc_id", "pos", "nth", "r.speaker_id", F.sha2("r.text", 256).alias("text_sha256"))


@query(rf"""
WITH {V.RAW_SQL}, f AS (SELECT doc_id, pos, length({FORM.format('raw')}) AS n_form FROM raw),
j AS (SELECT doc_id, string_agg({FORM.format('raw')}, '' ORDER BY pos) AS form FROM raw GROUP BY doc_id)
SELECT f.doc_id, f.pos, f.n_form, coalesce(sum(n_form) OVER (PARTITION BY f.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor, j.form = {FORM.format('d.text')} AS verbatim
FROM f JOIN j USING (doc_id) JOIN documents d USING (doc_id)""")
def align_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents", "doc_id", "text")
    whole = docs.withColumn("verbatim", alignment.verbatim(F.col("text"), F.split("text", "\n")))  # once for each text, before lines
    tested = whole.select("doc_id", "verbatim", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).where("trim(text) <> ''")
    return alignment.cursors(tested, "doc_id", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), "n_form", "cursor", "verbatim")


#: Quotes that open and close within a line are all that the tables hold; a segment is a line, so speech lies whole in one or beside it.
_SAID = '"[^"]*"'


@query(rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, i, {FORM.format('x')} AS f, i % 7 = 6 AS unsure, i % 2 = 1 AND i % 7 <> 6 AS ines, len(regexp_extract_all(x, '{_SAID}')) AS said,
         len(list_filter(string_split_regex(x, '{_SAID}'), lambda t: regexp_matches(t, '\S'))) AS gaps, len(list_filter(string_split_regex(x, '{_SAID}'), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))) > 0 AS loose
  FROM l WHERE trim(x) <> '' AND i % 3 <> 1),
p AS (
  SELECT doc_id, list({{'f': f, 'n': CASE WHEN ines AND loose THEN said + gaps ELSE 1 END, 'w': unsure::BIGINT + CASE WHEN ines THEN loose ELSE said > 0 END::BIGINT}} ORDER BY i) AS parts
  FROM g GROUP BY doc_id),
d AS (SELECT doc_id, coalesce({FORM.format('text')}, '') AS form, coalesce(parts, []) AS parts FROM documents LEFT JOIN p USING (doc_id)),
step(doc_id, form, parts, k, cur, n, w, fault) AS (
  SELECT doc_id, form, parts, 1, 0, 0, 0, len(parts) = 0 FROM d
  UNION ALL
  SELECT doc_id, form, parts, k + 1, CASE WHEN found > 0 THEN cur + found - 1 + length(part.f) ELSE cur END, n + part.n + (found > 1)::BIGINT,
         w + part.w + CASE WHEN found > 1 THEN 1 + contains(left(rest, found - 1), '"')::BIGINT ELSE 0 END, found = 0
  FROM (
    SELECT *, CASE WHEN part.f = '' THEN 0 WHEN starts_with(rest, part.f) THEN 1 WHEN length(part.f) >= 8 THEN strpos(rest, part.f) ELSE 0 END AS found
    FROM (SELECT *, parts[k] AS part, substr(form, cur + 1) AS rest FROM step WHERE NOT fault AND k <= len(parts)))),
e AS (SELECT * FROM step WHERE fault OR k > len(parts))
SELECT doc_id, CASE WHEN fault THEN 0 ELSE n + (cur < length(form))::BIGINT END::INTEGER AS n_rows,
       CASE WHEN fault THEN 0 WHEN cur < length(form) THEN w + 1 + contains(substr(form, cur + 1), '"')::BIGINT ELSE w END::INTEGER AS n_warnings,
       sha256(CASE WHEN fault THEN '' ELSE form END) AS form_sha256, CASE WHEN fault AND len(parts) > 0 THEN cur END::BIGINT AS refused_at, NOT fault AS accepted
FROM e""")
def align_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their own lines but every third, by turns of narrator and a speaker."""
    docs = V.table(spark, sf_dir, "documents", "doc_id", "text")
    line = lambda x, i: F.struct(x.alias("text"), F.when(i % 2 == 0, "narrator").otherwise("ines").alias("speaker_id"), F.lit("Neutral.").alias("direction"), F.lit("").alias("reaction"), (i % 7 == 6).alias("uncertain"), i.alias("i"))
    segments = F.filter(F.transform(F.split("text", "\n"), line), lambda s: (F.trim(s["text"]) != "") & (s["i"] % 3 != 1))
    made = alignment.align_chunks(docs.withColumn("segments", segments))
    return made.select(
        "doc_id", F.size("rows").alias("n_rows"), F.size("warnings").alias("n_warnings"), F.sha2(T.comparison_form(F.array_join(F.transform("rows", lambda r: r["text"]), "")), 256).alias("form_sha256"),
        F.nullif(F.regexp_extract("error", r"at character (\d+)", 1), F.lit("")).cast("long").alias("refused_at"), F.col("error").isNull().alias("accepted"),
    )


@query("SELECT d.doc_id, b.item_id, strpos(d.text, b.text) - 1 AS at FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate(V.table(spark, sf_dir, "documents", "doc_id", "text"), V.table(spark, sf_dir, "benchmark", "item_id", "text"))
