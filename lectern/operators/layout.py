"""Page layout: from blocks to classified segments in reading order.

A page is one row, ``doc_id, page, width, height, blocks`` (see ``BLOCKS``). Everything up to the
segments happens within the row, in array functions: no shuffle, and pages of one book run apart.

Defined results: null or empty ``blocks`` give no segments; null spans count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import hyphens

BOX = "bbox: struct<x0: double, y0: double, x1: double, y1: double>"
BLOCKS = f"array<struct<type: int, {BOX}, lines: array<struct<spans: array<struct<text: string, size: double, {BOX}>>>>>>"

# Fractions and limits that results depend on.
HEADER, FOOTER, FOOTNOTE = 0.08, 0.92, 0.80
EDGE_CHARS, HEADING_CAPS, HEADING_CHARS, SIDE_CHARS = 80, 60, 80, 200
SIDE_LEFT, SIDE_RIGHT, WIDE, LARGER, SMALL_NOTE, SMALL_SIDE = 0.28, 0.72, 0.55, 1.15, 0.85, 0.8
COLUMN_BLOCKS, COLUMN_SIDE, BODY_CHARS, BODY_SIZE, LARGE_IMAGE = 6, 3, 40, 12.0, 0.25


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def span_text(spans: Column) -> Column:
    """One line's text. A large first letter is glued to the lower-case rest; other spans meet with a space unless they touch."""

    def piece(span: Column, i: Column) -> Column:
        before, own = F.element_at(spans, F.greatest(i, F.lit(1))), F.coalesce(span["text"], F.lit(""))
        gone = F.coalesce(before["text"], F.lit(""))
        capital = T.strip(gone).rlike(r"^\p{L}{1,2}$") & T.lstrip(own).rlike(r"^\p{Ll}") & (F.coalesce(before["size"], F.lit(0.0)) > F.coalesce(span["size"], F.lit(0.0)) * 1.1)
        touching = gone.endswith(" ") | own.startswith(" ") | (span["bbox"]["x0"] - before["bbox"]["x1"] < 1.0)
        return F.when(i == 0, own).when(capital, T.lstrip(own)).when(touching, own).otherwise(F.concat(F.lit(" "), own))

    return F.coalesce(F.array_join(F.transform(spans, piece), ""), F.lit(""))


def block_lines(block: Column) -> Column:
    """The texts of a block's lines, without blank ones."""
    made = F.transform(block["lines"], lambda line: T.strip(span_text(line["spans"])))
    return F.coalesce(F.filter(made, lambda x: x != ""), F.array().cast("array<string>"))


def _spans(block: Column) -> Column:
    none = F.array().cast(f"array<struct<text: string, size: double, {BOX}>>")
    return F.coalesce(F.flatten(F.filter(F.transform(block["lines"], lambda line: line["spans"]), lambda s: s.isNotNull())), none)


def font_size(block: Column) -> Column:
    """Mean size of a block's spans, 0 for none."""
    return _let(_spans(block), lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + F.coalesce(x["size"], F.lit(0.0))) / F.size(s)).otherwise(0.0))


def _chars(block: Column) -> Column:
    return F.aggregate(_spans(block), F.lit(0), lambda a, s: a + F.length(F.coalesce(s["text"], F.lit(""))))


def modal_size(measured: Column) -> Column:
    """Most frequent size, in half points, of text blocks of 40 characters and more; of equals the first. ``measured``: struct(size, chars)."""
    sizes = F.transform(F.filter(measured, lambda m: (m["chars"] >= BODY_CHARS) & (m["size"] > 0)), lambda m: F.bround(m["size"] * 2) / 2)

    def most(x: Column) -> Column:
        counted = F.transform(F.array_distinct(x), lambda d, i: F.struct(F.size(F.filter(x, lambda y: y == d)).alias("n"), (-i).alias("i"), d.alias("d")))
        return F.coalesce(F.array_max(counted)["d"], F.lit(BODY_SIZE))

    return _let(sizes, most)


def reading_order(boxes: Column, width: Column) -> Column:
    """Blocks (structs with ``bbox``) in reading order: wide ones above, left column, right column, the other wide ones."""
    return _let(boxes, lambda held: _reading_order(held, width))


def _reading_order(boxes: Column, width: Column) -> Column:
    span = lambda b: b["bbox"]["x1"] - b["bbox"]["x0"]
    narrow = lambda b: span(b) < width * WIDE
    left = lambda b: (b["bbox"]["x0"] + b["bbox"]["x1"]) / 2 < width / 2

    def ordered(facts: Column) -> Column:
        two = (F.size(boxes) >= COLUMN_BLOCKS) & (facts["l"] >= COLUMN_SIDE) & (facts["r"] >= COLUMN_SIDE)

        def band(b: Column) -> Column:
            return F.when(~two, 0).when(narrow(b), F.when(left(b), 1).otherwise(2)).when(b["bbox"]["y0"] < facts["top"] - 4, 0).otherwise(3)

        keys = F.transform(boxes, lambda b, i: F.struct(band(b).alias("band"), b["bbox"]["y0"].alias("y"), b["bbox"]["x0"].alias("x"), i.alias("i")))
        return F.transform(F.array_sort(keys), lambda k: F.element_at(boxes, k["i"] + 1))

    facts = F.struct(
        F.size(F.filter(boxes, lambda b: narrow(b) & left(b))).alias("l"),
        F.size(F.filter(boxes, lambda b: narrow(b) & ~left(b))).alias("r"),
        F.array_min(F.transform(F.filter(boxes, narrow), lambda b: b["bbox"]["y0"])).alias("top"),
    )
    return _let(facts, ordered)


def is_heading_block(text: Column, size: Column, body: Column) -> Column:
    """Keyword or number; short capitals; or larger type and either title case in few words or short."""
    keyword = text.rlike(T.PAGE_HEADING) | text.rlike(r"(?U)^\d+$")
    capitals = text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]") & (F.length(text) <= HEADING_CAPS)
    title = F.size(F.split(text, r"(?U)\s+")).between(1, 8) & text.rlike(r"^\p{Lu}") & ~text.endswith(".")
    return keyword | capitals | ((size >= body * LARGER) & (title | (F.length(text) <= HEADING_CHARS)))


def kind_of(text: Column, size: Column, bbox: Column, width: Column, height: Column, body: Column) -> Column:
    """``header``, ``footer``, ``footnote``, ``sidenote``, ``heading`` or ``body``; null for an empty text."""
    x0, y0, x1, y1 = (bbox[k] for k in ("x0", "y0", "x1", "y1"))
    height, width = (F.when(v == 0, 1.0).otherwise(v) for v in (height, width))
    return (
        F.when(text == "", None)
        .when((y1 <= height * HEADER) & (F.length(text) <= EDGE_CHARS), "header")
        .when((y0 >= height * FOOTER) & (T.is_page_number(text) | (F.length(text) <= EDGE_CHARS)), "footer")
        .when((y0 >= height * FOOTNOTE) & (size < body * SMALL_NOTE), "footnote")
        .when((size < body * SMALL_SIDE) & ((x0 > width * SIDE_RIGHT) | (x1 < width * SIDE_LEFT)) & (F.length(text) <= SIDE_CHARS), "sidenote")
        .when(is_heading_block(text, size, body), "heading")
        .otherwise("body")
    )


def image_fraction(blocks: Column, width: Column, height: Column) -> Column:
    """Part of the page that its image blocks cover."""
    area = F.aggregate(F.filter(blocks, lambda b: b["type"] == 1), F.lit(0.0), lambda a, b: a + F.abs((b["bbox"]["x1"] - b["bbox"]["x0"]) * (b["bbox"]["y1"] - b["bbox"]["y0"])))
    return F.coalesce(area, F.lit(0.0)) / F.coalesce(F.nullif(F.abs(width * height), F.lit(0.0)), F.lit(1.0))


def merge_headings(parts: Column) -> Column:
    """Heading and body parts (``kind, text``) in order, where a bare number joins the heading right before it."""

    def step(made: Column, x: Column) -> Column:
        last = F.element_at(made, -1)
        joins = (x["kind"] == "heading") & x["text"].rlike(r"(?U)^\d+$") & F.coalesce(F.when(F.size(made) > 0, last["kind"] == "heading"), F.lit(False))
        grown = F.concat(F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0))), F.array(F.struct(last["kind"].alias("kind"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))))
        return F.when(joins, grown).otherwise(F.concat(made, F.array(F.struct(x["kind"].alias("kind"), x["text"].alias("text")))))

    return F.aggregate(parts, F.array().cast("array<struct<kind: string, text: string>>"), step)


def classified(pages: DataFrame, lexicon: dict | DataFrame | None = None) -> DataFrame:
    """``pages`` and ``parts``: its text blocks in reading order as ``kind, text, size, bbox``; ``body_size`` too."""
    blocks = F.coalesce(F.filter("blocks", lambda b: b["type"] == 0), F.array().cast(BLOCKS))
    measured = pages.withColumn("_m", F.transform(blocks, lambda b: F.struct(block_lines(b).alias("lines"), font_size(b).alias("size"), _chars(b).alias("chars"), b["bbox"].alias("bbox"))))
    sized = measured.withColumn("body_size", modal_size(F.col("_m"))).withColumn("_o", reading_order(F.col("_m"), F.col("width")))
    joined = hyphens.joined(sized, F.transform("_o", lambda o: o["lines"]), "_t", lexicon)
    parts = F.zip_with("_o", "_t", lambda o, t: F.struct(kind_of(t, o["size"], o["bbox"], F.col("width"), F.col("height"), F.col("body_size")).alias("kind"), t.alias("text"), o["size"].alias("size"), o["bbox"].alias("bbox")))
    return joined.withColumn("parts", parts).drop("_m", "_o", "_t")


def page_parts(pages: DataFrame, lexicon: dict | DataFrame | None = None, ocr=None) -> DataFrame:
    """Per page: ``segments`` (``kind, text``), ``images``, ``used_ocr`` and ``state``: kept, skipped (an image alone) or empty.

    ``ocr``: a column function of the page row that gives its recognised text, asked for only where the
    layout's own text is garbage; its paragraphs replace the segments if they are no garbage.
    """
    spoken = F.transform(F.filter("parts", lambda p: p["kind"].isin("heading", "body")), lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text")))
    made = classified(pages, lexicon).withColumn("segments", merge_headings(spoken))
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    made = made.withColumn("used_ocr", F.lit(False))
    if ocr is not None:
        read = made.withColumn("_ocr", F.when(T.is_garbage(whole), ocr)).withColumn("used_ocr", F.coalesce(~T.is_garbage(F.col("_ocr")), F.lit(False)))
        paragraphs = F.filter(F.split("_ocr", r"(?U)\n\s*\n"), lambda p: T.strip(p) != "")
        texts = hyphens.joined(read, F.transform(paragraphs, lambda p: F.split(p, r"\r?\n")), "_p", lexicon)
        made = texts.withColumn("segments", F.when(F.col("used_ocr"), F.transform("_p", lambda t: F.struct(F.lit("body").alias("kind"), t.alias("text")))).otherwise(F.col("segments"))).drop("_ocr", "_p")
    images = F.coalesce(F.size(F.filter("blocks", lambda b: b["type"] == 1)), F.lit(0))
    few = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + T.letters(s["text"])) < T.MIN_LETTERS
    covered = image_fraction(F.col("blocks"), F.col("width"), F.col("height")) >= LARGE_IMAGE
    state = F.when(few & (images > 0) & (covered | (F.size("segments") == 0)), "skipped").when(F.size("segments") == 0, "empty").otherwise("kept")
    return made.withColumn("images", F.greatest(images, F.lit(0))).withColumn("state", state).select("doc_id", "page", "segments", "images", "used_ocr", "state")


def segments(parts: DataFrame) -> DataFrame:
    """``doc_id, page, seg, kind, text`` of the pages that are kept.

    Outer generators here and elsewhere: of an inner one the optimizer infers a filter on the array's size
    and pushes it, with all that computes the array, below; so would be a filter on the state.
    """
    kept = parts.select("doc_id", "page", F.posexplode_outer(F.when(F.col("state") == "kept", F.col("segments"))).alias("seg", "s")).where("seg is not null")
    return kept.select("doc_id", "page", "seg", "s.kind", "s.text")
