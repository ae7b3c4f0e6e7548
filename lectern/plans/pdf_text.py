"""Book pages to clean text: layout, running lines, stitching, normalising, one text per book."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import cleanup, layout
from lectern.sources import shared


class Converted(NamedTuple):
    texts: DataFrame  # doc_id, text
    pages: DataFrame  # doc_id, page, segments, images, used_ocr, state
    failed: DataFrame  # doc_id of books with nothing left


def convert(pages: DataFrame, lexicon: dict | DataFrame | None = None, ocr: Column | None = None, keep_page_breaks: bool = False, plain: bool = False, names: DataFrame | None = None) -> Converted:
    """Texts of whole books from their page layouts (``doc_id, page, width, height, blocks``)."""
    parts = shared.written(layout.page_parts(pages, lexicon, ocr), "pages")  # pages are read, and their layout settled, once
    kept = cleanup.strip_running(layout.segments(parts))
    if keep_page_breaks:
        paragraphs = cleanup.page_breaks(kept, parts.where("state = 'kept'").select("doc_id", "page")).withColumnRenamed("seg", "para")
    else:
        paragraphs = cleanup.stitch(kept, lexicon)
    spoken = cleanup.normalised(paragraphs)
    named = pages.select("doc_id", F.col("doc_id").cast("string").alias("name")).distinct() if names is None else names
    texts = cleanup.clean_text(spoken, None if plain else cleanup.extraction_report(parts, named))
    return Converted(texts, parts, pages.select("doc_id").distinct().join(spoken.select("doc_id").distinct(), "doc_id", "left_anti"))
