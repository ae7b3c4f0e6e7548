"""Row generators over whole texts: chunks for an annotator, paragraphs and bounded pieces.

Pieces are one regular expression inside the JVM (``functions.text.split_text``). Chunk ends depend on
the chunk before, so they are walked per text, in Python over Arrow batches: one pass, no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# Keywords and limits.
KEYWORDS = "chapter|book|part|prologue|epilogue"
HEADING = re.compile(rf"\s*((?:{KEYWORDS})\b[^\n]{{0,110}})(?:\n|$)", re.IGNORECASE)
BEFORE_HEADING = re.compile(rf"\n\n(?=(?:{KEYWORDS})\b)", re.IGNORECASE)
PARAGRAPHS = r"\n\s*\n"
BEFORE, LEAST_CHUNK = 500, 256


class Chunk(NamedTuple):
    start: int
    end: int
    heading: bool
    text: str


class UnbrokenToken(ValueError):
    """A word longer than the limit."""


class Breaks:
    """Where a text may be cut: after blank lines, else after any white space. Found once, looked up by bisection."""

    def __init__(self, source: str):
        self.source = source
        self.blank = [m.start() for m in re.finditer(r"(?=\n\n)", source)]
        self.space = [m.span() for m in re.finditer(r"\s+", source)]

    def end(self, start: int, limit: int) -> int:
        """The end of a chunk of at most ``limit`` characters from ``start``."""
        most = start + limit
        if most >= len(self.source):
            return len(self.source)
        i = bisect.bisect_right(self.blank, most - 2) - 1  # both line ends must lie before the limit
        if i >= 0 and self.blank[i] >= start + limit // 3:
            return self.blank[i] + 2
        i = bisect.bisect_left(self.space, (most, 0)) - 1
        end = min(self.space[i][1], most) if i >= 0 else start
        if end <= start:
            raise UnbrokenToken(f"no white space in {limit} characters from {start}")
        return end


def next_chunk(source: str, offset: int, limit: int, breaks: Breaks | None = None) -> Chunk:
    """What comes at ``offset``: a heading on its own line, or text up to a limit or the next heading. ``limit`` 0 is none."""
    if m := HEADING.match(source, offset):
        return Chunk(offset, m.end(), True, m[1])
    end = (breaks or Breaks(source)).end(offset, limit) if limit else len(source)
    if m := BEFORE_HEADING.search(source, offset, end):
        end = m.end()
    return Chunk(offset, end, False, source[offset:end])


def chunks(source: str, limit: int = 0) -> Iterator[Chunk]:
    """All chunks of a text but blank ones."""
    at, breaks = 0, Breaks(source) if limit else None
    while at < len(source):
        chunk = next_chunk(source, at, limit, breaks)
        at = chunk.end
        if chunk.heading or chunk.text.strip():
            yield chunk


CHUNKS = "chunk int, start long, end long, heading boolean, text string, error string"


def chunk_text(docs: DataFrame, limit: int = 0, key: str = "doc_id") -> DataFrame:
    """``key, chunk, start, end, heading, text, error`` for ``docs(key, text)``.

    Null and blank texts have no chunks. Where a word exceeds the limit the rest of its text is one row
    with ``error`` and no further chunks. Repeated rows give repeated chunks.
    """

    def run(batches):
        names = ["chunk", "start", "end", "heading", "text", "error"]
        for b in batches:
            for i, source in enumerate(b.column(1)):
                rows, at = [], 0
                try:
                    for c in chunks(source.as_py() or "", limit):
                        rows.append((len(rows), c.start, c.end, c.heading, c.text, None))
                        at = c.end
                except UnbrokenToken as e:
                    rest = source.as_py()
                    rows.append((len(rows), at, len(rest), False, rest[at:], str(e)))
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
                    own = b.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {CHUNKS}")


def paragraphs(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows of ``df`` once for each paragraph: ``para`` from 0 and the paragraph in place of the text."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode_outer(F.split(column, "(?U)" + PARAGRAPHS)).alias("para", column)).where("para is not null")


def pieces(df: DataFrame, limit: int = 300, column: str = "text") -> DataFrame:
    """Rows of ``df`` once for each piece: ``piece`` from 0 and the piece in place of the text; an unbroken text gives one row, ``piece`` null."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode_outer(T.split_text(F.col(column), limit)).alias("piece", column))
