"""Passages in texts: the first place of every passage of a query set in every text, in one linear pass over the texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of passages that are searched for at once; a larger set is searched for in as many passes as it takes.
BLOCK_CHARS = 16_000_000


def locate(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``doc_id, item_id, at`` (characters from 0) where ``passages(item_id, text)`` occur in ``docs(doc_id, text)``.

    Passages are sent along in blocks of bounded size, an automaton finds all of a block's in one pass
    over each text, and no text moves. Null and empty passages and null texts have no places; passages
    of equal text each have a row.
    """
    usable = passages.where("text <> ''").select("item_id", "text")
    size = F.sum(F.length("text")).alias("n")
    blocks = max(1, -(-(usable.agg(size).first()["n"] or 0) * 5 // (4 * BLOCK_CHARS)))
    found = None
    for k in range(blocks):
        own = [(r[0], r[1]) for r in usable.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        part = _search(docs, own)
        found = part if found is None else found.union(part)
    return found


def _search(docs: DataFrame, passages: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(passages)

    def run(batches):
        automaton, items = None, {}
        for b in batches:
            if automaton is None:
                for item, text in shared.value:
                    items.setdefault(text, []).append(item)
                automaton = ahocorasick.Automaton()
                for text in items:
                    automaton.add_word(text, text)
                automaton.make_automaton()
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = {}
                for end, passage in automaton.iter(text) if text and items else ():
                    first.setdefault(passage, end - len(passage) + 1)
                rows += [(doc, item, at) for passage, at in first.items() for item in items[passage]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "at"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, at long")
