"""Readers of text, JSON, script, manifest and layout files, and of what a folder holds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.layout import BLOCKS

SCRIPT_ROW = "position int, speaker_id string, dialogue string, direction string, pause_after_ms int"
VOICE = "path string, speaker_id string, utterance_id string, transcript string, duration double, sample_rate int, sha256 string, gender string, dataset string, revision string, split string, attribution string"
PAGES = f"doc_id string, page int, width double, height double, blocks {BLOCKS}"
AUDIO_ROW = "scan_pos long, speaker_id string, id string, text_original string, text_normalized string, audio struct<bytes: binary, path: string>"


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``doc_id`` (the path) and whole ``text`` of UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def clean_texts(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts without metadata lines, and the ids of files with nothing left (an error for the caller to report)."""
    read = texts(spark, path).withColumn("text", T.clean_source(F.col("text")))
    return read.where("text is not null"), read.where("text is null").select("doc_id")


def json_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row per file that holds a JSON object; malformed files are rows of nulls with ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=True)


def scripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Script rows of JSON Lines files: ``book_id`` (the path), ``line`` from 1, and the row's fields, null where malformed.

    Lines are numbered within their file's text, so the order on disk is kept however files are split.
    """
    lines = texts(spark, path).select(F.col("doc_id").alias("book_id"), F.posexplode(F.split(F.regexp_replace("text", r"(\r?\n)+$", ""), r"\r?\n")).alias("line", "json"))
    return lines.select("book_id", (F.col("line") + 1).alias("line"), F.from_json("json", SCRIPT_ROW).alias("r")).select("book_id", "line", "r.*")


def voice_manifests(spark: SparkSession, path: str | list[str], dataset: str | None = None) -> DataFrame:
    """``voice_id`` and fields of each voice in library manifests, of one dataset if so asked."""
    fields = ", ".join(": ".join(x.split(" ")) for x in VOICE.split(", "))
    read = json_documents(spark, path, f"version int, dataset string, attribution string, voices map<string, struct<{fields}>>")
    own = read if dataset is None else read.where(F.col("dataset") == dataset)
    return own.select(F.explode("voices").alias("voice_id", "v")).select("voice_id", "v.*")


def speaker_labels(spark: SparkSession, path: str) -> DataFrame:
    """``speaker_id, gender`` from a JSON object of labels by id."""
    text = texts(spark, path).select(F.from_json("text", "map<string, string>").alias("m"))
    return text.select(F.explode("m").alias("speaker_id", "label")).select("speaker_id", T.gender(F.col("label")).alias("gender"))


def lexicon(spark: SparkSession, frequencies: str | None = None, words: str | None = None) -> DataFrame:
    """``word, zipf, listed`` from files: lines of a word, a tab and its Zipf frequency, and lines of a word alone; all in lower case.

    A word of either file has one row; without a frequency its ``zipf`` is null. Without files there are no rows.
    """
    rows = spark.createDataFrame([], "word string, zipf double, listed boolean")
    if frequencies:
        cells = F.split(F.lower("value"), "\t")
        rows = rows.union(spark.read.text(frequencies).select(T.strip(cells[0]), F.try_element_at(cells, F.lit(2)).try_cast("double"), F.lit(False)))
    if words:
        rows = rows.union(spark.read.text(words).select(T.strip(F.lower("value")), F.lit(None).cast("double"), F.lit(True)))
    return rows.where("word <> ''").groupBy("word").agg(F.max("zipf").alias("zipf"), F.bool_or("listed").alias("listed"))


def listing(spark: SparkSession, path: str, hashed: bool = False) -> DataFrame:
    """``path, size`` of all files below a folder, and ``sha256`` if asked; without it no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def layout_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored page layouts; see ``operators.layout``."""
    return spark.read.schema(PAGES).parquet(path)


def parsed_layouts(spark: SparkSession, path: str | list[str], parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Page layouts of binary documents by a parser given from outside: bytes to pages (``width, height, blocks``).

    A document that the parser can't read gives one row with ``page`` 0 and no blocks.
    """

    def run(batches):
        for b in batches:
            rows = []
            for name, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    rows += [{"doc_id": name, "page": i, **page} for i, page in enumerate(parser(content), 1)]
                except Exception:  # whatever a third-party parser raises
                    rows.append({"doc_id": name, "page": 0, "width": None, "height": None, "blocks": None})
            yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height", "blocks"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    return files.mapInPandas(run, PAGES)
