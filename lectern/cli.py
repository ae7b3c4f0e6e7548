"""Command line: ``python -m lectern COMMAND …``; every command reads and writes folders of tables.

A book folder holds ``run`` (the annotation run), ``script``, ``characters``, ``casting``, ``clips`` and the
outputs ``timeline``, ``books``, ``pcm`` and ``audio``, a WAV file for each book; a library folder holds ``voices`` and ``clips``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import hyphens
from lectern.operators import voices as V
from lectern.plans import annotators, audio, library, pdf_text, scripts
from lectern.sources import files, sinks
from lectern.sources.config import Settings, engine_name


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for k, v in options.items():
            p.add_argument("--" + k.replace("_", "-"), **({"action": "store_true"} if v is False else {"default": v, "type": type(v) if v is not None else str}))
        return p

    annotation = {"chunk_chars": 0, "segment_chars": 300, "engine": None, "annotator": "chat", "prompt": None, "sheet_prompt": None}
    command("text", "pages", "out", keep_page_breaks=False, plain=False, frequencies=None, words=None)
    command("script", "texts", "book", **annotation)
    command("voices-build", "rows", "library", count=20, max_rows=10_000, labels=None)
    command("voices-list", "library")
    command("cast", "book", "library")
    command("synthesize", "book", "library", engine=None)
    command("stitch", "book", "library", engine=None)
    command("run", "texts", "book", "library", **annotation)
    return top


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def _need(spark: SparkSession, path: str) -> DataFrame:
    found = _read(spark, path)
    if found is None:
        raise audio.InvalidInput(f"nothing at {path}")
    return found


def _prompt(path: str | None) -> str:
    if not path:
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _characters(book: DataFrame) -> DataFrame:
    entry = "name: string, aliases: array<string>, gender: string, age: string, voice: string"
    return book.select("book_id", F.explode(F.from_json("characters", f"map<string, struct<{entry}>>")).alias("speaker_id", "c")).select("book_id", "speaker_id", "c.*")


def text(spark: SparkSession, a) -> None:
    lexicon = hyphens.held_lexicon(files.lexicon(spark, a.frequencies, a.words)) if a.frequencies or a.words else None
    made = pdf_text.convert(files.layout_pages(spark, a.pages), lexicon, keep_page_breaks=a.keep_page_breaks, plain=a.plain)
    sinks.write_texts(made.texts, a.out).collect()
    audio.refuse(made.failed, "no text left")


def script(spark: SparkSession, a) -> None:
    engine = engine_name(a.engine or Settings.read().engine)
    recipe = scripts.Recipe(engine, a.chunk_chars, a.segment_chars, _prompt(a.prompt), _prompt(a.sheet_prompt))
    recipe.check()
    schemas = {k: annotators.response_schema(engine, k) for k in ("sheet", "script")}
    make = (lambda: annotators.QuoteAnnotator(delivery=engine == "dramabox")) if a.annotator == "quotes" else (lambda: annotators.ChatClient(schemas=schemas))
    texts = files.texts(spark, a.texts).withColumnRenamed("doc_id", "book_id")
    made = scripts.generate(texts, make, f"{a.book}/run", recipe)
    made.script.write.mode("ignore").parquet(f"{a.book}/script")  # an edited script stays
    made.characters.write.mode("overwrite").parquet(f"{a.book}/characters")
    made.warnings.write.mode("overwrite").parquet(f"{a.book}/warnings")
    audio.refuse(made.failed, "books that failed")


def voices_build(spark: SparkSession, a) -> None:
    rows = spark.read.schema(files.AUDIO_ROW).parquet(a.rows)
    labels = files.speaker_labels(spark, a.labels) if a.labels else None
    have = _read(spark, f"{a.library}/voices")
    made = library.build(rows, a.count, a.max_rows, have, labels)
    sinks.write_files(made.clips, a.library).collect()
    part = f"{a.library}/voices.new"
    made.voices.write.mode("overwrite").parquet(part)
    spark.read.parquet(part).write.mode("overwrite").parquet(f"{a.library}/voices")
    audio.refuse(made.shortage, "voices (have, wanted)")


def voices_list(spark: SparkSession, a) -> None:
    sinks.show(V.listing(_need(spark, f"{a.library}/voices")))


def cast(spark: SparkSession, a) -> None:
    rows, voices = _need(spark, f"{a.book}/script"), _need(spark, f"{a.library}/voices")
    made = audio.cast(rows, voices, _characters(_need(spark, f"{a.book}/characters")), _read(spark, f"{a.book}/casting"))
    part = f"{a.book}/casting.new"
    made.write.mode("overwrite").parquet(part)
    spark.read.parquet(part).write.mode("overwrite").parquet(f"{a.book}/casting")


def _clips(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Script, casting, voices, clips to keep and clips to make."""
    s = Settings(**(Settings.read().__dict__ | ({"engine": engine_name(a.engine)} if a.engine else {})))
    rows, casting, voices = (_need(spark, p) for p in (f"{a.book}/script", f"{a.book}/casting", f"{a.library}/voices"))
    return rows, casting, voices, *audio.synthesize(rows, casting, voices, _read(spark, f"{a.book}/clips"), annotators.ToneModel, "tone", s, _characters(_need(spark, f"{a.book}/characters")))


def synthesize(spark: SparkSession, a) -> None:
    sinks.append(_clips(spark, a)[4], f"{a.book}/clips")


def stitch(spark: SparkSession, a) -> None:
    rows, casting, voices, keep, _ = _clips(spark, a)
    made = audio.stitch(rows, casting, voices, keep.withColumn("valid", F.col("valid") & audio.valid("content")))
    for name, df in made._asdict().items():
        df.write.mode("overwrite").parquet(f"{a.book}/{name}")
    audio.write_sounds(made, f"{a.book}/audio").collect()


def run(spark: SparkSession, a) -> None:
    for step in (script, cast, synthesize, stitch):
        step(spark, a)


COMMANDS = {"text": text, "script": script, "voices-build": voices_build, "voices-list": voices_list, "cast": cast, "synthesize": synthesize, "stitch": stitch, "run": run}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 with a message for input that can't be used."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        COMMANDS[a.command](spark, a)
    except (audio.InvalidInput, scripts.ChangedRun, ValueError) as e:
        print(f"lectern: {e}")
        return 1
    return 0

