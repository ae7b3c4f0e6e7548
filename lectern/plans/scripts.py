"""Books to scripts: an annotator's answers, chunk after chunk, checked against the source.

Chunks of one book depend on each other, books don't. A round takes every unfinished book one accepted
answer further, books in parallel, and is written as a table before the next begins: a run that was
interrupted goes on after its last whole round, and no accepted answer is asked for twice. Headings and
blank stretches need no answer and are taken along.

A book's state is one row: where it stands, its characters, its last 24 rows. Its text is read once per
round, from a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import prompts as P
from lectern.functions import text as T
from lectern.operators import alignment, blocks, chunking, scripts
from lectern.operators.registry import NARRATOR, Registry, RegistryError
from lectern.plans.annotators import AnnotatorError, Truncated
from lectern.sources.config import engine_name

HEADING_DIRECTION = "Chapter heading."  # a fixed value
ATTEMPTS = 3


@dataclass(frozen=True)
class Recipe:
    """What a run's result depends on, besides the source and the annotator."""

    engine: str = "dramabox"
    chunk_chars: int = 0
    segment_chars: int = 300
    prompt: str = ""
    sheet_prompt: str = ""

    def check(self) -> None:
        engine_name(self.engine)
        if self.chunk_chars and self.chunk_chars < chunking.LEAST_CHUNK:
            raise ValueError(f"chunk_chars must be 0 or at least {chunking.LEAST_CHUNK}")
        T.split_pattern(self.segment_chars)


@dataclass
class State:
    phase: str = "sheet"  # sheet, script, done, failed
    offset: int = 0
    limit: int = 0
    characters: dict = field(default_factory=lambda: {"narrator": dict(NARRATOR)})
    sheet: list = field(default_factory=list)
    prior: list = field(default_factory=list)
    error: str | None = None


class Step(NamedTuple):
    rows: list
    warnings: list
    deliveries: list
    failures: list


def ask(state: State, chunk: str, call: Callable, check: Callable, failures: list):
    """An accepted answer as ``check`` makes it, or None: then the limit is smaller or the book has failed."""
    feedback = ""
    for _ in range(ATTEMPTS):
        try:
            return check(call(feedback))
        except Truncated as e:
            failures.append(str(e))
            size = min(state.limit, len(chunk))
            if size <= chunking.LEAST_CHUNK:
                state.phase, state.error = "failed", "the budget is insufficient at the minimum chunk size"
            state.limit = max(chunking.LEAST_CHUNK, size // 2)
            return None
        except (alignment.FidelityError, RegistryError, AnnotatorError) as e:
            feedback = str(e)
            failures.append(feedback)
    state.phase, state.error = "failed", f"at {state.offset}, after {ATTEMPTS} attempts: {feedback}"
    return None


def listed(answer) -> list:
    if not isinstance(answer, dict) or not isinstance(answer.get("characters"), list):
        raise RegistryError("a response needs a list of characters")
    return answer["characters"]


def advance(source: str, spans: list[tuple[int, int]], state: State, annotator, recipe: Recipe) -> Step:
    """One book, up to and with one accepted answer (or one that makes its chunks smaller)."""
    out = Step([], [], [], [])
    state.limit = state.limit or recipe.chunk_chars or max(1, len(source))
    breaks = chunking.Breaks(source)

    def sheet_answer(chunk: str):
        def check(answer):
            registry = Registry(state.characters)
            registry.update(listed(answer))
            return registry.characters

        data = {"source": chunk, "known_characters": state.characters}
        return ask(state, chunk, lambda f: annotator.annotate(recipe.sheet_prompt, data, f, "sheet"), check, out.failures)

    try:
        if state.phase == "sheet" and state.offset < len(source):
            end = breaks.end(state.offset, state.limit)
            made = sheet_answer(source[state.offset : end])
            if made is not None:
                state.characters, state.offset = made, end
        if state.phase == "sheet" and state.offset >= len(source):
            state.phase, state.offset, state.limit, state.sheet = "script", 0, recipe.chunk_chars or max(1, len(source)), sorted(state.characters)
            if source:
                return out
        while state.phase == "script" and state.offset < len(source):
            chunk = chunking.next_chunk(source, state.offset, state.limit, breaks)
            if chunk.heading:
                out.rows.append({"speaker_id": "narrator", "text": chunk.text, "direction": HEADING_DIRECTION, "reaction": "", "pause_after_ms": T.PAUSES["heading"], "told": None, "heading": True})
            elif chunk.text.strip():
                prior = (state.prior + out.rows)[-scripts.PRIOR_ROWS :]
                data = {
                    "source": chunk.text, "context_before": source[max(0, chunk.start - chunking.BEFORE) : chunk.start], "context_after": source[chunk.end : chunk.end + chunking.BEFORE],
                    "characters": state.characters, "prior_segments": [{"speaker_id": r["speaker_id"], "text": r["text"][-scripts.PRIOR_CHARS :]} for r in prior],
                }
                seen, delivered = alignment.clip_spans(spans, chunk.start, chunk.end), recipe.engine == "dramabox"
                call = lambda f: annotator.annotate(recipe.prompt, data, f, "script")  # noqa: B023, E731
                made = ask(state, chunk.text, call, lambda answer: alignment.align(chunk.text, answer, state.characters, seen, delivered), out.failures)  # noqa: B023
                if made is None:
                    break
                out.rows.extend(r | {"heading": False} for r in made.rows)
                out.deliveries.extend(made.deliveries)
                new = sorted(set(made.characters) - set(state.characters) - set(state.sheet))
                out.warnings.extend([*made.warnings, *({"text": made.characters[s]["name"], "reason": "Speaker not in the character sheet; added during annotation."} for s in new)])
                state.characters, state.offset = made.characters, chunk.end
                break
            state.offset = chunk.end
    except chunking.UnbrokenToken as e:
        state.phase, state.error = "failed", str(e)
    if state.phase == "script" and state.offset >= len(source):
        state.phase = "done"
    state.prior = (state.prior + out.rows)[-scripts.PRIOR_ROWS :]
    return out


STATE = "book_id string, identity string, state string, phase string"
ROUND = f"{STATE}, rows array<struct<speaker_id: string, text: string, direction: string, reaction: string, pause_after_ms: int, told: string, heading: boolean>>, warnings array<struct<text: string, reason: string>>, deliveries array<struct<text: string, delivery: string, speaker_id: string>>, failures array<string>"


def run_round(books: DataFrame, make_annotator: Callable, recipe: Recipe) -> DataFrame:
    """``books(book_id, text, spans, identity, state)`` one step further, as ``ROUND``."""

    def run(batches):
        annotator = None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                annotator = annotator or make_annotator()
                state = State(**json.loads(r["state"])) if r["state"] else State()
                step = advance(r["text"], [(s["start"], s["end"]) for s in r["spans"]], state, annotator, recipe)
                out.append((r["book_id"], r["identity"], json.dumps(state.__dict__, ensure_ascii=False), state.phase, *step))
            yield pd.DataFrame(out, columns=["book_id", "identity", "state", "phase", "rows", "warnings", "deliveries", "failures"])

    return books.mapInPandas(run, ROUND)


class Scripts(NamedTuple):
    script: DataFrame  # book_id, position, speaker_id, dialogue, direction, pause_after_ms
    characters: DataFrame  # book_id, characters (JSON by id)
    warnings: DataFrame  # book_id, text, reason
    failures: DataFrame  # book_id, round, reason
    failed: DataFrame  # book_id, error


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


class ChangedRun(RuntimeError):
    """The folder holds a run of other sources or settings."""


def generate(books: DataFrame, make_annotator: Callable, folder: str, recipe: Recipe | None = None, sheets: DataFrame | None = None, most_rounds: int | None = None) -> Scripts:
    """Scripts of ``books(book_id, text)``; ``folder`` is shared storage that keeps the run.

    ``sheets(book_id, characters)``: edited character sheets (JSON by id), used instead of asking for one.
    ``most_rounds`` ends the call early; calling again goes on.
    """
    spark, recipe = books.sparkSession, recipe or Recipe()
    recipe.check()
    key = json.dumps([recipe.__dict__, make_annotator().identity], sort_keys=True, ensure_ascii=False)
    source = f"{folder}/books"
    text = T.clean_source(F.col("text"))
    now = books.select(F.col("book_id").cast("string"), text.alias("text")).where("text is not null").withColumn("identity", F.sha2(F.concat_ws("\n", F.lit(key), "text"), 256))
    if not _exists(spark, source):
        start = now.withColumn("spans", alignment.quotes("text"))
        if sheets is None:
            start = start.withColumn("state", F.lit(None).cast("string"))
        else:
            first = F.concat(F.lit('{"phase": "script", "characters": '), "characters", F.lit("}"))
            start = start.join(sheets.select(F.col("book_id").cast("string"), first.alias("state")), "book_id", "left")
        start.write.mode("overwrite").parquet(source)
    held = spark.read.parquet(source)
    changed = now.join(held.select("book_id", F.col("identity").alias("_i")), "book_id", "left").where(~F.col("identity").eqNullSafe(F.col("_i")))
    if changed.limit(1).count():
        raise ChangedRun("sources, engine or settings changed; use another folder to keep the earlier run")
    n = 0
    while _exists(spark, f"{folder}/round={n}"):
        n += 1
    ended = 0
    while most_rounds is None or ended < most_rounds:
        if n:
            last = spark.read.schema(ROUND).parquet(f"{folder}/round={n - 1}").where("phase in ('sheet', 'script')").select("book_id", F.col("state").alias("_s"))
            todo = held.join(last, "book_id").withColumn("state", F.col("_s")).drop("_s")
        else:
            todo = held
        if not todo.limit(1).count():
            break
        run_round(todo, make_annotator, recipe).write.mode("overwrite").parquet(f"{folder}/round={n}")
        n, ended = n + 1, ended + 1
    return collected(spark, folder, n, recipe)


def collected(spark: SparkSession, folder: str, rounds: int, recipe: Recipe) -> Scripts:
    """The tables of a run from its rounds."""
    paths = [f"{folder}/round={i}" for i in range(rounds)]
    every = spark.read.schema(ROUND).option("basePath", folder).parquet(*paths).withColumn("round", F.regexp_extract(F.col("_metadata.file_path"), r"/round=(\d+)/", 1).cast("long")) if paths else spark.createDataFrame([], f"{ROUND}, round long")
    segments = every.select("book_id", "round", F.posexplode("rows").alias("nth", "r")).select("book_id", (F.col("round") * (1 << 32) + F.col("nth")).alias("seg"), "r.*")
    followed = blocks.following(segments, "book_id", F.floor(F.col("seg") / (1 << 40)), ["seg"], "heading", "_follows")  # blocks of 256 rounds
    paused = followed.withColumn("pause_after_ms", F.when(F.coalesce("_follows", F.lit(False)), T.PAUSES["heading"]).otherwise(F.col("pause_after_ms"))).drop("_follows")
    paused = paused.withColumn("direction", F.when(F.col("told").isNull(), F.col("direction")).otherwise(P.performed(F.col("direction"), F.col("told")))).drop("told")
    told = every.select("book_id", F.explode("deliveries").alias("d")).select("book_id", "d.*").where(P.trimmed(F.col("delivery"), F.col("speaker_id")))
    change = F.concat(F.lit(f"{alignment.TRIMMED}: "), "delivery", F.lit(" -> "), P.clean_delivery(F.col("delivery"), F.col("speaker_id")))
    warnings = every.select("book_id", F.explode("warnings").alias("w")).select("book_id", "w.*").union(told.select("book_id", "text", change.alias("reason")))
    last = every.groupBy("book_id").agg(F.max_by(F.struct("state", "phase"), "round").alias("s")).select("book_id", "s.*")
    state = last.withColumn("characters", F.get_json_object("state", "$.characters"))
    return Scripts(
        scripts.emit(paused, recipe.segment_chars), state.select("book_id", "characters"), warnings,
        every.select("book_id", "round", F.explode("failures").alias("reason")), state.where("phase = 'failed'").select("book_id", F.get_json_object("state", "$.error").alias("error")),
    )
