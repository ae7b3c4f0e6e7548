"""Scripts to audio: voices resolved, clips generated where none fits, and a checked timeline.

Clips are a growing table; what is wanted and what is there meet in an anti-join on fingerprints, so a
run generates what is missing and nothing else, and an interrupted run goes on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.functions import prompts as P
from lectern.operators import clips as C
from lectern.operators import scripts as S
from lectern.operators import voices as V
from lectern.sources import sinks, wav
from lectern.sources.config import Settings

CLIPS = (
    "book_id string, position long, fingerprint string, sha256 string, dialogue_sha256 string, speaker_id string, voice_id string, "
    "reference_sha256 string, sample_rate int, frames long, valid boolean, content binary"
)


#: Bytes of clips that a worker holds before it hands them on, one clip at least.
MOST_HELD = 1 << 23


class InvalidInput(ValueError):
    """Rows that stop a plan; the message lists some."""


def refuse(faults: DataFrame, what: str) -> None:
    some = faults.limit(5).collect()
    if some:
        raise InvalidInput(f"{what}: " + "; ".join(", ".join(str(v) for v in r) for r in some))


def prompted(script: DataFrame, characters: DataFrame, casting: DataFrame, voices: DataFrame) -> DataFrame:
    """Script rows with ``prompt`` and ``seconds``; characters (``book_id, speaker_id, gender, age, voice``) are optional."""
    cast = casting.join(voices.select("voice_id", F.col("gender").alias("_vg")), "voice_id").select("book_id", "speaker_id", "_vg")
    known = characters.select("book_id", "speaker_id", F.col("gender").alias("_g"), F.col("age").alias("_a"), F.col("voice").alias("_v"))
    both = script.join(cast, ["book_id", "speaker_id"]).join(known, ["book_id", "speaker_id"], "left")
    line = P.prompt(F.col("speaker_id"), F.col("dialogue"), F.col("direction"), F.col("_g"), F.col("_a"), F.col("_v"), F.col("_vg"))
    return both.withColumn("prompt", line).withColumn("seconds", P.duration(P.spoken_words(F.col("dialogue")), delivery=F.col("direction"))).select(*script.columns, "prompt", "seconds")


def synthesize(script: DataFrame, casting: DataFrame, voices: DataFrame, have: DataFrame | None, make_model: Callable, model_identity: str, settings: Settings | None = None, characters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clips to keep from ``have``, and new ones, both as ``CLIPS``. The caller appends the new ones to its table.

    ``make_model`` is called in each task that has something to generate, at its first row. A silent or
    broken clip comes out with ``valid`` false, so a later run takes it up again.
    """
    settings = settings or Settings()
    refuse(C.voiceless(script, casting, voices), "speakers without a voice; cast first")
    if settings.engine == "dramabox":
        none = script.sparkSession.createDataFrame([], "book_id string, speaker_id string, gender string, age string, voice string")
        script = prompted(script, characters if characters is not None else none, casting, voices)
    wanted = C.desired(script, casting, voices, model_identity, json.dumps(settings.__dict__, sort_keys=True), "prompt" if settings.engine == "dramabox" else None)
    have = script.sparkSession.createDataFrame([], CLIPS) if have is None else have
    seed = settings.seed

    def run(batches):
        model, names = None, [c.split()[0] for c in CLIPS.split(", ")]
        for b in batches:
            out, held = [], 0
            for r in b.itertuples(index=False):
                model = model or make_model()
                samples, rate = model.generate(r.spoken, r.voice_id, seed + int(r.position), r.direction)
                x = np.asarray(samples, np.float32)
                x = (x.mean(axis=0) if x.ndim == 2 else x).reshape(-1)
                fine = bool(len(x) and np.isfinite(x).all() and (np.abs(x) > A.SILENT).any())
                content = wav.encode(np.nan_to_num(x), rate)
                own = hashlib.sha256(json.dumps(r.dialogue, ensure_ascii=False).encode()).hexdigest()
                out.append((r.book_id, r.position, r.fingerprint, hashlib.sha256(content).hexdigest(), own, r.speaker_id, r.voice_id, r.reference_sha256, rate, len(x), fine, content))
                held += len(content)
                if held >= MOST_HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    work = C.worklist(wanted, have).select("book_id", "position", "fingerprint", "dialogue", "direction", "speaker_id", "voice_id", "reference_sha256", F.coalesce(F.col("prompt") if settings.engine == "dramabox" else F.lit(None), F.col("dialogue")).alias("spoken"))
    # generation is what takes time: lines are dealt evenly, whatever book they are of
    made = work.repartition("book_id", "position").mapInPandas(run, CLIPS)
    return C.reusable(wanted, have).select(*[c.split()[0] for c in CLIPS.split(", ")]), made


class Stitched(NamedTuple):
    timeline: DataFrame  # book_id, position, start_frame, end_frame, …
    books: DataFrame  # book_id, clips, milliseconds, identity
    pcm: DataFrame  # book_id, position, data


def stitch(script: DataFrame, casting: DataFrame, voices: DataFrame, clips: DataFrame) -> Stitched:
    """Ordered output of whole books; refuses missing, stale or damaged clips and books of mixed rates."""
    cast = script.join(casting.select("book_id", "speaker_id", "voice_id"), ["book_id", "speaker_id"], "left").join(voices.select("voice_id", F.col("sha256").alias("reference_sha256")), "voice_id", "left")
    refuse(C.stale(cast, clips), "clips missing or stale; synthesize first")
    refuse(C.mixed_rates(clips.join(script.select("book_id", "position"), ["book_id", "position"], "left_semi")), "sample rates differ")
    placed = clips.select("book_id", "position", "sha256", "frames", "sample_rate", "content").join(script.select("book_id", "position", "pause_after_ms"), ["book_id", "position"])
    books = C.totals(placed).join(C.identity(placed), "book_id")

    @F.pandas_udf("binary")
    def rendered(content: pd.Series, rate: pd.Series, pause: pd.Series) -> pd.Series:
        out = []
        for c, r, p in zip(content, rate, pause, strict=True):
            samples, _ = wav.decode(c)
            out.append(np.rint(samples[:, 0] * 32768).clip(-32768, 32767).astype("<i2").tobytes() + bytes(2 * round(r * p / 1000)))
        return pd.Series(out)

    parts = placed.select("book_id", "position", rendered("content", "sample_rate", "pause_after_ms").alias("data"))
    return Stitched(C.timeline(placed.drop("content")), books, parts)


def write_sounds(made: Stitched, folder: str) -> DataFrame:
    """One WAV file for each book below ``folder``: ``path, size``."""
    whole = made.timeline.groupBy("book_id").agg(F.max("sample_rate").alias("sample_rate"), (F.max(F.col("end_frame") + F.col("pause_frames")) * 2).alias("size"))
    return sinks.write_sounds(made.pcm.join(whole, "book_id"), folder)


def check_script(script: DataFrame) -> None:
    refuse(S.faults(script), "invalid script rows")


def cast(script: DataFrame, voices: DataFrame, characters: DataFrame, casting: DataFrame | None = None) -> DataFrame:
    """``book_id, speaker_id, voice_id`` for every speaker; earlier choices stay."""
    if casting is not None:
        refuse(V.casting_faults(casting, voices), "casting")
    speakers = script.select("book_id", "speaker_id").distinct().join(characters.select("book_id", "speaker_id", "gender"), ["book_id", "speaker_id"], "left")
    made = V.cast_greedy(speakers, voices, casting)
    refuse(made.where("error is not null").select("book_id", "error"), "casting")
    return made.select("book_id", F.explode("casting").alias("speaker_id", "voice_id"))


def valid(content: Column | str) -> Column:
    """Whether stored clips can be used: decodable, finite, audible."""
    return wav.heard(content, A.SILENT)

