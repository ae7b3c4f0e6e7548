"""A voice library from rows of recorded speech: gate, sample, label, and the clips themselves.

Two passes: the first decodes every row within the scan's limit and keeps only duration and verdict, so
no samples are shuffled; the second decodes again the few rows that were chosen.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.operators import voices as V
from lectern.sources import wav

RATE = 24_000  # a fixed value: clips of a library


def gate(samples: np.ndarray | None, rate: int | None) -> tuple[float | None, bool]:
    """Duration in seconds and whether a clip can be used; Python form of ``functions.audio.usable_clip``."""
    if samples is None or not len(samples) or not np.isfinite(samples).all():
        return None, False
    x = samples.mean(axis=1) if samples.ndim == 2 else samples
    seconds = len(x) / rate
    fine = A.CLIP_SECONDS[0] <= seconds <= A.CLIP_SECONDS[1] and float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) >= A.LEAST_RMS and np.mean(np.abs(x) >= A.FULL_SCALE) <= A.MOST_CLIPPED
    return seconds, bool(fine)


def judged(content: Column | str) -> Column:
    @F.pandas_udf("struct<duration: double, usable: boolean>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([gate(*(wav.decode(c) or (None, None))) for c in contents], columns=["duration", "usable"])

    return run(content)


class Library(NamedTuple):
    voices: DataFrame  # the whole library, old and new
    clips: DataFrame  # path, data of the new voices
    shortage: DataFrame  # a row where voices are fewer than asked for


def build(rows: DataFrame, count: int = 20, max_rows: int = 10_000, have: DataFrame | None = None, labels: DataFrame | None = None, files: DataFrame | None = None, dataset: str = "", revision: str = "main", split: str = "dev.clean", attribution: str = "") -> Library:
    """Extend a library (``have``) from ``rows`` (``sources.files.AUDIO_ROW``) until it holds ``count`` voices."""
    if count < 1 or max_rows < 1:
        raise ValueError("count and max_rows must be positive")
    spark = rows.sparkSession
    candidates = wav.resolved(rows.where(F.col("scan_pos") <= max_rows), files)
    verdicts = candidates.select("scan_pos", "speaker_id", judged("content").alias("j")).select("scan_pos", "speaker_id", "j.*")
    chosen = V.sample(verdicts, count, max_rows, None if have is None else have.select("speaker_id")).select("scan_pos")
    picked = candidates.join(F.broadcast(chosen), "scan_pos")  # at most ``count`` rows
    decoded = picked.withColumn("d", wav.decoded("content")).withColumn("data", wav.encoded(wav.resampled(F.col("d.samples"), F.col("d.sample_rate"), RATE), F.lit(RATE)))
    facts = decoded.withColumn("f", wav.facts("data")).withColumn("voice_id", F.concat(F.lit(V.VOICE_PREFIX), "speaker_id"))
    made = facts.select(
        "voice_id", F.concat(F.lit("clips/"), "voice_id", F.lit(".wav")).alias("path"), "speaker_id", F.col("id").alias("utterance_id"),
        F.coalesce(F.nullif("text_original", F.lit("")), "text_normalized", F.lit("")).alias("transcript"), (F.col("f.frames") / RATE).alias("duration"), F.lit(RATE).alias("sample_rate"), F.sha2("data", 256).alias("sha256"),
        F.lit("unknown").alias("gender"), F.lit(dataset).alias("dataset"), F.lit(revision).alias("revision"), F.lit(split).alias("split"), F.lit(attribution).alias("attribution"), "data",
    )
    clips = made.select("path", "data")
    labels = spark.createDataFrame([], "speaker_id string, gender string") if labels is None else labels
    new = V.label(made.drop("data"), labels)
    whole = new if have is None else V.label(have, labels).unionByName(new)
    return Library(whole, clips, V.shortage(whole, count))
