"""Clips: fingerprints, what to generate anew, what is stale, and the timeline of a finished book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.functions import text as T
from lectern.operators import scripts

DIGEST_BLOCK = 1024


def fingerprint(text: Column, reference: Column, model: Column, settings: Column, position: Column) -> Column:
    """Identity of a clip: what is spoken, the voice's clip, model, settings and position; direction and pause don't count."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), reference.alias("reference"), position.cast("long").alias("seed_position"), settings.alias("settings"), text.alias("text"))), 256)


def desired(script: DataFrame, casting: DataFrame, voices: DataFrame, model: str, settings: str, prompt: str | None = None) -> DataFrame:
    """Script rows with ``voice_id, reference_sha256, fingerprint``; rows whose speaker has no voice are left out (see :func:`voiceless`).

    ``prompt``: a column of ``script`` to speak from instead of its dialogue.
    """
    cast = script.join(casting.select("book_id", "speaker_id", "voice_id"), ["book_id", "speaker_id"])
    full = cast.join(voices.select("voice_id", F.col("sha256").alias("reference_sha256")), "voice_id")
    return full.withColumn("fingerprint", fingerprint(F.col(prompt or "dialogue"), F.col("reference_sha256"), F.lit(model), F.lit(settings), F.col("position")))


def voiceless(script: DataFrame, casting: DataFrame, voices: DataFrame) -> DataFrame:
    """``book_id, speaker_id`` of script rows without a voice of the library."""
    held = casting.join(voices.select("voice_id"), "voice_id", "left_semi")
    return script.select("book_id", "speaker_id").distinct().join(held, ["book_id", "speaker_id"], "left_anti")


def worklist(wanted: DataFrame, clips: DataFrame) -> DataFrame:
    """Wanted rows without a usable clip of the same fingerprint. ``clips``: ``book_id, position, fingerprint, valid``."""
    usable = clips.where(F.coalesce("valid", F.lit(False))).select("book_id", "position", "fingerprint")
    return wanted.join(usable, ["book_id", "position", "fingerprint"], "left_anti")


def reusable(wanted: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips to keep: those of a wanted fingerprint, under the speaker and voice they now have."""
    own = wanted.select("book_id", "position", "fingerprint", F.col("speaker_id").alias("_s"), F.col("voice_id").alias("_v"))
    others = [c for c in clips.columns if c not in ("speaker_id", "voice_id")]
    return clips.where(F.coalesce("valid", F.lit(False))).join(own, ["book_id", "position", "fingerprint"]).select(*others, F.col("_s").alias("speaker_id"), F.col("_v").alias("voice_id"))


def stale(wanted: DataFrame, clips: DataFrame) -> DataFrame:
    """``book_id, position, reason`` of script rows whose clip can't be assembled: missing, changed or damaged."""
    held = clips.select("book_id", "position", F.lit(True).alias("_c"), *[F.col(c).alias("_" + c) for c in ("dialogue_sha256", "speaker_id", "voice_id", "reference_sha256", "valid")])
    both = wanted.join(held, ["book_id", "position"], "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    reason = (
        F.when(F.col("_c").isNull(), "missing")
        .when(differs("_dialogue_sha256", T.digest(F.col("dialogue"))), "dialogue")
        .when(differs("_speaker_id", F.col("speaker_id")), "speaker")
        .when(differs("_voice_id", F.col("voice_id")), "voice")
        .when(differs("_reference_sha256", F.col("reference_sha256")), "reference")
        .when(~F.coalesce("_valid", F.lit(False)), "damaged")
    )
    return both.select("book_id", "position", reason.alias("reason")).where("reason is not null")


def mixed_rates(clips: DataFrame) -> DataFrame:
    """``book_id, rates`` of books whose clips don't have one sample rate."""
    return clips.groupBy("book_id").agg(F.countDistinct("sample_rate").alias("rates")).where("rates > 1")


def timeline(clips: DataFrame) -> DataFrame:
    """``clips(book_id, position, frames, sample_rate, pause_after_ms)`` with ``pause_frames``, ``start_frame`` and ``end_frame``."""
    paused = clips.withColumn("pause_frames", A.pause_frames(F.col("sample_rate"), F.col("pause_after_ms")))
    placed = scripts.running_sum(paused, "book_id", "position", F.col("frames") + F.col("pause_frames"), "start_frame")
    return placed.withColumn("end_frame", F.col("start_frame") + F.col("frames"))


def totals(clips: DataFrame) -> DataFrame:
    """``book_id, clips, milliseconds`` of whole books, pauses included; exact in thousandths of a frame's time."""
    length = F.sum(F.col("frames") * 1000 / F.col("sample_rate") + F.col("pause_after_ms"))
    return clips.groupBy("book_id").agg(F.count(F.lit(1)).alias("clips"), F.round(length, 3).alias("milliseconds"))


def identity(clips: DataFrame) -> DataFrame:
    """``book_id, identity``: a digest of the ordered clips and pauses, as a digest of the digests of blocks of positions.

    ``clips``: ``book_id, position, sha256, pause_after_ms``. No task holds more than one block's rows, and
    then one digest for each block.
    """
    line = F.concat_ws(":", "sha256", F.col("pause_after_ms").cast("string"))
    ordered = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value.alias("v")))), lambda x: x["v"]), "\n")
    blocks = clips.groupBy("book_id", F.floor(F.col("position") / DIGEST_BLOCK).alias("block")).agg(F.sha2(ordered("position", line), 256).alias("d"))
    return blocks.groupBy("book_id").agg(F.sha2(ordered("block", F.col("d")), 256).alias("identity"))


def model_file_faults(required: DataFrame, present: DataFrame, by_hash: bool = False) -> DataFrame:
    """``repo, name, reason`` of required files that are absent, empty or differ; by size, or by hash where sizes don't tell.

    ``required`` and ``present``: ``repo, name, size, sha256``.
    """
    held = present.select("repo", "name", F.col("size").alias("_z"), F.col("sha256").alias("_h"))
    differs = ~F.col("sha256").eqNullSafe(F.col("_h")) if by_hash else ~F.col("size").eqNullSafe(F.col("_z"))
    reason = F.when(F.col("_z").isNull(), "missing").when(F.col("_z") == 0, "empty").when(differs, "changed")
    return required.join(held, ["repo", "name"], "left").select("repo", "name", reason.alias("reason")).where("reason is not null")


def pcm(clips: DataFrame) -> DataFrame:
    """Ordered output in parts: ``book_id, position, data``, each clip's samples and its pause as 16-bit little-endian."""
    samples = F.concat(F.col("samples16"), F.array_repeat(F.lit(0), A.pause_frames(F.col("sample_rate"), F.col("pause_after_ms")).cast("int")))
    low = lambda x: F.pmod(x, F.lit(65536))
    as_hex = F.transform(samples, lambda x: F.concat(F.lpad(F.hex(F.pmod(low(x), F.lit(256))), 2, "0"), F.lpad(F.hex(F.floor(low(x) / 256)), 2, "0")))
    return clips.select("book_id", "position", F.unhex(F.array_join(as_hex, "")).alias("data"))
