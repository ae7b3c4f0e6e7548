"""WAV audio as rows: decoding, file facts and encoding, with the standard library alone."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Frames that are decoded together.
BLOCK = 65_536


def blocks(content: bytes | None, frames: int = BLOCK):
    """Samples (frames, channels) in -1..1 of 8, 16, 24 or 32 bit PCM, a block at a time; nothing of anything else."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            width, channels = w.getsampwidth(), w.getnchannels()
            while raw := w.readframes(frames):
                raw = raw[: len(raw) // (width * channels) * width * channels]
                if width == 1:
                    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
                elif width == 3:
                    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
                else:
                    x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
                yield x.reshape(-1, channels)
    except (wave.Error, EOFError):
        return


def head(content: bytes | None) -> tuple[int, int, int] | None:
    """Frames, rate and channels by the header; None for what isn't PCM in WAV."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            return w.getnframes(), w.getframerate(), w.getnchannels()
    except (wave.Error, EOFError):
        return None


def decode(content: bytes | None) -> tuple[np.ndarray, int] | None:
    """All samples, and the rate; None for anything but PCM in WAV."""
    known = head(content)
    if known is None:
        return None
    parts = list(blocks(content))
    return (np.concatenate(parts) if parts else np.zeros((0, known[2]), np.float32)), known[1]


def sound_header(size: int, rate: int) -> bytes:
    """The bytes before ``size`` bytes of 16-bit mono samples; RF64, whose sizes have 64 bits, where RIFF's 32 don't do."""
    kind = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16)
    if size + 36 < 1 << 32:
        return struct.pack("<4sI4s", b"RIFF", size + 36, b"WAVE") + kind + struct.pack("<4sI", b"data", size)
    wide = struct.pack("<4sIQQQI", b"ds64", 28, size + 72, size, size // 2, 0)
    return struct.pack("<4sI4s", b"RF64", (1 << 32) - 1, b"WAVE") + wide + kind + struct.pack("<4sI", b"data", (1 << 32) - 1)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A mono WAV file of 16 bits; samples beyond -1..1 are limited."""
    pcm = np.clip(np.rint(np.clip(np.asarray(samples, np.float64), -1, 1) * 32768), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def decoded(content: Column | str) -> Column:
    """Mono samples (the mean of the channels), rate and number of channels; nulls where the bytes are no WAV file."""

    @F.pandas_udf("struct<samples: array<float>, sample_rate: int, channels: int>")
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            got = decode(c)
            out.append((got[0].mean(axis=1).astype(np.float32), got[1], got[0].shape[1]) if got and len(got[0]) else (None, None, None))
        return pd.DataFrame(out, columns=["samples", "sample_rate", "channels"])

    return run(content)


def facts(content: Column | str) -> Column:
    """Frames, rate and channels from a file's header."""

    @F.pandas_udf("struct<frames: long, sample_rate: int, channels: int>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([head(c) or (None, None, None) for c in content], columns=["frames", "sample_rate", "channels"])

    return run(content)


def heard(content: Column | str, silent: float) -> Column:
    """Whether any sample is louder than ``silent``, up to the first block that has one; false where the bytes are no WAV file."""

    @F.pandas_udf("boolean")
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([any((np.abs(x.mean(axis=1)) > silent).any() for x in blocks(c)) for c in content], dtype=bool)

    return run(content)


def encoded(samples: Column | str, rate: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else encode(s, int(r)) for s, r in zip(samples, rate, strict=True)])

    return run(samples, rate)


def resolved(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Candidate rows with ``content``: their own bytes, else those of the file (``path, content``) they name; others go."""
    if files is None:
        return rows.withColumn("content", F.col("audio.bytes")).where("content is not null")
    held = files.select(F.col("path").alias("_p"), F.col("content").alias("_c"))
    wanted = F.when(F.col("audio.bytes").isNull(), F.col("audio.path"))
    return rows.join(held, wanted == F.col("_p"), "left").withColumn("content", F.coalesce("audio.bytes", "_c")).where("content is not null").drop("_p", "_c")


def resampled(samples: Column, rate: Column, to: int) -> Column:
    """Samples at another rate by linear interpolation; as they are where the rates agree."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, own in zip(s, r, strict=True):
            if x is None or own == to:
                out.append(x)
                continue
            n = round(len(x) * to / own)
            out.append(np.interp(np.arange(n) * (own / to), np.arange(len(x)), x).astype(np.float32))
        return pd.Series(out)

    return run(samples, rate)
