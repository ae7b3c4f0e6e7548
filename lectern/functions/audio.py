"""Waveform expressions over ``array<float>`` columns, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gates that results depend on.
CLIP_SECONDS, IDEAL_SECONDS = (6.0, 15.0), 10.0
LEAST_RMS, FULL_SCALE, MOST_CLIPPED, SILENT = 0.003, 0.999, 0.01, 0.00001
TRIM_DB, PAD_MS, FRAMES_PER_SECOND = -45.0, 80, 100


def _double(samples: Column) -> Column:
    return samples.cast("array<double>")


def finite(samples: Column) -> Column:
    """Whether there are samples and all are numbers."""
    fine = F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(samples) > 0) & fine, F.lit(False))


def rms(samples: Column) -> Column:
    x = _double(samples)
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def clipped_share(samples: Column) -> Column:
    return F.size(F.filter(_double(samples), lambda x: F.abs(x) >= FULL_SCALE)) / F.size(samples)


def seconds(samples: Column, rate: Column | int) -> Column:
    return F.size(samples) / rate


def usable_clip(samples: Column, rate: Column | int, least_rms: float = LEAST_RMS) -> Column:
    """A reference clip's gate: finite, 6 to 15 seconds, loud enough, at most 1 % at full scale."""
    length = seconds(samples, rate)
    return F.coalesce(finite(samples) & length.between(*CLIP_SECONDS) & (rms(samples) >= least_rms) & (clipped_share(samples) <= MOST_CLIPPED), F.lit(False))


def audible(samples: Column) -> Column:
    """A generated clip's gate: samples, all finite, some above silence."""
    return finite(samples) & F.exists(samples, lambda x: F.abs(x) > SILENT)


def to_mono(channels: Column) -> Column:
    """Mean of an array of channels; channels of different length end with the shortest."""
    n = F.size(channels)
    least = F.array_min(F.transform(channels, F.size))
    total = F.aggregate(F.slice(channels, 2, n), _double(F.slice(F.get(channels, 0), 1, least)), lambda a, c: F.zip_with(a, _double(F.slice(c, 1, least)), lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def trim_silence(samples: Column, rate: int, threshold_db: float = TRIM_DB, pad_ms: int = PAD_MS) -> Column:
    """From the first loud 10 ms frame to the last, 80 ms more at each end; unchanged if none is loud."""
    frame, pad = max(1, rate // FRAMES_PER_SECOND), round(rate * pad_ms / 1000)
    frames = F.floor(F.size(samples) / frame).cast("int")
    numbers = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    loud = F.filter(numbers, lambda i: rms(F.slice(samples, i * frame + 1, frame)) > 10 ** (threshold_db / 20))
    start = F.greatest(F.lit(0), F.array_min(loud) * frame - pad)
    end = F.least(F.size(samples), (F.array_max(loud) + 1) * frame + pad)
    return F.when(F.size(loud) > 0, F.slice(samples, start + 1, end - start)).otherwise(samples)


def pcm16(samples: Column) -> Column:
    """Samples limited to -1..1 as whole numbers of 16 bits."""
    return F.transform(_double(samples), lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32768).cast("int"))))


def pause_frames(rate: Column, pause_ms: Column) -> Column:
    return F.bround(rate * pause_ms / 1000).cast("long")
