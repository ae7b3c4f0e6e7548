"""Voice library and casting: labels, sampling of reference clips, and one distinct voice for each speaker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.functions import text as T

VOICE_PREFIX = "libritts_r_"  # a fixed value: the format of voice ids


def label(voices: DataFrame, labels: DataFrame) -> DataFrame:
    """Voices with ``gender`` in its normal form; unknown or invalid ones take their speaker's label (``labels(speaker_id, gender)``)."""
    own = F.nullif(T.gender(F.col("gender")), F.lit("unknown"))
    known = labels.select(F.col("speaker_id").cast("string").alias("_s"), T.gender(F.col("gender")).alias("_g"))
    others = [c for c in voices.columns if c != "gender"]
    return voices.join(known, F.col("speaker_id").cast("string") == F.col("_s"), "left").select(*others, F.coalesce(own, "_g", F.lit("unknown")).alias("gender"))


def qualified(rows: DataFrame, duration: str = "duration", usable: str = "usable") -> DataFrame:
    """Rows of numeric speakers whose clip passed the gate."""
    return rows.where(F.col("speaker_id").cast("string").rlike("^[0-9]+$") & F.col(usable) & F.col(duration).isNotNull())


def sample(rows: DataFrame, count: int, max_rows: int, owned: DataFrame | None = None, duration: str = "duration", usable: str = "usable") -> DataFrame:
    """The clip nearest ten seconds of each new speaker, from a scan that stops once ``count`` voices are there.

    ``rows``: ``scan_pos`` (from 1), ``speaker_id`` and any others. ``owned(speaker_id)``: voices the
    library already has. The scan's end is the first appearance of the last speaker it needs: a minimum
    per speaker and a top ``count`` of those, with no window over the scan. Of equally near clips the
    earliest is taken.
    """
    fit = qualified(rows.where(F.col("scan_pos") <= max_rows), duration, usable)
    have = 0
    if owned is not None:
        ids = owned.select(F.col("speaker_id").cast("string").alias("_o")).distinct()
        have = ids.count()
        fit = fit.join(ids, F.col("speaker_id").cast("string") == F.col("_o"), "left_anti")
    if have >= count:
        return fit.limit(0)
    first = fit.groupBy("speaker_id").agg(F.min("scan_pos").alias("_first"))
    stop = first.orderBy("_first").limit(count - have).agg(F.max("_first").alias("_stop"), F.count(F.lit(1)).alias("_n"))
    end = stop.select(F.when(F.col("_n") == count - have, F.col("_stop")).otherwise(F.lit(max_rows)).alias("_end"))  # one row
    seen = fit.join(F.broadcast(end), F.col("scan_pos") <= F.col("_end")).drop("_end")
    near = F.struct(F.abs(F.col(duration) - A.IDEAL_SECONDS), "scan_pos")
    others = [c for c in rows.columns if c != "speaker_id"]
    return seen.groupBy("speaker_id").agg(F.min_by(F.struct(*others), near).alias("r")).select("speaker_id", "r.*")


def shortage(voices: DataFrame, count: int) -> DataFrame:
    """One row ``have, wanted`` if a library holds fewer voices than asked for; else none."""
    return voices.agg(F.count(F.lit(1)).alias("have")).where(F.col("have") < count).withColumn("wanted", F.lit(count))


def invalid_references(voices: DataFrame, files: DataFrame) -> DataFrame:
    """``voice_id, reason`` of voices whose clip is outside the library, missing, changed, short or not mono.

    ``files(path, sha256, frames, sample_rate, channels)`` is what the library's folder holds.
    """
    found = files.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"), "frames", F.col("sample_rate").alias("_r"), "channels")
    both = voices.join(found, F.col("path") == F.col("_p"), "left")
    outside = F.col("path").startswith("/") | F.concat(F.lit("/"), F.col("path"), F.lit("/")).contains("/../")
    reason = (
        F.when(F.coalesce(outside, F.lit(True)) | F.col("_p").isNull(), "invalid or missing")
        .when(~F.col("_h").eqNullSafe(F.col("sha256")), "checksum changed")
        .when((F.col("frames") / F.col("_r") <= 5) | (F.col("channels") != 1), "not mono and longer than five seconds")
    )
    return both.select("voice_id", reason.alias("reason")).where("reason is not null")


def casting_faults(casting: DataFrame, voices: DataFrame) -> DataFrame:
    """``book_id, voice_id, reason``: cast voices the library lacks, and voices cast twice in a book."""
    unknown = casting.join(voices.select("voice_id"), "voice_id", "left_anti").select("book_id", "voice_id", F.lit("unknown voice").alias("reason"))
    twice = casting.groupBy("book_id", "voice_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("book_id", "voice_id", F.lit("cast twice").alias("reason"))
    return unknown.union(twice)


def uncast(speakers: DataFrame, casting: DataFrame) -> DataFrame:
    """Speakers (``book_id, speaker_id``) without a voice."""
    return speakers.select("book_id", "speaker_id").distinct().join(casting, ["book_id", "speaker_id"], "left_anti")


def _ranked(speakers: DataFrame) -> DataFrame:
    """Speakers with ``nth`` among those of their book and known gender; the narrator first, others by name."""
    order = [F.col("speaker_id") != "narrator", F.col("speaker_id")]
    return speakers.withColumn("wanted", F.when(F.col("gender").isin("female", "male"), F.col("gender")).otherwise("any")).withColumn("nth", F.row_number().over(Window.partitionBy("book_id", "wanted").orderBy(*order)))


def held_library(voices: DataFrame, most: int) -> tuple[list[tuple[str, str]], int]:
    """``(voice_id, gender)``, sorted, of a library's first ``most`` voices of every gender; and how many it has in all.

    A book of ``most`` speakers and earlier choices can take no others: each takes the first that is free,
    of a gender or of all. So a library of any size is looked at in Spark and never sent as a whole.
    """
    own = voices.select("voice_id", F.coalesce(T.gender(F.col("gender")), F.lit("unknown")).alias("gender"))
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("gender").orderBy("voice_id"))).where(F.col("_r") <= most)
    return sorted((r[0], r[1]) for r in first.select("voice_id", "gender").collect()), own.count()


def _largest(speakers: DataFrame) -> int:
    """The rows of the book that has most."""
    return speakers.groupBy("book_id").count().agg(F.max("count")).first()[0] or 0


def cast(speakers: DataFrame, voices: DataFrame) -> DataFrame:
    """``book_id, speaker_id, voice_id`` where each book has voices enough of every gender its speakers ask for.

    Speakers of known gender choose first, by joining the nth such speaker with the nth such voice. The
    others take what is left: which voices those are depends on no more than how many of either gender
    the book used, so the rest is ranked once for each such pair of numbers. Books without voices enough
    have rows without a voice; use :func:`cast_greedy` for them.
    """
    spark = speakers.sparkSession
    own = _ranked(speakers.select("book_id", "speaker_id", "gender").distinct())
    numbers, rows = {}, []
    for at, (voice, gender) in enumerate(held_library(voices, _largest(own))[0], 1):
        numbers[gender] = numbers.get(gender, 0) + 1
        rows.append((voice, gender, numbers[gender], at))
    library = spark.createDataFrame(rows, "voice_id string, gender string, r int, at int")
    sure = own.where("wanted <> 'any'").join(library.select(F.col("gender").alias("wanted"), F.col("r").alias("nth"), "voice_id"), ["wanted", "nth"], "left")
    used = own.groupBy("book_id").agg(F.count(F.when(F.col("wanted") == "female", 1)).alias("f"), F.count(F.when(F.col("wanted") == "male", 1)).alias("m"))
    rest = own.where("wanted = 'any'").join(used, "book_id")
    kinds = rest.groupBy("f", "m").agg(F.max("nth").alias("most"))
    taken = ((F.col("gender") == "female") & (F.col("r") <= F.col("f"))) | ((F.col("gender") == "male") & (F.col("r") <= F.col("m")))
    # of a kind no more than its books' speakers in all can be asked for; the library is the bounded side
    left = kinds.join(F.broadcast(library), (F.col("at") <= F.col("most") + F.col("f") + F.col("m")) & ~taken)
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("f", "m").orderBy("voice_id"))).select("f", "m", "nth", "voice_id")
    others = rest.join(left, ["f", "m", "nth"], "left")
    return sure.select("book_id", "speaker_id", "voice_id").union(others.select("book_id", "speaker_id", "voice_id"))


class Shelf:
    """Voices in order, by gender, for :func:`assign`. ``size``: of the library whose first voices of each gender these are."""

    def __init__(self, voices: list[tuple[str, str]], size: int | None = None):
        self.gender = dict(voices)
        self.own: dict[str, list[str]] = {}
        for voice, gender in voices:
            self.own.setdefault(gender, []).append(voice)
        self.size = len(voices) if size is None else size


def assign(speakers: list[tuple[str, str]], voices: list[tuple[str, str]] | Shelf, fixed: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """Voices of one book's ``(speaker, gender)``, given ``(voice, gender)`` in order and earlier choices; and who got another gender's.

    A speaker of known gender takes the first free voice of it, else the first free one. Fewer voices
    than speakers is a ``ValueError``. Of a shelf no more is looked at than is taken.
    """
    shelf = voices if isinstance(voices, Shelf) else Shelf(voices)
    chosen = dict(fixed or {})
    spent, at = set(chosen.values()), dict.fromkeys(shelf.own, 0)
    want = sorted({s for s in speakers if s[0] not in chosen}, key=lambda s: (s[1] not in ("female", "male"), s[0] != "narrator", s[0]))
    free = shelf.size - sum(v in shelf.gender for v in spent)
    if len(want) > free:
        raise ValueError(f"{len(want)} additional distinct voices are needed, {free} are available")

    def first(gender: str) -> str | None:
        """The first free voice of a gender."""
        own = shelf.own.get(gender, ())
        while (i := at.get(gender, 0)) < len(own) and own[i] in spent:
            at[gender] = i + 1
        return own[i] if i < len(own) else None

    unmatched = []
    for speaker, gender in want:
        known = gender in ("female", "male")
        voice, of = first(gender) if known else None, gender
        if voice is None:
            voice, of = min((v, g) for g in shelf.own if (v := first(g)) is not None)
            unmatched += [speaker] * known
        chosen[speaker] = voice
        at[of] += 1
    return chosen, unmatched


def cast_greedy(speakers: DataFrame, voices: DataFrame, casting: DataFrame | None = None) -> DataFrame:
    """``book_id, casting`` (map) ``, unmatched, error`` for any books, keeping earlier choices.

    A book's speakers meet in one row. Of the library as many voices of a gender are sent along as the largest book can take.
    """
    held = speakers.select("book_id", "speaker_id", "gender").distinct()
    known = held.select("book_id") if casting is None else held.select("book_id").union(casting.select("book_id"))
    library = Shelf(*held_library(voices, _largest(known)))
    books = speakers.groupBy("book_id").agg(F.collect_set(F.struct("speaker_id", F.coalesce(T.gender(F.col("gender")), F.lit("unknown")).alias("gender"))).alias("s"))
    if casting is None:
        books = books.withColumn("c", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    else:
        books = books.join(casting.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker_id", "voice_id"))).alias("c")), "book_id", "left")

    @F.pandas_udf("struct<casting: map<string, string>, unmatched: array<string>, error: string>")
    def run(s: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for own, fixed in zip(s, c, strict=True):
            try:
                out.append((*assign([(x["speaker_id"], x["gender"]) for x in own], library, dict(fixed) if fixed is not None else None), None))
            except ValueError as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["casting", "unmatched", "error"])

    return books.withColumn("r", run("s", "c")).select("book_id", "r.casting", "r.unmatched", "r.error")


def listing(voices: DataFrame) -> DataFrame:
    """What ``voices list`` prints: id, gender, speaker, sorted by id."""
    return voices.select("voice_id", F.coalesce(T.gender(F.col("gender")), F.lit("unknown")).alias("gender"), F.coalesce(F.col("speaker_id").cast("string"), F.lit("")).alias("speaker")).orderBy("voice_id")
