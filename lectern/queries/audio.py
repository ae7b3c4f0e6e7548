"""Queries on waveforms and clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import audio as A
from lectern.functions import text as T
from lectern.operators import clips as C
from lectern.operators import voices
from lectern.plans import annotators
from lectern.plans import audio as plan
from lectern.queries import cast as K
from lectern.queries import views as V
from lectern.sources.config import Settings

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WAVES_SQL = "w AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL)"


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings", "vec_id", "embedding").where("embedding is not null")


@query(f"""
WITH {WAVES_SQL}, m AS (SELECT vec_id, len(x) / 8.0 AS s, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms, len(list_filter(x, lambda v: abs(v) >= 0.999)) / len(x) AS clipped FROM w)
SELECT vec_id, round(rms, 6) AS rms, clipped::DOUBLE AS clipped, s BETWEEN 6 AND 15 AND rms >= 0.125 AND clipped <= 0.01 AS usable FROM m""")
def voice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as clips of eight samples a second; the loudness gate lies near their middle."""
    x = F.col("embedding")
    return waves(spark, sf_dir).select("vec_id", F.round(A.rms(x), 6).alias("rms"), A.clipped_share(x).alias("clipped"), A.usable_clip(x, 8, 0.125).alias("usable"))


@query(f"""
WITH {WAVES_SQL}
SELECT vec_id, len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AS finite, len(list_filter(x, lambda v: abs(v) > 0.00001)) > 0 AS audible FROM w""")
def wave_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("vec_id", A.finite(F.col("embedding")).alias("finite"), A.audible(F.col("embedding")).alias("audible"))


@query(f"""
WITH {WAVES_SQL}, f AS (SELECT vec_id, x, list_filter(range(len(x) // 4), lambda i: sqrt(list_sum(list_transform(x[i * 4 + 1 : i * 4 + 4], lambda v: v * v)) / 4) > pow(10, -15 / 20.0)) AS loud FROM w),
b AS (SELECT vec_id, x, CASE WHEN len(loud) > 0 THEN greatest(0, list_min(loud) * 4 - 8) ELSE 0 END AS a, CASE WHEN len(loud) > 0 THEN least(len(x), (list_max(loud) + 1) * 4 + 8) ELSE len(x) END AS z FROM f)
SELECT vec_id, (z - a)::INTEGER AS n, round(x[a + 1], 6) AS first FROM b""")
def silence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two embeddings' mean is the embedding again; frames are of four samples."""
    x = F.col("embedding")
    trimmed = waves(spark, sf_dir).select("vec_id", A.trim_silence(A.to_mono(F.array(x, x)), 400, -15.0, 20).alias("t"))
    return trimmed.select("vec_id", F.size("t").alias("n"), F.round(F.col("t")[0], 6).alias("first"))


_PRINT = "sha256(concat('{\"model\":\"m\",\"reference\":\"', v.sha256, '\",\"seed_position\":', s.position, ',\"settings\":\"{}\",\"text\":', to_json(s.dialogue)::VARCHAR, '}'))"
_CASTING = K.SQL["casting"].strip().removeprefix("WITH ")
WANTED_SQL = f"""casting AS (WITH {_CASTING}), {V.VOICES_SQL}, {V.SCRIPT_SQL},
wanted AS (SELECT s.book_id, s.position, s.speaker_id, s.dialogue, c.voice_id, v.sha256 AS reference_sha256, {_PRINT} AS fingerprint FROM script s JOIN casting c USING (book_id, speaker_id) JOIN voices v ON v.voice_id = c.voice_id)"""


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.desired(V.script(spark, sf_dir), K.casting(spark, sf_dir), V.voices(spark, sf_dir), "m", "{}")


def held(rows: DataFrame) -> DataFrame:
    """Clips of wanted rows, some absent, damaged, or made from something else."""
    p = F.col("book_id") + F.col("position")
    changed = lambda n, c: F.when(p % n == 0, F.concat(F.lit("x"), c)).otherwise(F.col(c))
    return rows.where(p % 7 != 0).select(
        "book_id", "position", changed(5, "fingerprint").alias("fingerprint"), (p % 11 != 0).alias("valid"), F.when(p % 13 == 0, "x").otherwise(T.digest(F.col("dialogue"))).alias("dialogue_sha256"),
        changed(17, "speaker_id").alias("speaker_id"), changed(19, "voice_id").alias("voice_id"), changed(23, "reference_sha256").alias("reference_sha256"),
    )


@query(f"WITH {WANTED_SQL} SELECT book_id, position, fingerprint FROM wanted WHERE (book_id + position) % 7 = 0 OR (book_id + position) % 5 = 0 OR (book_id + position) % 11 = 0")
def incremental_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wanted(spark, sf_dir)
    return C.worklist(rows, held(rows)).select("book_id", "position", "fingerprint")


@query(f"WITH {WANTED_SQL} SELECT book_id, position, speaker_id, voice_id FROM wanted WHERE NOT ((book_id + position) % 7 = 0 OR (book_id + position) % 5 = 0 OR (book_id + position) % 11 = 0)")
def reusable_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wanted(spark, sf_dir)
    return C.reusable(rows, held(rows)).select("book_id", "position", "speaker_id", "voice_id")


@query(f"""
WITH {WANTED_SQL}, r AS (SELECT book_id, position, book_id + position AS p FROM wanted),
x AS (SELECT book_id, position, CASE WHEN p % 7 = 0 THEN 'missing' WHEN p % 13 = 0 THEN 'dialogue' WHEN p % 17 = 0 THEN 'speaker' WHEN p % 19 = 0 THEN 'voice' WHEN p % 23 = 0 THEN 'reference' WHEN p % 11 = 0 THEN 'damaged' END AS reason FROM r)
SELECT book_id, position, reason FROM x WHERE reason IS NOT NULL""")
def stale_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wanted(spark, sf_dir)
    return C.stale(rows, held(rows))


CLIPS_SQL = f"{V.SCRIPT_SQL}, clips AS (SELECT book_id, position, length(dialogue) * 100 AS frames, 24000 AS sample_rate, CASE position % 3 WHEN 0 THEN 900 WHEN 1 THEN 150 ELSE 350 END AS pause, sha256(dialogue) AS sha256 FROM script)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("position") % 3
    return V.script(spark, sf_dir).select("book_id", "position", (F.length("dialogue") * 100).cast("long").alias("frames"), F.lit(24000).alias("sample_rate"), F.when(third == 0, 900).when(third == 1, 150).otherwise(350).alias("pause_after_ms"), F.sha2("dialogue", 256).alias("sha256"))


@query(f"""
WITH {CLIPS_SQL}, s AS (SELECT *, pause * 24 AS pause_frames, coalesce(sum(frames + pause * 24) OVER (PARTITION BY book_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM clips)
SELECT book_id, position, start::BIGINT AS start_frame, (start + frames)::BIGINT AS end_frame, pause_frames::BIGINT AS pause_frames FROM s""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.timeline(clips(spark, sf_dir)).select("book_id", "position", "start_frame", "end_frame", "pause_frames")


@query(f"WITH {CLIPS_SQL} SELECT book_id, count(*) AS clips, round(sum(frames * 1000 / 24000 + pause), 3) AS milliseconds FROM clips GROUP BY book_id")
def book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.totals(clips(spark, sf_dir))


@query(f"""
WITH {CLIPS_SQL}, b AS (SELECT book_id, position // 1024 AS block, sha256(string_agg(concat(sha256, ':', pause), chr(10) ORDER BY position, concat(sha256, ':', pause))) AS d FROM clips GROUP BY book_id, block)
SELECT book_id, sha256(string_agg(d, chr(10) ORDER BY block)) AS identity FROM b GROUP BY book_id""")
def book_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.identity(clips(spark, sf_dir))


@query(f"""
WITH casting AS (WITH {_CASTING}), {V.VOICES_SQL}, p AS (SELECT book_id, CASE WHEN book_id % 5 = 0 THEN concat('x', voice_id) ELSE voice_id END AS voice_id FROM casting),
c AS (SELECT book_id, voice_id FROM p UNION ALL SELECT book_id, voice_id FROM p WHERE book_id % 7 = 0)
SELECT book_id, voice_id, 'unknown voice' AS reason FROM c WHERE voice_id NOT IN (SELECT voice_id FROM voices) UNION ALL SELECT book_id, voice_id, 'cast twice' FROM c GROUP BY book_id, voice_id HAVING count(*) > 1""")
def casting_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' whole casting, some voices unknown, some books cast twice."""
    made = K.casting(spark, sf_dir).select("book_id", F.when(F.col("book_id") % 5 == 0, F.concat(F.lit("x"), "voice_id")).otherwise(F.col("voice_id")).alias("voice_id"))
    twice = F.explode(F.when(F.col("book_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return voices.casting_faults(made.select("book_id", "voice_id", twice).select("book_id", "voice_id"), V.voices(spark, sf_dir))


@query(f"""
WITH {CLIPS_SQL}, r AS (SELECT book_id, CASE WHEN book_id % 3 = 0 AND position % 2 = 0 THEN 48000 ELSE 24000 END AS rate FROM clips)
SELECT book_id, count(DISTINCT rate) AS rates FROM r GROUP BY book_id HAVING count(DISTINCT rate) > 1""")
def mixed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books some of whose clips have another rate."""
    other = (F.col("book_id") % 3 == 0) & (F.col("position") % 2 == 0)
    return C.mixed_rates(clips(spark, sf_dir).withColumn("sample_rate", F.when(other, 48000).otherwise(24000)))


@query(f"""
WITH casting AS (WITH {_CASTING}), s AS (SELECT DISTINCT conv_id AS book_id, role AS speaker_id FROM conversations)
SELECT book_id, speaker_id FROM s WHERE NOT EXISTS (SELECT 1 FROM casting c WHERE c.book_id = s.book_id AND c.speaker_id = s.speaker_id AND (c.book_id + length(c.speaker_id)) % 4 > 0)""")
def uncast_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers that a casting with gaps leaves without a voice."""
    made = K.casting(spark, sf_dir).where((F.col("book_id") + F.length("speaker_id")) % 4 > 0)
    return voices.uncast(V.script(spark, sf_dir), made)


@query(f"""
WITH {V.VOICES_SQL}, v AS (SELECT voice_id, sha256, substr(voice_id, 2)::BIGINT AS i FROM voices),
p AS (SELECT *, CASE WHEN i % 7 = 0 THEN '../' || voice_id WHEN i % 7 = 1 THEN '/' || voice_id ELSE voice_id || '.wav' END AS path FROM v)
SELECT voice_id, CASE WHEN i % 7 < 2 OR i % 7 = 2 THEN 'invalid or missing' WHEN i % 7 = 3 THEN 'checksum changed' ELSE 'not mono and longer than five seconds' END AS reason FROM p WHERE i % 7 < 4 OR i % 7 = 4 OR i % 7 = 5""")
def reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library's clips: outside its folder, missing, changed, of two channels, or of exactly five seconds."""
    i = F.substring("voice_id", 2, 20).cast("long") % 7
    library = V.voices(spark, sf_dir).withColumn("i", i).withColumn("path", F.when(F.col("i") == 0, F.concat(F.lit("../"), "voice_id")).when(F.col("i") == 1, F.concat(F.lit("/"), "voice_id")).otherwise(F.concat("voice_id", F.lit(".wav"))))
    sha = F.when(F.col("i") == 3, F.concat(F.lit("x"), "sha256")).otherwise(F.col("sha256")).alias("sha256")
    files = library.where("i <> 2").select("path", sha, F.when(F.col("i") == 5, 120_000).otherwise(120_001).alias("frames"), F.lit(24_000).alias("sample_rate"), F.when(F.col("i") == 4, 2).otherwise(1).alias("channels"))
    return voices.invalid_references(library, files)


@query(rf"""
WITH {WANTED_SQL}
SELECT book_id, position, speaker_id, voice_id, 1200 * greatest(1, len(regexp_extract_all(dialogue, '[\p{{L}}\p{{N}}_'']+'))) AS frames, 24000 AS sample_rate, true AS valid, sha256(to_json(dialogue)::VARCHAR) AS dialogue_sha256 FROM wanted""")
def synthesized_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip of every line by the model that plays tones."""
    named = lambda df: df.withColumn("book_id", F.col("book_id").cast("string"))
    _, made = plan.synthesize(named(V.script(spark, sf_dir)).withColumn("direction", F.lit("Level.")), named(K.casting(spark, sf_dir)), V.voices(spark, sf_dir), None, annotators.ToneModel, "tone", Settings(engine="chatterbox"))
    return made.select(F.col("book_id").cast("long").alias("book_id"), "position", "speaker_id", "voice_id", "frames", "sample_rate", "valid", "dialogue_sha256")
