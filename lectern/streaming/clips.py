"""Streams: script rows as they are written, to the clips they lack; and a voice scan that stops by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import clips as C
from lectern.operators import voices as V

SCRIPT = "book_id string, position long, speaker_id string, dialogue string, direction string, pause_after_ms int"


def script_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Script rows from Parquet files as they appear in a folder."""
    return spark.readStream.schema(SCRIPT).option("maxFilesPerTrigger", files).parquet(path)


def maintain(stream: DataFrame, wanted: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], clips: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to the table ``clips`` what each batch of script rows lacks in it.

    ``wanted`` adds voice and fingerprint to rows, ``generate`` makes clips of rows. A batch's clips go to a
    partition of its own that replaces what an interrupted try of it left, so each batch counts once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        have = spark.read.option("mergeSchema", "false").parquet(clips).where(F.col("batch") != number) if _there(spark, clips) else None
        work = wanted(rows)
        work = work if have is None else C.worklist(work, have)
        generate(work).write.mode("overwrite").parquet(f"{clips}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(at) and fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "batch=*/*.parquet")))


def voice_scan(stream: DataFrame, library: str, count: int, max_rows: int, checkpoint: str) -> StreamingQuery:
    """Scan rows (``scan_pos, speaker_id, duration, usable``) in batches until the library holds ``count`` voices.

    Each batch adds the best clip of its new speakers, so across batches the first batch with a usable
    clip decides; a batch after the count is reached adds nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        have = spark.read.parquet(library).where(F.col("batch") != number) if _there(spark, library) else None
        owned = None if have is None else have.select("speaker_id")
        V.sample(rows, count, max_rows, owned).write.mode("overwrite").parquet(f"{library}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pace(script: DataFrame, rows_per_second: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Lines and spoken seconds by book and time of writing (``written`` timestamp), in tumbling windows with a bound on late rows."""
    words = F.regexp_count("dialogue", F.lit(r"[\p{L}\p{N}_']+"))
    timed = script.withWatermark("written", late)
    return timed.groupBy("book_id", F.window("written", rows_per_second)).agg(F.count(F.lit(1)).alias("lines"), F.sum(words).alias("words"))
