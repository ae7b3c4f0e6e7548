"""Writers. Spark's commit protocol makes a table appear as a whole; single files are written under another name and renamed."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import wav


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files(path, data)``, one file each below ``folder``; ``path, size`` of what was written.

    A file is written under a name of its own attempt and then renamed, so a task that runs again, or
    twice at once, leaves one whole file.
    """

    def run(batches):
        fs, at = store(folder)
        for b in batches:
            sizes = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole = f"{at}/{path}"
                fs.create_dir(whole.rpartition("/")[0], recursive=True)
                part = f"{whole}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(data or b"")
                fs.move(part, whole)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.select("path", F.col("data").cast("binary")).mapInArrow(run, "path string, size long")


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """One ``<doc_id>.txt`` for each row of ``texts(doc_id, text)``."""
    name = F.concat(F.regexp_replace(F.col("doc_id").cast("string"), r"[^A-Za-z0-9._-]+", "_"), F.lit(".txt"))
    return write_files(texts.select(name.alias("path"), F.encode("text", "UTF-8").alias("data")), folder)


def write_sounds(parts: DataFrame, folder: str) -> DataFrame:
    """One WAV file for each book of ``parts(book_id, position, data, sample_rate, size)``; ``path, size`` of what was written.

    ``data``: 16-bit mono samples, ``size``: the bytes of all the book's. A file is one stream in order, so a
    book is one task, which holds a batch of its parts; the file appears under its name when it is whole.
    """

    def run(batches):
        fs, at = store(folder)
        fs.create_dir(at, recursive=True)
        book, out, part, done = None, None, "", 0

        def close():
            whole = f"{re.sub(r'[^A-Za-z0-9._-]+', '_', str(book))}.wav"
            out.close()
            fs.move(part, f"{at}/{whole}")
            return pa.RecordBatch.from_arrays([pa.array([whole]), pa.array([done], pa.int64())], ["path", "size"])

        for b in batches:
            for name, data, rate, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or name != book:
                    if out is not None:
                        yield close()
                    book, part, done = name, f"{at}/{uuid.uuid4().hex}.part", 0
                    out = fs.open_output_stream(part, compression=None)
                    out.write(wav.sound_header(size, rate))
                out.write(data or b"")
                done += len(data or b"")
        if out is not None:
            yield close()

    ordered = parts.repartition("book_id").sortWithinPartitions("book_id", "position")
    return ordered.select("book_id", F.col("data").cast("binary"), "sample_rate", F.col("size").cast("long")).mapInArrow(run, "path string, size long")


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON document, as people edit it: indented, letters as they are."""
    folder, _, name = path.rpartition("/")
    row = spark.createDataFrame([(name, json.dumps(value, indent=2, ensure_ascii=False) + "\n")], "path string, text string")
    write_files(row.select("path", F.encode("text", "UTF-8").alias("data")), folder).collect()


def write_script(script: DataFrame, folder: str) -> None:
    """Script rows as JSON Lines by book, unless the folder is there: an edited script is never replaced."""
    rows = script.select("book_id", F.struct("position", "speaker_id", "dialogue", "direction", "pause_after_ms").alias("r"))
    ordered = rows.repartition("book_id").sortWithinPartitions("book_id", "r.position")
    ordered.select("book_id", F.to_json("r").alias("value")).write.mode("ignore").partitionBy("book_id").text(folder)


def append(df: DataFrame, folder: str) -> None:
    """Rows to a growing table, such as diagnostics of failed attempts."""
    df.write.mode("append").parquet(folder)


def show(df: DataFrame, rows: int = 1000) -> None:
    """A listing on the console."""
    df.show(rows, truncate=False)
