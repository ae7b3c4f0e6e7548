"""Corpus preparation in five stages, each over all that the one before kept.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``. All but the last
return the columns of ``documents``. ``run`` applies them in turn, writing each result as Parquet to
the shared folder and reading it again, so a later stage never recomputes an earlier one; what a stage
wrote for itself, and the table it started from, go when its result is there. It returns the columns
``RESULT`` of the last stage's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import bpe, common, mixing, secrets, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels table, doesn't reject."""
    return toxicity.reject(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic")))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; rows that share an id are one document."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    drop = found.where("component_id < doc_id").select("doc_id").distinct()
    own = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text", "source", "lang"))
    return docs.join(drop, "doc_id", "left_anti").withColumn("_nth", F.row_number().over(own)).where("_nth = 1").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    changed = secrets.redact(docs)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources uses it."""
    return mixing.copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian unsigned 32-bit integers, their number, and the digest of the text decoded from them."""
    ids = bpe.encode_checked(docs)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_near),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

RESULT = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

#: Learned weights, fingerprints and merges aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES:
        with common.swept() as kept:
            docs, path = common.cut(stage(spark, docs, sf_dir), "stage")
            kept.add(path)
        if last:
            common.remove(spark, last)
        last = path
    return docs.select(*RESULT)
