"""The pipeline's stages, each against what it must do with its own input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import mixing, secrets, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_toxic_documents_go_and_clean_ones_stay(spark, docs, sf):
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == COLUMNS
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}


def test_one_of_each_group_stays(spark, docs, sf):
    more = docs.union(docs.where("doc_id < 5")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = corpus_pipeline.keep_one_of_near(spark, more, sf)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.select("doc_id", "text")).collect()}
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == COLUMNS and sorted(x for x in got if x is not None) == sorted(set(groups.values()))


def test_near_duplicates_send_no_keys_to_the_driver(spark, docs, sf, monkeypatch):
    made, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: made.append(links(*a)) or made[-1])
    corpus_pipeline.keep_one_of_near(spark, docs, sf)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in made]
    assert plans and all("SortMergeJoin" in x and "Broadcast" not in x for x in plans)


def test_secrets_are_replaced(spark, docs, sf):
    made = corpus_pipeline.redact_secrets(spark, docs, sf)
    assert made.columns == COLUMNS and made.count() == docs.count() and made.where("n_chars <> length(text)").count() == 0
    assert secrets.scan(made).select(F.explode("found").alias("f")).where("f.k < 3").count() == 0
    clean = {r.doc_id for r in secrets.scan(docs).where("size(found) = 0").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == before[r.doc_id] for r in made.collect() if r.doc_id in clean)


def test_sources_come_near_their_targets(spark, docs, sf):
    made = corpus_pipeline.mix_sources(spark, docs, sf)
    sizes = mixing.measured(docs)
    target = {r.source: r.target for r in mixing.plan(sizes)[1].collect()}
    got = {r.source: r.n for r in mixing.measured(made).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    largest = sizes.agg(F.max("size")).first()[0]
    assert made.columns == COLUMNS and all(abs(got.get(s, 0) - t) <= largest for s, t in target.items())
    assert made.groupBy("doc_id").count().where("count > 2").count() == 0


def test_tokens_and_the_whole_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and rows
    assert all(r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in rows)
    assert all(np.frombuffer(r.ids, "<u4").max(initial=0) < 50257 for r in rows)


def test_an_empty_corpus(spark, sf, tmp_path, docs):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tokens_are_decoded_in_the_stage(spark, docs, sf):
    more = docs.union(docs.limit(1).withColumn("doc_id", F.lit(-1)).withColumn("text", F.lit("é 😀 <|endoftext|> x")))
    more = more.union(docs.limit(1).withColumn("doc_id", F.lit(-2)).withColumn("text", F.lit(None).cast("string")))
    texts = {r.doc_id: r.text or "" for r in more.collect()}
    got = corpus_pipeline.STAGES[-1][1](spark, more, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert all(r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens == len(r.ids) // 4 for r in got)
