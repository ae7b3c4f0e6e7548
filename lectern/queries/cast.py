"""Queries on characters, voices and casting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import clips as C
from lectern.operators import registry, voices
from lectern.queries import views as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(r"""
WITH r AS (SELECT c_nationkey AS book_id, 'c' || c_custkey AS speaker_id, c_name AS name, ['she', c_mktsegment || c_custkey] AS aliases FROM customer WHERE c_custkey % 2 = 0),
u AS (SELECT c_nationkey AS book_id, 'u' || c_custkey AS speaker_id, concat('CUSTOMER#', lpad((c_custkey - c_custkey % 2)::VARCHAR, 9, '0')) AS name, ['Nick' || c_custkey, 'They', lower(c_mktsegment) || (c_custkey - 6)] AS aliases FROM customer WHERE c_custkey % 3 = 0),
k AS (SELECT book_id, speaker_id AS owner, list_filter(aliases, lambda x: x <> 'she') AS had, unnest([speaker_id, name] || list_filter(aliases, lambda x: x <> 'she')) AS key FROM r),
a AS (SELECT book_id, speaker_id, unnest([speaker_id, name] || list_filter(aliases, lambda x: x <> 'They')) AS key FROM u),
h AS (SELECT a.book_id, a.speaker_id, list(DISTINCT k.owner ORDER BY k.owner) AS owners, arg_min(k.had, k.owner) AS had FROM a JOIN k ON a.book_id = k.book_id AND lower(a.key) = lower(k.key) GROUP BY a.book_id, a.speaker_id)
SELECT u.book_id, u.speaker_id, coalesce(h.owners[1], u.speaker_id) AS canonical, coalesce(len(h.owners), 0)::BIGINT AS owners,
       array_to_string(list_sort(list_distinct(coalesce(h.had, []) || list_filter(u.aliases, lambda x: x <> 'They') || CASE WHEN h.owners[1] <> u.speaker_id THEN [u.name, u.speaker_id] ELSE [] END)), ',') AS aliases
FROM u LEFT JOIN h USING (book_id, speaker_id)""")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    key = F.col("c_custkey")
    known = c.where(key % 2 == 0).select(F.col("c_nationkey").alias("book_id"), F.concat(F.lit("c"), key).alias("speaker_id"), F.col("c_name").alias("name"), F.array(F.lit("she"), F.concat("c_mktsegment", key)).alias("aliases"))
    name = F.concat(F.lit("CUSTOMER#"), F.lpad((key - key % 2).cast("string"), 9, "0"))
    aliases = F.array(F.concat(F.lit("Nick"), key), F.lit("They"), F.concat(F.lower("c_mktsegment"), (key - 6).cast("string")))
    new = c.where(key % 3 == 0).select(F.col("c_nationkey").alias("book_id"), F.concat(F.lit("u"), key).alias("speaker_id"), name.alias("name"), aliases.alias("aliases"))
    return registry.link_aliases(known, new).select("book_id", "speaker_id", "canonical", "owners", F.array_join("aliases", ",").alias("aliases"))


@query(r"""
WITH c AS (SELECT c_nationkey AS book_id, c_custkey AS nth, 'c' || c_custkey AS sid, 'Name ' || (c_custkey // 40) AS name, c_name AS alias FROM customer),
o AS (SELECT *, first_value(sid) OVER (PARTITION BY book_id, name ORDER BY nth) AS own FROM c),
a AS (SELECT book_id, own, alias AS x FROM o UNION SELECT book_id, own, unnest([sid, name]) FROM o WHERE sid <> own),
l AS (SELECT book_id, own, string_agg(x, ',' ORDER BY x) AS aliases FROM a GROUP BY ALL)
SELECT book_id, own AS speaker_id, min(name) AS name, min(aliases) AS aliases, CASE WHEN bool_or(nth % 2 = 0) THEN 'female' ELSE 'unknown' END AS gender, count(*)::INTEGER AS n_items
FROM o JOIN l USING (book_id, own) GROUP BY book_id, own
UNION ALL SELECT DISTINCT book_id, 'narrator', 'Narrator', '', 'unknown', 0 FROM c""")
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's customers as one book's updates; those of one name are one character, who has been found under all their ids."""
    c = V.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    item = F.struct(F.concat(F.lit("c"), F.col("c_custkey")).alias("speaker_id"), F.concat(F.lit("Name "), F.floor(F.col("c_custkey") / 40)).alias("name"), F.array("c_name", F.lit("he")).alias("aliases"), F.when(F.col("c_custkey") % 2 == 0, "f").otherwise("").alias("gender"))
    made = registry.merge_characters(c.select(F.col("c_nationkey").alias("book_id"), F.col("c_custkey").alias("nth"), item.alias("item")))
    people = made.where("speaker_id is not null").withColumn("p", F.from_json("character", "name string, aliases array<string>, gender string"))
    return people.select("book_id", "speaker_id", "p.name", F.array_join("p.aliases", ",").alias("aliases"), "p.gender", F.col("items").alias("n_items"))


@query(r"""
WITH a AS (SELECT c_nationkey AS book_id, 'c' || c_custkey AS speaker_id, c_name AS name, c_mktsegment AS aliases, CASE c_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender, NULL::VARCHAR AS age, '' AS voice FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT c_nationkey AS book_id, 'c' || c_custkey AS speaker_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Sheet ' || c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'x' END AS aliases, CASE WHEN c_custkey % 6 = 0 THEN 'male' END AS gender, 'adult' AS age, 'low' AS voice FROM customer WHERE c_custkey % 2 = 0)
SELECT book_id, speaker_id, coalesce(nullif(s.name, ''), a.name) AS name, coalesce(s.aliases, a.aliases, '') AS aliases, coalesce(s.gender, a.gender, 'unknown') AS gender, coalesce(s.age, a.age) AS age, coalesce(nullif(s.voice, ''), nullif(a.voice, '')) AS voice
FROM a FULL JOIN s USING (book_id, speaker_id)""")
def character_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    key, ids = F.col("c_custkey"), [F.col("c_nationkey").alias("book_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("speaker_id")]
    none = F.array().cast("array<string>")
    found = c.where(key % 3 != 0).select(*ids, F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"), F.when(key % 4 == 0, "F").when(key % 4 == 1, " male ").when(key % 4 == 2, "").alias("gender"), F.lit(None).cast("string").alias("age"), F.lit("").alias("voice"))
    sheet = c.where(key % 2 == 0).select(*ids, F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Sheet "), "c_name")).alias("name"), F.when(key % 7 == 0, F.array(F.lit("x"))).otherwise(none).alias("aliases"), F.when(key % 6 == 0, "M").otherwise("unknown").alias("gender"), F.lit("adult").alias("age"), F.lit("low").alias("voice"))
    return registry.overlay(found, sheet).withColumn("aliases", F.coalesce(F.array_join("aliases", ","), F.lit("")))


@query(f"""
WITH {V.VOICES_SQL}, l AS (SELECT n_nationkey::VARCHAR AS speaker_id, CASE n_regionkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender FROM nation)
SELECT voice_id, coalesce(nullif(voices.gender, 'unknown'), l.gender, 'unknown') AS gender FROM voices LEFT JOIN l USING (speaker_id)""")
def voice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices without a usable gender of their own take the label of their speaker."""
    region = F.col("n_regionkey") % 3
    labels = V.table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("speaker_id"), F.when(region == 0, "F").when(region == 1, "M").alias("gender"))
    odd = V.voices(spark, sf_dir).withColumn("gender", F.when(F.col("gender") == "unknown", F.when(F.col("voice_id").endswith("5"), "neither")).otherwise(F.upper("gender")))
    return voices.label(odd, labels).select("voice_id", "gender")


@query("""
WITH q AS (SELECT event_id + 1 AS scan_pos, user_id AS speaker_id, value AS duration FROM events WHERE event_type <> 'error' AND event_id < 5000 AND user_id IS NOT NULL AND value IS NOT NULL AND user_id >= 10),
f AS (SELECT speaker_id, min(scan_pos) AS first FROM q GROUP BY speaker_id),
e AS (SELECT CASE WHEN count(*) = 60 THEN max(first) ELSE 5000 END AS stop FROM (SELECT first FROM f ORDER BY first LIMIT 60)),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY abs(duration - 10), scan_pos) AS n FROM q, e WHERE scan_pos <= stop)
SELECT speaker_id, scan_pos, duration FROM r WHERE n = 1""")
def voice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of ten voices grows to seventy from a scan of events."""
    e = V.table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    rows = e.select((F.col("event_id") + 1).alias("scan_pos"), F.col("user_id").alias("speaker_id"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("usable"))
    return voices.sample(rows, 70, 5000, spark.range(10).withColumnRenamed("id", "speaker_id")).select("speaker_id", "scan_pos", "duration")


@query(f"WITH {V.VOICES_SQL} SELECT voice_id, gender, coalesce(speaker_id, '') AS speaker FROM voices")
def voice_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voices.listing(V.voices(spark, sf_dir))


GENDERS = {"user": "female", "assistant": "male"}


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gender = F.when(F.col("speaker_id") == "user", "female").when(F.col("speaker_id") == "assistant", "male").otherwise("unknown")
    return V.script(spark, sf_dir).select("book_id", "speaker_id").distinct().withColumn("gender", gender)


@query(f"""
WITH {V.VOICES_SQL}, s AS (SELECT DISTINCT conv_id AS book_id, role AS speaker_id, CASE role WHEN 'user' THEN 'female' WHEN 'assistant' THEN 'male' ELSE 'unknown' END AS gender FROM conversations),
one AS (SELECT gender, min(voice_id) AS voice_id FROM voices WHERE gender <> 'unknown' GROUP BY gender),
own AS (SELECT book_id, speaker_id, gender, voice_id FROM s JOIN one USING (gender)),
r AS (SELECT book_id, speaker_id, row_number() OVER (PARTITION BY book_id ORDER BY speaker_id <> 'narrator', speaker_id) AS n FROM s WHERE gender = 'unknown'),
left_ AS (SELECT r.book_id, r.speaker_id, r.n, v.voice_id, row_number() OVER (PARTITION BY r.book_id, r.speaker_id ORDER BY v.voice_id) AS k FROM r JOIN (SELECT * FROM voices ORDER BY voice_id LIMIT 12) v ON NOT EXISTS (SELECT 1 FROM own o WHERE o.book_id = r.book_id AND o.voice_id = v.voice_id))
SELECT book_id, speaker_id, voice_id FROM own UNION ALL SELECT book_id, speaker_id, voice_id FROM left_ WHERE k = n""")
def casting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voices.cast(speakers(spark, sf_dir), V.voices(spark, sf_dir))


@query(f"""
WITH {V.VOICES_SQL}, s AS (SELECT DISTINCT conv_id AS book_id, role AS speaker_id FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY speaker_id <> 'narrator', speaker_id) AS nth, count(*) OVER (PARTITION BY book_id) AS n FROM s),
v AS (SELECT voice_id, row_number() OVER (ORDER BY voice_id <> 'v000000000', voice_id) AS nth FROM voices)
SELECT book_id, speaker_id, voice_id, (n - 1)::INTEGER AS n_unmatched FROM r JOIN v USING (nth)""")
def casting_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casting where female voices are scarce: every speaker asks for one, and all but one voice of the library are of other or unknown gender."""
    library = V.voices(spark, sf_dir).withColumn("gender", F.when(F.col("voice_id") == "v000000000", "female").when(F.col("gender") == "female", "unknown").otherwise(F.col("gender")))
    made = voices.cast_greedy(speakers(spark, sf_dir).withColumn("gender", F.lit("female")), library)
    return made.select("book_id", F.explode("casting").alias("speaker_id", "voice_id"), F.size("unmatched").alias("n_unmatched"))


@query("""
WITH r AS (SELECT p_brand AS repo, p_partkey::VARCHAR AS name, p_size::BIGINT AS size FROM part),
h AS (SELECT p_brand AS repo, p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END END AS size FROM part WHERE p_partkey % 5 <> 0),
f AS (SELECT repo, name, CASE WHEN h.size IS NULL THEN 'missing' WHEN h.size = 0 THEN 'empty' WHEN h.size <> r.size THEN 'changed' END AS reason FROM r LEFT JOIN h USING (repo, name))
SELECT repo, name, reason FROM f WHERE reason IS NOT NULL""")
def model_file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").select(F.col("p_brand").alias("repo"), F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("long").alias("size"), F.lit(None).cast("string").alias("sha256"), "p_partkey")
    held = part.where("p_partkey % 5 <> 0").withColumn("size", F.expr("CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END END"))
    return C.model_file_faults(part, held)
