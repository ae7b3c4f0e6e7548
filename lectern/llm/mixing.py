"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources that hold them. Capacity flows from each pattern to
the quotas of its sources; a pattern's first use of its words is free, each further use costs one
more, and flows of one cost level are found before the next (Dinic's phases), which gives least cost
because costs sit on the first arcs only. Within a pattern documents are then chosen by a seeded hash
of their id: those below the cut are used once more than those above.

The cut comes from three sums over hash buckets, each 1024 times finer, so no source is ever sorted
or gathered. Documents in the last bucket are used in proportion, each a part of its words.

Patterns, a recipe's vocabulary, are held by the driver: more than ``MOST_PATTERNS`` is an error.

Defined results: null text has size 0; a null source is a source of its own, last in order; documents
of size 0 take nothing; an empty table gives no rows; repeated rows are all counted and share a hash.
"""

from __future__ import annotations

import math
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), (3, 2), 2, "mix:17:"
MOST_PATTERNS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column) -> Column:
    """30 bits of a seeded hash that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long").bitwiseAND((1 << 30) - 1)


def quotas(sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, repeats: int = REPEATS) -> dict[str | None, float]:
    """Targets of sources: ``share`` of all sizes dealt by weight, none above ``repeats`` times its size.

    Dealing the excess again and again ends where every source below its cap gets the same amount per
    weight; walking sources by how soon they reach their cap finds that amount at once.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, heavy = share[0] * sum(sizes.values()), sum(weight.values())  # whole is in units of 1/share[1]
    level = None
    for s in sorted(order, key=lambda s: (repeats * sizes[s] / weight[s], order.index(s))):
        if level is None and share[1] * repeats * sizes[s] * heavy > whole * weight[s]:
            level = (whole, share[1], heavy)
        if level is None:
            whole, heavy = whole - share[1] * repeats * sizes[s], heavy - weight[s]
    return {s: float(repeats * sizes[s]) if level is None else min(float(repeats * sizes[s]), level[0] / level[1] * weight[s] / level[2]) for s in order}


def route(patterns: dict[str, tuple[int, tuple]], quota: dict, repeats: int = REPEATS) -> dict[tuple[str, object], int]:
    """Min-cost flow: words that each pattern (size, sources) gives to each of its sources.

    Costs lie on the arcs out of the start alone, where no least-cost path ever returns, so filling
    the residual network level by level of cost is the successive-shortest-path method.
    """
    nodes: dict = {"start": 0, "end": 1}
    heads, to, room = [[], []], [], []

    def node(x) -> int:
        if x not in nodes:
            nodes[x] = len(nodes)
            heads.append([])
        return nodes[x]

    def arc(a: int, b: int, c: int) -> int:
        for x, y, z in ((a, b, c), (b, a, 0)):
            heads[x].append(len(to))
            to.append(y)
            room.append(z)
        return len(to) - 2

    entry = {p: arc(0, node(("p", p)), 0) for p in patterns}
    across = {(p, s): arc(node(("p", p)), node(("s", s)), size * repeats) for p, (size, sources) in patterns.items() for s in sources}
    for s, most in quota.items():
        arc(node(("s", s)), 1, most)
    for _ in range(repeats):
        for p, (size, _s) in patterns.items():
            room[entry[p]] += size
        while True:
            depth, queue = {0: 0}, deque([0])
            while queue:
                a = queue.popleft()
                for e in heads[a]:
                    if room[e] and to[e] not in depth:
                        depth[to[e]] = depth[a] + 1
                        queue.append(to[e])
            if 1 not in depth:
                break
            tried, path, a = [0] * len(heads), [], 0
            while True:
                if a == 1:
                    most = min(room[e] for e in path)
                    for e in path:
                        room[e] -= most
                        room[e ^ 1] += most
                    path, a = [], 0
                    continue
                while tried[a] < len(heads[a]):
                    e = heads[a][tried[a]]
                    if room[e] and depth.get(to[e]) == depth[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(heads[a]):
                    path.append(heads[a][tried[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break
    return {k: room[e ^ 1] for k, e in across.items()}


def key(sources: Column) -> Column:
    """A membership pattern as a string that tells null from every text."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(sources)), lambda s: F.when(s.isNull(), "n").otherwise(F.concat(F.lit("s"), F.hex(s)))), ",")


def plan(sizes: DataFrame, weights=WEIGHTS, share=SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """Cuts by pattern and targets by source, from ``sizes(sources array<string>, p, size, h)``.

    ``p`` is :func:`key` of the sources. Cuts: ``p, base`` (whole uses of every document), ``cut`` (documents
    hashed below it are used once more), ``num, den`` (the part of one more use in the bucket at the cut).
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("p").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"))
    rows = sums.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    held: dict = {}
    for r in rows:
        for s in set(r.sources):
            held[s] = held.get(s, 0) + r.size
    target = quotas(held, weights, share, repeats)
    flow = route({r.p: (r.size, tuple(set(r.sources))) for r in rows}, {s: math.floor(t + 0.5) for s, t in target.items()}, repeats)
    given: dict[str, int] = {}
    for (p, _), f in flow.items():
        given[p] = given.get(p, 0) + f
    cuts = [(r.p, given[r.p] // r.size if r.size else 1, given[r.p] % r.size if r.size else 0) for r in rows]
    kinds = {"p": pa.string(), "base": pa.int64(), "num": pa.int64(), "cut": pa.int64()}
    at = common.small(spark, [(p, b, n, 0) for p, b, n in cuts], **kinds)
    for shift in (20, 10, 0):
        own = sizes.join(F.broadcast(at.select("p", "num", "cut")), "p").where((F.shiftright("h", shift + 10) == F.col("cut")) & (F.col("num") > 0))
        buckets = own.groupBy("p", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("z"))
        got: dict[str, list] = {}
        for r in _at_cut(buckets.where("z > 0"), at).collect():
            got.setdefault(r.p, []).append((r.b, r.z))
        after = []
        for r in at.collect():
            left, cut, den = r.num, r.cut << 10, 1
            for b, z in sorted(got.get(r.p, [])) if r.num else ():
                if left < z:
                    cut, den = b, z
                    break
                left -= z
            after.append((r.p, r.base, left, cut, den))
        at = common.small(spark, [x[:4] for x in after], **kinds)
    targets = common.small(spark, [(s, held[s], t) for s, t in target.items()], source=pa.string(), source_size=pa.int64(), target=pa.float64())
    return common.small(spark, after, **kinds, den=pa.int64()), targets


def _at_cut(buckets: DataFrame, at: DataFrame) -> DataFrame:
    """Of each pattern's buckets only what tells the cut: the bucket that holds it, and the sum below as one."""
    below = F.coalesce(F.sum("z").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cum = buckets.withColumn("below", below).join(F.broadcast(at.select("p", "num")), "p").where("below <= num and num < below + z")
    return cum.select("p", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("b"), F.col("below").alias("z")), F.struct("b", "z"))).alias("x")).select("p", "x.b", "x.z")


def taken() -> Column:
    """Words that the mix takes of a document, from its ``size`` and ``h`` beside its pattern's cut."""
    return F.expr("size * base + case when h < cut then size when h = cut then size * num div den else 0 end").cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Sizes, hashes and patterns of ``docs(doc_id, text, source)``, each document in its one source."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text")).alias("size"), seeded(F.col("doc_id")).alias("h")).withColumn("sources", F.array("source")).withColumn("p", key(F.col("sources")))


def copies(docs: DataFrame, **recipe) -> DataFrame:
    """The rows of ``docs``, each as often as the mix uses it; a part of a use counts from one half on."""
    columns = docs.columns
    sizes, _ = common.cut(measured(docs), "sizes")
    cuts, _ = plan(sizes, **recipe)
    seen = docs.select(F.struct(*columns).alias("d"), words(F.col("text")).alias("size"), seeded(F.col("doc_id")).alias("h"), key(F.array(F.col("source").cast("string"))).alias("p"))
    more = F.when(F.col("h") < F.col("cut"), 1).when((F.col("h") == F.col("cut")) & (F.col("num") * 2 >= F.col("den")), 1).otherwise(0)
    n = (F.col("base") + F.when(F.col("size") > 0, more).otherwise(0)).cast("int")
    return seen.join(F.broadcast(cuts), "p").select("d", F.explode(F.array_repeat(F.lit(0), n))).select("d.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, _ = common.cut(measured(common.table(spark, sf_dir, "documents", "doc_id", "text", "source")), "sizes")
    cuts, targets = plan(sizes)
    both = sizes.join(F.broadcast(cuts), "p").join(F.broadcast(targets.withColumnRenamed("source", "own")), F.col("source").eqNullSafe(F.col("own")))
    return both.select("doc_id", "size", "source_size", "target", taken().alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::UBIGINT & 1073741823)::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source),
o AS (
  SELECT *, (2 * 3 * (sum(source_size) OVER ()) - 2 * 2 * 2 * coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 2 AS whole,
         sum(w) OVER (ORDER BY 2 * source_size / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy,
         row_number() OVER (ORDER BY 2 * source_size / w, n) AS k
  FROM s),
l AS (SELECT whole, heavy FROM o WHERE 4 * source_size * heavy > whole * w ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size,
         coalesce(least((2 * source_size)::DOUBLE, (SELECT whole::DOUBLE FROM l) / 2 * w / (SELECT heavy FROM l)), (2 * source_size)::DOUBLE) AS target
  FROM s),
b AS (
  SELECT source, h, sum(size) AS z, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (CASE WHEN d.size = 0 THEN 0 ELSE
        d.size * (floor(t.target + 0.5)::BIGINT // t.source_size)
        + least(d.size, greatest(0, d.size * least(b.z, greatest(0, floor(t.target + 0.5)::BIGINT % t.source_size - b.below)) // b.z)) END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h
"""
