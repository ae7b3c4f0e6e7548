"""Exact top-k by inner product: a ball tree for each shard, walked best bound first.

Components become whole numbers, ``floor(1024 * x)``. Candidates are dealt by their closest centre, at most
``CENTRES`` of them from a bounded sample, and clusters into shards of about ``SHARD`` vectors, so a shard's
ball is no wider than its cluster. A node's bound is the query's product with its centre plus the query's
length times its radius; a branch is cut when its bound is below the query's current k-th score.

That score is shared between shards: each query first searches one shard of the cluster with the highest
bound, next one of each of ``NEXT`` clusters that still reach its k-th score, and then only the other
shards of clusters whose bound reaches the k-th of all that was found. In each round a shard that is
asked goes to one task for each ``QUERIES`` of all queries, its tree is built there once, and queries
stream past it in batches: what a task holds is one shard and one batch.

The sample shapes clusters alone; every vector is a candidate and every bound holds for all of a cluster.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id,
take no part; vectors of different length don't meet; rows with the query's own id are its own; an
empty vector scores 0 with other empty ones; scores beyond 64 bits are cut off at the limits; repeated
rows are candidates of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP, SCALE, SHARD, LEAF = 10, 1024.0, 4096, 64
#: Clusters, sampled vectors for each of them, clusters of vectors whose length the sample doesn't hold, clusters of the second round, vectors compared together.
CENTRES, SAMPLED, OTHER, NEXT, TOGETHER, SEED = 1024, 16, 64, 3, 4096, 29
#: Queries that one copy of a shard may have to answer, about.
QUERIES = 1 << 18
FOUND = "query_id long, vec_id long, score long"


def real(rows: np.ndarray) -> np.ndarray:
    """Whole numbers as floating point; past 1e300, where squares are infinite and bounds with them, cut off there."""
    if rows.dtype != object:
        return rows.astype(np.float64)
    most = 10**300
    return np.array([[float(max(-most, min(most, v))) for v in r] for r in rows.tolist()], np.float64).reshape(rows.shape)


class BallTree:
    """Balls over the rows of an integer matrix; ``order`` lists rows so that each node holds a run of it."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        x = real(rows)
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right (-1: a leaf)
        centres, radii = [], []

        def node(a: int, b: int) -> int:
            own = x[self.order[a:b]]
            centre = own.mean(axis=0)
            centres.append(centre)
            with np.errstate(all="ignore"):
                radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            self.nodes.append((a, b, -1, -1))
            return len(self.nodes) - 1

        todo = [node(0, len(x))] if len(x) else []
        while todo:
            k = todo.pop()
            a, b, _, _ = self.nodes[k]
            if b - a <= leaf or radii[k] == 0:
                continue
            own = x[self.order[a:b]]
            with np.errstate(all="ignore"):
                p = own[((own - centres[k]) ** 2).sum(axis=1).argmax()]
                q = own[((own - p) ** 2).sum(axis=1).argmax()]
                split = np.argsort(own @ (q - p), kind="stable")
            self.order[a:b] = self.order[a:b][split]
            m = (a + b) // 2
            self.nodes[k] = (a, b, node(a, m), node(m, b))
            todo += self.nodes[k][2:]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return bounds(real(queries), self.centres, self.radii)


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball no less than any product within, rounding allowed for."""
    with np.errstate(all="ignore"):
        length = np.sqrt((queries * queries).sum(axis=1))
        slack = 1e-9 * length[:, None] * (np.sqrt((centres**2).sum(axis=1)) + radii) + 1e-3
        out = queries @ centres.T + length[:, None] * radii + slack
    out[~np.isfinite(out)] = np.inf  # numbers whose squares are too large tell nothing
    return out


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: in floating point where that is exact, else in whole numbers of any size."""
    if rows.dtype != object and query.dtype != object:
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
        if most < 2.0**53:
            return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    own = rows.astype(object) @ query.astype(object) if rows.shape[1] else np.zeros(len(rows), object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in own], np.int64)


class Shard:
    """Candidates of one length: ids, whole numbers and their tree."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.tree = BallTree(rows)
        self.rows, self.names = rows[self.tree.order], ids[self.tree.order]
        self.small = rows.dtype != object
        self.reals = self.rows.astype(np.float64) if self.small else None
        self.most = float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) if self.small else 0.0

    def search(self, queries: np.ndarray, qids: np.ndarray, floors: np.ndarray, k: int = TOP) -> list[tuple[int, int, int]]:
        """``query id, row id, score`` of each query's best ``k`` rows scoring its floor or more."""
        out, tree = [], self.tree
        if not len(self.rows) or not len(queries):
            return out
        exact = self.small and queries.dtype != object and self.most * float(np.abs(queries).max(initial=0)) < 2.0**53
        for at in range(0, len(queries), 256):
            for n, bound in enumerate(tree.bounds(queries[at : at + 256]).tolist(), at):
                query, own, worst = queries[n].astype(np.float64) if exact else queries[n], int(qids[n]), int(floors[n])
                heap, best = [(-bound[0], 0)], []  # best: (score, -id), least first
                while heap:
                    top, node = heapq.heappop(heap)
                    if -top < worst:
                        break
                    a, b, left, right = tree.nodes[node]
                    if left >= 0:
                        for child in (left, right):
                            if bound[child] >= worst:
                                heapq.heappush(heap, (-bound[child], child))
                        continue
                    score = (self.reals[a:b] @ query).astype(np.int64) if exact else products(self.rows[a:b], query)
                    for i in np.flatnonzero(score >= worst).tolist():
                        one = (int(score[i]), -int(self.names[a + i]))
                        if -one[1] == own:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, one)
                        elif one > best[0]:
                            heapq.heapreplace(best, one)
                    if len(best) == k:
                        worst = max(worst, best[0][0])
                out += [(own, -i, s) for s, i in best]
        return out


def lengths(vectors: pa.Array):
    """Rows of each vector length, and those vectors as a matrix."""
    sizes = np.asarray(vectors.value_lengths())
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        own = vectors if len(at) == len(sizes) else vectors.take(pa.array(at))
        yield at, np.asarray(own.flatten()).astype(np.float64).reshape(len(at), n)


def whole(x: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` as integers, of any size where 64 bits don't do."""
    if np.abs(x).max(initial=0) < 2.0**52:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[int(v) * int(SCALE) if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in r] for r in x.tolist()], object).reshape(x.shape)


class Clusters:
    """Centres by vector length. Vectors of a length without centres share clusters with a ball of any size."""

    def __init__(self, rows: list[list[float]], many: int, steps: int = 4):
        by, rng = {}, np.random.default_rng(SEED)
        for r in rows:
            by.setdefault(len(r), []).append(r)
        self.centres, at = {}, OTHER
        for n, own in sorted(by.items()):
            x = scaled(np.array(own, np.float64).reshape(len(own), n))
            c = x[rng.permutation(len(x))[: max(1, many * len(x) // max(1, len(rows)))]]
            for _ in range(steps):
                near = _closest(x, c)[0]
                c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            self.centres[n] = (at, c)
            at += len(c)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector (rows of one length, scaled), and the distance to its centre."""
        if x.shape[1] not in self.centres:
            return np.full(len(x), x.shape[1] % OTHER), np.full(len(x), np.inf)
        at, c = self.centres[x.shape[1]]
        near, far = _closest(x, c)
        return at + near, far

    def bounds(self, x: np.ndarray, radii: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """Clusters that hold any vector of the length of ``x``, and each query's bounds there."""
        at, c = self.centres.get(x.shape[1], (0, np.zeros((0, x.shape[1]))))
        own = [i for i in range(len(c)) if at + i in radii]
        names = np.array([at + i for i in own] or [x.shape[1] % OTHER], np.int64)
        return names, bounds(x, c[own], np.array([radii[at + i] for i in own])) if own else np.full((len(x), 1), np.inf)


def _closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    with np.errstate(all="ignore"):
        for at in range(0, len(x), TOGETHER):
            own = x[at : at + TOGETHER]
            near[at : at + TOGETHER] = ((c * c).sum(axis=1) - 2 * own @ c.T).argmin(axis=1)
            far[at : at + TOGETHER] = np.sqrt(((own - c[near[at : at + TOGETHER]]) ** 2).sum(axis=1))
    return near, far


def scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.floor(x * SCALE)


def _placed(clusters):
    """Vectors with their cluster, the distance to its centre, and a number that deals them out within it."""

    def run(batches):
        count = 0
        for b in batches:
            for at, x in lengths(b.column(1)):
                c, far = clusters.value.place(scaled(x))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(c, pa.int64()), pa.array(far), pa.array(_hashed(np.arange(count, count + len(at))).view(np.int64))], ["vec_id", "vector", "c", "far", "deal"])
                count += len(at)

    return run


def _near(clusters, radii: dict[int, float]):
    """Queries with their first clusters, by bound: told once, so that all rounds agree on them."""

    def run(batches):
        for b in batches:
            for at, x in lengths(b.column(1)):
                names, most = clusters.value.bounds(scaled(x), radii)
                first = names[np.argsort(-most, axis=1, kind="stable")[:, : NEXT + 1]]
                ends = np.arange(len(at) + 1, dtype=np.int32) * first.shape[1]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(first.reshape(-1), pa.int64()))], ["vec_id", "vector", "near"])

    return run


#: ``kind`` 0: a candidate; 1: a query, with its floor.
SHARDED = "c long, sub int, block int, kind int, id long, least long, vector array<double>"


def _ask(clusters, subs: dict[int, int], radii: dict[int, float], blocks: int, turn: int):
    """The shards that each query is sent to in a round.

    Round 0: one shard of the cluster with the highest bound; 1: one of each of the next that reach the
    floor; 2: all others of clusters that do.
    """

    def run(batches):
        for b in batches:
            ids, vectors, near, floors = np.asarray(b.column(0)), b.column(1), b.column(2), np.asarray(b.column(3))
            for at, x in lengths(vectors):
                names, most = clusters.value.bounds(scaled(x), radii)
                first = np.asarray(near.take(pa.array(at)).flatten()).reshape(len(at), -1)
                # the place of each cluster among the query's first ones, or one past them
                rank = np.full(most.shape, NEXT + 1)
                rank[np.arange(len(at))[:, None], np.searchsorted(names, first)] = np.arange(first.shape[1])
                reach = most >= floors[at][:, None]
                many = np.array([subs.get(c, 0) for c in names.tolist()], np.int64)
                home = (_hashed(ids[at])[:, None] % np.maximum(many, 1).astype(np.uint64)).astype(np.int64)
                if turn < 2:
                    row, col = np.nonzero((rank == 0 if turn == 0 else (rank > 0) & (rank <= NEXT) & reach) & (many > 0))
                    sub = home[row, col]
                else:
                    row, col = np.nonzero(reach & (many > 0))
                    times = many[col]
                    row, col = np.repeat(row, times), np.repeat(col, times)
                    sub = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    # of the first clusters' home shards those out of reach then are out of reach now
                    new = (sub != home[row, col]) | (rank[row, col] > NEXT)
                    row, col, sub = row[new], col[new], sub[new]
                for s in range(0, len(row), 1 << 13):
                    own = slice(s, s + (1 << 13))
                    r = at[row[own]]
                    block = (_hashed(ids[r] + 1) % np.uint64(blocks)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[col[own]]), pa.array(sub[own].astype(np.int32)), pa.array(block), pa.array(np.ones(len(r), np.int32)), pa.array(ids[r], pa.int64()), pa.array(floors[r], pa.int64()), vectors.take(pa.array(r))],
                        ["c", "sub", "block", "kind", "id", "least", "vector"],
                    )

    return run


def _hashed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(1)


def _search(k: int):
    """Rows sorted by shard, candidates before queries: the tree is built when the first query comes, and queries stream past it."""

    def run(batches):
        shard, held, trees = None, [], None
        for b in batches:
            c, sub, block, kind = (np.asarray(b.column(i)) for i in range(4))
            new = np.flatnonzero((c[1:] != c[:-1]) | (sub[1:] != sub[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), len(c)], strict=True):
                if a == z:
                    continue
                if shard != (own := (int(c[a]), int(sub[a]), int(block[a]))):
                    shard, held, trees = own, [], None
                part = b.slice(a, z - a)
                if kind[a] == 0:
                    held.append(part)
                    continue
                if trees is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    ids = np.asarray(t.column("id").combine_chunks())
                    trees, held = {x.shape[1]: Shard(ids[at], whole(x)) for at, x in lengths(t.column("vector").combine_chunks())}, []
                for at, x in lengths(part.column("vector")) if trees else ():
                    if x.shape[1] in trees:
                        found = trees[x.shape[1]].search(whole(x), np.asarray(part.column("id"))[at], np.asarray(part.column("least"))[at], k)
                        q, v, s = zip(*found, strict=True) if found else ((), (), ())
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, shard: int = SHARD, asked_in: list | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: best ``k`` of ``vectors(vec_id, embedding)`` for each of ``queries``.

    ``asked_in``, if given, gets the number of queries sent to shards in each round.
    """
    spark = vectors.sparkSession
    fine = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.col("vec_id").isNotNull()
    )
    rows, n = fine(vectors), fine(vectors).count()
    many = max(1, min(CENTRES, n // shard))
    share = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLED * 4 * many / max(1, n)))
    # copies are one vector in the sample, however many there are
    sample = [r.vector for r in rows.where(share).select("vector").distinct().orderBy(F.xxhash64("vector")).limit(SAMPLED * 8 * many).collect()]
    clusters = spark.sparkContext.broadcast(Clusters(sample, many))
    held, _ = common.cut(rows.mapInArrow(_placed(clusters), "vec_id long, vector array<double>, c long, far double, deal long"), "placed")
    sums = held.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # at most CENTRES and OTHER rows
    if not sums:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    subs, radii = {r.c: -(-r.n // shard) for r in sums}, {r.c: r.far for r in sums}
    of = F.create_map(*[F.lit(x) for c, m in subs.items() for x in (c, m)])
    zero, none = F.lit(0), F.lit(-(1 << 63)).cast("long")
    candidates = held.select("c", F.pmod("deal", F.element_at(of, F.col("c"))).cast("int").alias("sub"), zero.alias("kind"), F.col("vec_id").alias("id"), none.alias("least"), "vector")
    asked, _ = common.cut(fine(queries).mapInArrow(_near(clusters, radii), "vec_id long, vector array<double>, near array<long>"), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, turns = None, 3 if sum(subs.values()) > 1 else 1
    for turn in range(turns):
        if found is None:
            wanted = asked.withColumn("least", none)
        else:  # ``k`` found anywhere are a floor for all that is left
            floors = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
            wanted = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "vector", "near", F.coalesce("kth", none).alias("least"))
        sent, _ = common.cut(wanted.mapInArrow(_ask(clusters, subs, radii, blocks, turn), SHARDED), "asked")
        if asked_in is not None:
            asked_in.append(sent.count())
        # shards that nobody asks stay where they are
        rows = candidates.join(sent.select("c", "sub", "block").distinct(), ["c", "sub"]).select(*sent.columns)
        key = ("c", "sub", "block")
        got, _ = common.cut(rows.union(sent).repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(_search(k), FOUND), "found")
        found = got if found is None else found.union(got)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(len(q.e)), lambda i: q.e[i + 1] * c.e[i + 1]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 10
"""
