"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance.

A fingerprint is cut into ``BLOCKS`` blocks. Two fingerprints at distance ``MAX_BITS`` or less agree
in at least ``BLOCKS - MAX_BITS`` whole blocks, so joining on every choice of that many blocks finds
every such pair: with 7 blocks and 4 bits a key holds 27 or 28 bits and there are 35 keys.
Equal fingerprints meet first, so a group of copies, however large, is one row in the join.

Defined results: null or blank text has fingerprint zero, linked like any other; repeated rows give
repeated rows; a null ``doc_id`` takes no part in the minimum; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, MAX_BITS, BLOCKS, SEED = 4, 4, 7, 42
#: A block's bucket of more fingerprints than this is dealt into tiles, and each pair of tiles is a task of its own.
TILE = 2048


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    for at in range(0, n, 1 << 15):
        k = min(1 << 15, n - at)
        h = np.fromiter((digest(next(shingles), seed) for _ in range(k)), np.dtype("<u8"), k)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long) of ``docs(doc_id, text)``; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(run), "doc_id long, fp long")


def masks(blocks: int = BLOCKS, bits: int = MAX_BITS) -> list[int]:
    """Signed 64-bit masks of every choice of blocks that two near fingerprints may share."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (ends[i + 1] - ends[i])) - 1) << ends[i] for i in range(blocks)]
    return [x - (1 << 64) if (x := sum(c)) >> 63 else x for c in combinations(parts, blocks - bits)]


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within one bucket: at most one fewer than its rows."""
    left, out = np.arange(len(fp)), []
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            one, edge = edge[0], edge[1:]
            near = np.bitwise_count(fp[left] ^ fp[one]) <= bits
            out += [(one, x) for x in left[near]]
            edge, left = np.concatenate([edge, left[near]]), left[~near]
    return out


def _links(bits: int):
    def run(batches):
        kept = None
        for b in chain(batches, [None]):
            now = None if b is None else np.stack([np.asarray(b.column(i)) for i in range(4)])
            both = now if kept is None else kept if now is None else np.concatenate([kept, now], axis=1)
            if both is None or not both.shape[1]:
                continue
            new = np.flatnonzero(np.any(both[:3, 1:] != both[:3, :-1], axis=0)) + 1
            last = both.shape[1] if b is None else (new[-1] if len(new) else 0)
            kept, rows = both[:, last:], both[:, :last]
            if not last:
                continue
            starts = np.concatenate([[0], new[new < last]])
            sizes = np.diff(np.concatenate([starts, [last]]))
            fp, ends = rows[3].view(np.uint64), np.repeat(starts + sizes, sizes)
            left, right, at = [], [], np.flatnonzero(np.repeat(sizes <= 16, sizes))
            for d in range(1, 16):  # small buckets: all at once
                at = at[at + d < ends[at]]
                hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
                left.append(fp[hit])
                right.append(fp[hit + d])
            for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
                pairs = np.array(_forest(fp[s : s + n], bits), np.int64).reshape(-1, 2) + s
                left.append(fp[pairs[:, 0]])
                right.append(fp[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    return run


def links(distinct: DataFrame, bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``a, b``: verified links that connect every two of the ``distinct(fp)`` at ``bits`` or fewer.

    Within a bucket a spanning forest stands for all its pairs. A bucket of n fingerprints, all of them
    different, is n (n / ``TILE`` + 1) / 2 rows or fewer in the shuffle: keys of 27 bits hold about N / 2^27
    of N random fingerprints, so past some 10^11 documents the blocks should be fewer and wider.

    Spark takes the keys for as many as the fingerprints, of which each has 35, and the buckets for fewer
    yet: by its sizes alone it would send millions of rows through the driver. So that join is always sorted.
    """
    cases = F.array(*[F.struct(F.lit(i).cast("long").alias("c"), F.lit(m).alias("m")) for i, m in enumerate(masks(blocks, bits))])
    keyed = distinct.select("fp", F.explode(cases).alias("x")).select(F.col("x.c").alias("c"), F.col("fp").bitwiseAND(F.col("x.m")).alias("k"), "fp")
    many = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", common.other("k").alias("o"), "n")
    dealt = keyed.withColumn("o", common.other("k")).join(many.hint("merge"), ["c", "o"]).withColumn("t", F.ceil(F.col("n") / TILE).cast("long"))
    own = F.pmod(F.xxhash64("fp"), F.col("t"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("t") - 1), lambda j: F.least(own, j) * F.col("t") + F.greatest(own, j))
    placed = dealt.select("c", "k", F.explode(tiles).alias("p"), "fp")
    return placed.repartition("c", "k", "p").sortWithinPartitions("c", "k", "p").mapInArrow(_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``: the smallest doc_id reachable by links."""
    fps, _ = common.cut(fingerprints(docs), "fps")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = common.components(links(groups.select("fp"), bits, blocks))
    merged = groups.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp")).select("fp", "first", "root")
    least = merged.groupBy("root").agg(F.min("first").alias("component_id")).select(common.other("root").alias("r"), "component_id")
    ids = merged.withColumn("r", common.other("root")).join(least, "r").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))
