"""Language ID, toxicity, embeddings, WARC, top-k and mixing: held-out accuracy, brute force, round trips, SQL."""

import itertools
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import embeddings, langid, mixing, queries, topk, toxicity, warc

VECTORS = "vec_id long, embedding array<float>, label int"


# --- op3


def test_gradients_by_differences():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for k in net.p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            if k[0] == "W":
                at = (x[rng.integers(5), rng.integers(4)], at[1])
            old, values = net.p[k][at], []
            for d in (1e-2, -1e-2):
                net.p[k][at] = old + d
                values.append(net.gradients(x, y)[0])
            net.p[k][at] = old
            assert abs((values[0] - values[1]) / 2e-2 - g[k][at]) < 2e-3


def test_language_of_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op3_langid(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, ("the of and to in " if i % 2 else "der die und das ist ") * 20, "en" if i % 2 else "de") for i in range(40)] + [(90, None, "en"), (91, "", None), (92, "12 .", "de"), (None, "x", "en"), (93, "und die " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[90].score == 0 and got[93].lang_pred == "de"
    none = langid.learn(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


# --- op7


def area(scores, truth):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    pos = np.array(truth, bool)
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    got = toxicity.op7_toxicity(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    toxic = [truth[r.doc_id] for r in held]
    assert sum(toxic) > 0 and area([r.score for r in held], toxic) >= 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    clean = [r for r in held if not truth[r.doc_id]]
    assert np.mean([r.predicted for r in clean]) <= 0.05


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "bad " * 400_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (3, 7)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 4 and len({round(r.score, 12) for r in got if r.doc_id in (1, 2)}) == 1
    model = toxicity.fit(["you idiot fool"] * 5 + ["a kind word"] * 5, [1] * 5 + [0] * 5)
    assert model.score("idiot fool") > 0.5 > model.score("kind word")
    more = docs.withColumn("score", F.lit(0)).withColumn("a b", F.lit(1))
    assert toxicity.reject(more, model).columns == more.columns
    assert toxicity.learn(docs, labels.limit(0)).score("x") < 1e-9


# --- op4


def groups_by_definition(rows, least=0.93):
    fit = {i: np.array(v, np.float64) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: x for i, _, x in rows}
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(fit), 2):
        a, b = fit[i], fit[j]
        if label[i] == label[j] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
            links[i] += 1
            links[j] += 1
            p, q = top(i), top(j)
            root[max(p, q)] = min(p, q)
    return {i: (links[i], top(i)) for i in links}


def test_embedding_groups_and_recall(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for c in range(12):
        centre = rng.standard_normal(64)
        for _ in range(20):
            noise = rng.standard_normal(64) * np.linalg.norm(centre) / 8 * rng.uniform(0.05, 0.42)
            rows.append((n, [float(x) for x in np.float32(centre + noise)], c % 3))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(5)]
    n += 5
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 64, 0), (n + 3, [float("nan")] * 64, 0), (n + 4, [None, *rows[0][1][1:]], 0), (n + 5, rows[0][1], None), (n + 6, rows[0][1][:3], 0), (n + 7, [1e30] * 64, 1), (n + 8, [1e-30] * 64, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    expected = groups_by_definition([(i, v and [None if x is None else np.float32(x) for x in v], c) for i, v, c in rows])
    assert got.keys() == expected.keys()
    assert sum(a for a, _ in got.values()) >= 0.97 * sum(a for a, _ in expected.values()) and all(got[i][0] <= expected[i][0] for i in got)
    assert np.mean([got[i][1] == expected[i][1] for i in got]) >= 0.97
    assert all(got[i] == (0, i) for i in range(n, n + 7))


@pytest.mark.parametrize(("dim", "many"), [(1, 64), (2, 64), (3, 200), (16, 64), (64, 64), (64, 400), (65, 1000)])
def test_filter_recall_at_the_threshold(dim, many):
    rng = np.random.default_rng(dim)
    a, b = rng.standard_normal((2, 1000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = b - (a * b).sum(axis=1, keepdims=True) * a if dim > 1 else np.zeros_like(a)
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-30)
    near = 0.931 * a + np.sqrt(1 - 0.931**2) * b
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(embeddings.filters(a, many), embeddings.filters(near, many), strict=True)]
    assert np.mean(met) >= 0.98


def test_embedding_tiles_and_empty(spark, monkeypatch):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in np.float32(centre + rng.standard_normal(16) * 0.02)], 1) for i in range(60)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r.n_links == 59 and r.component_id == 0 and r.kept == (r.vec_id == 0) for r in got)


# --- op6


def best_by_definition(rows, k=10):
    fine = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in fine:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(fine[q], fine[c], strict=True)), c) for c in fine if c != q and len(fine[c]) == len(fine[q]))
            out[q] = [(c, -s) for s, c in scores[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("shard", [40, 8192])
def test_top_k(spark, shard):
    rng = np.random.default_rng(shard)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8))]) for i in range(0, 900, 3)]
    rows += [(1000 + i, rows[0][1]) for i in range(15)] + [(2000, None), (2001, [None] * 8), (2100, [float("inf")] * 8), (2200, [1.0, 2.0]), (2201, [3.0, 4.0]), (2300, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), shard=shard).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    rows = [(i, v and [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    expected = best_by_definition(rows)
    for q in expected:
        if q != 2300:
            assert got[q] == [(c, limit(s)) for c, s in expected[q]], q
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_asks_few_shards(spark):
    """Shards whose bound lies below what the first shards gave are asked by no query."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((24, 16)) * 4
    rows = [(i, [float(x) for x in np.float32(centres[i % 24] + rng.standard_normal(16) * 0.1)]) for i in range(2400)]
    df, asked = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), []
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), shard=100, asked_in=asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == best_by_definition([(i, [np.float32(x) for x in v]) for i, v in rows])
    assert asked[0] == 24 and sum(asked) < 24 * 24 / 3


def test_top_k_edges(spark):
    """Repeated rows, a third of all vectors equal, lengths that no centre has, and numbers beyond 64 bits and beyond squares."""
    rows = [(i % 7 * 100, [1.0, float(i % 3)]) for i in range(60)] + [(1000 + i, [2.0, 2.0]) for i in range(60)] + [(3000 + i * 100, [float(x) for x in range(i)]) for i in range(12)]
    rows += [(5000, [1e300, -1e300]), (5100, [1e200, 1.0]), (5200, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = [(i, [int(x) * 1024 if abs(x) > 2**52 else int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    expected = {}
    for q, a in whole:
        if q % 100 == 0:
            expected.setdefault(q, []).extend((-limit(sum(x * y for x, y in zip(a, b, strict=True))), c) for c, b in whole if c != q and len(a) == len(b))
    expected = {q: [(c, -s) for s, c in sorted(v)[:10]] for q, v in expected.items() if v}
    for shard in (8, 4096):
        got = {}
        for r in topk.top_k(df, df.where("vec_id % 100 = 0"), shard=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in expected.items()}
        assert got == expected


# --- op5


def test_archives(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 5000, "<p>b</p>", "line\r\n\r\nbreak"]
    urls = ["http://www.example.org/a?b=2&a=1", "https://example.org/a?a=1&b=2#x", None, "http://xn--e.example/p q", "http://example.org:8080/", "not a url", "http://[bad"]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(5, "not a url", "<p>b</p>")], "page_id long, url string, html string")
    directory, folder, archives = warc.build(pages)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.captures_of(directory, folder), archives).collect())
    assert [g[:3] for g in got] == [(0, 8, "revisit"), (1, 8, "response"), (2, 0, "revisit"), (3, 0, "response"), (4, 10000, "response"), (5, 8, "response"), (5, 8, "response"), (6, 13, "response")]
    assert [g[3] for g in got] == [1, None, 3, None, None, None, None, None]
    held = sorted((r.asDict() for r in directory.collect()), key=lambda r: r["first"])
    both = warc.lookup(held, "http://example.org/a?a=1&b=2", folder, archives)
    assert sorted(r["page_id"] for r in both) == [0, 1] and {r["payload"] for r in both} == {None, b"<p>a</p>"}
    assert warc.lookup(held, "http://none.example/", folder, archives) == [] and warc.lookup(held, "not a url", folder, archives)[0]["payload"] == b"<p>b</p>"
    small, f2, a2 = warc.build(pages, least=9)
    assert {r.record_type for r in warc.read(warc.captures_of(small, f2), a2).collect()} == {"response"}
    none, f3, a3 = warc.build(pages.limit(0))
    assert warc.read(warc.captures_of(none, f3), a3).count() == 0


def test_index_of_many_blocks(spark):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 40).cast("string"), F.lit(".example/")).alias("url"), F.col("id").cast("string").alias("html"))
    archives, folder = warc.common.fresh_path(spark, "w"), warc.common.fresh_path(spark, "c")
    captures, _ = warc.common.cut(warc.write(warc.classify(pages), archives), "cap")
    held = sorted((r.asDict() for r in warc.index(captures, folder, lines=7).collect()), key=lambda r: r["first"])
    assert len(held) > 60
    found = warc.search(spark.createDataFrame(held), folder, spark.createDataFrame([(f"example,h{h})/",) for h in (3, 3, 17, 39, 99)], "key string")).collect()
    assert sorted(r.page_id for r in found) == sorted(i for h in (3, 17, 39) for i in range(h, 500, 40))
    every = warc.search(spark.createDataFrame(held), folder, warc.keys_of(pages))
    assert sorted(r.page_id for r in every.collect()) == list(range(500))
    for h in range(0, 40, 3):
        assert sorted(r["page_id"] for r in warc.lookup(held, f"http://h{h}.example/", folder, archives)) == list(range(h, 500, 40))


def test_search_reads_only_the_blocks_that_may_hold_a_key(spark, monkeypatch):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.format_string("%03d", F.col("id") % 200), F.lit(".example/")).alias("url"), F.lit("x").alias("html"))
    archives, folder = warc.common.fresh_path(spark, "w"), warc.common.fresh_path(spark, "c")
    captures, _ = warc.common.cut(warc.write(warc.classify(pages), archives), "cap")
    held = sorted((r.asDict() for r in warc.index(captures.coalesce(1), folder, lines=5).collect()), key=lambda r: (r["file"], r["first"], r["start"]))
    read, real = [], warc.range_read
    monkeypatch.setattr(warc, "range_read", lambda fs, path, start, size, opened: read.append(start) or real(fs, path, start, size, opened))
    own = [r for r in held if r["file"] == held[0]["file"]]
    keys = sorted({x for r in own[3:40:9] for x in (r["first"], r["last"])})
    rows = [{k: r[k] for k in ("file", "start", "first", "last", "size")} for r in own] + [{"file": own[0]["file"], "start": None, "first": k, "last": None, "size": None} for k in keys]
    found = [x for b in warc._find(folder)([pa.RecordBatch.from_pylist(rows)]) for x in b.to_pylist()]
    assert {x["key"] for x in found} == set(keys) and len(found) == sum(k == x for k in keys for x in (f["key"] for f in found))
    assert len(own) > 20 and len(read) <= 3 * len(keys)


# --- op8


def cheapest(patterns, quota, repeats):
    """Least cost among all ways to give the most words, tried out on tiny networks."""
    names = list(patterns)
    options = []
    for p in names:
        size, sources = patterns[p]
        options.append([x for x in itertools.product(range(size * repeats + 1), repeat=len(sources)) if sum(x) <= size * repeats])
    best = None
    for pick in itertools.product(*options):
        used = {}
        for p, x in zip(names, pick, strict=True):
            for s, v in zip(patterns[p][1], x, strict=True):
                used[s] = used.get(s, 0) + v
        if any(v > quota[s] for s, v in used.items()):
            continue
        cost = sum(sum(max(0, sum(x) - k * patterns[p][0]) for k in range(1, repeats)) for p, x in zip(names, pick, strict=True))
        best = max(best or (-1, 0), (sum(used.values()), -cost))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    rng = np.random.default_rng(seed)
    patterns = {"a": (int(rng.integers(1, 4)), ("x",)), "b": (int(rng.integers(1, 4)), ("x", "y")), "c": (int(rng.integers(1, 3)), ("y",))}
    quota = {"x": int(rng.integers(0, 8)), "y": int(rng.integers(0, 8))}
    flow = mixing.route(patterns, quota)
    given = {p: sum(v for (q, _), v in flow.items() if q == p) for p in patterns}
    cost = sum(sum(max(0, given[p] - k * patterns[p][0]) for k in range(1, 2)) for p in patterns)
    assert (sum(flow.values()), -cost) == cheapest(patterns, quota, 2)
    assert all(sum(v for (_, t), v in flow.items() if t == s) <= quota[s] for s in quota)


def test_targets_by_dealing_again_and_again():
    rng = np.random.default_rng(8)
    for _ in range(50):
        sizes = {f"s{i}": int(rng.integers(0, 1000)) for i in range(int(rng.integers(1, 7)))} | ({None: 5} if rng.integers(2) else {})
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
        for _ in range(500):
            total = sum(weight[s] for s in open_)
            if left < 1e-9 or not open_:
                break
            give, left = left, 0.0
            for s in sorted(open_, key=str):
                target[s] += give * weight[s] / total
                if target[s] >= 2 * sizes[s]:
                    left += target[s] - 2 * sizes[s]
                    target[s] = 2.0 * sizes[s]
                    open_.discard(s)
        got = mixing.quotas(sizes)
        assert all(got[s] == pytest.approx(target[s], abs=1e-6) for s in order)


def test_mix_of_overlapping_sources(spark):
    docs = [(i, ["x"] if i % 3 == 0 else ["x", "y"] if i % 3 == 1 else [None], 10 + i % 7) for i in range(300)]
    sizes = spark.createDataFrame(docs, "doc_id long, sources array<string>, size long").withColumn("p", mixing.key(F.col("sources"))).withColumn("h", mixing.seeded(F.col("doc_id")))
    cuts, targets = mixing.plan(sizes)
    taken = sizes.join(cuts, "p").select("doc_id", "size", "sources", mixing.taken().alias("taken")).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in taken)
    t, of = {r.source: r.target for r in targets.collect()}, lambda k: 2 * sum(r.size for r in taken if r.doc_id % 3 == k)
    most = min(t[None], of(2)) + min(t["x"] + t["y"], of(0) + of(1), t["x"] + of(1))  # the least cuts of this network
    assert sum(r.taken for r in taken) == pytest.approx(most, rel=0.01)
    assert mixing.plan(sizes.limit(0))[0].count() == 0


def test_mix_of_many_patterns(spark):
    """Several hundred sources: what is taken comes to each target, but for the part of one bucket."""
    docs = [(i, [f"s{i % 400:03d}"], 5 + i % 11) for i in range(8000)]
    sizes = spark.createDataFrame(docs, "doc_id long, sources array<string>, size long").withColumn("p", mixing.key(F.col("sources"))).withColumn("h", mixing.seeded(F.col("doc_id")))
    cuts, targets = mixing.plan(sizes)
    taken = sizes.join(cuts, "p").select(F.element_at("sources", 1).alias("source"), "size", mixing.taken().alias("taken"))
    got = {r.source: (r.taken, r.most) for r in taken.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()}
    goal = {r.source: r.target for r in targets.collect()}
    assert len(got) == 400 and all(abs(t - goal[s]) <= 1 for s, (t, _) in got.items()) and taken.where("taken > 2 * size or taken < 0").count() == 0


def test_mix_edges(spark, tmp_path):
    rows = [(i, "w " * (i % 5), ["a", "b", None][i % 3]) for i in range(60)] + [(None, "x y", "a"), (7, "dup dup", "b"), (7, "dup dup", "b"), (99, None, "c"), (98, "", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op8_mixing(spark, str(tmp_path))
    out = got.collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.op8_mixing(spark, str(tmp_path)).collect()))


# --- odd tables


@pytest.mark.parametrize("name", ["op1_suffix", "op2_secrets", "op3_langid", "op7_toxicity", "op8_mixing", "op9_bpe", "op10_simhash"])
def test_documents_with_nulls_repeats_and_clashing_columns(spark, tmp_path, name):
    """One row out for each row in, whatever other columns are called; the same from the bare table; none from an empty one."""
    rows = [(i % 9, f"text {i % 4} of some words and more " * (i % 3), ["en", "fr", None][i % 3], ["a", None][i % 2]) for i in range(40)] + [(None, None, None, None), (None, "x y z", "en", "a"), (50, None, "fr", "b"), (51, "", None, "b")]
    kind = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, kind)
    clash = docs.select("*", *[F.lit(7).alias(c) for c in ("size", "h", "p", "score", "held_out", "fp", "spans", "doc", "found", "ids", "n", "component_id", "target")])
    labels = spark.createDataFrame([(i, i % 2, 3) for i in range(9)] + [(None, 1, 3), (3, None, 3)], "doc_id long, toxic int, score int")
    found = {}
    for folder, df in (("bare", docs), ("clash", clash), ("empty", clash.limit(0))):
        df.write.parquet(str(tmp_path / folder / "documents.parquet"))
        labels.write.parquet(str(tmp_path / folder / "labels.parquet"))
        found[folder] = sorted(map(str, queries.QUERIES[name](spark, str(tmp_path / folder)).collect()))
    assert found["bare"] == found["clash"] and len(found["bare"]) == len(rows) and found["empty"] == []


@pytest.mark.parametrize("name", ["op4_embeddings", "op5_warc", "op6_topk"])
def test_other_tables_with_nulls_repeats_and_clashing_columns(spark, tmp_path, name):
    vectors = spark.createDataFrame([(i % 5 * 100, [1.0, float(i % 4)], i % 2) for i in range(24)] + [(None, [1.0, 2.0], 1), (7, None, 1), (8, [2.0, 1.0], None)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(i % 6, f"http://h{i % 3}.example/", "<p>same</p>" * (i % 2)) for i in range(20)] + [(None, None, None), (9, "", "x")], "page_id long, url string, html string")
    found = {}
    for folder, more in (("bare", False), ("clash", True), ("empty", True)):
        for table, df in (("embeddings", vectors), ("pages", pages)):
            df = df.select("*", *[F.lit(7).alias(c) for c in ("key", "file", "start", "n", "m", "fs", "rep", "c", "sub", "kind", "vector", "digest", "first")]) if more else df
            (df.limit(0) if folder == "empty" else df).write.parquet(str(tmp_path / folder / f"{table}.parquet"))
        found[folder] = sorted(map(str, queries.QUERIES[name](spark, str(tmp_path / folder)).collect()))
    assert found["bare"] == found["clash"] and found["bare"] and found["empty"] == []
    assert name == "op6_topk" or len(found["bare"]) == (vectors if name == "op4_embeddings" else pages).count()


# --- all with SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'") if f.endswith(".parquet") else None
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    plain = lambda r: [float(f"{x:.9g}") if isinstance(x, float) else x for x in r]
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(queries.SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted((plain([r[i] for i in at]) for r in found.fetchall()), key=repr)
