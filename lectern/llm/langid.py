"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Each text's UTF-8 bytes are read in segments of ``SEGMENT``, both ways; every position gets a
probability for each language from the two hidden states there, and a document's probabilities are
the mean over all its positions. Segments make the work linear and let thousands of them, from texts
of any length, move through the recurrence together.

It learns from a bounded sample: about ``SAMPLE`` documents of each language, chosen by a hash of the
id, of a longer one ``LONGEST`` characters from a seeded place on, and ``PER_TEXT`` stretches of
``STRETCH`` bytes of each. Rows that share an id count once. More than ``MOST`` languages are an error.

Defined results: null text, and text without a letter, is ``und`` with score 0; so is all text when
there is nothing to learn from; rows with null id or null language are never learned from; repeated
rows give repeated rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HIDDEN, SEGMENT, TOGETHER = 8, 256, 2048
SAMPLE, LONGEST, PER_TEXT, STRETCH, MOST, SEED = 150, 20_000, 4, 64, 200, 23
STEPS, BATCH, RATE = 160, 192, 0.02
LETTER = regex.compile(r"\p{L}")
DIRECTIONS = ("f", "b")


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


class Network:
    """Per direction: byte table ``W`` (256, 3H), recurrences ``U`` (H, 2H) and ``V`` (H, H), output ``O`` (H, L)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng, self.labels, self.hidden = np.random.default_rng(seed), labels, hidden
        self.p = {"c": np.zeros(len(labels), np.float32)}
        for d in DIRECTIONS:
            for name, shape, size in (("W", (256, 3 * hidden), 0.3), ("U", (hidden, 2 * hidden), 0.3), ("V", (hidden, hidden), 0.3), ("O", (hidden, len(labels)), 0.3)):
                self.p[name + d] = (rng.standard_normal(shape) * size).astype(np.float32)

    def states(self, x: np.ndarray, d: str, valid: np.ndarray | None = None, keep: bool = False):
        """Hidden states (T, B, H) of bytes ``x`` (T, B); the backward direction starts at the end, after any padding."""
        w, u, v, n = self.p["W" + d], self.p["U" + d], self.p["V" + d], self.hidden
        steps, many = x.shape
        h, out, kept = np.zeros((many, n), np.float32), np.empty((steps, many, n), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = w[x[t]]
            zr = np.tanh((a[:, : 2 * n] + h @ u) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[:, :n], zr[:, n:]
            rh = r * h
            m = np.tanh(a[:, 2 * n :] + rh @ v)
            if keep:
                kept[t] = (h, z, r, rh, m)
            h = m + z * (h - m)
            if valid is not None:
                h *= valid[t][:, None]
            out[t] = h
        return out, kept

    def positions(self, x: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (T, B, L) at every position."""
        z = self.states(x, "f")[0] @ self.p["Of"]
        z += self.states(x, "b", valid)[0] @ self.p["Ob"]
        z += self.p["c"]
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        n, (steps, many) = self.hidden, x.shape
        runs = {d: self.states(x, d, keep=True) for d in DIRECTIONS}
        z = sum(runs[d][0] @ self.p["O" + d] for d in DIRECTIONS) + self.p["c"]
        z -= z.max(axis=2, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=2, keepdims=True)
        loss = -float(np.log(q[:, np.arange(many), y] + 1e-9).mean())
        q[:, np.arange(many), y] -= 1
        q /= steps * many
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = q.sum(axis=(0, 1))
        for d in DIRECTIONS:
            out, kept = runs[d]
            u, v = self.p["U" + d], self.p["V" + d]
            g["O" + d] = np.tensordot(out, q, ([0, 1], [0, 1]))
            from_out, dh = q @ self.p["O" + d].T, np.zeros((many, n), np.float32)
            da = np.empty((steps, many, 3 * n), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, rh, m = kept[t]
                dh = dh + from_out[t]
                dm = dh * (1 - z) * (1 - m * m)
                drh = dm @ v.T
                dz, dr = dh * (h - m) * z * (1 - z), drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                g["U" + d] += h.T @ dzr
                g["V" + d] += rh.T @ dm
                da[t, :, : 2 * n], da[t, :, 2 * n :] = dzr, dm
                dh = dh * z + drh * r + dzr @ u.T
            order = np.argsort(x, axis=None, kind="stable")
            flat, rows = x.reshape(-1)[order], da.reshape(-1, 3 * n)[order]
            starts = np.flatnonzero(np.diff(flat.astype(np.int16), prepend=-1))
            g["W" + d][flat[starts]] = np.add.reduceat(rows, starts, axis=0)
        return loss, g

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its pooled probability."""
        raw = [(t or "").encode("utf-8", "surrogatepass") if t and LETTER.search(t) else b"" for t in texts]
        if not self.labels or not any(raw):
            return ["und"] * len(texts), np.zeros(len(texts))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        cuts = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(raw)), cuts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start, left = np.repeat(np.cumsum(size) - size, cuts) + nth * SEGMENT, np.minimum(SEGMENT, np.repeat(size, cuts) - nth * SEGMENT)
        order = np.argsort(left, kind="stable")  # short segments go together
        buffer, pool = np.frombuffer(b"".join(raw) + bytes(SEGMENT), np.uint8), np.zeros((len(raw), len(self.labels)))
        for at in range(0, len(doc), TOGETHER):
            own = order[at : at + TOGETHER]
            steps = np.arange(int(left[own].max()))[:, None]
            valid = (steps < left[own]).astype(np.float32)
            prob = self.positions(buffer[start[own] + steps], valid)
            np.add.at(pool, doc[own], np.einsum("tbl,tb->bl", prob, valid))
        best, some = pool.argmax(axis=1), size > 0
        score = np.where(some, pool[np.arange(len(raw)), best] / np.maximum(size, 1), 0.0)
        return [self.labels[i] if s else "und" for i, s in zip(best.tolist(), some.tolist(), strict=True)], np.clip(score, 0, 1)


def fit(texts: list[str], languages: list[str], steps: int = STEPS) -> Network:
    net = Network(sorted(set(languages)))
    rng, place = np.random.default_rng(SEED), {s: i for i, s in enumerate(net.labels)}
    stretches: list[list[np.ndarray]] = [[] for _ in net.labels]
    for text, language in zip(texts, languages, strict=True):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for _ in range(PER_TEXT if len(raw) else 0):
            at = int(rng.integers(0, max(1, len(raw) - STRETCH + 1)))
            stretches[place[language]].append(np.resize(raw[at : at + STRETCH], STRETCH))
    have = [i for i, s in enumerate(stretches) if s]
    if len(have) < 1:
        return Network([])
    sets = {i: np.stack(stretches[i]) for i in have}
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        y = np.resize(have, max(BATCH, 24 * len(have)))  # as many of each language
        x = np.stack([sets[i][rng.integers(len(sets[i]))] for i in y.tolist()], axis=1)
        _, grads = net.gradients(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * np.float32(min(1.0, 1 / max(norm, 1e-9)))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.98 * second[k] + 0.02 * g * g
            rate = RATE * (1 - step / (steps + 1)) ** 0.5
            net.p[k] = (net.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on ``docs(doc_id, text, lang)`` but for held-out ids; counts by language first, then a hashed sample."""
    usable = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out("doc_id"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().limit(MOST + 1).collect()}
    if len(counts) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not counts:
        return Network([])
    share = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    most = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, sample / n)])
    # however often an id is repeated, one text of it comes to the driver for each language
    at = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.greatest(F.length("text") - LONGEST + 1, F.lit(1))).cast("int") + 1
    chosen = usable.where(share < F.element_at(most, F.col("lang"))).select("doc_id", "lang", F.substring("text", at, F.lit(LONGEST)).alias("text"))
    rows = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", "text").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit([r[2] for r in rows], [r[1] for r in rows])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in chain.from_iterable(map(common.slices, batches)):
            labels, scores = shared.value.label(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(run), "doc_id long, lang_pred string, score double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = learn(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return predict(common.table(spark, sf_dir, "documents", "doc_id", "text"), net).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
