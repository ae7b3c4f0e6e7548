"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding.

Text is cut at added tokens, then by the vocabulary's word pattern. The symbols of one piece sit in
the leaves of a tree whose nodes hold the lowest ``(rank, position)`` below them: the root names the
leftmost lowest-rank merge, a merge updates three leaves in logarithmic time, and encoding ends when
the root holds no rank. The trees of many short pieces are worked in step, one row of an array each;
a long piece has a tree of its own. Recent short pieces are remembered in a table of bounded size.

Defined results: null text counts as empty (no ids); repeated rows give repeated rows; texts of any
length are encoded whole, in time n log n even where a text is one unbroken piece.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.json"
#: White space as Unicode defines it; Python's own class also holds four control characters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MASK = (1 << 64) - 1
#: Remembered pieces of a worker; characters of text encoded at a time; bytes of a piece that joins a common tree.
CACHE, BLOCK, SHORT = 200_000, 1 << 20, 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and added tokens of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids, back = model["vocab"], {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(back[c] for c in s) for s, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.leaf = [ids[c] for c in letters]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.leaves = np.array(self.leaf, np.int32)
        self.result = np.zeros(len(model["merges"]), np.int32)
        self.keys, self.ranks = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, np.int32)
        for (a, b), (rank, made) in self.merge.items():
            self.result[rank] = made
            slot = (((a << 20 | b) * 0x9E3779B97F4A7C15 & MASK) >> 43) & (len(self.keys) - 1)
            while self.keys[slot] >= 0:
                slot = slot + 1 & (len(self.keys) - 1)
            self.keys[slot], self.ranks[slot] = a << 20 | b, rank
        self.pieces = regex.compile(PIECES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece of any length: leaf ``i`` holds ``rank * size + i``, in 8 bytes."""
        ids = [self.leaf[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        merge, size = self.merge, 1 << (n - 2).bit_length() if n > 2 else 1
        none = len(self.result) * size
        first = np.array(ids, np.int32)
        rank = self._pair(first[:-1], first[1:]).astype(np.int64)
        level = np.full(size, none, np.int64)
        level[: n - 1] = np.where(rank < len(self.result), rank * size + np.arange(n - 1), none)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = array("q", np.concatenate([np.full(1, none, np.int64), *levels[::-1]]).tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                best = min(tree[at], tree[at ^ 1])
                at >>= 1
                if tree[at] == best:
                    break
                tree[at] = best

        while tree[1] < none:
            i = tree[1] % size
            j = after[i]
            ids[i] = merge[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = k = after[j]
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
            put(i, m[0] * size + i if k < n and (m := merge.get((ids[i], ids[k]))) else none)
            p = before[i]
            if p >= 0:
                put(p, m[0] * size + p if (m := merge.get((ids[p], ids[i]))) else none)
        return [x for x in ids if x >= 0]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``none`` where they don't merge."""
        key = a.astype(np.int64) << 20 | b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64) & (len(self.keys) - 1)
        out, todo = np.full(len(key), len(self.result), np.int32), np.arange(len(key))
        while len(todo):
            got = self.keys[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
            slot[todo] = slot[todo] + 1 & (len(self.keys) - 1)
        return out

    def _in_step(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pieces of 2 to ``size`` bytes, their trees side by side."""
        n, none, bits = len(pieces), len(self.result) * size, size.bit_length() - 1
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, size + 1), -1, np.int32)
        ids[np.arange(size + 1) < length[:, None]] = self.leaves[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int16), (n, 1))
        tree = np.full((n, 2 * size), none, np.int32)
        row, at = np.nonzero(ids[:, 1:] >= 0)
        rank = self._pair(ids[row, at], ids[row, at + 1])
        tree[row, size + at] = np.where(rank < len(self.result), rank * size + at, none)
        for level in range(bits - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            root = tree[live, 1]
            i = root & (size - 1)
            j = after[live, i].astype(np.int64)
            k = after[live, j].astype(np.int64)
            p = before[live, i].astype(np.int64)
            new = self.result[root >> bits]
            ids[live, i], ids[live, j], after[live, i], before[live, k] = new, -1, k, i
            right, left = ids[live, k], ids[live, p]  # a place past the end, or before the start, holds -1
            right[k >= length[live]] = -1
            left[p < 0] = -1
            m = len(live)
            rank = self._pair(np.concatenate([new, left]), np.concatenate([right, new]))
            ok = np.concatenate([right, left]) >= 0
            pos = np.concatenate([i, np.where(p < 0, i, p)])
            value = np.where(ok & (rank < len(self.result)), rank * size + pos, none)
            tree[live, size + np.minimum(j, size - 1)] = none
            tree[live, size + i] = value[:m]
            has = p >= 0
            tree[live[has], size + p[has]] = value[m:][has]
            rows, node = np.concatenate([live, live, live]), size + np.concatenate([np.minimum(j, size - 1), pos])
            for _ in range(bits):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < none]
        kept = ids >= 0
        packed, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces."""
        raw = [s.encode("utf-8", "surrogatepass") for s in pieces]
        out, classes = {}, {8: [], 16: [], 32: [], 64: []}
        for s, b in zip(pieces, raw, strict=True):
            if 2 <= len(b) <= SHORT:
                classes[max(8, 1 << (len(b) - 1).bit_length())].append((s, b))
            else:
                out[s] = np.array(self.piece(b), "<u4").tobytes()
        for size, group in classes.items():
            for at in range(0, len(group), 1 << 14):
                names, values = zip(*group[at : at + (1 << 14)], strict=True)
                out.update(zip(names, self._in_step(values, size), strict=True))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BLOCK):
                chars += len(texts[end])
                end += 1
            parts = [self.split.split(t) if self.split else [t] for t in texts[at:end]]
            found = [[self.pieces.findall(x) for x in p[::2]] for p in parts]
            if len(self.known) > CACHE:
                self.known.clear()
            self.known.update(self.learn(sorted({x for p in found for f in p for x in f}.difference(self.known))))
            get = self.known.__getitem__
            for p, f in zip(parts, found, strict=True):
                packed = [b"".join(map(get, x)) for x in f]
                for mark, tail in zip(p[1::2], packed[1:], strict=True):
                    packed[0] += self.added[mark].to_bytes(4, "little") + tail
                out.append(packed[0])
            if chars > BLOCK:  # one very long text, perhaps with very long pieces
                self.known.clear()
            at = end
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process and path."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, decoded: bool = True) -> DataFrame:
    """``doc_id, ids`` (packed, see :meth:`Vocabulary.encode_all`) and, if asked, ``decoded`` text; one pass, no shuffle."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        v = vocabulary(path)
        for b in chain.from_iterable(map(common.slices, batches)):
            ids = v.encode_all([t or "" for t in b.column(1).to_pylist()])
            back = [pa.array(map(v.decode, ids), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *back], ["doc_id", "ids", "decoded"][: 2 + len(back)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(run), "doc_id long, ids binary" + ", decoded string" * decoded)


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded_sha256``: packed ids, and the digest of the text that they decode to; the decoded text stays in the worker."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        v = vocabulary(path)
        for b in chain.from_iterable(map(common.slices, batches)):
            ids = v.encode_all([t or "" for t in b.column(1).to_pylist()])
            back = [hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "ids", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(run), "doc_id long, ids binary, decoded_sha256 string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the digests leave the worker, not the ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        v = vocabulary(path)
        for b in chain.from_iterable(map(common.slices, batches)):
            all_ids = v.encode_all([t or "" for t in b.column(1).to_pylist()])
            out = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()) for ids in all_ids]
            n, x, y = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"))
