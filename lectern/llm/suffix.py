"""Suffix-array dedup: bytes covered by a string of ``SPAN`` bytes that also starts earlier in the corpus.

Sorting every suffix of a corpus together isn't needed to find the repeats of one length. Each window
of ``SPAN`` bytes has an anchor, the leftmost of its ``GRAM``-byte strings with the least hash, at a
place that the window's content alone decides: equal windows have equal anchors, equally far in.
Windows next to each other mostly share an anchor, so a stretch of windows is one row (anchor hash,
stretch hash, place). Rows of one anchor meet:

* stretches with equal hashes repeat the first of them, if their bytes agree: within a batch they are
  compared there; else stretches that follow each other in both documents are joined to runs, cut to
  ``RUN`` bytes, and the bytes of a run and of what it repeats meet in a later stage;
* stretches that differ, but share the anchor, are cut out of their documents and their suffixes are
  sorted: a mergesort whose comparisons find the common extension of two suffixes by binary search
  over prefix polynomial hashes. Neighbours that agree in ``SPAN`` bytes, checked byte by byte, are
  repeats, but for the first.

No byte is removed on a hash alone. Where the bytes of a run disagree, all stretches of its anchors are
sorted again without regard to their hashes.

Repeats within a batch are settled before anything is shuffled. An anchor with more than ``TILE``
different stretches (the edges of a very common passage) is sorted in tiles; what is first in its tile
then meets the other tiles' by the bytes of its window. Anchors that many documents share, as a sample
of about ``SAMPLE`` documents tells, are dealt by anchor and stretch from the start, so no task holds all
their rows; the sample decides where rows go, never what is compared.

Texts are bytes throughout. A long one is hashed in blocks of about ``BLOCK`` windows and cut out of
parts of ``PART`` bytes, so memory doesn't grow with a text beyond the bytes of the row itself.

Defined results: null text is empty; rows that share an id are one document and all get its result; a
document without an id takes no part and loses nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN, GRAM, TILE = 100, 32, 512
#: Windows of text hashed together, windows sorted together, and stretches whose copies are looked for together.
BLOCK, WINDOWS, TOGETHER = 1 << 19, 1 << 18, 1 << 19
#: Bytes of a run that are compared at once, and of a part of a text.
RUN, PART = 4096, 1 << 20
#: Documents in the sample for hot anchors, different stretches there that make an anchor hot, and parts that a hot run's bytes are dealt into.
SAMPLE, HOT, SALT = 4096, 16, 256
BASE = 0x9E3779B97F4A7C15
LOW = np.uint64(127)
#: ``kind`` 0: a stretch; 1: windows ``p`` to ``p + more`` that repeat earlier ones; 2: a stretch of a hot anchor.
ROW = pa.schema([("ah", pa.int64()), ("ch", pa.int64()), ("doc", pa.int64()), ("p", pa.int64()), ("off", pa.int32()), ("more", pa.int32()), ("kind", pa.int32())])

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        n = max(n, BLOCK + (1 << 16))
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = tuple(both)
    return _powers[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Prefix polynomial hashes of a byte string: any substring's hash from two of them."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.power, self.inverse = _table(len(data) + 1, base)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes, up to ``most``, the suffixes at ``a`` and ``b`` have in common."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        for _ in range(most.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of windows that share an anchor, in texts laid end to end: anchor hash, stretch hash, text, first window, anchor's place in it, more windows."""
    wide, n = span - gram + 1, len(data)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < span:
        return none
    h = Hashes(data)
    g = _mix((h.prefix[gram:] - h.prefix[:-gram]) * h.inverse[: n - gram + 1])
    count = len(g)
    blocks = -(-count // wide) + 1
    keys = np.full(blocks * wide, np.iinfo(np.uint64).max)
    keys[:count] = g & ~LOW
    keys = (keys.reshape(blocks, wide) & ~LOW) | np.arange(wide, dtype=np.uint64)
    ahead = np.minimum.accumulate(keys, axis=1).reshape(-1)
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - span + 1
    left, right = behind[:windows], ahead[wide - 1 : wide - 1 + windows]
    first = np.arange(windows)
    begin = first // wide * wide
    later = ((right & ~LOW) < (left & ~LOW)) & (first != begin)
    at = begin + np.where(later, wide + (right & LOW).astype(np.int64), (left & LOW).astype(np.int64))
    long = sizes >= span
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - span + 1, -1)
    p = np.flatnonzero(np.cumsum(inside[:windows]) > 0)
    if not len(p):
        return none
    at = at[p]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1) | np.isin(p, starts))
    own = np.searchsorted(starts, p[new], "right") - 1  # of texts with one start all but the last are empty
    more = np.diff(np.append(new, len(p))) - 1
    q, lo = at[new], p[new]
    stretch = _mix(h.of(lo, more + span) ^ _mix((q - lo).astype(np.uint64) << np.uint64(8) | more.astype(np.uint64)))
    return g[q], stretch, own, lo - starts[own], q - lo, more


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows that touch or overlap become one; input in any order."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.flatnonzero(np.diff(doc, prepend=doc[0]) != 0)
    group = np.zeros(len(doc), np.int64)
    group[new] = 1
    group = np.cumsum(group)
    top = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    start = np.ones(len(doc), bool)
    start[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1] + 1)
    at = np.flatnonzero(start)
    return doc[at], lo[at], top[np.append(at[1:], len(doc)) - 1]


def _rows(ah, ch, doc, p, off, more, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), t) for x, t in zip((ah, ch, doc, p, off, more, kind), ROW.types, strict=True)], schema=ROW)


def _pieces(texts: pa.Array, windows: int):
    """``row, first byte, bytes`` of texts in pieces that overlap, so that each window is whole in one of them."""
    for row in range(len(texts)):
        if texts[row].is_valid:
            raw = np.frombuffer(texts[row].as_buffer(), np.uint8)
            for at in range(0, max(1, len(raw) - SPAN + 1), windows):
                yield row, at, raw[at : at + windows + SPAN - 1]


def joined(doc: np.ndarray, p: np.ndarray, more: np.ndarray, hdoc: np.ndarray, hp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches beside what they repeat, as runs that go on in both: the run of each, then document, first window, more windows, and what the run repeats."""
    order = np.lexsort((p, doc))
    doc, p, more, hdoc, hp = (x[order] for x in (doc, p, more, hdoc, hp))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hdoc[1:] != hdoc[:-1]) | (p[1:] - hp[1:] != p[:-1] - hp[:-1]) | (p[1:] != p[:-1] + more[:-1] + 1)
    at, run = np.flatnonzero(new), np.zeros(len(doc), np.int64)
    run[order] = np.cumsum(new) - 1
    last = np.append(at[1:], len(doc)) - 1
    return run, doc[at], p[at], p[last] + more[last] - p[at] if len(at) else p, hdoc[at], hp[at]


def settled(data: list[bytes], block: np.ndarray, at: np.ndarray, more: np.ndarray, hblock: np.ndarray, hat: np.ndarray) -> np.ndarray:
    """Whether stretches at places in blocks of bytes have the bytes of others; long runs are compared at once."""
    run, b, lo, n, hb, hlo = joined(block, at, more, hblock, hat)
    same = [data[i][x : x + k] == data[j][y : y + k] for i, x, j, y, k in zip(b.tolist(), lo.tolist(), hb.tolist(), hlo.tolist(), (n + SPAN).tolist(), strict=True)]
    return np.array(same, bool)[run] if len(same) else np.zeros(len(run), bool)


def _scan(hot: np.ndarray, windows: int, bits: int):
    """Stretches of all texts; of those with equal hashes and bytes within a batch only the first."""

    def settle(found: list[tuple], data: list[bytes]):
        block, at, ah, ch, doc, p, off, more = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((p, doc, ch, ah))
        block, at, ah, ch, doc, p, off, more = (x[order] for x in (block, at, ah, ch, doc, p, off, more))
        first = np.ones(len(ah), bool)
        first[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(ah) else np.zeros(0, np.int64)
        twin = ~first & (doc == doc[head]) & (p == p[head])  # of rows that share an id
        again = np.flatnonzero(~first & ~twin)
        again = again[settled(data, block[again], at[again], more[again], block[head[again]], at[head[again]])]
        keep = ~twin
        keep[again] = False
        d, lo, hi = _runs(doc[again], p[again], p[again] + more[again])
        yield _rows(ah[keep], ch[keep], doc[keep], p[keep], off[keep], more[keep], np.isin(ah[keep], hot).astype(np.int32) * 2)
        if len(d):  # dealt out by a hash of their place
            key = _mix((d * 1_000_003 + lo).astype(np.uint64)).view(np.int64)
            yield _rows(key, key, d, lo, np.zeros(len(d)), (hi - lo).clip(0, (1 << 31) - 1), np.ones(len(d)))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            docs, some = np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())
            found, data, count, size = [], [], 0, 0
            held: list[tuple[int, int, np.ndarray]] = []
            for one in chain(_pieces(texts, windows // 2), [None]):
                if one is not None and some[one[0]] and len(one[2]) >= SPAN:
                    held.append(one)
                    size += len(one[2])
                if held and (one is None or size >= windows):
                    row, base = np.array([x[0] for x in held]), np.array([x[1] for x in held], np.int64)
                    sizes = np.array([len(x[2]) for x in held], np.int64)
                    starts = np.cumsum(sizes) - sizes
                    data.append(b"".join(x[2] for x in held))
                    ah, ch, own, p, off, more = anchors(np.frombuffer(data[-1], np.uint8), starts, sizes)
                    ch = ch & np.uint64((1 << bits) - 1)
                    found.append((np.full(len(ah), len(data) - 1), starts[own] + p, ah.view(np.int64), ch.view(np.int64), docs[row[own]], base[own] + p, off, more))
                    count += len(ah)
                    held, size = [], 0
                if found and (one is None or count >= TOGETHER):
                    yield from settle(found, data)
                    found, data, count = [], [], 0

    return run


#: ``hdoc``, ``hp``: the place that windows ``p`` to ``p + more`` repeat; ``tile`` not null: a stretch to compare within its anchor;
#: neither: windows that are known to repeat earlier ones. ``many``: the anchor has more tiles than one.
MET = "ah long, tile long, doc long, p long, off int, more int, many boolean, hdoc long, hp long"


def _meet(hot: dict[int, int], tile: int):
    """Rows sorted by anchor, stretch and place: repeats of whole stretches, and stretches to compare.

    Of a cold anchor stretches are held back until a second or, past a tile, ``tile`` of them are there.
    """

    def sent(rows: list[np.ndarray], n: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        ah, doc, p, off, more = rows
        none = pa.nulls(len(ah), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(ah, pa.int64()), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(p, pa.int64()), pa.array(off.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(many, pa.bool_()), none, none],
            ["ah", "tile", "doc", "p", "off", "more", "many", "hdoc", "hp"],
        )

    def repeated(doc, p, more, hdoc, hp, known: np.ndarray) -> pa.RecordBatch:
        n = len(doc)
        none, zero = pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))
        return pa.RecordBatch.from_arrays(
            [none, none, pa.array(doc, pa.int64()), pa.array(p, pa.int64()), zero, pa.array(more.astype(np.int32)), pa.array(np.zeros(n, bool)), pa.array(hdoc, pa.int64(), mask=known), pa.array(hp, pa.int64(), mask=known)],
            ["ah", "tile", "doc", "p", "off", "more", "many", "hdoc", "hp"],
        )

    def run(batches):
        head = None  # of the current stretch: ah, ch, doc, p
        wait = [np.zeros(0, np.int64)] * 5  # stretches held back, all of one anchor
        nth = 0  # that anchor's stretches so far, if more than a tile
        for b in chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            lead = [np.zeros(0, np.int64)] * 5
            if b is not None:
                ah, ch, doc, p, off, more, kind = (np.asarray(b.column(i)) for i in range(7))
                done = kind == 1
                first = np.ones(len(ah), bool)
                first[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1]) | done[1:] | done[:-1]
                first[0] = head is None or done[0] or head[0] != ah[0] or head[1] != ch[0]
                at = np.maximum.accumulate(np.where(first, np.arange(len(ah)), -1))
                hd, hp = np.where(at >= 0, doc[at], head[2] if head else 0), np.where(at >= 0, p[at], head[3] if head else 0)
                again = done | (~first & ((doc != hd) | (p != hp)))
                if again.any():
                    yield repeated(doc[again], p[again], more[again], hd[again], hp[again], done[again])
                if not done[-1]:
                    head = (ah[-1], ch[-1], int(hd[-1]), int(hp[-1]))
                spread = np.flatnonzero(first & (kind == 2))
                if len(spread):
                    tiles = np.array([hot.get(x, 1) for x in ah[spread].tolist()], np.int64)
                    yield sent([x[spread].astype(np.int64) for x in (ah, doc, p, off, more)], (_mix(ch[spread].view(np.uint64)) >> np.uint64(1)).astype(np.int64) % tiles, tiles > 1)
                lead = [x[first & (kind == 0)].astype(np.int64) for x in (ah, doc, p, off, more)]
            rows = [np.concatenate(x) for x in zip(wait, lead, strict=True)]
            k = rows[0]
            if b is not None and not len(lead[0]):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(k)))
            before = np.zeros(len(start), np.int64)  # stretches of the group's anchor that are sent already
            if len(k) and nth and last == k[0]:
                before[0] = nth
            total = before + size
            hold = np.zeros(len(start), bool)
            if b is not None:
                hold[-1] = total[-1] <= tile
            group = np.repeat(np.arange(len(start)), size)
            send = (total > 1)[group] & ~hold[group]
            place = np.arange(len(k)) - start[group] + before[group]
            if send.any():
                yield sent([x[send] for x in rows], place[send] // tile, (total > tile)[group][send])
            if b is not None:
                wait = [x[hold[group]] for x in rows]
                last, nth = k[-1], 0 if hold[-1] else int(total[-1])

    return run


RUNS = "doc long, p long, more int, hdoc long, hp long"


def _follow(batches):
    """Repeats sorted by document and place, joined to runs and cut to ``RUN`` bytes."""
    step = RUN - SPAN + 1
    for b in batches:
        _, doc, p, more, hdoc, hp = joined(*(np.asarray(b.column(i)).astype(np.int64) for i in range(5)))
        cuts = more // step + 1
        row = np.repeat(np.arange(len(doc)), cuts)
        nth = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * step
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(p[row] + nth), pa.array(np.minimum(more[row] - nth, step - 1).astype(np.int32)), pa.array(hdoc[row]), pa.array(hp[row] + nth)], ["doc", "p", "more", "hdoc", "hp"])


def merge_order(h: Hashes, data: np.ndarray, bucket: np.ndarray, at: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Order of the suffixes at ``at`` by bucket and content, stable; ``bucket`` ascends on input.

    Bottom-up mergesort, all buckets and runs of a level at once: an element's place in a merged run is
    its place in its own run plus its rank in the other, found by binary search over suffix comparisons.
    """
    n, order = len(at), np.arange(len(at))
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if n else order
    sizes = np.diff(np.append(starts, n))
    begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    run, most = 1, int(sizes.max(initial=0))
    while run < most:
        live = np.flatnonzero(size > run)
        inner = live - begin[live]
        pair = inner // (2 * run) * (2 * run)
        right = inner - pair >= run
        base = begin[live] + pair
        end = np.minimum(begin[live] + size[live], base + 2 * run)
        low = np.where(right, base, base + run)
        high = np.where(right, base + run, np.maximum(end, base + run))
        low, high = np.minimum(low, end), np.minimum(high, end)
        from_ = low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            x, y = at[order[live[todo]]], at[order[mid]]
            same = h.extension(x, y, span)
            equal = same == span
            a, b = data[x + np.minimum(same, span - 1)], data[y + np.minimum(same, span - 1)]
            after = np.where(equal, right[todo], b < a)  # the one at mid goes before this element
            low[todo], high[todo] = np.where(after, mid + 1, low[todo]), np.where(after, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        place = base + (inner - pair - np.where(right, run, 0)) + (low - from_)
        fresh = order.copy()
        fresh[place] = order[live]
        order, run = fresh, 2 * run
    return order


def repeats(data: np.ndarray, group: np.ndarray, off: np.ndarray, start: np.ndarray, more: np.ndarray, doc: np.ndarray, p: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Windows of stretches, by suffix sort: whether each repeats an earlier one; its doc, place, group and start in ``data``."""
    count = more + 1
    row = np.repeat(np.arange(len(more)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at, wdoc, wp = start[row] + nth, doc[row], p[row] + nth
    bucket = group[row] * 256 + (off[row] - nth + 128)
    first = np.lexsort((wp, wdoc, bucket))
    h = Hashes(data)
    order = first[merge_order(h, data, bucket[first], at[first], span)]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(bucket[a] == bucket[b])
    equal = near[h.extension(at[a[near]], at[b[near]], span) == span]
    for k in range(0, len(equal), 1 << 14):  # hashes may agree by chance: the bytes tell
        e = equal[k : k + (1 << 14)]
        wrong = (data[at[a[e]][:, None] + np.arange(span)] != data[at[b[e]][:, None] + np.arange(span)]).any(axis=1)
        if wrong.any():
            for i in np.unique(bucket[a[e[wrong]]]):  # sort such a bucket by its bytes
                own = np.flatnonzero(bucket[order] == i)
                order[own] = sorted(order[own].tolist(), key=lambda x: (data[at[x] : at[x] + span].tobytes(), wdoc[x], wp[x]))
            a, b = order[:-1], order[1:]
            near = np.flatnonzero(bucket[a] == bucket[b])
            equal = np.array([x for x in near.tolist() if data[at[a[x]] : at[a[x]] + span].tobytes() == data[at[b[x]] : at[b[x]] + span].tobytes()], np.int64)
            break
    joined = np.zeros(len(order), bool)
    joined[equal + 1] = True
    lead = np.maximum.accumulate(np.where(joined, 0, np.arange(len(order))))
    again = np.zeros(len(order), bool)
    again[order] = joined & ((wdoc[order] != wdoc[order[lead]]) | (wp[order] != wp[order[lead]]))
    return again, wdoc, wp, group[row], at


#: ``w`` null: windows ``p`` to ``p + more`` repeat earlier ones, or, if ``bad``, they don't though hashes said so; else one window's bytes, first in its tile, to meet the other tiles'.
COMPARED = "w binary, doc long, p long, more int, bad boolean"


def _out(w, doc, p, more, bad) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([w, pa.array(doc, pa.int64()), pa.array(p, pa.int64()), pa.array(np.asarray(more).astype(np.int32)), pa.array(bad, pa.bool_())], ["w", "doc", "p", "more", "bad"])


def _compare(batches):
    """Texts cut out, sorted by ``ASK``: runs against what they repeat, and stretches by suffix sort, a few groups at a time."""

    def settle(t: pa.Table):
        raw = t.column("text").to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ah, tile, doc, p, off, more = (np.asarray(t.column(c)).astype(np.int64) for c in ("a", "b", "doc", "p", "off", "more"))
        group = np.cumsum(np.append(0, (ah[1:] != ah[:-1]) | (tile[1:] != tile[:-1])))
        again, wdoc, wp, wgroup, at = repeats(data, group, off, np.cumsum(sizes) - sizes, more, doc, p)
        d, lo, hi = _runs(wdoc[again], wp[again], wp[again])
        yield _out(pa.nulls(len(d), pa.binary()), d, lo, hi - lo, np.zeros(len(d), bool))
        many = np.zeros(group[-1] + 1, bool)
        many[group] = np.asarray(t.column("many").to_numpy(), bool)
        left, text = np.flatnonzero(~again & many[wgroup]), data.tobytes()
        for k in range(0, len(left), 1 << 16):
            own = left[k : k + (1 << 16)]
            yield _out(pa.array([text[x : x + SPAN] for x in at[own].tolist()], pa.binary()), wdoc[own], wp[own], np.zeros(len(own)), np.zeros(len(own), bool))

    def verify(t: pa.Table, head: tuple):
        """The rows of runs, what they repeat first in each group; ``head`` is the last one before, by its key."""
        keys = [np.asarray(t.column(c)) for c in ("a", "b", "n", "salt")]
        first, texts = np.asarray(t.column("off")) < 0, t.column("text").combine_chunks()
        at = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        known = at >= 0
        for k, h in zip(keys, head[0], strict=True):  # a group whose head is missing is not that of the head before
            known &= k == np.where(at >= 0, k[at], h)
        if head[1] is not None:
            known |= (at < 0) & np.logical_and.reduce([k == h for k, h in zip(keys, head[0], strict=True)])
        heads = pa.concat_arrays([pa.array([head[1]], pa.binary()), texts]).take(pa.array(at + 1))
        same = known & np.asarray(pc.equal(texts, heads).fill_null(False))
        doc, p, more = (np.asarray(t.column(c)) for c in ("doc", "p", "more"))
        own = ~first
        yield _out(pa.nulls(int(own.sum()), pa.binary()), doc[own], p[own], more[own], ~same[own])
        if first.any():
            i = int(np.flatnonzero(first)[-1])
            head = (tuple(int(k[i]) for k in keys), texts[i].as_py())
        return head

    kept: pa.Table | None = None
    head = ((0, 0, -1, 0), None)
    for b in chain(batches, [None]):
        if b is not None:
            now = pa.Table.from_batches([b])
            runs = now.filter(pc.greater_equal(now.column("n"), 0))
            if runs.num_rows:
                head = yield from verify(runs, head)
                now = now.filter(pc.less(now.column("n"), 0))
            kept = now if kept is None else pa.concat_tables([kept, now])
        while kept is not None and kept.num_rows:
            count = np.cumsum(kept.column("more").to_numpy().astype(np.int64) + 1)
            if b is not None and count[-1] < WINDOWS:
                break
            ah, tile = (kept.column(c).to_numpy() for c in ("a", "b"))
            ends = np.flatnonzero((ah[1:] != ah[:-1]) | (tile[1:] != tile[:-1])) + 1
            ends = np.append(ends, kept.num_rows) if b is None else ends  # the last group may go on
            if not len(ends):
                break
            end = int(ends[min(len(ends) - 1, int(np.searchsorted(count[ends - 1], WINDOWS)))])
            yield from settle(kept.slice(0, end))
            kept = kept.slice(end)


def _across(batches):
    """Windows sorted by their bytes and place: all but the first of equal ones repeat it."""
    head = None
    for b in batches:
        w, doc, p = b.column(0), np.asarray(b.column(1)), np.asarray(b.column(2))
        if not len(w):
            continue
        first = np.ones(len(w), bool)
        first[1:] = np.asarray(pc.not_equal(w[1:], w[:-1]))
        first[0] = head is None or head[0] != w[0].as_py()
        at = np.maximum.accumulate(np.where(first, np.arange(len(w)), -1))
        hd, hp = np.where(at >= 0, doc[at], head[1] if head else 0), np.where(at >= 0, p[at], head[2] if head else 0)
        again = (doc != hd) | (p != hp)
        head = (w[-1].as_py(), int(hd[-1]), int(hp[-1]))
        d, lo, hi = _runs(doc[again], p[again], p[again])
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(lo, pa.int64()), pa.array((hi - lo).astype(np.int32))], ["doc", "p", "more"])


#: What is asked of a text and where it goes. ``n`` below 0: a stretch for tile ``b`` of anchor ``a``; else ``n`` bytes
#: that are to be, or (``off`` -1) are, those of document ``a`` at ``b``, in the part ``salt`` of all that should be.
ASK = ("a", "b", "n", "salt", "off", "more", "many", "p")


def _compared(texts: DataFrame, apart: DataFrame, runs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What becomes of stretches ``apart`` and of ``runs``: rows of ``COMPARED`` without windows, and the repeats among the windows of several tiles."""
    part = lambda: F.floor(F.col("p") / PART).cast("long").alias("part")
    no, zero = F.lit(False), F.lit(0)
    asks = apart.select("doc", part(), F.col("ah").alias("a"), F.col("tile").alias("b"), F.lit(-1).alias("n"), zero.alias("salt"), "off", "more", "many", "p")
    if runs is not None:
        salted = runs.select("doc", "p", "more", "hdoc", "hp", (F.col("more") + SPAN).alias("n"), F.pmod(F.xxhash64("doc", "p"), F.lit(SALT)).cast("int").alias("salt"))
        asks = asks.union(salted.select("doc", part(), F.col("hdoc").alias("a"), F.col("hp").alias("b"), "n", "salt", zero.alias("off"), "more", no.alias("many"), "p"))
        heads = salted.select("hdoc", "hp", "n", "more", "salt").distinct().select(F.col("hdoc").alias("doc"), F.col("hp").alias("p"), "n", "more", "salt")
        asks = asks.union(heads.select("doc", part(), F.col("doc").alias("a"), F.col("p").alias("b"), "n", "salt", F.lit(-1).alias("off"), "more", no.alias("many"), "p"))
    size = F.octet_length("text")
    # a part goes on for as many bytes as the longest ask has
    parts = texts.where("text is not null and doc_id is not null").select("doc_id", "text", F.explode(F.sequence(zero, F.floor(F.greatest(size - 1, zero) / PART).cast("int"))).alias("k"))
    pieces = parts.select("doc_id", F.col("k").cast("long").alias("k"), F.substring("text", F.col("k") * PART + 1, F.lit(PART + RUN)).alias("text"))
    # asks are the side that streams past a part: what many documents ask of one is never gathered, and its rows can be split
    held = asks.join(pieces, (F.col("doc") == F.col("doc_id")) & (F.col("part") == F.col("k")))
    asked = F.greatest(F.col("n"), F.col("more") + SPAN)
    cut = held.select(*ASK, "doc", asked.alias("size"), F.substring("text", (F.col("p") - F.col("part") * PART + 1).cast("int"), asked).alias("text"))
    cut = cut.where(F.octet_length("text") == F.col("size")).drop("size")  # what the document doesn't have is left out
    key = ("a", "b", "n", "salt")
    found, _ = common.cut(cut.repartition(*key).sortWithinPartitions(*key, "off", "doc", "p").mapInArrow(_compare, COMPARED), "compared")
    across = found.where("w is not null").select("w", "doc", "p").repartition("w").sortWithinPartitions("w", "doc", "p").mapInArrow(_across, "doc long, p long, more int")
    return found.where("w is null"), across


def _hot(texts: DataFrame, windows: int, tile: int, least: int = HOT) -> dict[int, int]:
    """Anchors with ``least`` different stretches or more in about ``SAMPLE`` documents, and the tiles that all their stretches would fill."""
    every = -(-texts.count() // SAMPLE)
    if not every:
        return {}
    some = texts.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(every)) == 0)
    seen = some.mapInArrow(_scan(np.zeros(0, np.int64), windows, 64), ROW_SQL).where("kind = 0").select("ah", "ch").distinct().groupBy("ah").agg(F.count(F.lit(1)).alias("n"))
    return {r.ah: -(-r.n * every // tile) for r in seen.where(F.col("n") >= least).orderBy(F.desc("n"), "ah").limit(1 << 14).collect()}


ROW_SQL = "ah long, ch long, doc long, p long, off int, more int, kind int"


def removed(docs: DataFrame, windows: int = BLOCK, tile: int = TILE, bits: int = 64, hot: int = HOT) -> DataFrame:
    """``doc, p, more``: windows ``p`` to ``p + more`` of the document also start earlier. A window may come up twice.

    ``bits`` are those of a stretch's hash that are looked at; with few of them collisions can be tested.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    known = _hot(texts, windows, tile, hot)
    scan = lambda: texts.mapInArrow(_scan(np.array(sorted(known), np.int64), windows, bits), ROW_SQL)
    spread = F.when(F.col("kind") == 2, F.xxhash64("ah", "ch")).otherwise(F.col("ah"))
    met, _ = common.cut(scan().repartition(spread).sortWithinPartitions("ah", "ch", "doc", "p").mapInArrow(_meet(known, tile), MET), "met")
    # written, as runs end where batches do: made twice, what is asked of the repeated text could be cut elsewhere than what it repeats
    runs, _ = common.cut(met.where("hdoc is not null").select("doc", "p", "more", "hdoc", "hp").repartition("doc").sortWithinPartitions("doc", "p").mapInArrow(_follow, RUNS), "runs")
    found, across = _compared(texts, met.where("tile is not null"), runs)
    out = met.where("tile is null and hdoc is null").select("doc", "p", "more").union(found.where("not bad").select("doc", "p", "more")).union(across)
    if found.where("bad").limit(1).count():  # hashes of different stretches are equal
        bad = found.where("bad").select(F.col("doc").alias("d"), F.col("p").alias("x"), F.col("more").alias("y"))
        rows = scan().where("kind <> 1")
        odd = rows.join(bad, (F.col("doc") == F.col("d")) & (F.col("p") <= F.col("x") + F.col("y")) & (F.col("x") <= F.col("p") + F.col("more"))).select(common.other("ah").alias("o")).distinct()
        every = texts.mapInArrow(_scan(np.zeros(0, np.int64), windows, 64), ROW_SQL)
        rows, _ = common.cut(every.where("kind = 0").withColumn("o", common.other("ah")).join(odd, "o"), "odd")
        tiles = rows.groupBy("ah").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("t")).select(common.other("ah").alias("o"), "t")
        apart = rows.join(tiles, "o").select("ah", F.pmod(F.xxhash64("doc", "p"), F.col("t")).alias("tile"), "doc", "p", "off", "more", (F.col("t") > 1).alias("many"))
        found, across = _compared(texts, apart, None)
        out = out.union(every.where("kind = 1").select("doc", "p", "more")).union(found.select("doc", "p", "more")).union(across)
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges (end exclusive) that touch or overlap, as maximal runs in order."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
    return lo[new], top[np.append(new[1:], len(lo)) - 1]


def _apply(with_text: bool):
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                lo = hi = np.zeros(0, np.int64)
                if spans.is_valid and len(spans.values):
                    lo = np.asarray(spans.values.field(0)).astype(np.int64)
                    lo, hi = merged(lo, np.minimum(lo + np.asarray(spans.values.field(1)).astype(np.int64) + SPAN, len(raw)))
                digest, pieces, at = hashlib.sha256(), [], 0
                for x, y in zip([*lo.tolist(), len(raw)], [*hi.tolist(), len(raw)], strict=True):
                    digest.update(raw[at:x])
                    if with_text:
                        pieces.append(raw[at:x])
                    at = y
                out.append((len(raw), int((hi - lo).sum()), len(lo), digest.hexdigest(), *([b"".join(pieces)] if with_text else [])))
            cols = list(zip(*out, strict=True)) or [()] * (4 + with_text)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return run


def dedup(docs: DataFrame, with_text: bool = False, **parameters) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, the bytes that are left, ``kept``; ``parameters`` are those of :func:`removed`."""
    spans = removed(docs, **parameters).groupBy("doc").agg(F.collect_list(F.struct("p", "more")).alias("spans"))
    both = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_apply(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents", "doc_id", "text"))
