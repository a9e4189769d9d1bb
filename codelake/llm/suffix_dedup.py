"""Removal of repeated byte strings by a sorted suffix table.

A byte goes if a string of `SPAN` bytes that covers it also starts anywhere else, in the same document or another.
Sorting every suffix would move each byte hundreds of times, so the suffixes sorted are those at anchors: the place of
the smallest hash of `LEAD` bytes among those in a window of SPAN bytes. Equal windows have the same anchor in the
same place, so windows can be equal only if their anchors' suffixes begin alike, and no repeat is lost.

1. Each document's windows fall into runs with a common anchor. Anchors whose leading bytes (by hash) stand nowhere
   else are done. Runs of one document with equal bytes confirm each other; one of them goes on.
2. Neighbouring runs that are left form segments, cut where an anchor's hash says so, and so at the same places of equal
   texts. Segments are range-partitioned by their suffixes with sampled splitters, each bucket is sorted by a multikey
   quicksort over eight-byte symbols, and neighbours are compared byte by byte, those on either side of a bucket's edge
   included. That confirms whole documents and passages at one comparison each.
3. Runs that segments left open, and one of each class of equal runs that could answer them, are sorted one by one in the
   same way. Neighbours that share windows confirm them, and bound how far any other suffix agrees to the right. The
   same sort of the reversed bytes before the anchors bounds the agreement to the left.
4. Windows within these bounds that are still open, and may repeat by a count of their hashes, are sorted themselves;
   those equal to a neighbour repeat.

So hashes only say what cannot repeat; what repeats is decided by comparing bytes in sorted order.

Defined results: null texts are empty; texts shorter than SPAN keep every byte; repeated rows repeat each other and so
lose all windows; strings at the very start or end of a text count like others; very long texts are worked through in
slabs that overlap; an empty table gives an empty table; other columns are not read. Rows are told apart by a 64-bit
hash of id and text.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import Stored, cut, shuffle_partitions

SPAN = 400
PASSAGE_WORDS = 51
LEAD_WORDS = 12
LEAD = 64
SLAB = 1 << 17
TOGETHER = 1 << 15  # bytes of short texts that are worked through at once: arrays of that size stay in the cache
BUCKET_ROWS = 10_000
BUCKET_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 16
LOOK = 8  # neighbours on either side that are compared where the next one leaves windows open
_RNG = np.random.default_rng(23)
SYMBOLS = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORDS = re.compile(r"\w+")
IS_WORD = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(128)] + [False] * 128)
PLACE = np.uint64((1 << 24) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2**64 and of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (BASES[which], pow(BASES[which], -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[which] = tuple(out)
    return have


class Hashes:
    """Hashes of any substrings of some bytes."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        power, self.inverse = _power_table(which, len(raw) + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(SYMBOLS[which][raw] * power[: len(raw)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _places(part: np.ndarray, span: int, lead: int) -> tuple[Hashes, np.ndarray, np.ndarray]:
    """The hashes of some bytes, those of all their strings of `lead` bytes, and the anchor of every window."""
    h = Hashes(part)
    heads = h.all(lead)
    return h, heads, _least(heads, span - lead + 1)


def _least(heads: np.ndarray, width: int) -> np.ndarray:
    """Of any `width` neighbouring hashes the place of the smallest."""
    low, size = (heads & ~PLACE) | np.arange(len(heads), dtype=np.uint64), 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return (low & PLACE).astype(np.int64)


def anchors(raw: np.ndarray, span: int = SPAN, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common anchor: anchor, first and last window start, hash of the leading bytes, hash of all bytes of the run's windows."""
    parts = []
    for at in range(0, max(0, len(raw) - span + 1), SLAB):
        h, heads, place = _places(raw[at : at + SLAB + span - 1], span, lead)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.append(first[1:], len(place)) - 1
        m = place[first]
        whole = h.of(first, last + span) + (last - first).astype(np.uint64)
        parts.append((m + at, first + at, last + at, heads[m].view(np.int64), whole.view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts))


def anchors_of_many(texts: list[bytes], span: int = SPAN, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """The runs of many texts, worked through together: the number of the text, then as anchors() gives them."""
    size = np.array([len(t) for t in texts])
    parts = [(np.full(len(got[0]), i), *got) for i in np.flatnonzero(size > TOGETHER) for got in [anchors(np.frombuffer(texts[i], dtype=np.uint8), span, lead)]]
    few: list[int] = []
    held = 0
    for i in [*np.flatnonzero((size >= span) & (size <= TOGETHER)).tolist(), -1]:
        if few and (i < 0 or held + size[i] > TOGETHER):
            parts.append(_together([texts[k] for k in few], np.array(few), span, lead))
            few, held = [], 0
        if i >= 0:
            few.append(i)
            held += size[i]
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _together(texts: list[bytes], numbers: np.ndarray, span: int, lead: int) -> tuple[np.ndarray, ...]:
    """Texts end to end; windows that reach into the next text are left out, so every run is as if its text stood alone."""
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    h, heads, place = _places(np.frombuffer(b"".join(texts), dtype=np.uint8), span, lead)
    owner = np.repeat(np.arange(len(texts)), size)[: len(place)]
    window = np.flatnonzero(np.arange(len(place)) <= (begin + size - span)[owner])
    place, owner = place[window], owner[window]
    first = np.concatenate([[0], np.flatnonzero((np.diff(place) != 0) | (np.diff(owner) != 0)) + 1])
    a, b, m, own = window[first], window[np.append(first[1:], len(window)) - 1], place[first], owner[first]
    whole = h.of(a, b + span) + (b - a).astype(np.uint64)
    return numbers[own], m - begin[own], a - begin[own], b - begin[own], heads[m].view(np.int64), whole.view(np.int64)


def multikey_order(symbols: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """The order of keys, given as rows of symbols: three-way quicksort by one symbol after another, only rows equal so far going on to the next; a few rows are compared as they are."""
    order = np.arange(len(symbols))
    todo = [(0, len(symbols), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        while hi - lo > 1 and depth < symbols.shape[1]:
            part = order[lo:hi]
            key = symbols[part, depth]
            if hi - lo <= 4096:
                at = np.argsort(key, kind="stable")
                order[lo:hi] = part[at]
                key = key[at]
                edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [hi - lo]])
                for i in np.flatnonzero(np.diff(edges) > 1):
                    a, b = lo + int(edges[i]), lo + int(edges[i + 1])
                    if b - a <= 64:
                        order[a:b] = sorted(order[a:b].tolist(), key=keys.__getitem__)
                    else:
                        todo.append((a, b, depth + 1))
                break
            pivot = np.partition(key, len(key) // 2)[len(key) // 2]
            less, equal = key < pivot, key == pivot
            a, b = lo + int(less.sum()), lo + int(less.sum() + equal.sum())
            order[lo:hi] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
            todo += [(lo, a, depth), (b, hi, depth)]
            lo, hi, depth = a, b, depth + 1
    return order


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)
    return int(x.argmax())


def _matrix(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes padded with zeros to a multiple of eight, and their lengths."""
    size = np.array([len(k) for k in keys])
    width = -(-max(1, int(size.max())) // 8) * 8
    return np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), dtype=np.uint8).reshape(len(keys), width), size


def sorted_with_prefixes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and how many bytes each has in common with the next in that order."""
    m, size = _matrix(keys)
    order = multikey_order(m.view(">u8"), keys)
    m, size = m[order], size[order]
    common = np.zeros(max(0, len(keys) - 1), dtype=np.int64)
    for at in range(0, len(common), 4096):
        end = min(at + 4096, len(common))
        differ = m[at:end] != m[at + 1 : end + 1]
        common[at:end] = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return order, np.minimum(common, np.minimum(size[:-1], size[1:]))


def suffix_order(suffixes: list[bytes], first: int = 512) -> np.ndarray:
    """The order of suffixes of any length: by multikey quicksort of their first bytes, and where these are equal as they are."""
    if not suffixes:
        return np.zeros(0, dtype=np.int64)
    heads = [x[:first] for x in suffixes]
    m, _ = _matrix(heads)
    order = multikey_order(m.view(">u8"), heads)
    at = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or heads[order[i]] != heads[order[at]]:
            if i - at > 1 and len(heads[order[at]]) == first:
                order[at:i] = sorted(order[at:i].tolist(), key=suffixes.__getitem__)
            at = i
    return order


def shared_windows(m1: int, a1: int, b1: int, body1: bytes, m2: int, a2: int, b2: int, body2: bytes, span: int, right: int | None = None) -> tuple[int, int, int]:
    """How far two suffixes agree from their anchors m on, and the first and last distance from window start to anchor of the windows that both share (first above last: none). Bodies begin at a."""
    if right is None:
        right = common_prefix(body1[m1 - a1 :], body2[m2 - a2 :])
    left = common_prefix(body1[: m1 - a1][::-1], body2[: m2 - a2][::-1])
    return right, max(span - right, m1 - b1, m2 - b2), min(left, m1 - a1, m2 - a2)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges lo to hi of window starts, joined where they touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _pairs(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"lo": lo, "hi": hi} for lo, hi in ranges]


def _covers(ranges: list[tuple[int, int]], lo: int, hi: int) -> bool:
    return any(x <= lo and hi <= y for x, y in ranges)


RANGES = "array<struct<lo: int, hi: int>>"
RUN = {"a": "int", "m": "int", "b": "int", "lead": "bigint", "whole": "bigint"}
RUNS = ", ".join(f"r{c} array<{kind}>" for c, kind in RUN.items())
FOUND = f"rid long, m int, a int, b int, reach int, shared {RANGES}, pid int, edge int, body binary"


def _segments(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """Texts with their open runs, in order -> segments: the bytes of neighbouring runs, and what the document alone confirms (done)."""
    every = max(2, 1344 // max(1, (span - LEAD) // 2))  # a segment is cut at one anchor in so many
    rows, size = [], 0
    repeated: set[int] = set()  # equal rows meet here by their rid; one of them is enough, as all that they hold is sure
    columns = ["rid", "m", "a", "b", "body", *(f"r{c}" for c in RUN), "done"]
    for pdf in batches:
        for rid, text, again, *runs in pdf[["rid", "text", "again", *(f"r{c}" for c in RUN)]].itertuples(index=False):
            if again:
                if rid in repeated:
                    continue
                repeated.add(rid)
            raw = text.encode("utf-8", "surrogatepass")
            a, m, b, lead, whole = runs
            left = np.ones(len(a), dtype=bool)
            sure = np.full(len(a), bool(again))
            order = np.lexsort((a, whole, lead))
            same = (lead[order[1:]] == lead[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
            first = order[0]
            for i in np.flatnonzero(same) if same.any() else ():
                first = order[i] if i == 0 or not same[i - 1] else first
                k = order[i + 1]
                if raw[a[k] : b[k] + span] == raw[a[first] : b[first] + span]:
                    sure[k] = sure[first] = True
                    left[k] = False
            done = merged(list(zip(a[sure].tolist(), b[sure].tolist())))
            a, m, b, lead, whole = (x[left] for x in runs)
            begin = len(rows)
            for i, j in _stretches(a, b, lead, every):
                lo, hi = int(a[i]), int(b[j - 1])
                rows.append((rid, m[i], lo, hi, raw[lo : hi + span], a[i:j], m[i:j], b[i:j], lead[i:j], whole[i:j], _pairs([(max(x, lo), min(y, hi)) for x, y in done if x <= hi and y >= lo])))
                size += hi + span - lo
            if done:  # all that the document alone confirms goes with its first segment
                rows[begin] = (*rows[begin][:-1], _pairs(done))
            if size > BUCKET_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _stretches(a: np.ndarray, b: np.ndarray, lead: np.ndarray, every: int) -> Iterator[tuple[int, int]]:
    """Runs i to j - 1 that make up a segment: neighbours, cut where an anchor's hash says so or the segment grows too long."""
    edges = np.concatenate([[0], np.flatnonzero((a[1:] != b[:-1] + 1) | (lead[1:] % every == 0)) + 1, [len(a)]]).tolist()
    for i, j in zip(edges, edges[1:]):
        while b[j - 1] - a[i] > SEGMENT_BYTES and j - i > 1:
            k = i + max(1, int(np.searchsorted(b[i:j], a[i] + SEGMENT_BYTES)))
            yield i, k
            i = k
        yield i, j


def _compare_neighbours(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """A bucket of suffixes, sorted: how far each agrees with a neighbour, the windows it shares with neighbours, and the bucket's first and last suffix with their bytes."""
    from pyspark import TaskContext

    held = [p for p in batches if len(p)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True)
    m, a, b = (pdf[c].to_numpy(dtype=np.int64) for c in "mab")
    body = pdf["body"].tolist()
    suffix = [x[i:] for x, i in zip(body, (m - a).tolist())]
    order = suffix_order(suffix)
    pdf, m, a, b = pdf.iloc[order].reset_index(drop=True), m[order].tolist(), a[order].tolist(), b[order].tolist()
    body, suffix = [body[i] for i in order], [suffix[i] for i in order]
    n = len(pdf)
    common = [common_prefix(x, y) for x, y in zip(suffix, suffix[1:])]
    reach = np.zeros(n, dtype=np.int64)
    reach[:-1] = common
    reach[1:] = np.maximum(reach[1:], common)
    shared: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    agree = common
    for step in range(1, LOOK + 1):
        todo = [i for i, c in enumerate(agree) if c >= min(LEAD, span)]
        if not todo:
            break
        for i in todo:
            j = i + step
            if step > 1 and _covers(shared[i], a[i], b[i]) and _covers(shared[j], a[j], b[j]):
                continue
            _, far, near = shared_windows(m[i], a[i], b[i], body[i], m[j], a[j], b[j], body[j], span, agree[i])
            if far <= near:
                shared[i] = merged([*shared[i], (m[i] - near, m[i] - far)])
                shared[j] = merged([*shared[j], (m[j] - near, m[j] - far)])
        agree = [min(x, y) for x, y in zip(agree, common[step:])]
    edge = np.zeros(n, dtype=np.int32)
    edge[0] += 1
    edge[-1] += 2
    yield pd.DataFrame({"rid": pdf["rid"], "m": m, "a": a, "b": b, "reach": reach, "shared": [_pairs(x) for x in shared], "pid": TaskContext.get().partitionId(), "edge": edge, "body": [x if e else None for x, e in zip(body, edge)]})


def _compare_across(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """Two suffixes on either side of an edge: how far they agree, and the windows of each that both share."""
    for pdf in batches:
        out = []
        for x in pdf.itertuples(index=False):
            right, far, near = shared_windows(x.m, x.a, x.b, x.body, x.m_, x.a_, x.b_, x.body_, span)
            out += [(rid, m, a, right, _pairs([(m - near, m - far)] if far <= near else [])) for rid, m, a in ((x.rid, x.m, x.a), (x.rid_, x.m_, x.a_))]
        yield pd.DataFrame(out, columns=["rid", "m", "a", "reach", "shared"])


def _across_edges(found: DataFrame, compare: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], kind: str) -> DataFrame:
    """What compare says of the last row of each bucket and the first row of the next one that is not empty. Only the numbers of the buckets pass through the driver."""
    edges = found.where("edge > 0")
    pids = sorted(r["pid"] for r in edges.select("pid").distinct().collect())
    following = edges.sparkSession.createDataFrame(list(zip(pids, pids[1:])), "pid int, next int")
    last = edges.where("edge >= 2").join(following, "pid")
    first = edges.where("edge % 2 = 1").select(*[F.col(c).alias("next" if c == "pid" else f"{c}_") for c in edges.columns])
    return last.join(first, "next").mapInPandas(compare, kind)


def _contexts(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """Segments with the runs that are in question -> the bytes around each anchor."""
    for pdf in batches:
        for lo in range(0, len(pdf), 200):
            rows = []
            for rid, seg, body, *runs in pdf.iloc[lo : lo + 200][["rid", "seg", "body", "ra", "rm", "rb", "rlead"]].itertuples(index=False):
                for a, m, b, lead in zip(*(x.tolist() for x in runs)):
                    part = body[a - seg : b - seg + span]
                    rows.append((rid, m, a, b, lead, part, lead.to_bytes(8, "big", signed=True) + part[: m - a][::-1]))
            yield pd.DataFrame(rows, columns=["rid", "m", "a", "b", "lead", "body", "before"])


def _left_neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted reversed bytes before the anchors, within equal leading bytes: how far each agrees with a neighbour."""
    from pyspark import TaskContext

    held = [p for p in batches if len(p)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True)
    keys = pdf["before"].tolist()
    order, common = sorted_with_prefixes(keys)
    reach = np.zeros(len(pdf), dtype=np.int64)
    reach[:-1] = common
    reach[1:] = np.maximum(reach[1:], common)
    edge = np.zeros(len(pdf), dtype=np.int32)
    edge[0] += 1
    edge[-1] += 2
    out = pdf.iloc[order][["rid", "m"]].assign(before_reach=np.maximum(reach - 8, 0), pid=TaskContext.get().partitionId(), edge=edge)
    yield out.assign(body=[keys[i] if e else None for i, e in zip(order, edge)])


def _left_across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for x in pdf.itertuples(index=False):
            common = max(0, common_prefix(x.body, x.body_) - 8)
            out += [(x.rid, x.m, common), (x.rid_, x.m_, common)]
        yield pd.DataFrame(out, columns=["rid", "m", "before_reach"])


def _equal_neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A bucket of windows, sorted: those equal to a neighbour, and the bucket's first and last."""
    from pyspark import TaskContext

    held = [p for p in batches if len(p)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True)
    keys = pdf["body"].tolist()
    order = suffix_order(keys)
    keys = [keys[i] for i in order]
    same = np.array([x == y for x, y in zip(keys, keys[1:])], dtype=bool)
    twice = np.append(same, False) | np.insert(same, 0, False)
    edge = np.zeros(len(keys), dtype=np.int32)
    edge[0] += 1
    edge[-1] += 2
    keep = twice | (edge > 0)
    out = pdf.iloc[order][["rid", "lo"]].assign(twice=twice, pid=TaskContext.get().partitionId(), edge=edge, body=[k if e else None for k, e in zip(keys, edge)])
    yield out[keep]


def _equal_across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([r for x in pdf.itertuples(index=False) if x.body == x.body_ for r in ((x.rid, x.lo), (x.rid_, x.lo_))], columns=["rid", "lo"])


def _buckets(df: DataFrame, size: Column) -> int:
    """Buckets of a bounded number of rows and bytes each."""
    n, size = df.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return max(shuffle_partitions(df.sparkSession), math.ceil(n / BUCKET_ROWS), math.ceil((size or 0) / BUCKET_BYTES))


def open_runs(docs: DataFrame, span: int, stored: Stored) -> DataFrame:
    """docs(rid, text) -> (rid, n, runs): of each document the runs whose anchors' leading bytes stand anywhere else too, in order; all others cannot repeat. n counts repeated rows' runs again."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                n, *got = anchors_of_many([t.encode("utf-8", "surrogatepass") for t in part["text"]], span)
                yield pd.DataFrame({"rid": part["rid"].to_numpy()[n], **dict(zip(["m", "a", "b", "lead", "whole"], got))})

    # counts are stored before they are joined back: a join of two plain exchanges is one whose hot keys Spark can split
    runs = stored.keep("runs", docs.where(F.octet_length("text") >= span).mapInPandas(scan, "rid long, m int, a int, b int, lead long, whole long"))
    leads = stored.keep("leads", runs.groupBy("lead").count().where("count > 1").select("lead"))
    return runs.join(leads, "lead").groupBy("rid").agg(F.array_sort(F.collect_set(F.struct(*RUN))).alias("runs"), F.count("*").alias("n"))


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs(rid, text) -> (rid, spans): for each rid that has any, the ranges lo to hi of window starts whose bytes also start elsewhere."""
    stored = Stored(docs.sparkSession)
    # 1. what can repeat
    open_ = open_runs(docs, span, stored)
    apart = [F.col(f"runs.{c}").alias(f"r{c}") for c in RUN]
    segments = stored.keep(
        "segments", docs.join(open_.select("rid", (F.col("n") > F.size("runs")).alias("again"), *apart), "rid").mapInPandas(lambda it: _segments(it, span), f"rid long, m int, a int, b int, body binary, {RUNS}, done {RANGES}")
    )
    stored.drop("runs", "leads")

    # 2. segments against their neighbours
    suffix, size = F.expr("substring(body, m - a + 1)"), F.col("b") - F.col("a") + span
    keyed = segments.select("rid", "m", "a", "b", "body").repartitionByRange(_buckets(segments, size), F.substring(suffix, 1, 2 * LEAD), F.xxhash64(suffix), "rid", "m")
    found = stored.keep("found", keyed.mapInPandas(lambda it: _compare_neighbours(it, span), FOUND))
    across = f"rid long, m int, a int, reach int, shared {RANGES}"
    fixed = _across_edges(found, lambda it: _compare_across(it, span), across)
    first = stored.keep("first", found.select("rid", "a", "shared").union(fixed.select("rid", "a", "shared")).where("size(shared) > 0").groupBy("rid", "a").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared")))
    stored.drop("found")
    known = segments.select("rid", F.explode("done").alias("s")).union(first.select("rid", F.explode("shared"))).select("rid", "s.lo", "s.hi")

    # 3. the runs that are left against theirs
    told = segments.select("rid", F.col("a").alias("seg"), "done", F.explode(F.arrays_zip(*(f"r{c}" for c in RUN))).alias("r")).select("rid", "seg", "done", *[F.col(f"r.r{c}").alias(c) for c in RUN])
    covered = "exists(done, s -> s.lo <= a AND s.hi >= b) OR coalesce(exists(shared, s -> s.lo <= a AND s.hi >= b), false)"
    runs = stored.keep("left", told.join(first.withColumnRenamed("a", "seg"), ["rid", "seg"], "left").select("rid", "seg", *RUN, (~F.expr(covered)).alias("open")))
    asking = stored.keep("asking", runs.where("open").select("lead").distinct())
    classes = runs.where("NOT open").groupBy("lead", "whole").agg(F.min(F.struct("rid", "seg", "m", "a", "b")).alias("r"))
    answers = classes.select("r.*", "lead").join(asking, "lead", "left_semi").select("rid", "seg", "m", "a", "b", "lead")
    needed = runs.where("open").select("rid", "seg", "m", "a", "b", "lead").union(answers).groupBy("rid", "seg").agg(F.collect_set(F.struct("m", "a", "b", "lead")).alias("runs"))
    bodies = segments.select("rid", F.col("a").alias("seg"), "body").join(needed.select("rid", "seg", *[F.col(f"runs.{c}").alias(f"r{c}") for c in ("a", "m", "b", "lead")]), ["rid", "seg"])
    around = stored.keep("around", bodies.mapInPandas(lambda it: _contexts(it, span), "rid long, m int, a int, b int, lead long, body binary, before binary"))
    stored.drop("left", "asking")
    buckets = _buckets(around, size)
    right = stored.keep("right", around.select("rid", "m", "a", "b", "body").repartitionByRange(buckets, suffix, "rid", "m").mapInPandas(lambda it: _compare_neighbours(it, span), FOUND))
    fixed = _across_edges(right, lambda it: _compare_across(it, span), across)
    before = stored.keep("before", around.select("rid", "m", "before").repartitionByRange(buckets, "before", "rid", "m").mapInPandas(_left_neighbours, "rid long, m int, before_reach int, pid int, edge int, body binary"))
    more = _across_edges(before, _left_across, "rid long, m int, before_reach int")
    none = F.array().cast(RANGES)
    both = (
        right.select("rid", "m", "reach", F.lit(0).alias("before_reach"), "shared")
        .union(fixed.select("rid", "m", "reach", F.lit(0), "shared"))
        .union(before.select("rid", "m", F.lit(0), "before_reach", none))
        .union(more.select("rid", "m", F.lit(0), "before_reach", none))
        .groupBy("rid", "m").agg(F.max("reach").alias("reach"), F.max("before_reach").alias("before_reach"), F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))
    )
    # what neighbours confirm, and the widest range in which anything could agree
    ranged = stored.keep("ranged", both.join(around.select("rid", "m", "a", "b", "lead").distinct(), ["rid", "m"]).select(
        "rid", "m", "lead", "a", "shared", F.greatest("a", F.col("m") - F.col("before_reach")).alias("first"), F.least("b", F.col("m") + F.col("reach") - span).alias("last"),
    ))
    stored.drop("right", "before")
    confirmed = ranged.select("rid", F.explode("shared").alias("s")).select("rid", "s.lo", "s.hi")

    # 4. single windows that neither tells apart
    settled = "first > last OR exists(shared, s -> s.lo <= first AND s.hi >= last)"
    unsettled = stored.keep("unsettled", ranged.where(f"NOT ({settled})").select("lead").distinct())
    windows = ranged.where("first <= last").join(unsettled, "lead", "left_semi").join(around.select("rid", "m", "a", "body"), ["rid", "m", "a"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                out = []
                for rid, m, a, first, last, shared, body in pdf.iloc[lo : lo + 1000][["rid", "m", "a", "first", "last", "shared", "body"]].itertuples(index=False):
                    h = Hashes(np.frombuffer(body, dtype=np.uint8)[first - a : last - a + span]).all(span).view(np.int64)
                    at = np.arange(first, last + 1)
                    sure = np.zeros(len(at), dtype=bool)
                    for s in shared:
                        sure |= (at >= s["lo"]) & (at <= s["hi"])
                    out.append((np.full(len(at), rid), np.full(len(at), m), np.full(len(at), a), at, h, sure))
                if out:
                    yield pd.DataFrame(dict(zip(["rid", "m", "a", "lo", "h", "sure"], map(np.concatenate, zip(*out)))))

    each = stored.keep("each", windows.mapInPandas(hashed, "rid long, m int, a int, lo int, h long, sure boolean"))
    # an open window is asked if its hash stands twice; one window that is sure already answers
    place = F.struct("rid", "m", "a", "lo")
    twice = stored.keep("twice", each.groupBy("h").agg(F.count("*").alias("n"), F.min("sure").alias("all_sure"), F.min(F.when(F.col("sure"), place)).alias("r")).where("n > 1 AND NOT all_sure").select("h", "r"))
    wanted = each.where("NOT sure").join(twice.select("h"), "h").select("rid", "m", "a", "lo").union(twice.where("r IS NOT NULL").select("r.*")).groupBy("rid", "m", "a").agg(F.collect_set("lo").alias("at"))

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                rows = [(rid, int(w), body[w - a : w - a + span]) for rid, a, body, at in pdf.iloc[lo : lo + 200][["rid", "a", "body", "at"]].itertuples(index=False) for w in at]
                yield pd.DataFrame(rows, columns=["rid", "lo", "body"])

    singles = stored.keep("singles", around.select("rid", "m", "a", "body").dropDuplicates(["rid", "m", "a"]).join(wanted, ["rid", "m", "a"]).mapInPandas(single, "rid long, lo int, body binary"))
    stored.drop("around", "each", "twice", "unsettled")
    equal = stored.keep("equal", singles.repartitionByRange(_buckets(singles, F.lit(span)), "body", "rid", "lo").mapInPandas(_equal_neighbours, "rid long, lo int, twice boolean, pid int, edge int, body binary"))
    last = equal.where("twice").select("rid", "lo").union(_across_edges(equal, _equal_across, "rid long, lo int")).select("rid", "lo", F.col("lo").alias("hi"))
    spans = cut(known.union(confirmed).union(last).distinct().groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    stored.drop()
    return spans


def _merged_runs(lo: np.ndarray, hi: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes [start, end) covered by the windows that start at lo to hi."""
    runs: list[tuple[int, int]] = []
    for i in np.argsort(lo, kind="stable"):
        s, e = int(lo[i]), int(hi[i]) + span
        if runs and s <= runs[-1][1]:
            if e > runs[-1][1]:
                runs[-1] = (runs[-1][0], e)
        else:
            runs.append((s, e))
    return runs


def kept_bytes(raw: bytes, spans: list | np.ndarray | None, span: int) -> tuple[bytes, int]:
    """What is left of the bytes, and the number of runs removed."""
    if spans is None or not len(spans):
        return raw, 0
    runs = _merged_runs(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]), span)
    ends = [0, *[e for _, e in runs]]
    return b"".join(raw[e:s] for e, (s, _) in zip(ends, runs)) + raw[ends[-1] :], len(runs)


def digests(docs: DataFrame, span: int = SPAN, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text). With `words` also n_passages, n_passage_bytes: maximal runs of strings of so many words that stand anywhere else too, which span does not always reach, and their bytes; these two come from hashes, the others from the sorted suffixes."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    texts = rows.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.join(repeats(texts, span), "rid", "left")
    if words is None:
        marked = marked.withColumn("places", F.array().cast("array<long>"))
    else:
        marked = marked.join(repeated_strings(texts, words), "rid", "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")
    def digest(text: pd.Series, spans: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, p in zip(text, spans, places):
            raw = (t or "").encode("utf-8", "surrogatepass")
            kept, n = kept_bytes(raw, s, span)
            runs = [] if p is None else _merged_runs(p >> 32, p & 0xFFFFFFFF, 0)
            out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), len(runs), sum(e - b for b, e in runs)))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"])

    out = marked.select("doc_id", digest("text", "spans", "places").alias("d")).select("doc_id", "d.*")
    return out if words is not None else out.drop("n_passages", "n_passage_bytes")


def passage_span(words: int) -> int:
    """Bytes that so many words have in all but the tersest text: three a word, and one between any two. Strings with fewer are looked at as they are."""
    return 4 * words - 1


def may_be_terse(raw: np.ndarray, words: int, span: int) -> bool:
    """Whether a string of so many words and fewer bytes than span can be in a text: every run of ASCII word characters and every other character may be a word."""
    ascii_word = IS_WORD[raw]
    start = (raw >= 0xC0) | (ascii_word & ~np.concatenate([[False], ascii_word[:-1]]))
    at = np.flatnonzero(start)
    return bool((at[words - 1 :] - at[: max(0, len(at) - words + 1)] < span).any())


@functools.cache
def _word_characters() -> np.ndarray:
    """Whether each code point is a word character, as WORDS has it."""
    return np.array([chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)])


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word and the one behind it."""
    edges, at, before = [], 0, False
    for lo in range(0, len(text), SLAB):
        part = text[lo : lo + SLAB]
        if part.isascii():
            is_word, place = IS_WORD[np.frombuffer(part.encode(), dtype=np.uint8)], np.arange(len(part) + 1)
        else:
            point = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            is_word = _word_characters()[point]
            place = np.concatenate([[0], np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), dtype=np.int64)])
        edges.append(at + place[np.flatnonzero(np.concatenate([[before], is_word[:-1]]) != is_word)])
        at, before = at + int(place[-1]), bool(is_word[-1])
    edge = np.concatenate([*edges, np.full(int(before), at)]).astype(np.int64)
    return edge[::2], edge[1::2]


def strings_of_words(texts: list[str], words: int, lead: int | None = None) -> tuple[np.ndarray, ...]:
    """The strings of so many words of each text: number of the text, first byte, end, two hashes. With `lead`, runs of neighbouring strings whose smallest hash of `lead` words stands in the same place: where the run begins and ends, that hash, and a hash of its bytes."""
    out = [tuple(np.zeros(0, dtype=np.int64) for _ in range(5))]
    few: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        few.append(i)
        held += len(text)
        if held > TOGETHER or i == len(texts) - 1:
            out += _strings_together([texts[k] for k in few], np.array(few), words, lead)
            few, held = [], 0
    return tuple(np.concatenate(x) for x in zip(*out))


def _strings_together(texts: list[str], numbers: np.ndarray, words: int, lead: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts one below the other; strings that reach into the next text are left out."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) + 1 for r in raw])
    begin = np.cumsum(size) - size
    whole = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    start, end = word_places("\n".join(texts))
    owner = np.searchsorted(begin, start, side="right") - 1
    for at in range(0, len(start) - words + 1, SLAB):
        s, e, own = (x[at : at + SLAB + words - 1] for x in (start, end, owner))
        base = int(s[0])
        s, e, part = s - base, e - base, whole[base : e[-1]]
        first = np.flatnonzero(own[: len(own) - words + 1] == own[words - 1 :])
        if not len(first):
            continue
        last, h, key = first, [Hashes(part, k) for k in (0, 1)], None
        if lead is not None:
            heads = h[0].of(s[: len(s) - lead + 1], e[lead - 1 :])
            place = _least(heads, words - lead + 1)[first]
            new = np.concatenate([[0], np.flatnonzero((np.diff(place) != 0) | (np.diff(own[first]) != 0)) + 1])
            last, first, key = first[np.append(new[1:], len(first)) - 1], first[new], heads[place[new]]
        lo, hi, own = s[first], e[last + words - 1], own[first]
        key = h[0].of(lo, hi) if key is None else key
        yield numbers[own], lo + base - begin[own], hi + base - begin[own], key.view(np.int64), h[1].of(lo, hi).view(np.int64)


def word_windows(text: str, spans: list | None, words: int, span: int) -> tuple[np.ndarray, ...]:
    """Start, end and two hashes of the strings from one word to the `words`-th of which all windows of span bytes are in spans, or that are shorter."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if spans is None and not may_be_terse(raw, words, span):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = np.concatenate([[0], np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), dtype=np.int64)])
    place = np.array([m.span() for m in WORDS.finditer(text)], dtype=np.int64).reshape(-1, 2)
    start, end = at[place[: max(0, len(place) - words + 1), 0]], at[place[words - 1 :, 1]]
    change = np.zeros(len(raw) + 2, dtype=np.int64)
    for s in spans if spans is not None else ():
        change[s["lo"]] += 1
        change[s["hi"] + 1] -= 1
    seen = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
    n = np.maximum(end - span + 1 - start, 0)
    ok = seen[start + n] - seen[start] == n
    start, end = start[ok], end[ok]
    return start, end, *(Hashes(raw, k).of(start, end).view(np.int64) for k in (0, 1))


def passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """docs(rid, text) -> (rid, spans): the strings of `words` words that stand anywhere else too, as ranges of windows of passage_span bytes (lo to hi + span).

    A string whose windows of passage_span bytes do not all repeat, by the sorted suffix table, cannot repeat. Those that
    are left, and the terse ones, are told apart by 128-bit hashes.
    """
    span = passage_span(words)
    stored = Stored(docs.sparkSession)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, text, spans in pdf[["rid", "text", "spans"]].itertuples(index=False):
                got = word_windows(text, spans, words, span)
                if len(got[0]):
                    yield pd.DataFrame(dict(zip(["lo", "hi", "h1", "h2"], got))).assign(rid=rid, hi=got[1] - span)

    each = stored.keep("each", docs.join(repeats(docs, span), "rid", "left").mapInPandas(hashed, "lo int, hi int, h1 long, h2 long, rid long"))
    twice = stored.keep("twice", each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    spans = cut(each.join(twice, ["h1", "h2"]).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    stored.drop()
    return spans


def repeated_strings(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """docs(rid, text) -> (rid, places): the strings that passages() finds, without sorting; first byte and end in one number, the first in its upper half.

    As in step 1, strings fall into runs with a common anchor, here the smallest hash of LEAD_WORDS words, and those whose
    anchor stands nowhere else are done. Equal runs (by two hashes) confirm each other. Only runs that no other equals,
    and one of each class of equal runs with their anchor, are taken apart into strings, told apart by 128-bit hashes.
    """
    stored = Stored(docs.sparkSession)
    kind = "rid long, lo int, hi int, h1 long, h2 long"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                n, *got = strings_of_words(part["text"].tolist(), words, min(words, LEAD_WORDS))
                yield pd.DataFrame({"rid": part["rid"].to_numpy()[n], **dict(zip(["lo", "hi", "h1", "h2"], got))})

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                parts = []
                for rid, text, runs in pdf.iloc[lo : lo + 500][["rid", "text", "runs"]].itertuples(index=False):
                    raw = text.encode("utf-8", "surrogatepass")
                    parts += [(rid, r["lo"], raw[r["lo"] : r["hi"]].decode("utf-8", "surrogatepass")) for r in runs]
                rid, at, text = zip(*parts)
                n, start, end, h1, h2 = strings_of_words(list(text), words)
                yield pd.DataFrame({"rid": np.array(rid)[n], "lo": np.array(at)[n] + start, "hi": np.array(at)[n] + end, "h1": h1, "h2": h2})

    # counts are stored before they are joined back, as in open_runs
    runs = stored.keep("strings", docs.where(F.octet_length("text") >= 2 * words - 1).mapInPandas(scan, kind))
    leads = stored.keep("anchors", runs.groupBy("h1").count().where("count > 1").select("h1"))
    held = stored.keep("held", runs.join(leads, "h1"))
    stored.drop("strings", "anchors")
    classes = stored.keep("classes", held.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("rid", "lo", "hi")]))
    asking = stored.keep("alone", classes.groupBy("h1").agg(F.count("*").alias("k"), F.min("n").alias("n")).where("k > 1 AND n = 1").select("h1"))
    needed = classes.join(asking, "h1", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    each = stored.keep("each", docs.join(needed, "rid").mapInPandas(apart, kind))
    twice = stored.keep("twice", each.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    equal = stored.keep("equal", classes.where("n > 1").select("h1", "h2"))
    found = held.join(equal, ["h1", "h2"]).select("rid", "lo", "hi").union(each.join(twice, ["h1", "h2"]).select("rid", "lo", "hi"))
    places = cut(found.groupBy("rid").agg(F.collect_set(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("places")))
    stored.drop()
    return places


def without_repeats(docs: DataFrame, span: int = SPAN, words: int | None = None) -> DataFrame:
    """docs with their repeated bytes gone from text, and n_chars counted anew where there is such a column; a character cut in two goes whole. With words, what goes is every passage of at least so many whole words that stands elsewhere too, however few bytes it has; at least 17, as its windows have to be longer than LEAD."""
    if words is not None:
        span = passage_span(words)
    if span <= LEAD:
        raise ValueError(f"strings of {span} bytes are too short for anchors of {LEAD}")
    # whatever else docs holds travels in one column, out of the way of this module's names
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("rest"))
    texts = rows.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.join(repeats(texts, span) if words is None else passages(texts, words), "rid", "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else kept_bytes(t.encode("utf-8", "surrogatepass"), s, span)[0].decode("utf-8", "ignore") for t, s in zip(text, spans)])

    out = marked.select("rest", kept("text", "spans").alias("text"))
    counted = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return out.select(*[F.col("text") if c.lower() == "text" else counted.alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns])
