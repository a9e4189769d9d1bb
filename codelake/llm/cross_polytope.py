"""Near-duplicate embeddings by cross-polytope hashing (Andoni et al., 2015), with verified pairs.

Each table of hashes rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the
signed axis nearest to it; a table's code joins the axes of a few rotations. Besides its own bucket a vector probes
those reached by its least certain axis. Larger tables of vectors take more rotations, and as many more tables of hashes
as keep the chance of missing a pair at the threshold at `MISS` at most.

1. Buckets first hold names and 128 signs of random projections (16 bytes). Those whose signs differ from all others'
   in the bucket by more than a pair at the threshold does (but for one in a million) leave it.
2. Vectors are sent to the buckets in which they are left, compared by cosine in double precision and linked at the
   threshold or above it.

Equal vectors are one node with a weight, so thousands of copies cost one row. A bucket's nodes are dealt into chunks
and every two chunks meet in a block of bounded size, so a crowded bucket is many small units of work. A pair is
counted only in the first table and bucket in which it meets; blocks return a count and a local root for each node,
never the pairs. Components come from the local roots.

Vectors that are null, zero or hold null or non-finite components, and vectors of different lengths, link with
nothing. Repeated rows are vectors of their own, linked with each other. A cosine of just the threshold links. Every
row comes back; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import cut, group_starts, pairs_within, roots, shuffle_partitions, usable_vector, whole_groups
from codelake.llm.components import components

THRESHOLD = 0.95
TABLES = 8  # at least
MISS = 0.001
PROBES = 1
CHUNK = 1024
SIGNS = 128
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; rows have a power of two of columns."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(x: np.ndarray, axes: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(n, tables, 1 + probes) bucket codes: a vector's own, then those that change its least certain axes one by one."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x / np.sqrt((x * x).sum(1, keepdims=True)), ((0, 0), (0, size - d)))
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + probes), dtype=np.int64)
    row = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(axes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            big = np.abs(y[row[:, None], top])
            top = np.where((big[:, :1] >= big[:, 1:]), top, top[:, ::-1])
            signed = top + size * (y[row[:, None], top] < 0)
            best.append(signed[:, 0])
            second.append(signed[:, 1])
            gap.append(np.abs(big[:, 0] - big[:, 1]))
        best, second, order = np.stack(best, 1), np.stack(second, 1), np.argsort(np.stack(gap, 1), axis=1)
        base = (2 * size) ** np.arange(axes)
        out[:, t, 0] = best @ base
        for p in range(probes):
            at = order[:, p % axes]
            out[:, t, 1 + p] = out[:, t, 0] + (second[row, at] - best[row, at]) * base[at]
    return out


def axes_for(n: int, dim: int) -> int:
    """Rotations a table of hashes takes for n vectors."""
    return max(2, math.ceil(math.log(max(2, n)) / math.log(2 * max(2, dim)) - 0.5))


@lru_cache(maxsize=64)
def tables_for(dim: int, axes: int, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> int:
    """The tables with which a pair at the threshold is missed with a chance of at most MISS: one table's chance is measured on random pairs, less two standard errors. The same on every executor."""
    if dim < 2:
        return tables
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, 500, dim))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.sqrt((b * b).sum(1, keepdims=True))
    x, y = (codes(v, axes, 8, probes, SEED + 1) for v in (a, threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b))
    hits = (x[:, :, :, None] == y[:, :, None, :]).any((2, 3))
    p = hits.mean()
    p = min(1 - 1e-9, max(1 / hits.size, p - 2 * math.sqrt(p * (1 - p) / hits.size)))
    return max(tables, math.ceil(math.log(MISS) / math.log(1 - p)))


def first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table in which rows of a and b (n, tables, codes) share a bucket, and the smallest code they share there."""
    none = np.iinfo(np.int64).max
    table, code = np.full(len(a), -1), np.full(len(a), none)
    left = np.arange(len(a))
    for t in range(a.shape[1]):
        x, y = a[left, t], b[left, t]
        shared = np.where((x[:, :, None] == y[:, None, :]).any(2), x, none).min(1)
        hit = shared != none
        table[left[hit]], code[left[hit]] = t, shared[hit]
        left = left[~hit]
        if not len(left):
            break
    return table, code


def signs(x: np.ndarray, seed: int = SEED + 2) -> np.ndarray:
    """(n, 2) 64-bit words: on which side of random planes each vector lies."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def most_different(threshold: float, lost: float = 1e-6) -> int:
    """The fewest differing signs that a pair at the threshold exceeds with a chance of at most `lost`."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    total = 0.0
    for n in range(SIGNS + 1):
        total += math.comb(SIGNS, n) * p**n * (1 - p) ** (SIGNS - n)
        if 1 - total <= lost:
            return n
    return SIGNS


BLOCK = ["dim", "t", "code", "i", "j"]


def _alike(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Blocks of nodes with their signs -> the nodes that another of the block may be near to."""
    for part in whole_groups(batches, BLOCK):
        words, chunk, cross = part[["s0", "s1"]].to_numpy().astype(np.int64).view(np.uint64), part["chunk"].to_numpy(), (part["i"] != part["j"]).to_numpy()
        near = np.zeros(len(part), dtype=bool)
        for a, b in pairs_within(group_starts(part, BLOCK)):
            ok = (np.bitwise_count(words[a] ^ words[b]).sum(1) <= most) & ~(cross[a] & (chunk[a] == chunk[b]))
            near[a[ok]] = near[b[ok]] = True
        yield part.loc[near, ["dim", "t", "code", "node"]]


def _dealt(entries: DataFrame, chunk: int) -> DataFrame:
    """Entries (dim, t, code, node, ...) of the buckets that hold several, dealt into blocks of two chunks each."""
    # written before it is joined back, so that Spark can split the join at a hot bucket
    crowd = cut(entries.groupBy("dim", "t", "code").agg(F.count("*").alias("n")).where("n > 1").select("dim", "t", "code", F.ceil(F.col("n") / chunk).cast("int").alias("parts")))
    other = entries.join(crowd, ["dim", "t", "code"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), "parts").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return other.select(*entries.columns, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def _blocks(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(shuffle_partitions(dealt.sparkSession), *BLOCK).sortWithinPartitions(*BLOCK)


def _compare(batches: Iterator[pd.DataFrame], threshold: float, probes: int) -> Iterator[pd.DataFrame]:
    """Blocks of nodes -> node, links (the weight of what it links with, counted here), root (the smallest node it hangs together with here)."""
    for pdf in whole_groups(batches, BLOCK):
        for dim, part in pdf.groupby("dim", sort=False):
            part = part.reset_index(drop=True)
            x = np.stack(part["embedding"]).astype(np.float64)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            own = np.stack(part["codes"]).reshape(len(part), -1, 1 + probes)
            t, code, node, weight, chunk = (part[c].to_numpy() for c in ("t", "code", "node", "weight", "chunk"))
            cross = (part["i"] != part["j"]).to_numpy()
            left, right = [], []
            for a, b in pairs_within(group_starts(part, BLOCK), max(1, 6_400_000 // x.shape[1])):
                ok = ~(cross[a] & (chunk[a] == chunk[b]))
                a, b = a[ok], b[ok]
                close = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[close], b[close]
                if len(a):
                    first, where = first_meeting(own[a], own[b])
                    here = (first == t[a]) & (where == code[a])
                    left.append(a[here])
                    right.append(b[here])
            if left and (n := sum(map(len, left))):
                a, b = np.concatenate(left), np.concatenate(right)
                links = np.zeros(len(part), dtype=np.int64)
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                low = roots(len(part), a, b)
                at = np.flatnonzero(links)
                yield pd.DataFrame({"node": node[at], "links": links[at], "root": node[low[at]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, axes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding); axes follow the number of vectors unless given."""
    rows = vectors.select("vec_id", F.when(usable_vector("embedding"), F.col("embedding")).alias("embedding")).withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    nodes = cut(rows.where("node IS NOT NULL").groupBy("node", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight")))
    n = nodes.count()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                k = axes or axes_for(n, dim)
                x = np.stack(part["embedding"]).astype(np.float64)
                got, side = codes(x, k, tables_for(dim, k, threshold, tables, probes), probes), signs(x)
                yield pd.DataFrame({"node": part["node"], "embedding": part["embedding"], "weight": part["weight"], "dim": dim, "codes": list(got.reshape(len(part), -1)), "s0": side[:, 0], "s1": side[:, 1]})

    kind = dict(nodes.dtypes)["embedding"]
    full = cut(nodes.mapInPandas(hashed, f"node long, embedding {kind}, weight long, dim int, codes array<long>, s0 long, s1 long"))
    entries = full.select("dim", "node", "s0", "s1", F.posexplode("codes").alias("k", "code")).select("dim", F.expr(f"CAST(k DIV {1 + probes} AS INT)").alias("t"), "code", "node", "s0", "s1")
    most = most_different(threshold)
    near = _blocks(_dealt(entries, 4 * CHUNK)).mapInPandas(lambda it: _alike(it, most), "dim int, t int, code long, node long")
    left = cut(near.distinct())
    blocks = _blocks(_dealt(left, CHUNK).join(full.drop("dim", "s0", "s1"), "node"))
    found = cut(blocks.mapInPandas(lambda it: _compare(it, threshold, probes), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = tree.join(nodes.select("node", "low"), "node")
    lows = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    of_node = cut(nodes.select("node", "weight", "low").join(links, "node", "left").join(named.select("node", "root").join(lows, "root").select("node", "component_id"), "node", "left"))
    out = rows.select("vec_id", "node").join(of_node, "node", "left")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "low", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
