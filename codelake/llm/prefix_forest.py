"""Approximate nearest neighbours by a hash-prefix forest (LSH forest; Bawa, Condie and Ganesan, 2005).

Vectors are dealt into shards of about `SHARD_ROWS` (fewer where they are long). A shard keeps, for each of `TREES`
trees, its vectors' long hash strings (signs of 64 random projections) in one sorted array. A query descends every tree
to its longest matching prefix, a range of that array; then all trees give up one bit at a time together until the
ranges hold `WANTED` entries. Only those are compared: by cosine in single precision, and the best of them, with all
that rounding could put among them, in double precision. The query set meets all shards in blocks: each (block, shard)
pair is one unit of work, so neither a common vector nor a large query set lands in one task; the best of each shard
are merged by a ranking that keeps k rows a partition before it shuffles.

`WANTED` is a number for each query and shard, whatever the shard holds; a shard with fewer entries than that is
searched whole. Independent directions in 64 dimensions have no near neighbours to speak of (the fifth best of 50 000 is
at about 58 degrees), so a high recall of these takes about 40 % of a full shard; data with close neighbours find
them among the longest prefixes and could do with a far smaller number, which is an argument.

Null vectors, and those that are zero or hold null or non-finite components, neither ask nor answer. Vectors of
different lengths are not compared. Repeated rows stay separate rows: each asks on its own, and all but itself answer,
rows of its own id and equal ones too. Ties go to the smaller id. An empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm.common import usable_vector

TREES = 64
BITS = 64
SHARD_ROWS = 16_384
SHARD_VALUES = 1 << 20
QUERY_ROWS = 8192
WANTED = 6144
SEED = 11
RESULT = "dim int, block int, query_row long, query_id long, vec_id long, score double"


class Forest:
    """The sorted hash strings of one shard; vectors of unit length."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(trees, vectors.shape[1], BITS)).astype(np.float32)
        self.order, self.keys = [], []
        for t in range(trees):
            h = self.strings(vectors, t)
            self.order.append(np.argsort(h, kind="stable"))
            self.keys.append(h[self.order[-1]])
        self.n = len(vectors)

    def strings(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        return np.packbits(vectors @ self.planes[tree] > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)

    def ranges(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that begin like h (trees, queries) stand in each tree, for a prefix length of each query."""
        low_bits = np.array([(1 << (BITS - i)) - 1 for i in range(BITS + 1)], dtype=np.uint64)[length]
        first = np.stack([np.searchsorted(k, x, "left") for k, x in zip(self.keys, h & ~low_bits)])
        return first, np.stack([np.searchsorted(k, x, "right") for k, x in zip(self.keys, h | low_bits)])

    def candidates(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range under the longest prefix, of one length in all trees, that gives `wanted` entries.

        The ascent from the longest matches is one bit at a time in all trees at once; as ranges only grow on the way,
        the length at which it ends is found by halving.
        """
        h = np.stack([self.strings(queries, t) for t in range(len(self.keys))])
        enough, too_long = np.zeros(h.shape[1], dtype=np.int64), np.full(h.shape[1], BITS + 1)
        while (too_long - enough > 1).any():
            length = (enough + too_long) // 2
            first, last = self.ranges(h, length)
            ok = (last - first).sum(0) >= wanted
            enough, too_long = np.where(ok, length, enough), np.where(ok, too_long, length)
        return self.ranges(h, enough)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from first to last."""
    return np.cumsum(x * y, axis=1)[:, -1]


def in_order(df: pd.DataFrame, side: str) -> tuple[pd.DataFrame, np.ndarray, list[tuple]]:
    """Rows by id and vector, their vectors, and a name for each: id, vector, and the how-manieth equal row it is."""
    keys = [f"{side}_id", "bits"]
    named = df.assign(bits=[np.asarray(v, dtype=np.float64).tobytes() for v in df[f"{side}_vector"]]).sort_values(keys, kind="stable", ignore_index=True)
    nth = named.groupby(keys, sort=False).cumcount()
    return named, np.frombuffer(b"".join(named["bits"]), dtype=np.float64).reshape(len(named), -1), list(zip(named[keys[0]], named["bits"], nth))


def nearest_in_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, wanted: int, trees: int = TREES, own: np.ndarray | None = None) -> pd.DataFrame:
    """The k best candidates of one shard for each query; own: the row that is the query itself, or -1 (without it, all rows of the query's id)."""
    squares, qsquares = dots(vectors, vectors), dots(queries, queries)
    unit, qunit = ((v / np.sqrt(s)[:, None]).astype(np.float32) for v, s in ((vectors, squares), (queries, qsquares)))
    forest = Forest(unit, trees)
    first, last = forest.candidates(qunit, wanted)
    seen = np.zeros(len(ids), dtype=bool)
    got: list[tuple[np.ndarray, ...]] = []
    for i in range(len(query_ids)):
        for order, a, b in zip(forest.order, first[:, i], last[:, i]):
            seen[order[a:b]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        found = found[(ids[found] != query_ids[i]) if own is None else (found != own[i])]
        near = unit[found] @ qunit[i]
        if len(found) > k:  # what rounding, or a tie that the ids decide, could put among the k best
            found = found[near >= np.partition(near, -k)[-k] - 1e-4]
        both = squares[found] * qsquares[i]
        size = np.where((both > 0) & np.isfinite(both), np.sqrt(both), np.sqrt(squares[found]) * np.sqrt(qsquares[i]))
        score = dots(vectors[found], queries[i][None]) / size
        best = np.lexsort((ids[found], -score))[:k]
        got.append((np.full(len(best), i), np.full(len(best), query_ids[i]), ids[found][best], score[best]))
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(["query_row", "query_id", "vec_id", "score"], zip(*got))})


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, wanted: int = WANTED, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row of queries(vec_id, embedding) among vectors(vec_id, embedding)."""
    # names of their own for both sides: where both come from one table, the plan else takes the columns of one for the other's
    take = lambda df, side: df.where(usable_vector("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias(f"{side}_id"), F.col("embedding").alias(f"{side}_vector"), F.size("embedding").alias("dim"))
    queries, vectors = take(queries, "q"), take(vectors, "v")
    n, longest = vectors.agg(F.count("*"), F.max("dim")).first()
    shards = max(1, math.ceil(n / max(1, min(SHARD_ROWS, SHARD_VALUES // (longest or 1)))))
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    q = queries.withColumn("block", F.pmod(F.xxhash64("q_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    v = vectors.withColumn("shard", F.pmod(F.xxhash64("v_id", F.lit(2)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    # rows of one id share a block and a shard, so all that equal a query are at hand wherever its own row is, and a
    # block's rows have the same order, and so the same numbers, in every shard
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
        (left, x, names), (right, y, there) = in_order(left, "q"), in_order(right, "v")
        place = {name: i for i, name in enumerate(there)}
        own = np.array([place.get(name, -1) for name in names])
        best = nearest_in_shard(left["q_id"].to_numpy(), x, right["v_id"].to_numpy(), y, k, max((k + 1) * trees, wanted), trees, own)
        return best.assign(dim=left["dim"].iloc[0], block=left["block"].iloc[0])

    keys = ["dim", "block", "shard"]
    best = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(meet, RESULT)
    rank = F.row_number().over(Window.partitionBy("dim", "block", "query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
