"""N-gram Jaccard self-join of documents with Bayesian candidate pruning (BayesLSH; Satuluri and Parthasarathy, 2012).

A document is the set of its word 5-grams (words: runs of letters, digits and `_`, lower-cased; a shorter text is one
gram of all its words). Documents of equal sets form a class, and only classes are compared. Pairs of classes that share
a band of MinHash values are candidates. They are compared a few MinHash values at a time and dropped as soon as the
probability that they reach the threshold, given the matches so far, falls below the tolerance; what is left is
verified exactly on the sets.

1. Within each band, half of the bits of the MinHash values travel and candidates are pruned; the survivors' components
   are groups, so that boilerplate that many unlike texts share does not chain them together. Bands of the same classes
   are looked at once; the classes of a band too large for one block are a group as they are.
2. Each class's set is sent to its group. Groups are cut into blocks of bounded size (two chunks each), so a group of
   thousands is many units of work; a group of n chunks sends each set n times. Blocks prune and verify the candidates
   and return a count of links and a local root for each class, never the pairs.

Defined results: null ids, null texts and texts without a word link with nothing (n_links 0, a component of their
own); repeated rows are documents of their own, linked with each other; an empty table gives an empty table; very long
texts are taken whole; other columns are not read. A similarity of just the threshold links; components are named by
their smallest id, and of several rows with that id all count as kept. Sets hold 64-bit hashes of grams, and a class is
named by a 64-bit hash of its set.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import cut, group_starts, pairs_within, roots, shuffle_partitions, unused, whole_groups
from codelake.llm.components import components

GRAM = 5
THRESHOLD = 0.8
TOLERANCE = 1e-5
HASHES = 128
STEP = 32
BANDS, ROWS = 25, 5  # a pair at 0.8 shares a band with probability 0.99995
CHUNK = 128
WORDS = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(17)
XORS = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
ODDS = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, WORDS.findall(text.lower()))), dtype=np.uint64)


def grams(text: str | None, n: int = GRAM) -> np.ndarray:
    """The sorted set of hashed word n-grams of a text."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = h * MIX + w[j : j + len(h)]
    return np.unique(_mixed(h + np.uint64(k)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, HASHES) MinHash values of non-empty sets."""
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 60_000):
            size += len(sets[end])
            end += 1
        flat = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for j in range(HASHES):
            out[at:end, j] = np.minimum.reduceat((flat ^ XORS[j]) * ODDS[j], starts)
        at = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    b = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), b.shape[:2]).copy()
    for r in range(ROWS):
        h = _mixed(h * MIX + b[:, :, r])
    return h.view(np.int64)


def class_name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """After n values, the fewest matches with which P(similarity >= threshold | matches) is still at least the tolerance (uniform prior)."""
    out = {}
    for n in range(step, hashes + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i], which are few sets in many pairs or few pairs."""
    if len(a) <= 8:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
    used, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    values, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    total = np.zeros((len(used), len(used)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = max(1, 4_000_000 // len(used))
    for lo in range(0, len(values), width):
        s, e = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(used), min(width, len(values) - lo)), dtype=np.float32)
        m[row[s:e], column[s:e] - lo] = 1
        total += m @ m.T
    return total[inverse[: len(a)], inverse[len(a) :]].astype(np.int64)


def share_a_band(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of MinHash values agree in any band."""
    return (x[:, : BANDS * ROWS] == y[:, : BANDS * ROWS]).reshape(len(x), BANDS, ROWS).all(2).any(1)


def _survivors(batches: Iterator[pd.DataFrame], threshold: float, tolerance: float) -> Iterator[pd.DataFrame]:
    """Bands of classes with half the bits of their MinHash values -> each class that some other may resemble, and the first class it hangs together with. Half the bits agree wherever all do, so nothing is lost."""
    least = least_matches(threshold, tolerance)
    for part in whole_groups(batches, ["band"], 5000):
        half = np.frombuffer(b"".join(part["half"]), dtype=np.uint16).reshape(len(part), HASHES)
        left, right = [], []
        for a, b in pairs_within(group_starts(part, ["band"]), 200_000):
            matches = np.zeros(len(a), dtype=np.int64)
            for n in sorted(least):
                matches += (half[a, n - STEP : n] == half[b, n - STEP : n]).sum(1)
                ok = matches >= least[n]
                a, b, matches = a[ok], b[ok], matches[ok]
            left.append(a)
            right.append(b)
        if left and sum(map(len, left)):
            a, b = np.concatenate(left), np.concatenate(right)
            cls, low, at = part["cls"].to_numpy(), roots(len(part), a, b), np.unique(np.concatenate([a, b]))
            yield pd.DataFrame({"u": cls[at], "v": cls[low[at]]})


def candidate_groups(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """classes(cls, bands, half) -> (node, root): the classes that may have a link, and the groups within which all links are."""
    spark = classes.sparkSession
    bands = classes.select("cls", F.explode("bands").alias("band"))
    members = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("cls").alias("v"), F.bit_xor(F.xxhash64("cls")).alias("x1"), F.sum(F.hash("cls").cast("long")).alias("x2")).where("n > 1")
    # aggregates are written before they are joined back, so that Spark can split the join at a hot key
    shared = cut(members.groupBy("n", "v", "x1", "x2").agg(F.min("band").alias("band")).select("band", "n", "v"))
    small = bands.join(shared.where(F.col("n") <= CHUNK).select("band"), "band").join(classes.select("cls", "half"), "cls")
    pruned = small.repartition(shuffle_partitions(spark), "band").sortWithinPartitions("band", "cls").mapInPandas(lambda it: _survivors(it, threshold, tolerance), "u long, v long")
    crowded = bands.join(shared.where(F.col("n") > CHUNK).select("band", "v"), "band").select(F.col("cls").alias("u"), "v")
    return components(pruned.union(crowded))


BLOCK = ["root", "i", "j"]


def _compare(batches: Iterator[pd.DataFrame], threshold: float, tolerance: float) -> Iterator[pd.DataFrame]:
    least = least_matches(threshold, tolerance)
    for part in whole_groups(batches, BLOCK, 1500):
        sig = np.stack([np.frombuffer(x, dtype=np.uint32) for x in part["sig"]])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part["grams"]]
        size = np.array([len(s) for s in sets])
        cls, weight, chunk = (part[c].to_numpy() for c in ("cls", "weight", "chunk"))
        cross = (part["i"] != part["j"]).to_numpy()
        starts = group_starts(part, BLOCK)
        links = np.zeros(len(part), dtype=np.int64)
        left, right = [], []
        for a, b in pairs_within(starts, 200_000):
            ok = ~(cross[a] & (chunk[a] == chunk[b])) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
            a, b = a[ok], b[ok]
            matches = np.zeros(len(a), dtype=np.int64)
            for n in sorted(least):
                matches += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(1)
                ok = matches >= least[n]
                a, b, matches = a[ok], b[ok], matches[ok]
            ok = share_a_band(sig[a], sig[b])
            a, b = a[ok], b[ok]
            block = np.searchsorted(starts, a, side="right")
            for edge in np.split(np.arange(len(a)), np.flatnonzero(np.diff(block)) + 1):
                if len(edge):
                    x, y = a[edge], b[edge]
                    both = _intersections(sets, x, y)
                    ok = both / (size[x] + size[y] - both) >= threshold
                    left.append(x[ok])
                    right.append(y[ok])
        if left and sum(map(len, left)):
            a, b = np.concatenate(left), np.concatenate(right)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            low, at = roots(len(part), a, b), np.flatnonzero(links)
            yield pd.DataFrame({"node": cls[at], "links": links[at], "root": cls[low[at]]})


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, text -> doc_id, class, band keys, half the bits of the MinHash values (null without an id or a word)."""
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo : lo + 500]
            sets = [grams(t) for t in part["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "cls": pd.array([pd.NA] * len(part), dtype="Int64"), "bands": [None] * len(part), "half": [None] * len(part)})
            if "_row" in part:
                out["_row"] = part["_row"].to_numpy()
            if full:
                sig = signatures([sets[i] for i in full])
                out.loc[full, "cls"] = [class_name(sets[i]) for i in full]
                bands, half = out["bands"].to_numpy(copy=True), out["half"].to_numpy(copy=True)
                for i, k, x in zip(full, band_keys(sig), sig.astype(np.uint16)):
                    bands[i], half[i] = k, x.tobytes()
                out["bands"], out["half"] = bands, half
            out.loc[out["doc_id"].isna(), "cls"] = pd.NA
            yield out


def _payload(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets and MinHash values of the documents that stand for their class."""
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo : lo + 500]
            sets = [grams(t) for t in part["text"]]
            ok = [i for i, (s, c) in enumerate(zip(sets, part["cls"])) if len(s) and class_name(s) == c]
            if ok:
                sig = signatures([sets[i] for i in ok])
                yield part.iloc[ok][["cls", "weight", "root", "parts"]].assign(sig=[x.tobytes() for x in sig], grams=[sets[i].tobytes() for i in ok])


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, by_row: bool = False) -> DataFrame:
    """doc_id, n_links, component_id, kept for every row of docs(doc_id, text); by_row also takes and gives a key _row, and gives the component itself (null without a word or an id), which its smallest id need not tell from others."""
    spark = docs.sparkSession
    key = ["_row"] if by_row else []
    docs = docs.select("doc_id", "text", *key)
    rows = cut(docs.mapInPandas(_sketch, f"doc_id {dict(docs.dtypes)['doc_id']}, cls long, bands array<long>, half binary" + ", _row long" * by_row))
    classes = cut(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("weight"), F.any_value("bands").alias("bands"), F.any_value("half").alias("half")))
    groups = candidate_groups(classes, threshold, tolerance)
    crowd = cut(groups.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")))
    asked = groups.join(crowd, "root").join(classes.select(F.col("cls").alias("node"), "low", "weight"), "node").select(F.col("node").alias("cls"), "low", "weight", "root", "parts")
    texts = docs.join(asked, docs["doc_id"] == asked["low"]).select("cls", "weight", "root", "parts", "text")
    payload = texts.mapInPandas(_payload, "cls long, weight long, root long, parts int, sig binary, grams binary")
    dealt = (
        payload.withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(3)), "parts").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("cls", "weight", "sig", "grams", "chunk", "root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    blocks = dealt.repartition(shuffle_partitions(spark), *BLOCK).sortWithinPartitions(*BLOCK, "cls")
    found = cut(blocks.mapInPandas(lambda it: _compare(_distinct(it), threshold, tolerance), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).join(classes.select(F.col("cls").alias("node"), "low"), "node")
    lows = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    of_class = cut(
        classes.select(F.col("cls").alias("node"), "weight", "low").join(links, "node", "left").join(named.select("node", "root").join(lows, "root").select("node", "component_id", *["root"] * by_row), "node", "left")
    )
    out = rows.select("doc_id", *key, F.col("cls").alias("node")).join(of_class, "node", "left")
    return out.select(
        "doc_id",
        F.coalesce(F.col("links") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "low", "doc_id").alias("component_id"),
        *key,
        *[F.coalesce("root", "node").alias("component")] * by_row,
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each class once in a block, also where its document stands in the table several times."""
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        key = list(zip(pdf["root"], pdf["i"], pdf["j"], pdf["cls"]))
        keep = [k != p for k, p in zip(key, [last, *key])]
        last = key[-1]
        yield pdf[keep]


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that a document of the same component with a smaller id stands for; of the rows of a component that share its smallest id one stays. The columns of docs. Rows are told apart by a 64-bit hash of id and text."""
    # the key goes by a name of its own only in what is handed to the join, which reads no other columns
    key = unused(docs, "_row")
    marked = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    linked = cut(jaccard_join(marked.select("doc_id", "text", F.col(key).alias("_row")), by_row=True).where("component IS NOT NULL").select("_row", "component", "kept"))
    stays = linked.where("kept").groupBy("component").agg(F.min("_row").alias("_row")).select("_row")
    gone = linked.select("_row").distinct().join(stays, "_row", "left_anti").withColumnRenamed("_row", key)
    out = marked.join(gone, key, "left_anti")
    again = linked.groupBy("_row").count().where("count > 1").select(F.col("_row").alias(key))
    if not again.isEmpty():
        out = out.join(again, key, "left_anti").unionByName(out.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)
