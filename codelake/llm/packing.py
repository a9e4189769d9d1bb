"""Packing by lexical retrieval: every window is filled with the unused texts nearest to its seed by BM25.

A document's ids (with an end id) are cut into whole windows, which need no neighbours, and a tail. Tails are sorted by
`HASHES` MinHash values of their ids, so that lexically near ones stand together, and cut into shards of `SHARD_TAILS`; a
shard keeps an inverted index with BM25 weights, whose document frequencies and mean length come from all tails of the
table. The longest unused tail of a shard seeds a window, the index returns its best unused neighbours by the seed's
rarest terms, `NEIGHBOURS` at a time, and they fill the window in that order as long as they fit whole; what then remains
is filled with the first part of the best neighbour left, whose rest goes back into the shard. Only where these are used
up do the next best follow, until none shares a term. So all windows but the last of a shard are full.

Sorting is range partitioning, so a word that all tails have, a group of copies or of equal rows is cut like any other
stretch. A seed sees its shard only: of the ten nearest of all tails it sees two to three times as many as it would in
shards dealt at random (README).

Null texts are empty: a document of the end id alone. Repeated rows are packed as documents of their own. An empty
table gives an empty table, very long texts are cut like others, and other columns are not read. Of neighbours with the
same score, and of seeds of the same length, the order within the shard decides, which is that of ids and texts. Ids are
held in 16 bits; a larger vocabulary is an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.bpe_stream import default_vocabulary, transducer
from codelake.llm.common import cut, shuffle_partitions

WINDOW = 2048
END = 1
SHARD_TAILS = 3000
QUERY_TERMS = 16
NEIGHBOURS = 64
HASHES = 4
K1, B = 1.2, 0.75


class Ids(dict):
    """Word -> its ids as bytes, by the tokenizers library's own model; unknown words are encoded when they come."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.model, self.limit, self.rules = Tokenizer.from_file(path).model, limit, transducer(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        s = word if word.isascii() and word.isprintable() else "".join(self.rules.letter[b] for b in word.encode())
        got = self[word] = np.array([t.id for t in self.model.tokenize(s)], dtype=np.uint16).tobytes()
        return got

    def of(self, text: str | None) -> np.ndarray:
        """The ids of a text, with the end id."""
        out = []
        for part in self.rules.pieces(text):
            if isinstance(part, int):
                out.append(np.uint16(part).tobytes())
            else:
                out.extend(map(self.__getitem__, part))
        return np.frombuffer(b"".join(out) + np.uint16(END).tobytes(), dtype=np.uint16)


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    return Ids(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@lru_cache(maxsize=1)
def orders() -> np.ndarray:
    """Random orders of all ids."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(1 << 16).astype(np.uint16) for _ in range(HASHES)])


def nearness(tail: np.ndarray) -> int:
    """The first id of a tail in each order, as one number: tails with much in common often begin alike."""
    key = 0
    for first in orders()[:, tail].min(axis=1).tolist():
        key = key << 16 | first
    return key >> 1


class Shard:
    """The inverted index of some tails, and the greedy filling of windows."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.left = np.array([len(t) for t in tails])
        terms, counts, owner, self.query = [], [], [], []
        for i, t in enumerate(tails):
            u, c = np.unique(t, return_counts=True)
            w = idf[u] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(t) / mean))
            terms.append(u)
            counts.append(w)
            owner.append(np.full(len(u), i))
            rare = np.argsort(-idf[u], kind="stable")[:QUERY_TERMS]
            self.query.append(u[rare])
        term, weight, who = np.concatenate(terms), np.concatenate(counts), np.concatenate(owner)
        order = np.argsort(term, kind="stable")
        term, self.weight, self.who = term[order], weight[order], who[order]
        self.first = np.searchsorted(term, np.arange(int(term[-1]) + 2))

    def scores(self, seed: int) -> np.ndarray:
        score = np.zeros(len(self.left))
        for t in self.query[seed]:
            a, b = self.first[t], self.first[t + 1]
            score[self.who[a:b]] += self.weight[a:b]
        score[self.left == 0] = 0
        score[seed] = 0
        return score

    def ranked(self, seed: int) -> Iterator[np.ndarray]:
        """The unused tails that share a term with a seed, best first, in blocks of NEIGHBOURS (one may have one more)."""
        score = self.scores(seed)
        top = np.argpartition(-score, min(NEIGHBOURS, len(score) - 1))[: NEIGHBOURS + 1]
        top = top[score[top] > 0]
        yield (best := top[np.lexsort((top, -score[top]))])
        score[best] = 0
        rest = np.flatnonzero(score)
        rest = rest[np.lexsort((rest, -score[rest]))]
        for i in range(0, len(rest), NEIGHBOURS):
            yield rest[i : i + NEIGHBOURS]

    def neighbours(self, seed: int) -> np.ndarray:
        """The best unused tails for a seed, best first; those that share no term are not among them."""
        return next(self.ranked(seed))

    def fill(self, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of (tail, ids of it used before, ids taken)."""
        used = np.zeros(len(self.left), dtype=np.int64)
        by_length = list(np.lexsort((np.arange(len(self.left)), self.left)))

        def take(i: int, n: int) -> tuple[int, int, int]:
            piece = (int(i), int(used[i]), int(n))
            used[i] += n
            self.left[i] -= n
            return piece

        while by_length:
            seed = by_length.pop()
            if not self.left[seed]:
                continue
            room = window - int(self.left[seed])
            pieces = [take(seed, self.left[seed])]
            for near in self.ranked(seed) if room else ():
                for i in near:
                    if 0 < self.left[i] <= room:
                        room -= int(self.left[i])
                        pieces.append(take(i, self.left[i]))
                for i in near:
                    if room and self.left[i]:
                        n = min(room, int(self.left[i]))
                        room -= n
                        pieces.append(take(i, n))
                if not room:
                    break
            while room and by_length:  # nothing near is left: the longest of the rest
                i = by_length[-1]
                if self.left[i]:
                    n = min(room, int(self.left[i]))
                    room -= n
                    pieces.append(take(i, n))
                if not self.left[i]:
                    by_length.pop()
            yield pieces


PIECE = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of docs(doc_id, text)."""
    path = vocabulary or default_vocabulary()
    if max(transducer(path).surface) >= 1 << 16:
        raise ValueError(f"{path} has ids beyond {(1 << 16) - 1}")
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    piece = PIECE.format(kind)

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 34
        ids = ids_of(path)
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part, rows = pdf.iloc[lo : lo + 1000], []
                for d, (doc, text) in enumerate(zip(part["doc_id"], part["text"])):
                    x = ids.of(text)
                    whole = len(x) // window * window
                    for at in range(0, whole, window):
                        rows.append((d, at, window, crc(x[at : at + window]), len(x), 2 * number, 0, None, None))
                        number += 1
                    if whole < len(x):
                        rows.append((d, whole, len(x) - whole, None, len(x), number, 0, x[whole:].tobytes(), nearness(x[whole:])))
                        number += 1
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tail", "near"])
                out["doc_id"] = part["doc_id"].to_numpy()[out["doc_id"]] if len(out) else part["doc_id"]
                out["ids_crc32"], out["near"] = out["ids_crc32"].astype("Int64"), out["near"].astype("Int64")
                yield out

    cuts = cut(docs.mapInPandas(tokenized, f"{piece}, tail binary, near long"))
    tails = cuts.where("tail IS NOT NULL")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, length = np.zeros(1 << 16, dtype=np.int64), 0, 0
        for pdf in batches:
            for t in pdf["tail"]:
                x = np.frombuffer(t, dtype=np.uint16)
                df[np.unique(x)] += 1
                n, length = n + 1, length + len(x)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": [*at, -1, -2], "n": [*df[at], n, length]})

    # at most one row a vocabulary entry, whatever the number of documents
    counted = tails.select("tail").mapInPandas(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]
    total, length = int(counted.get(-1, 0)), int(counted.get(-2, 0))
    df = np.zeros(1 << 16)
    terms = counted[counted.index >= 0]
    df[terms.index] = terms
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = length / max(1, total)
    shards = max(1, math.ceil(total / SHARD_TAILS))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 34
        for pdf in chunks(batches, SHARD_TAILS):
            pdf = pdf.sort_values(["doc_id", "start", "tail"], kind="stable", na_position="first").reset_index(drop=True)
            held = [np.frombuffer(t, dtype=np.uint16) for t in pdf["tail"]]
            rows = []
            for pieces in Shard(held, idf, mean).fill(window):
                offset = 0
                for i, used, took in pieces:
                    rows.append((i, used, took, crc(held[i][used : used + took]), 2 * number + 1, offset))
                    offset += took
                number += 1
            out = pd.DataFrame(rows, columns=["i", "start", "length", "ids_crc32", "sequence_id", "offset"])
            at = out.pop("i").to_numpy()
            out["start"] += pdf["start"].to_numpy()[at]
            yield out.assign(doc_id=pdf["doc_id"].to_numpy()[at], doc_tokens=pdf["doc_tokens"].to_numpy()[at])

    # equal tails by their row, so that no group of copies is a task; their order does not show
    by = ["near", F.xxhash64("doc_id", "tail"), "sequence_id"]
    near = tails.repartitionByRange(min(shards, shuffle_partitions(docs.sparkSession)), *by).sortWithinPartitions(*by).drop("near").mapInPandas(packed, piece)
    return cuts.where("tail IS NULL").drop("tail", "near").unionByName(near)


def chunks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches of rows as they come, joined and cut again to so many rows each; the last two share what is left, if it is less than half."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        while n >= 2 * rows:
            both = pd.concat(held, ignore_index=True)
            yield both.iloc[:rows]
            held, n = [both.iloc[rows:]], n - rows
    if n:
        both = pd.concat(held, ignore_index=True)
        at = rows if 2 * n > 3 * rows else -(-n // 2) if n > rows else n
        yield both.iloc[:at]
        if at < n:
            yield both.iloc[at:]
