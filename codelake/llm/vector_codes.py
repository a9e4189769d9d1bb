"""Short codes for vectors: product quantization with Lloyd's algorithm, pruned by the triangle inequality (Elkan, 2003).

Components become integers (floor of 4096 x), vectors are cut into `PARTS` equal parts, and each part position has a
codebook of `ENTRIES` entries that begins as that part of the vectors with the smallest ids. A round assigns every part
to the nearest entry of its codebook and moves the entries to the floor of their parts' mean.

Between rounds each vector keeps, for every part, its entry, an upper bound of the distance to it and one lower bound of
the distance to each entry, in a table that the next round replaces. A moved entry shifts its bounds by as far as it
moved. An entry is skipped only where a bound is strictly greater than the upper bound (its own lower bound, or half of
its distance from the vector's entry); upper bounds are rounded up and lower ones down (to a 255th of the greatest of
their part), so what is skipped is truly farther. All others are compared by whole numbers, and of equal distances the
lower index wins, so the result is that of comparing all. A task sends sums and counts for each entry, never vectors;
the codebooks, `ENTRIES` vectors in size, are all that the driver holds.

Vectors that are null or hold null or non-finite components are dropped, and those of another length than the most
frequent one (the longer of equally frequent ones), which no codebook fits. A length that `PARTS` does not divide is cut
at the floors of its eighths. With fewer than `ENTRIES` vectors codebooks have that many entries. Rows without an id come
last and rows of the same id stand in the order of their integers where the first entries are chosen; each row is coded
on its own. Components whose square sums would not fit 64 bits count as the largest that do (32 768 for 64 components).
An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import Stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are kept this much on the safe side of rounding.
UP, DOWN = 1 + 1e-9, 1 - 1e-9
STATE = "vec_id string, label string, body binary, code binary, upper binary, lower binary, step binary"


def finite(c: str) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    ok = F.forall(F.col(c).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(c).isNotNull() & ok, F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """(rows, length) of floor(4096 x), as far as their squares can be added up."""
    most = isqrt((1 << 60) // max(1, vectors.shape[1]))
    return np.clip(np.floor(vectors * SCALE), -most, most).astype(np.int64)


def cuts(length: int) -> list[slice]:
    at = [length * p // PARTS for p in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:])]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


def half_distances(entries: np.ndarray) -> np.ndarray:
    """Half of the distance between each two entries, rounded down."""
    return np.sqrt(squares(entries[:, None], entries[None]).astype(np.float64)) * (DOWN / 2)


def reassign(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring code, upper and lower (changed in place) of parts x up to date with entries; returns the number of distances computed."""
    half = half_distances(entries)
    open_ = (upper[:, None] >= lower) & (upper[:, None] >= half[code])
    open_[np.arange(len(x)), code] = False
    r = np.flatnonzero(open_.any(1))
    at, own = np.arange(len(r)), code[r]
    exact = squares(x[r], entries[own])
    upper[r], lower[r, own] = np.sqrt(exact) * UP, np.sqrt(exact) * DOWN
    left = open_[r] & (upper[r][:, None] >= lower[r]) & (upper[r][:, None] >= half[own])
    i, j = np.nonzero(left)
    d = squares(x[r[i]], entries[j])
    lower[r[i], j] = np.sqrt(d) * DOWN
    found = np.full((len(r), len(entries)), np.iinfo(np.int64).max)
    found[at, own] = exact
    found[i, j] = d
    best = found.argmin(1)  # the first of equal ones
    code[r], upper[r] = best, np.sqrt(found[at, best]) * UP
    return len(r) + len(d)


class Bounds:
    """What a batch of vectors keeps between rounds."""

    def __init__(self, pdf: pd.DataFrame, length: int, entries: int, kind: str):
        flat = lambda c, t: np.frombuffer(b"".join(pdf[c]), dtype=t)
        n = len(pdf)
        self.kind, self.x = kind, flat("body", kind).reshape(n, length).astype(np.int64)
        if pdf["code"].iloc[0] is None:  # nothing is known yet
            self.code = np.zeros((n, PARTS), dtype=np.int64)
            self.upper = np.full((n, PARTS), np.inf)
            self.lower = np.zeros((n, PARTS, entries))
            return
        self.code = flat("code", np.uint8).reshape(n, PARTS).astype(np.int64)
        self.upper = flat("upper", "<f4").reshape(n, PARTS).astype(np.float64)
        self.lower = flat("lower", np.uint8).reshape(n, PARTS, entries) * flat("step", "<f4").reshape(n, PARTS, 1).astype(np.float64) * DOWN

    def moved(self, by: np.ndarray) -> None:
        """by: how far each entry (part, entry) moved."""
        self.upper += np.take_along_axis(by, self.code.T, axis=1).T
        self.upper *= UP
        self.lower = np.maximum(0, self.lower - by[None]) * DOWN

    def update(self, books: list[np.ndarray]) -> int:
        return sum(reassign(self.x[:, s], b, self.code[:, p], self.upper[:, p], self.lower[:, p]) for p, (s, b) in enumerate(zip(cuts(self.x.shape[1]), books)))

    def columns(self) -> dict[str, list[bytes]]:
        rows = lambda a: [r.tobytes() for r in a]
        up = self.upper.astype("<f4")
        up = np.where(up < self.upper, np.nextafter(up, np.float32(np.inf)), up)
        step = (self.lower.max(2) / 255).astype("<f4")
        # the division is by the step as stored; where it rounded down, the greatest bound is cut to 255 steps
        lower = np.minimum(255, np.floor(self.lower / np.maximum(step, np.float32(1e-30))[:, :, None])).astype(np.uint8)
        return {"body": rows(self.x.astype(self.kind)), "code": rows(self.code.astype(np.uint8)), "upper": rows(up), "lower": rows(lower), "step": rows(step)}


def _moments(length: int, entries: int, kind: str):
    """Sums and counts of the parts of each entry: one row a component of the codebooks for each task."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((entries, length), dtype=np.int64), np.zeros((PARTS, entries), dtype=np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):  # sums of so many are whole numbers in floating point, too
                part = pdf.iloc[lo : lo + 4096]
                x = np.frombuffer(b"".join(part["body"]), dtype=kind).reshape(len(part), length)
                code = np.frombuffer(b"".join(part["code"]), dtype=np.uint8).reshape(len(part), PARTS)
                for p, s in enumerate(cuts(length)):
                    count[p] += np.bincount(code[:, p], minlength=entries)
                    for c in range(s.start, s.stop):
                        total[:, c] += np.bincount(code[:, p], weights=x[:, c], minlength=entries).astype(np.int64)
        of = np.concatenate([np.full(s.stop - s.start, p) for p, s in enumerate(cuts(length))]) if length else np.zeros(0, dtype=np.int64)
        e, c = np.divmod(np.arange(entries * length), max(1, length))
        yield pd.DataFrame({"entry": e, "component": c, "total": total.reshape(-1), "n": count[of[c], e] if length else []})

    return told


def _books(states: DataFrame, books: list[np.ndarray], kind: str) -> list[np.ndarray]:
    """The entries at the floor of their parts' means; entries without parts stay."""
    length, entries = sum(b.shape[1] for b in books), len(books[0])
    told = states.select("body", "code").mapInPandas(_moments(length, entries, kind), "entry int, component int, total long, n long").groupBy("entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    whole = np.concatenate(books, axis=1)
    for entry, component, total, n in told.collect():  # one row for each component of the codebooks
        if n:
            whole[entry, component] = total // n
    return [whole[:, s].copy() for s in cuts(length)]


def train(vectors: DataFrame, stored: Stored, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], str] | None:
    """The vectors' last state, the codebooks by part, and how the integers are kept; None without vectors."""
    kept = vectors.where(finite("embedding")).select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").alias("_id"), F.size("embedding").alias("_size"))
    most = kept.groupBy("_size").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("top")).orderBy(F.desc("n"), F.desc("_size")).first()
    if most is None:
        return None
    length, kind = most["_size"], "<i2" if (most["top"] or 0) * SCALE < 32_000 else "<i4"
    kept = kept.where(F.col("_size") == length)
    # the order of floors is not that of components, so ties of an id are settled by whole numbers
    whole = F.transform("embedding", lambda x: F.floor(x * SCALE))
    first = [r["embedding"] for r in kept.orderBy(F.col("_id").asc_nulls_last(), whole, "embedding").limit(ENTRIES).collect()]
    x = integers(np.array(first, dtype=np.float64).reshape(len(first), length))
    books = [x[:, s].copy() for s in cuts(length)]
    entries = len(first)

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = integers(np.array(pdf["embedding"].tolist(), dtype=np.float64).reshape(len(pdf), length)).astype(kind)
            yield pdf[["vec_id", "label"]].assign(body=[r.tobytes() for r in x], code=None, upper=None, lower=None, step=None)

    def pass_(books: list[np.ndarray], by: np.ndarray):
        def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 4096):
                    part = pdf.iloc[lo : lo + 4096]
                    bounds = Bounds(part, length, entries, kind)
                    bounds.moved(by)
                    bounds.update(books)
                    yield part[["vec_id", "label"]].assign(**bounds.columns())

        return told

    states, by = kept.select("vec_id", "label", "embedding").mapInPandas(bodies, STATE), np.zeros((PARTS, entries))
    for n in range(rounds + 1):
        states = stored.keep(f"round{n}", states.mapInPandas(pass_(books, by), STATE))
        if n:
            stored.drop(f"round{n - 1}")
        if n < rounds:
            before, books = books, _books(states, books, kind)
            by = np.stack([np.sqrt(squares(a, b)) * UP for a, b in zip(before, books)])
    return states, books, kind


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all components, by part, entry and position."""
    return sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector of vectors(vec_id, embedding, label) that is kept."""
    kinds = dict(vectors.dtypes)
    stored = Stored(vectors.sparkSession)
    trained = train(vectors, stored, rounds)
    if trained is None:
        return vectors.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    states, books, kind = trained
    length = sum(b.shape[1] for b in books)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["body"]), dtype=kind).reshape(len(pdf), length).astype(np.int64)
            code = np.frombuffer(b"".join(pdf["code"]), dtype=np.uint8).reshape(len(pdf), PARTS)
            error = sum(squares(x[:, s], b[code[:, p]]) for p, (s, b) in enumerate(zip(cuts(length), books)))
            yield pdf[["vec_id", "label"]].assign(code=[c.hex() for c in pdf["code"]], error=error)

    coded = stored.keep("codes", states.select("vec_id", "label", "body", "code").mapInPandas(told, "vec_id string, label string, code string, error long"))
    # a stored table, so that Spark knows its size before it chooses the join
    sums = stored.keep("labels", coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return met.select(F.col("vec_id").cast(kinds["vec_id"]).alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
