from hashlib import sha256

import numpy as np
import pytest

from codelake.llm import vector_codes
from codelake.llm.vector_codes import ENTRIES, PARTS, ROUNDS, codes, cuts, reassign

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The contract, written out: all distances of every round."""
    kept = [(i, [int(np.floor(4096 * np.float64(v))) for v in np.array(x, dtype=np.float32)], label) for i, x, label in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1])
    books = [[r[1][s] for r in kept[:ENTRIES]] for s in cuts(n)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[s], e)), k) for k, e in enumerate(books[p])) for p, s in enumerate(cuts(n))] for _, x, _ in kept]

    for _ in range(ROUNDS):
        got = assigned()
        for p, s in enumerate(cuts(n)):
            for k in range(len(books[p])):
                own = [r[1][s] for r, g in zip(kept, got) if g[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    got = assigned()
    digest = sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    return [(r[0], "".join(f"{k:02x}" for _, k in g), e, by[r[2]], digest) for r, g, e in zip(kept, got, errors)]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def some(n, length=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, length))
    return [(i * 3, [float(v) for v in np.float32(centres[i % 6] + r.normal(size=length) * 0.3)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]


def test_equals_all_distances(spark):
    rows = some(300) + [(-1, None, 1), (-2, [1.0] * 15 + [None], 1), (-3, [1.0] * 15 + [float("nan")], 2), (-4, [1.0] * 15 + [float("inf")], 2)]
    rows += [(5, [0.5] * 16, 1)] * 4 + [(None, [0.0] * 16, None), ((1 << 60) + 1, [-0.00001] * 16, None)]
    assert ordered(codes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == ordered(plain(rows))


def test_many_equal_distances(spark):
    """Small whole numbers: ties everywhere, entries that are equal, entries without parts."""
    r = np.random.default_rng(2)
    rows = [(i, [float(v) / 4096 for v in r.integers(-1, 2, 8)], int(i % 2)) for i in range(400)]
    assert ordered(codes(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(plain(rows))


@pytest.mark.parametrize("n", [1, 15, 17])
def test_few_vectors(spark, n):
    rows = some(n, 24)
    assert ordered(codes(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(plain(rows))


def test_pruning_skips_and_never_changes_the_result():
    r = np.random.default_rng(3)
    x = (r.normal(size=(20, 8))[r.integers(0, 20, 5000)] * 4000 + r.normal(size=(5000, 8)) * 300).astype(np.int64)
    entries = x[:ENTRIES].copy()
    code, upper, lower = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.zeros((len(x), ENTRIES))
    done = []
    for _ in range(6):
        done.append(reassign(x, entries, code, upper, lower))
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (upper**2 >= d[np.arange(len(x)), code]).all() and (lower**2 <= d).all()
        new = np.stack([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else entries[k] for k in range(ENTRIES)])
        by = np.sqrt(((new - entries) ** 2).sum(1)) * vector_codes.UP
        upper, lower, entries = (upper + by[code]) * vector_codes.UP, np.maximum(0, lower - by) * vector_codes.DOWN, new
    assert done[-1] < done[0] / 4 < len(x) * ENTRIES / 4


def test_bounds_survive_storage():
    import pandas as pd

    r = np.random.default_rng(4)
    x = r.integers(-9000, 9000, size=(200, 32))
    pdf = pd.DataFrame({"body": [v.astype("<i2").tobytes() for v in x], "code": None})
    b = vector_codes.Bounds(pdf, 32, ENTRIES, "<i2")
    b.update([x[:ENTRIES, s] for s in cuts(32)])
    again = vector_codes.Bounds(pd.DataFrame(b.columns()), 32, ENTRIES, "<i2")
    assert (again.code == b.code).all() and (again.x == x).all()
    assert (again.upper >= b.upper).all() and (again.lower <= b.lower).all() and (again.lower >= b.lower * 0.99 - b.lower.max(2, keepdims=True) / 250).all()


def test_odd_tables(spark):
    assert codes(spark.createDataFrame([], SCHEMA)).collect() == []
    mixed = some(40, 10) + [(1, [1.0, 2.0], 1), (2, [], 1)]  # ten components in eight parts; other lengths go
    got = codes(spark.createDataFrame([(*r, 1, "x") for r in mixed], SCHEMA + ", code int, of string")).collect()
    assert ordered(got) == ordered(plain(some(40, 10))) and len(got[0].code) == 2 * PARTS
    large = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    assert {r.code for r in codes(spark.createDataFrame(large, SCHEMA)).collect()} == {"00" * 8, "01" * 8, "02" * 8}
