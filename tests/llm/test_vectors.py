"""op1 and op3 against brute force."""

import numpy as np
import pytest

from codelake.llm import cross_polytope, prefix_forest

KIND = "vec_id long, embedding array<float>, label int, score string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], KIND)


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] * 15 + [None]), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0])]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:130] = x[7] + rng.normal(size=(30, 16)).astype(np.float32) * 0.02  # near copies
    x[130:150] = x[9]  # copies
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def cosines(vectors):
    x = np.array([v for _, v in vectors], dtype=np.float64)
    n = np.sqrt((x * x).sum(1))
    return (x @ x.T) / (n[:, None] * n)


def test_forest_recall_and_ties(spark, vectors, monkeypatch):
    monkeypatch.setattr(prefix_forest, "SHARD_ROWS", 100)
    monkeypatch.setattr(prefix_forest, "QUERY_ROWS", 50)
    df = table(spark, vectors + ODD)
    got = prefix_forest.search(df, df).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    c = cosines(vectors)
    found = 0
    for q in range(300):
        rows = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(r["vec_id"] != q for r in rows)
        assert all(abs(r["score"] - c[q, r["vec_id"]]) < 1e-12 for r in rows)
        order = [(-r["score"], r["vec_id"]) for r in rows]
        assert order == sorted(order)
        best = np.lexsort((np.arange(300), -np.where(np.arange(300) == q, -2, c[q])))[:5]
        found += len(set(best.tolist()) & {r["vec_id"] for r in rows})
    assert found / 1500 >= 0.9
    # copies: ties go to the smallest ids, and a copy does not return itself
    assert [r["vec_id"] for r in sorted(by[131], key=lambda r: r["rank"])] == [9, 130, 132, 133, 134]
    assert set(by) == set(range(300)) | set()


def test_forest_with_few_rows(spark):
    df = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert [(r["query_id"], r["vec_id"]) for r in prefix_forest.search(df, df).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    assert prefix_forest.search(df.limit(0), df.limit(0)).count() == 0
    assert prefix_forest.search(df.limit(1), df.limit(1)).count() == 0


@pytest.mark.parametrize("chunk", [256, 8])
def test_near_duplicates_against_all_pairs(spark, vectors, monkeypatch, chunk):
    monkeypatch.setattr(cross_polytope, "CHUNK", chunk)
    twice = [(950, vectors[5][1]), (950, vectors[5][1])]  # an id that comes twice
    got = cross_polytope.near_duplicates(table(spark, vectors + twice + ODD)).collect()
    assert len(got) == 300 + 2 + len(ODD)
    rows = vectors + twice
    c = cosines(rows) >= 0.95
    np.fill_diagonal(c, False)
    ids = [i for i, _ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *[label[j] for j in np.flatnonzero(c[i])]]) for i in range(len(rows))]
    want = sorted((ids[i], int(c[i].sum()), min(ids[j] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows)))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] < 900 or r["vec_id"] == 950) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert all(r["n_links"] == 0 and r["kept"] for r in got if 900 <= r["vec_id"] < 907)


def test_near_duplicates_of_nothing(spark):
    assert cross_polytope.near_duplicates(table(spark, []).limit(0)).count() == 0
    assert cross_polytope.near_duplicates(table(spark, ODD)).count() == len(ODD)


@pytest.mark.parametrize("axes", [3, 4])
def test_recall_with_the_axes_of_large_tables(spark, axes):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, 0.9501 * a + np.sqrt(1 - 0.9501**2) * b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cross_polytope.near_duplicates(df, axes=axes).where("n_links > 0").count()
    assert got >= 998  # of 1000 vectors in 500 pairs


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose((cross_polytope.hadamard(x) ** 2).sum(1), (x * x).sum(1))


def test_forest_repeated_ids(spark):
    """Each row asks on its own; rows of its id, and equal rows, answer like any other."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 0.1]), (50, [1.0, 0.1]), (3, [-1.0, 0.0])]
    df = table(spark, rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in prefix_forest.search(df.where("vec_id <> 3"), df).collect())
    x = np.array([v for _, v in table_values(rows)])
    c = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None]
    want = []
    for q in range(4):
        order = sorted((j for j in range(5) if j != q), key=lambda j: (-c[q, j], rows[j][0]))
        want += [(rows[q][0], rank + 1, rows[j][0], round(c[q, j], 6)) for rank, j in enumerate(order)]
    assert got == sorted(want)


def table_values(rows):
    return [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows]
