import random

import numpy as np

from codelake.llm.common import group_starts, pairs_within, roots, whole_groups
from codelake.llm.components import components


def brute(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_against_union_find(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(random.randrange(2000, 2200), random.randrange(2000, 2200)) for _ in range(120)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {n: r for n, r in brute([e for e in edges if e[0] != e[1]]).items()}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_and_roots():
    import pandas as pd

    pdf = pd.DataFrame({"k": [1, 1, 1, 2, 3, 3]})
    starts = group_starts(pdf, ["k"])
    pairs = {(int(a), int(b)) for x, y in pairs_within(starts, 2) for a, b in zip(x, y)}
    assert pairs == {(0, 1), (0, 2), (1, 2), (4, 5)}
    assert roots(5, np.array([3, 1]), np.array([1, 4])).tolist() == [0, 1, 2, 1, 1]
    torn = [pdf.iloc[:2], pdf.iloc[2:5], pdf.iloc[5:]]
    assert [g["k"].tolist() for g in whole_groups(iter(torn), ["k"], rows=2)] == [[1, 1, 1, 2], [3, 3]]
