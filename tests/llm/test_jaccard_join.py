import random

import numpy as np
import pytest

from codelake.llm import jaccard_join as J
from codelake.llm.jaccard_join import WORDS


def shingles(text):
    w = WORDS.findall((text or "").lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(n)]
    label = [rows[i][0] for i in range(n)]
    for _ in range(n):
        new = [min([x for x in [label[i], *[label[j] for j in linked[i]]] if x is not None], default=None) for i in range(n)]
        if new == label:
            break
        label = new
    return sorted(((rows[i][0], len(linked[i]), label[i]) for i in range(n)), key=str)


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    words = ["w%d" % i for i in range(500)]
    out = []
    for d in range(25):
        base = [random.choice(words) for _ in range(random.choice([3, 5, 40, 200]))]
        for k in range(random.choice([1, 1, 2, 8])):
            t = base.copy()
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                t[random.randrange(len(t))] = random.choice(words)
            out.append((d * 100 + k, " ".join(t)))
    out += [(9000, None), (9001, ""), (9002, "!!! ..."), (9003, "One two"), (9004, "one TWO!"), (None, out[0][1]), (9005, out[0][1]), (9005, out[0][1]), (9006, " ".join(random.choice(words) for _ in range(30_000)))]
    return out


@pytest.mark.parametrize("chunk", [128, 3])
def test_equals_all_pairs(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, lang string, cls int, weight int")
    got = J.jaccard_join(df).collect()
    assert sorted(((r["doc_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_groups_hold_only_what_may_link(spark):
    # each text shares half of its words with the next: bands may meet now and then, but no pair can reach the threshold
    words = [f"w{i}" for i in range(3000)]
    rows = [(k, " ".join(words[20 * k : 20 * k + 40])) for k in range(100)] + [(1000 + k, " ".join(words[2500:2700] + [f"x{k}"])) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = df.mapInPandas(J._sketch, "doc_id long, cls long, bands array<long>, half binary")
    groups = J.candidate_groups(sketched.select("cls", "bands", "half"), J.THRESHOLD, J.TOLERANCE)
    alike = {r["cls"] for r in sketched.where("doc_id >= 1000").collect()}
    assert {r["node"] for r in groups.collect()} == alike and groups.select("root").distinct().count() == 1
    x = np.arange(2 * J.HASHES, dtype=np.uint32).reshape(2, -1)
    y = x.copy()
    y[0, 1] += 1
    y[1, ::5] += 1
    assert J.share_a_band(x, y).tolist() == [True, False]


def test_one_of_each(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = J.one_of_each(df).collect()
    label = {}
    for i, _, c in brute(rows):
        label.setdefault(c, set()).add(i)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(c for c in label if c is not None)
    assert len([r for r in kept if r["doc_id"] is None]) == 1 and kept[0].asDict().keys() == {"doc_id", "text", "node"}


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(df).count() == 0 and J.one_of_each(df).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = J.least_matches(0.8, 1e-5)
    rng = np.random.default_rng(3)
    lost = sum((np.cumsum(rng.random(128) < 0.8)[[31, 63, 95, 127]] < [least[n] for n in (32, 64, 96, 128)]).any() for _ in range(3000))
    assert lost <= 3 and least[128] > 60
    a, b = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64)), np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    sig = J.signatures([np.union1d(a[:800], b[:200]), np.union1d(a[:800], b[200:400])])
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.15
