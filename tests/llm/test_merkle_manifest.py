from hashlib import sha256
from zlib import crc32

import pytest

from codelake.llm import merkle_manifest
from codelake.llm.merkle_manifest import FANOUT, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda s: sha256(s.encode()).hexdigest()


def lower(text):
    return text and text.translate({c: c + 32 for c in range(65, 91)})


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i // FANOUT * FANOUT
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + FANOUT])))
        i //= FANOUT
    return out


def plain(rows):
    """The contract, written out."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            changed = r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0
            d = leaf((*r[:4], lower(r[4]))) if changed else leaf(r)
            for a, b in steps:
                d = H(a + d + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), d, d == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def rows():
    some = [(i, f"s{i % 3}" if i % 2 else "hot", None if i % 7 == 0 else "en", i, f"Text Ä {i}") for i in range(9000)]  # 4500 in one source: more than one block
    odd = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "de", 0, ""), (5, "", "de", 0, "A"), (5, "", "de", 0, "A"), (-3, "one", None, 4, "X" * 100_000), (1 << 60, "é", "x", 2, "ABC"), ((1 << 60) + 1, "z", "x", 2, None)]
    return some + odd + [(10_000 + i, f"only{i}", "en", 1, "B") for i in range(40)]


def test_equals_the_contract_written_out(spark, rows):
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert ordered(got) == ordered(plain(rows))
    assert 0 < sum(not r.verified for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257])
def test_sizes_around_full_runs(n):
    digests = [H(str(i)) for i in range(n)]
    block, tree = merkle_manifest.Block(digests, n), levels(digests)
    assert block.top() == tree[-1][0] and len(block.levels) == len(tree)
    for i in {0, n // 2, n - 1}:
        assert block.siblings(i) == [x for step in path(tree, i) for x in step]
        assert merkle_manifest.fold(digests[i], block.siblings(i)) == block.top()


def test_no_rows_and_other_columns(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "a", "en", 1, "x", 2, "y", 3)], SCHEMA + ", tree int, leaf string, pos int")
    got = manifest(one).collect()
    assert ordered(got) == ordered(plain([(1, "a", "en", 1, "x")])) and got[0].leaf == got[0].subroot == got[0].root
