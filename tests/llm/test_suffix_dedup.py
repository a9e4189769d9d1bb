import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from codelake.llm import queries
from codelake.llm import suffix_dedup as S


def brute(rows, span):
    count = Counter()
    for _, t in rows:
        r = (t or "").encode()
        count.update(r[j : j + span] for j in range(len(r) - span + 1))
    out = []
    for i, t in rows:
        r = (t or "").encode()
        gone = bytearray(len(r))
        for j in range(len(r) - span + 1):
            if count[r[j : j + span]] > 1:
                gone[j : j + span] = b"\1" * span
        runs = sum(1 for j in range(len(r)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(r, gone) if not y)).hexdigest()))
    return sorted(out)


def brute_passages(rows, words):
    texts = [(i, t or "", [m.span() for m in re.finditer(r"\w+", t or "")]) for i, t in rows]
    count = Counter(t[w[j][0] : w[j + words - 1][1]] for _, t, w in texts for j in range(len(w) - words + 1))
    out = []
    for i, t, w in texts:
        gone = [False] * len(t)
        for j in range(len(w) - words + 1):
            a, b = w[j][0], w[j + words - 1][1]
            if count[t[a:b]] > 1:
                gone[a:b] = [True] * (b - a)
        runs = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, runs, sum(len(c.encode()) for c, g in zip(t, gone) if g)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    passages = ["".join(random.choice("abcdefgh ") for _ in range(n)) for n in (399, 400, 401, 450, 800)]
    out = []
    for k in range(60):
        t = "".join(random.choice("xyz ") for _ in range(random.randrange(0, 900)))
        for p in random.sample(passages, 2):
            t += p[random.randrange(0, 20) :] + "".join(random.choice("uvw") for _ in range(random.randrange(0, 300)))
        out.append((k, t))
    return out + [(200, None), (201, ""), (202, "from " * 1000), (203, "é" * 700), (204, out[5][1]), (204, out[5][1]), (205, "from " * 90 + "x"), (206, "".join(random.choice("pqrs") for _ in range(60_000)))]


@pytest.mark.parametrize(("bucket", "slab"), [(20_000, 1 << 20), (5, 1 << 20), (20_000, 1000)])
def test_equals_every_window(spark, rows, monkeypatch, bucket, slab):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(S, "SLAB", slab)
    if slab != 1 << 20:  # executors of a local session run the module anew, so slabs are compared here
        raw = np.frombuffer(rows[-1][1].encode(), dtype=np.uint8)
        m, a, b, _, _ = S.anchors(raw)
        assert a[0] == 0 and b[-1] == len(raw) - S.SPAN and (a[1:] == b[:-1] + 1).all() and (m >= b).all() and (m <= a + S.SPAN - S.LEAD).all()
        return
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rid int, m int").repartition(5)
    got = S.digests(df, words=51).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows, 400)
    assert sorted((r["doc_id"], r["n_passages"], r["n_passage_bytes"]) for r in got) == brute_passages(rows, 51)


def test_text_without_repeats(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = S.without_repeats(df)
    assert out.columns == df.columns
    want = {i: (n - gone) for i, n, gone, _, _ in brute(rows, 400)}
    for r in out.collect():
        assert (r["text"] is None) == (r["doc_id"] == 200)
        assert abs(len((r["text"] or "").encode()) - want[r["doc_id"]]) <= 4 and r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_other_columns_keep_their_values(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "s", 2, "p", "r") for i, t in rows[:20] + rows[5:6]], "doc_id long, text string, rid long, spans string, m int, passages string, rest string")
    for out in (S.without_repeats(df), S.without_repeats(df, words=51)):
        assert out.columns == df.columns and out.count() == 21
        assert {tuple(r)[2:] for r in out.collect()} == {(7, "s", 2, "p", "r")}
    with pytest.raises(ValueError):
        S.without_repeats(df, words=10)


def test_a_group_of_copies_and_periodic_texts(spark):
    random.seed(9)
    base = "".join(random.choice("abcdefghij ") for _ in range(3000))
    rows = [(k, base) for k in range(40)] + [(100 + k, base[: 1000 + k] + "".join(random.choice("xyz") for _ in range(700)) + base[1200 + 9 * k :]) for k in range(30)]
    rows += [(200, "ab" * 4000), (201, "ab" * 300 + "c" + "ab" * 300), (202, "x" * 5000), (203, base + base[:700]), (204, "y" + base[5:450])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r)[:5] for r in S.digests(df).collect()) == brute(rows, 400)


def test_terse_strings_of_words():
    raw = lambda t: np.frombuffer(t.encode(), dtype=np.uint8)
    for text in ("a " * 51, "ä—b " * 51, "日" * 60, "ab " * 20 + "x y " * 26):
        assert S.may_be_terse(raw(text), 51, 203)
    assert not S.may_be_terse(raw("a " * 50), 51, 203) and not S.may_be_terse(raw("word " * 400), 51, 203) and not S.may_be_terse(raw(""), 51, 203)


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(df).count() == 0 and S.without_repeats(df).count() == 0


def test_multikey_quicksort():
    random.seed(5)
    keys = [bytes(random.choice(b"ab") for _ in range(random.randrange(1, 40))) for _ in range(6000)] + [b"a" * 39] * 200
    order, common = S.sorted_with_prefixes(keys)
    got = [keys[i] for i in order]
    padded = lambda k: k.ljust(40, b"\0")
    assert [padded(k) for k in got] == sorted(padded(k) for k in keys)
    assert all(S.common_prefix(x, y) == c for x, y, c in zip(got, got[1:], common))


def test_query_catches_passages_shorter_than_the_span(spark, tmp_path):
    random.seed(11)
    own = lambda n: " ".join("".join(random.choice("abcdefghijklmnop") for _ in range(random.randrange(3, 9))) for _ in range(n))
    passages = [own(51 + k) for k in range(5)] + [own(50), "é—ü " * 25 + "x"]
    assert all(len(p.encode()) < 400 for p in passages)
    rows = [(10 * k + i, f"{own(40 + 30 * i)} {p} {own(90 - 20 * i)}") for k, p in enumerate(passages) for i in range(3)]
    rows += [(100 + i, own(200)) for i in range(10)] + [(200, None), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows, 400) and not any(r["n_removed"] for r in got)
    assert sorted((r["doc_id"], r["n_passages"], r["n_passage_bytes"]) for r in got) == brute_passages(rows, 51)
    assert {r["doc_id"] for r in got if r["n_passages"]} == {10 * k + i for k in (0, 1, 2, 3, 4, 6) for i in range(3)}  # one has 50 words


@pytest.mark.parametrize(("slab", "together"), [(1 << 17, 1 << 15), (7, 1 << 15), (1 << 17, 10)])
def test_strings_of_words(monkeypatch, slab, together):
    monkeypatch.setattr(S, "SLAB", slab)
    monkeypatch.setattr(S, "TOGETHER", together)
    random.seed(13)
    texts = ["".join(random.choice("ab_é日½ -\n\0😀") for _ in range(random.randrange(200))) for _ in range(40)] + ["", "a", "-" * 30, "ab " * 30]
    words = [[(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(r"\w+", t)] for t in texts]
    want = [(i, w[j][0], w[j + 4][1]) for i, w in enumerate(words) for j in range(len(w) - 4)]
    n, lo, hi, h1, h2 = S.strings_of_words(texts, 5)
    assert list(zip(n.tolist(), lo.tolist(), hi.tolist())) == want
    strings = [texts[i].encode()[a:b] for i, a, b in want]
    assert len(set(zip(h1.tolist(), h2.tolist()))) == len(set(strings)) == len(set(zip(strings, h1.tolist(), h2.tolist())))
    # runs cover the same strings, each once
    n, lo, hi, *_ = S.strings_of_words(texts, 5, 2)
    m, a, b, *_ = S.strings_of_words([texts[i].encode()[x:y].decode() for i, x, y in zip(n, lo, hi)], 5)
    assert list(zip(n[m].tolist(), (lo[m] + a).tolist(), (lo[m] + b).tolist())) == want
    assert all(len(x) == 0 for x in S.strings_of_words([], 5))
