"""op7 to op10 and the pipeline."""

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from codelake.llm import byte_cnn, importance, jaccard_join, license_scan, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


# -- op7 -------------------------------------------------------------------

def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "was", "old", "and", "small", "trees", "grew", "there"]) for _ in range(n))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        t = prose(rng, rng.choice([20, 80, 300]))
        if i % 5 == 0:
            t += " idiot " + prose(rng, 5)
        if i % 7 == 0:
            t = t.replace(" ", "$$$ ")
        rows.append((i, t))
    rows += [(2000, None), (2001, ""), (2002, prose(rng, 20_000)), (2003, rows[1][1]), (2003, rows[1][1]), (None, rows[1][1])]
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0), "x") for i in range(0, 900, 2)] + [(None, 1, 0, "x"), (2003, None, None, "x"), (3, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    return docs_of(spark, rows), labels


def test_bad_text_is_not_sampled(graded):
    is_bad = lambda i: i is not None and i < 900 and (i % 5 == 0 or i % 7 == 0)
    got = importance.resample(*graded).collect()
    assert len(got) == 906
    # drawn in proportion to the weights: clean texts stay but for a few, bad ones go but for a few
    assert sum(r["selected"] == is_bad(r["doc_id"]) for r in got) <= 0.03 * len(got)
    assert max(r["log_weight"] for r in got if is_bad(r["doc_id"])) < -2 < -1 < min(r["log_weight"] for r in got if not is_bad(r["doc_id"]))
    assert importance.resample(*graded).collect() == got  # the same sample when drawn again
    assert importance.selected(*graded).count() == sum(r["selected"] for r in got)


def test_ratios_equal_a_plain_count(graded):
    docs, labels = graded
    buckets, ratios = importance.fit(docs, labels)
    good = {r["doc_id"]: bool(r["quality"] == 1 and not r["toxic"]) for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    target, raw, n = np.zeros(2 * importance.BUCKETS), np.zeros(2 * importance.BUCKETS), [0, 0]
    for r in docs.collect():
        if r["doc_id"] in good:
            f = importance.features(r["text"])
            raw[f] += 1
            target[f] += good[r["doc_id"]]
            n[0] += 1
            n[1] += good[r["doc_id"]]
    part = n[1] / n[0]
    smooth = np.where(np.arange(len(raw)) < importance.BUCKETS, importance.SMOOTH, importance.SMOOTH_PAIRS)
    want = np.log((target + smooth * part) / (part * (raw + smooth)))
    at = np.flatnonzero((np.abs(want) >= importance.DEAD) & (raw > 0))
    assert sorted(buckets.tolist()) == at.tolist() and np.allclose(ratios[np.argsort(buckets)], want[at], atol=1e-5)


def test_selection_equals_a_plain_computation(spark, graded):
    docs, labels = graded
    got = importance.resample(docs, labels).collect()
    grade = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            grade[r["doc_id"]] = grade.get(r["doc_id"], True) and r["quality"] == 1 and not r["toxic"]
    rows = [(r["doc_id"], importance.features(r["text"])) for r in docs.collect()]
    target, raw, n = {}, {}, [0, 0]
    for i, f in rows:
        if i in grade:
            n[0] += 1
            n[1] += grade[i]
            for b in f.tolist():
                raw[b] = raw.get(b, 0) + 1
                target[b] = target.get(b, 0) + grade[i]
    part, weight, mean, square = n[1] / n[0], {}, [0.0, 0.0], [0.0, 0.0]
    support = {b: c / (c + (importance.SUPPORT if b < importance.BUCKETS else importance.SUPPORT_PAIRS)) for b, c in raw.items()}
    for b, c in raw.items():
        s = importance.SMOOTH if b < importance.BUCKETS else importance.SMOOTH_PAIRS
        weight[b] = math.log((target[b] + s * part) / (part * (c + s))) * support[b]
    for kind in (0, 1):
        mine = [b for b in raw if (b >= importance.BUCKETS) == kind]
        centre = importance.CENTRE * sum(target[b] * weight[b] for b in mine) / sum(target[b] * support[b] for b in mine)
        for b in mine:
            weight[b] -= centre * support[b]
        mean[kind], square[kind] = sum(weight[b] for b in mine) / importance.BUCKETS, sum(weight[b] ** 2 for b in mine) / importance.BUCKETS
    score = []
    for _, f in rows:
        k = [int((f < importance.BUCKETS).sum()), int((f >= importance.BUCKETS).sum())]
        score.append((sum(weight.get(b, 0.0) for b in f.tolist()) - k[0] * mean[0] - k[1] * mean[1]) / math.sqrt(1 + k[0] * square[0] + k[1] * square[1]))
    noise = [r["g"] for r in docs.select(importance.gumbel(F.col("doc_id"), 1).alias("g")).collect()]
    size = round(sum(min(1.0, math.exp(x + importance.SLACK)) for x in score))
    order = sorted(range(len(rows)), key=lambda i: (-round((score[i] + noise[i]) * 2**24), rows[i][0] if rows[i][0] is not None else 2**63))
    want = sorted(((rows[i][0] if rows[i][0] is not None else -1), True) for i in order[:size])
    assert np.allclose(sorted(r["log_weight"] for r in got), sorted(score), atol=1e-3)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, True) for r in got if r["selected"]) == want


def test_clashing_columns(spark, graded):
    docs, labels = graded
    extra = docs.limit(40).withColumns({"_row": F.lit(1), "selected": F.lit("x"), "_language": F.lit(2.5), "key": F.lit(3)})
    for out in (importance.selected(extra, labels), byte_cnn.confident(extra.withColumn("lang", F.lit("en"))), jaccard_join.one_of_each(extra)):
        assert out.columns == extra.columns and {(r["_row"], r["selected"], r["_language"], r["key"]) for r in out.collect()} == {(1, "x", 2.5, 3)}
    assert license_scan.scans(extra.withColumn("labels", F.lit(1))).count() == 40 and packing.pack(extra.withColumn("tail", F.lit(1))).count() >= 40


def test_ngrams_speak_for_a_text_too(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        rows.append((i, prose(rng, 60) + (" lantern harbour" if good and i % 3 else "") + (" gloomy" if not good and i % 8 else "")))
        labels.append((i, int(good), 0))
    rows += [(900, "lantern harbour lantern harbour"), (901, "gloomy"), (902, "lantern harbour"), (903, "quite unseen text"), (904, None)]
    got = {r["doc_id"]: r["log_weight"] for r in importance.resample(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[902] > 0.1 and got[900] > 0.1 and got[901] < -1 and abs(got[903]) < 0.1 and got[904] == 0


def test_long_texts_are_not_judged_by_collisions(spark):
    # bad words are common among the labelled rows, and a long text of unseen words hits many of their buckets
    rng = random.Random(9)
    words = [f"bad{i}" for i in range(300)]
    rows = [(i, prose(rng, 40) + (" " + " ".join(words) if i % 4 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    rows += [(1000 + n, " ".join(f"new{k}w{n}" for k in range(50_000 if n < 4 else 200_000))) for n in range(6)]
    got = {r["doc_id"]: r for r in importance.resample(docs_of(spark, rows), labels).collect()}
    assert all(got[1000 + n]["selected"] for n in range(6))
    assert not any(got[i]["selected"] for i in range(0, 240, 4)) and all(got[i]["selected"] for i in range(240) if i % 4)


def test_gumbel_top_k(spark):
    keys = [random.Random(1).randrange(-(2**40), 2**40) for _ in range(500)] + [7] * 20
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 3, 260, 520):
        assert importance.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    noise = [r["g"] for r in spark.range(5000).select(importance.gumbel(F.col("id"), 1).alias("g")).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.06 and abs(np.var(noise) - np.pi**2 / 6) < 0.15


def test_without_labels_or_rows(spark, graded):
    docs, labels = graded
    assert all(r["selected"] for r in importance.resample(docs, labels.limit(0)).collect())
    assert importance.resample(docs.limit(0), labels).count() == 0


# -- op8 -------------------------------------------------------------------

LICENSED = ["", None, "Released under the MIT License.", "x Relesed undr the MIT Licence. and Apache  License; mit-license", "mitlicense mit licenses", "GENERAL\npublic LICENSE general public", "licensed under cc by nc 4.0", "Ä" * 10 + " MIT license é", "word " * 20_000 + "licensed under the apache license, version 2.0",
            "permission is hereby granted free of charge to any person obtaining a copy", "nothing here at all"]


def test_licences_against_a_search_of_the_whole_text(spark):
    got = {r["doc_id"]: r for r in license_scan.scans(docs_of(spark, list(enumerate(LICENSED)))).collect()}
    for i, t in enumerate(LICENSED):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        fuzzy = {label for text, label in license_scan.NOTICES if regex.search(rf"(?:{regex.escape(text, literal_spaces=True)}){{e<={len(text) // 10}}}", low)}
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and r["labels"] == ",".join(sorted({x for _, x in places} | fuzzy))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        assert all(s["edits"] <= 8 and low[s["start"] : s["end"]] for s in r["spans"])
    assert license_scan.scans(docs_of(spark, [])).count() == 0


# -- op9 -------------------------------------------------------------------

def test_packing_covers_every_id_once(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "straße", "日本"]) for _ in range(rng.choice([0, 3, 300, 2047, 2500, 9000]))) for _ in range(120)] + [None, "<|endoftext|> x", "a" * 30_000]
    rows = list(enumerate(texts))
    monkeypatch.setattr(packing, "SHARD_TAILS", 40)
    got = packing.pack(docs_of(spark, rows + rows[5:6])).toPandas()
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = got[got["doc_id"] == i]
        assert (own["doc_tokens"] == len(ids)).all()
        assert own["length"].sum() == len(ids) * (2 if i == 5 else 1)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own["start"], own["length"], own["ids_crc32"]))
        if i != 5:
            own = own.sort_values("start")
            assert own["start"].tolist() == [0, *(own["start"] + own["length"]).tolist()[:-1]]
    padded = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = int(s["length"].sum())
        assert total <= 2048 and s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        padded += 2048 - total if total & (total - 1) else 0
    assert padded <= 2048 * 8
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_neighbours_are_lexical():
    a, b = np.array([5, 6, 7, 8] * 20, dtype=np.uint16), np.array([15, 16, 17, 18] * 20, dtype=np.uint16)
    tails = [a, b, a[:70], b[:70], a[:60]]
    idf = np.ones(1 << 16, dtype=np.float32)
    shard = packing.Shard(tails, idf, 70.0)
    assert set(shard.neighbours(0).tolist()) == {2, 4} and set(shard.neighbours(1).tolist()) == {3}
    first = next(packing.Shard(tails, idf, 70.0).fill(window=210))
    assert {i for i, _, _ in first} in ({1, 3, 0}, {0, 2, 4}) and sum(n for _, _, n in first) == 210


def test_neighbours_equal_plain_bm25():
    rng = np.random.default_rng(8)
    tails = [rng.integers(0, 60, rng.integers(5, 80)).astype(np.uint16) for _ in range(50)]
    held = [set(t.tolist()) for t in tails]
    df = np.array([sum(i in h for h in held) for i in range(1 << 16)])
    idf = np.log(1 + (len(tails) - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = float(np.mean([len(t) for t in tails]))
    shard = packing.Shard(tails, idf, mean)
    for seed in range(0, 50, 7):
        terms = sorted(held[seed], key=lambda i: (-idf[i], i))[: packing.QUERY_TERMS]
        plain = []
        for j, t in enumerate(tails):
            tf = {i: int((t == i).sum()) for i in terms}
            plain.append(sum(float(idf[i]) * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(t) / mean)) for i, c in tf.items() if c))
        plain[seed] = 0
        want = [j for j in np.lexsort((np.arange(50), -np.array(plain))) if plain[j] > 0]
        got = shard.neighbours(seed).tolist()
        assert sorted(got) == sorted(want) and all(abs(plain[x] - plain[y]) < 1e-4 for x, y in zip(got, want))


def test_windows_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 900)))) for i in range(60)]
    a, b = (packing.pack(docs_of(spark, rows).repartition(n)).toPandas() for n in (1, 7))
    window = lambda df: sorted(tuple(sorted(zip(g["doc_id"], g["start"], g["length"], g["offset"]))) for _, g in df.groupby("sequence_id"))
    assert window(a) == window(b)


# -- op10 ------------------------------------------------------------------

def test_held_out_accuracy_and_odd_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs_of(spark, [(-1, None), (-2, ""), (-3, "123 !!!"), (-4, "and the of " * 20_000), (None, "und der die")])
    got = byte_cnn.identify(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)).collect()
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in true]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) >= 0.9
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and by[-1]["score"] == 0 and by[-4]["lang_pred"] in set(true.values())
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(true) + 5
    assert byte_cnn.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in byte_cnn.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pair_tables_equal_the_plain_convolution():
    rng = np.random.default_rng(2)
    net = byte_cnn.Network({w: rng.normal(size=(w, byte_cnn.CLASSES, byte_cnn.FILTERS)) for w in byte_cnn.WIDTHS}, np.zeros(24), rng.normal(size=(24, 2)), np.zeros(2), ["a", "b"])
    net.prepare()
    x = byte_cnn.windows("Größe und Höhe".encode() * 60)
    want = np.concatenate([np.stack([sum(t[k][x[:, i + k]] for k in range(w)) for i in range(byte_cnn.WINDOW - w + 1)]).max(0) for w, t in net.tables.items()], axis=1)
    assert np.allclose(net.pooled(x), np.maximum(want, 0), atol=1e-4)
    assert byte_cnn.windows(b"").shape == (1, byte_cnn.WINDOW) and len(byte_cnn.windows(b"x" * 1025)) == 3


# -- pipeline --------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == start.columns
            assert after.count() >= 0.5 * docs.count()
        docs, before = after, docs
    pieces = docs.toPandas()
    lengths = pieces.groupby("doc_id")["length"].sum()
    assert (lengths == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)


def test_rows_are_judged_not_ids(spark, graded):
    docs, labels = graded
    rng = random.Random(21)
    bad, clean = prose(rng, 40).replace(" ", "$$$ ") + " idiot idiot", [prose(rng, 40) for _ in range(3)]
    rows = [(None, clean[0]), (None, clean[1]), (None, bad), (5000, clean[2]), (5000, bad)]
    got = importance.selected(docs.unionByName(docs_of(spark, rows)), labels).where("doc_id IS NULL OR doc_id = 5000").collect()
    assert {(None, clean[0]), (None, clean[1]), (5000, clean[2])} <= {(r["doc_id"], r["text"]) for r in got} and bad not in {r["text"] for r in got}

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, d), (5, d), (6, c + " z"), (7, b), (8, a), (8, a), (None, a), (None, a)]
    got = jaccard_join.one_of_each(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (2, b), (4, c), (4, d), (0, a), (0, a)])


def test_passages_of_more_than_fifty_words_go(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeoßé") for _ in range(rng.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for k, n in enumerate([30, 45, 50, 51, 52, 55, 58, 60, 51, 80]):
        passage = " ".join(rng.choice("abcdefgh") for _ in range(n)) if k == 8 else text(n)  # 51 words of one letter too
        for half in (0, 1):
            before, after = text(70) + f" x{k}{half} ", f" y{k}{half} " + text(70)
            rows.append((2 * k + half, before + passage + after))
            want[2 * k + half] = before + ("" if n > 50 else passage) + after
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs_of(spark, rows), "").collect()}
    assert got == want


def test_pipeline_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_packing_deals_near_tails_together():
    """Of the nearest tails of all, more are in the seed's shard than by chance, and copies are next to each other."""
    rng = np.random.default_rng(9)
    topics = [rng.choice(40_000, 300, replace=False) for _ in range(8)]
    tails = [rng.choice(topics[i % 8], 120).astype(np.uint16) for i in range(800)]
    order = np.argsort([packing.nearness(t) for t in tails], kind="stable")
    shard = np.empty(800, dtype=int)
    shard[order] = np.arange(800) // 100
    share = np.mean([(shard[[j for j in range(i % 8, 800, 8) if j != i]] == shard[i]).mean() for i in range(200)])
    assert share > 0.25  # 0.125 by chance
    assert packing.nearness(tails[5]) == packing.nearness(tails[5][::-1])


def test_packing_walks_on_past_the_first_neighbours():
    """A seed whose nearest tails are all short takes the next best, not the longest of the rest."""
    tails = [np.arange(100, 150, dtype=np.uint16)] + [np.array([100 + i % 16], dtype=np.uint16) for i in range(200)] + [np.full(40, 9, dtype=np.uint16)]
    idf = np.ones(1 << 16, dtype=np.float32)
    first = next(packing.Shard(tails, idf, 5.0).fill(window=200))
    assert sum(n for _, _, n in first) == 200 and 201 not in {i for i, _, _ in first}


@pytest.mark.parametrize("n", [0, 1, 5, 6, 9, 10, 11, 14, 15, 16, 40])
@pytest.mark.parametrize("batch", [1, 3, 100])
def test_packing_chunks(n, batch):
    rows = pd.DataFrame({"a": range(n)})
    got = list(packing.chunks((rows.iloc[i : i + batch] for i in range(0, n, batch)), 10))
    assert [x for g in got for x in g["a"]] == list(range(n)) and all(0 < len(g) <= 15 for g in got)
    assert all(len(g) >= 5 for g in got) or n < 10
