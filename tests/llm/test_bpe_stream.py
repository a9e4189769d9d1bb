import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import bpe_stream

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe_stream.default_vocabulary()
    return bpe_stream.Transducer(path), tokenizers.Tokenizer.from_file(path)


def expected(lib, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


CASES = ["", " ", "Hello wörld's <|endoftext|> ΑΣ 12 x", "don't'Re İstanbul ﬀ é <|startoftext|><|endoftext|>x", "日本語テキスト😀😀 \x1c\x1d a\x00b​", "²½ⅷ٣", "ß" * 500, "a" * 5000, "ha" * 2001, "a_b__c  d", "''s's 'sabc", "😀" * 700, "é É"]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(both, text):
    assert both[0].digest(text) == expected(both[1], text)


def test_long_words_of_tokens(both):
    random.seed(2)
    t, lib = both
    parts = [s for s in t.vocab if "</w>" not in s and s.isascii() and s.isalpha()]
    for _ in range(40):
        word = "".join(random.choice(parts) for _ in range(500))
        assert t.digest(word) == expected(lib, word)


def test_letters_of_many_scripts(both):
    random.seed(4)
    t, lib = both
    for top in (0x100, 0x250, 0x2100, 0x3100, 0x1F650):
        for _ in range(60):
            codes = [random.choice([random.randrange(0x20, top), random.randrange(0x20, 0x100)]) for _ in range(80)]
            text = "".join(chr(c) for c in codes if not 0xD800 <= c < 0xE000)
            assert t.digest(text) == expected(lib, text)


def test_chunks_do_not_matter(both, monkeypatch):
    monkeypatch.setattr(bpe_stream, "CHUNK", 7)
    for text in CASES:
        assert both[0].digest(text) == expected(both[1], text)


def test_decoder_states(both):
    t, lib = both
    text = "grüße 日本 ok"
    ids = lib.encode(text, add_special_tokens=False).ids
    assert "".join(t.decode(ids)) == lib.decode(ids, skip_special_tokens=False)
    assert "".join(t.readable(ids)).strip() == "grüße 日本 ok"
    for step in (1, 2, 5):
        state = bpe_stream.Decoder(t)
        parts = [ids[i : i + step] for i in range(0, len(ids), step)]
        assert b"".join(state.surfaces(p) for p in parts).decode() == lib.decode(ids, skip_special_tokens=False)
        assert "".join(state.text(p) for p in parts) + state.text((), final=True) == "grüße 日本 ok "
    odd = [ids[0], 10**6, -1, *ids[1:]]
    assert bpe_stream.Decoder(t).surfaces(odd) == bpe_stream.Decoder(t).surfaces(ids) and bpe_stream.Decoder(t).text(odd) == bpe_stream.Decoder(t).text(ids)
    # what the query hashes: the words, each with a space after it
    assert t.digests(text)[3] == hashlib.sha256("grüße 日本 ok ".encode()).hexdigest()


def test_tables(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "x"), (2, "a b", "y"), (2, "a b", "y"), (3, "", None)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in bpe_stream.digests(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == got[3]["decoded_sha256"] == empty and got[2]["n_tokens"] == 2
    assert bpe_stream.digests(docs).count() == 4 and bpe_stream.digests(docs.limit(0)).count() == 0
    back = bpe_stream.decode(bpe_stream.encode(docs.where("doc_id = 2"))).first()
    assert back["decoded"] == "a</w> b</w>" and len(back["ids"]) == 2
    lib = tokenizers.Tokenizer.from_file(bpe_stream.default_vocabulary())
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in bpe_stream.digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(lib, texts[r["doc_id"]] or "")


def test_lookahead_bounds_a_small_merge_list():
    assert bpe_stream.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2 + 2
    assert F  # the module is used through Spark above
