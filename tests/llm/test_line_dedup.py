from collections import Counter
from hashlib import sha256
from random import Random

import numpy as np
import pandas as pd
import pytest

from codelake.llm import line_dedup
from codelake.llm.line_dedup import EDGE, GOES, KEY, OPEN, PLACE, stream

SCHEMA = "doc_id long, text string"


def key(line):
    return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})


def plain(rows, least=10):
    split = [(text or "").split("\n") for _, text in rows]
    n = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    kept = [[x for x in lines if n[key(x)] < least] for lines in split]
    return [(doc, len(a), len(a) - len(b), sha256("\n".join(b).encode()).hexdigest()) for (doc, _), a, b in zip(rows, split, kept)]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def corpus():
    r = Random(3)
    common = ["Subscribe now", "ÄÖ  Ünder", "same", "* * *", "nine only", " wide space"]
    rows = []
    for i in range(400):
        lines = [f"line {i} {j}" for j in range(r.randrange(4))] + [r.choice(["", " ", "\t"]) + r.choice([c, c.upper(), c.lower()]) + r.choice(["", "\r"]) for c in common[:4] if r.random() < 0.3]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(1000 + i, "nine only\nrest of it\n") for i in range(9)] + [(1100 + i, "ten\n\nten\nx") for i in range(10)]
    rows += [(2000, None), (None, None), (None, ""), (2001, "\n"), (2002, "same\n" * 5000 + "end"), (2003, "x\r\ny\x0b\n\x1cz")]
    rows += [(3000, "repeated row\nof one id")] * 12 + [(None, "no id\nat all")] * 11 + [(3001, "only nine\ncopies")] * 9
    return rows


def test_equals_the_contract_written_out(spark):
    rows = corpus()
    assert ordered(line_dedup.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()) == ordered(plain(rows))


def test_a_line_of_nearly_all_documents_fills_many_partitions(spark):
    rows = [(i, f"everywhere\nown {i}\nEverywhere ") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = docs.select(*line_dedup.document(), docs["text"].cast("binary").alias("text"))
    by = [*KEY, *PLACE]
    parts = texts.mapInPandas(line_dedup._lines, line_dedup.LINES).repartitionByRange(6, *by).sortWithinPartitions(*by)
    n = [r["count"] for r in parts.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert len(n) == 6 and max(n) < 2 * sum(n) / 6
    assert ordered(line_dedup.digests(docs).collect()) == ordered(plain(rows))


@pytest.mark.parametrize("cuts", [1, 3, 7])
@pytest.mark.parametrize("batch", [1, 2, 5, 1000])
def test_runs_over_batches_and_partitions(cuts, batch):
    """Sorted rows cut anywhere: what the partitions let through, with what the edges add up to, is what whole groups say."""
    r = np.random.default_rng(cuts * 10 + batch)
    docs = {k: r.integers(1, 30) for k in range(12)}
    rows = [(k, -k, d, 0, pos, pos == 0) for k, n in docs.items() for d in range(n) for pos in range(1 + (d % 3))]
    pdf = pd.DataFrame(rows, columns=["k1", "k2", "d1", "d2", "pos", "first"])
    edges, opened, gone = Counter(), [], []
    for part in np.array_split(np.arange(len(pdf)), cuts):
        part = pdf.iloc[part]
        for out in stream((part.iloc[i : i + batch] for i in range(0, len(part), batch)), 10):
            for kind, k1, _, d1, _, pos, n in out.itertuples(index=False):
                if kind == EDGE:
                    edges[k1] += n
                else:
                    (gone if kind == GOES else opened).append((k1, d1, pos))
    got = gone + [x for x in opened if edges[x[0]] >= 10]
    assert sorted(got) == sorted((k, d, pos) for k, _, d, _, pos, _ in rows if docs[k] >= 10)
    assert OPEN not in (GOES, EDGE) and len(set(got)) == len(got)


def test_bitmaps_and_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", keep string, d1 int")
    for r, (_, n, dropped, _) in zip(ordered(line_dedup.keep_bitmaps(docs).collect()), ordered(plain(rows))):
        assert (r[1], r[2]) == (n, dropped)
        stays = np.ones(n, dtype=bool) if r[3] is None else line_dedup.kept_lines(r[3], n)
        assert (~stays).sum() == dropped
    left = line_dedup.without_common_lines(docs)
    assert left.columns == docs.columns
    assert ordered((r.doc_id, sha256((r.text or "").encode()).hexdigest()) for r in left.collect()) == ordered((a, d) for a, _, _, d in plain(rows))
    assert left.where("text IS NULL").count() == 2


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.digests(none).collect() == [] and line_dedup.keep_bitmaps(none).collect() == []
