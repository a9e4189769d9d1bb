"""Lines that many documents share, as a compressed bitmap of the lines that stay for every document.

A line's key is the line without white space at its ends, A-Z in lower case; empty keys are never common. Hashes of keys
(128 bits), each with its document and its position, are sorted by range partitioning on all three, so that a key of any
frequency spreads over as many partitions as its rows fill. Each partition streams through its runs of equal hashes and
counts the first occurrences of a key in its documents. A run holds back rows only until it has `LEAST` documents, and
then lets the rest through; the runs at a partition's edges, which may go on next door, are counted together afterwards
(at most two a partition, of fewer than `LEAST` documents each). What goes is gathered by document into a bitmap: bit i
(most significant bit first) is 0 where line i goes, and lines beyond its end stay. Texts are read, and meet only their
bitmaps.

A document is a row: rows with equal ids and texts count as often as they come, as do rows without an id. Null and empty
texts are one empty line. Texts may be of any length, though one text's lines are split in memory; an empty table gives
an empty table, and other columns are not read (`without_common_lines` hands them on).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from codelake.llm.common import Stored, group_starts, shuffle_partitions, unused

LEAST = 10
SPACE = b" \t\n\x0b\x0c\r"
KEY, PLACE = ["k1", "k2"], ["d1", "d2", "pos"]
LINES = "k1 long, k2 long, d1 long, d2 long, pos int, first boolean"
#: kind 0: a line that goes; 1: a line of a run at an edge that has too few documents so far; 2: the documents of a run at an edge
FOUND = "kind int, k1 long, k2 long, d1 long, d2 long, pos int, n long"
GOES, OPEN, EDGE = 0, 1, 2


def keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]


def document(doc: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits that tell documents apart, except those of equal id and text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.col(doc), whole).alias("d1"), F.xxhash64(F.lit(1), whole, F.col(doc)).alias("d2")]


def _lines(batches: Iterator[pd.DataFrame], most: int = 100_000) -> Iterator[pd.DataFrame]:
    """Each line's key, hashed, with its place and whether its document has the key for the first time."""
    places, hashes, first, n = [], [], [], 0

    def told() -> pd.DataFrame:
        k = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
        d1, d2, pos = (np.concatenate(x) for x in zip(*places))
        return pd.DataFrame({"k1": k[:, 0], "k2": k[:, 1], "d1": d1, "d2": d2, "pos": pos, "first": np.array(first, dtype=bool)})

    for pdf in batches:
        for d1, d2, text in zip(pdf["d1"].to_numpy(), pdf["d2"].to_numpy(), pdf["text"]):
            seen: dict[bytes, bytes] = {}
            at = []
            for i, key in enumerate(keys(text)):
                if not key:
                    continue
                h = seen.get(key)
                first.append(h is None)
                if h is None:
                    h = seen[key] = xxhash.xxh3_128_digest(key)
                hashes.append(h)
                at.append(i)
            if at:
                places.append((np.full(len(at), d1), np.full(len(at), d2), np.array(at, dtype=np.int32)))
                n += len(at)
            if n >= most:
                yield told()
                places, hashes, first, n = [], [], [], 0
    if n:
        yield told()


def _rows(kind: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows to hand on, without those that repeat the one before (equal documents)."""
    own = pdf.iloc[group_starts(pdf, KEY + PLACE)[:-1]]
    return own.assign(kind=kind, n=0)[["kind", *KEY, *PLACE, "n"]]


def stream(batches: Iterator[pd.DataFrame], least: int = LEAST) -> Iterator[pd.DataFrame]:
    """Sorted rows of LINES of one partition -> FOUND."""
    held, count, at_edge = None, 0, True  # of the run that is not over: its rows while it has too few documents; whether it is the partition's first

    def edge(key: tuple[int, int], n: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": [EDGE], "k1": [key[0]], "k2": [key[1]], "d1": [0], "d2": [0], "pos": [0], "n": [n]})

    key = None
    for pdf in batches:
        if not len(pdf):
            continue
        if key is not None and count >= least:  # the run is let through
            same = ((pdf["k1"] == key[0]) & (pdf["k2"] == key[1])).to_numpy()
            n = len(pdf) if same.all() else int(np.argmin(same))
            count += int(pdf["first"].to_numpy()[:n].sum())
            if n:
                yield _rows(GOES, pdf.iloc[:n])
                pdf = pdf.iloc[n:]
            if not len(pdf):
                continue
            if at_edge:
                yield edge(key, count)
            at_edge, held = False, None
        elif held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        starts = group_starts(pdf, KEY)
        counts = np.add.reduceat(pdf["first"].to_numpy().astype(np.int64), starts[:-1])
        lengths = np.diff(starts)
        if len(counts) > 1:
            if at_edge:  # the partition's first run is over
                one = pdf.iloc[: starts[1]]
                yield _rows(GOES if counts[0] >= least else OPEN, one)
                yield edge((one["k1"].iloc[0], one["k2"].iloc[0]), int(counts[0]))
            many = counts >= least
            many[-1] = False
            if at_edge:
                many[0] = False
            if many.any():
                yield _rows(GOES, pdf[np.repeat(many, lengths)])
            at_edge = False
        held, count = pdf.iloc[starts[-2] :], int(counts[-1])
        key = (held["k1"].iloc[0], held["k2"].iloc[0])
        if count >= least:
            yield _rows(GOES, held)
            held = None
    if key is not None:
        if count < least:
            yield _rows(OPEN, held)
        yield edge(key, count)


@F.pandas_udf(BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    def packed(at: np.ndarray) -> bytes:
        keep = np.ones(int(at.max()) // 8 * 8 + 8, dtype=bool)  # whole bytes
        keep[at] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return dropped.map(packed)


def kept_lines(keep: bytes, n: int) -> np.ndarray:
    """Which of n lines stay, from a bitmap."""
    out = np.ones(n, dtype=bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[:n]
    out[: len(bits)] = bits
    return out


def bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(doc_id, text) -> (d1, d2, n_dropped, keep) for each different document that loses lines; d1 and d2 as `document` makes them."""
    spark, stored = docs.sparkSession, Stored(docs.sparkSession)
    texts = docs.select(*document(), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    lines = stored.keep("lines", texts.mapInPandas(_lines, LINES))
    by = [*KEY, *PLACE]
    # equal rows are dealt at random, so that copies of one row fill as many partitions as they need
    ranged = lines.repartitionByRange(shuffle_partitions(spark), *by, F.rand(5)).sortWithinPartitions(*by)
    found = stored.keep("found", ranged.mapInPandas(lambda batches: stream(batches, least), FOUND))
    stored.drop("lines")
    common = found.where(F.col("kind") == EDGE).groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*KEY)
    goes = found.where(F.col("kind") == GOES).select(*PLACE).union(found.where(F.col("kind") == OPEN).join(common, KEY, "left_semi").select(*PLACE))
    by_doc = goes.groupBy("d1", "d2").agg(F.collect_set("pos").alias("at"))
    out = stored.keep("bitmaps", by_doc.select("d1", "d2", F.size("at").cast("long").alias("n_dropped"), _bitmap("at").alias("keep")))
    stored.drop("found")
    return out


def n_lines(text: str = "text") -> Column:
    whole = F.coalesce(F.col(text), F.lit(""))
    return (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep for every row of docs(doc_id, text); keep is null where all lines stay."""
    met = docs.select("doc_id", *document(), n_lines().alias("n_lines")).join(bitmaps(docs, least), ["d1", "d2"], "left")
    return met.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep")


def remaining(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    return b"\n".join([line for line, stays in zip(lines, kept_lines(keep, len(lines)).tolist()) if stays])


@F.pandas_udf(BinaryType())
def _remaining(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([remaining(t, k) for t, k in zip(text, keep)], dtype=object)


@F.pandas_udf(StringType())
def _digest(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([sha256(remaining(t, k)).hexdigest() for t, k in zip(text, keep)], dtype=object)


def without_common_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs(doc_id, text, ...), with all their columns, and texts without common lines; null texts stay null."""
    d1, d2, keep = (unused(docs, c) for c in ("d1", "d2", "keep"))
    a, b = document()
    found = bitmaps(docs, least).select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("keep").alias(keep)).hint("shuffle_hash")
    met = docs.withColumns({d1: a, d2: b}).join(found, [d1, d2], "left")
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(_remaining(F.coalesce("text", F.lit("")).cast("binary"), keep).cast("string"))
    return met.withColumn("text", text).select(*docs.columns)


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs(doc_id, text)."""
    # bitmaps are a stored table, so a hot key of this join is one that Spark can split
    met = docs.select("doc_id", "text", *document()).join(bitmaps(docs, least).hint("shuffle_hash"), ["d1", "d2"], "left")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return met.select("doc_id", n_lines().alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), _digest(whole, "keep").alias("kept_sha256"))
