"""A Merkle manifest of a table of documents: digests of rows, of each source and of the whole, with a proof for each row.

A row's leaf is the SHA-256 (lowercase hex, and so are all digests) of its doc_id, source, lang, n_chars and text, each
`-` if null, else its number of UTF-8 bytes, `:` and its value. Leaves of a source stand in the order of doc_id; while
several nodes remain, every `FANOUT` consecutive ones become the digest of their digests. What remains is the source's
subroot; the subroots, by source, make the root in the same way.

Texts are hashed where they are read, and only digests move. Leaves are sorted by range partitioning, and a row's place
is its number in its partition plus what stands before it, so a source of any size has many partitions. The tree is
built by aligned blocks of `FANOUT` ** `LEVELS` nodes: a block is a matrix of 64-byte rows whose reshaped runs are hashed
level by level, and its top is a node of the next round's blocks. Proofs go the other way: a block gets the siblings
above its top, and adds those of its own levels, which plain arithmetic on a row's number finds in the matrices.

Null ids come first in their source, the null source first of all. Rows of the same id and source stand in the order of
their leaves; equal rows have equal leaves, so their order doesn't show, though each keeps its place and its proof. An
empty table gives an empty table; texts may be empty or of any length (the order of 10^9 characters, Spark's limit for a
value), other columns are not read. A row without an id is never tampered with.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm.common import Stored, group_starts, shuffle_partitions, whole_groups

FANOUT = 16
LEVELS = 3
BLOCK = FANOUT**LEVELS
DIGEST = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = "tree string, pos long, n long, digest string"


def leaf(text: Column | None = None) -> Column:
    """The digest of a row of documents, or of the row with another text."""
    values = [(text if c == "text" and text is not None else F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text was lower-cased (A-Z), for ids whose CRC-32 5 divides; else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", UPPER, LOWER)))


def matrix(digests: list[str] | np.ndarray) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), dtype=np.uint8).reshape(-1, DIGEST)


def parents(nodes: np.ndarray) -> np.ndarray:
    """One level up: each run of FANOUT rows, the last run maybe shorter, becomes the digest of its bytes."""
    whole = len(nodes) // FANOUT
    runs = [*nodes[: whole * FANOUT].reshape(whole, FANOUT * DIGEST)]
    if len(nodes) % FANOUT:
        runs.append(nodes[whole * FANOUT :].reshape(-1))
    return matrix([sha256(r).hexdigest() for r in runs])


class Block:
    """Consecutive nodes of a tree, from an aligned place on, and the levels above them."""

    def __init__(self, digests: list[str] | np.ndarray, n: int):
        """n: nodes of the whole tree on this level; more levels follow as long as it has more than one node."""
        self.levels = [matrix(digests)]
        while n > 1 and len(self.levels) <= LEVELS:
            self.levels.append(parents(self.levels[-1]))
            n = -(-n // FANOUT)

    def top(self) -> str:
        return self.levels[-1].tobytes().decode()

    def siblings(self, i: int) -> list[str]:
        """For each level below the top what stands before and after row i's node in its run: [before, after, before, ...]."""
        out = []
        for nodes in self.levels[:-1]:
            first = i - i % FANOUT
            out += [nodes[first:i].tobytes().decode(), nodes[i + 1 : first + FANOUT].tobytes().decode()]
            i //= FANOUT
        return out


def fold(digest: str, siblings: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in zip(siblings[::2], siblings[1::2]):
        digest = sha256((before + digest + after).encode()).hexdigest()
    return digest


def positions(rows: DataFrame, order: list[str], stored: Stored, name: str) -> DataFrame:
    """rows(tree, ...) with pos, the row's number in its tree by order, and n, the rows of its tree."""
    parts = shuffle_partitions(rows.sparkSession)
    # equal rows are dealt at random, so they are no hot key; their order does not show
    sorted_ = rows.repartitionByRange(parts, "tree", *order, F.rand(7)).sortWithinPartitions("tree", *order)
    ranged = stored.keep(name, sorted_.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33).cast("int")))
    counted = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    w = Window.partitionBy("tree")
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counted = counted.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    placed = stored.keep(f"{name}-placed", ranged.join(counted, ["tree", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"))
    stored.drop(name)
    return placed


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))


def by_block(nodes: DataFrame) -> DataFrame:
    """Rows of a block together, in order."""
    return nodes.repartition(shuffle_partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos")


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = ["tree", "block"]
    for pdf in whole_groups(batches, keys):
        at = group_starts(pdf, keys)
        for a, b in zip(at, at[1:]):
            yield pdf.iloc[a:b]


def gathered(rows: Iterator[tuple], columns: list[str], most: int = 4000) -> Iterator[pd.DataFrame]:
    """Frames of at most `most` rows."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def climb(nodes: DataFrame, stored: Stored, name: str) -> list[DataFrame]:
    """nodes(tree, pos, n, digest), and above them round by round the blocks' tops, up to one node a tree."""

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = ((g["tree"].iloc[0], g["block"].iloc[0], -(-g["n"].iloc[0] // BLOCK), Block(g["digest"].to_numpy(), g["n"].iloc[0]).top()) for g in blocks(batches))
        yield from gathered(tops, ["tree", "pos", "n", "digest"])

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1 or len(rounds) == 1:
        rounds.append(stored.keep(f"{name}{len(rounds)}", by_block(blocked(rounds[-1].select("tree", "pos", "n", "digest"))).mapInPandas(up, NODE)))
    return rounds


ABOVE = ["path", "subroot", "root"]


def met(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Each block's rows behind one row of what is above the block: above(tree, block, path, subroot, root)."""
    head = above.withColumn("pos", F.lit(-1).cast("long"))
    return by_block(blocked(nodes).unionByName(head, allowMissingColumns=True))


def descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, pos, name, digest, path, subroot, root): each node's siblings up to the root, from those above its block."""

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for g in blocks(batches):
                head, g = g.iloc[0], g.iloc[1:]
                block, rest = Block(g["digest"].to_numpy(), int(g["n"].iloc[0])), list(head["path"])
                for i, (pos, name, digest) in enumerate(zip(g["pos"], g["name"], g["digest"])):
                    yield head["tree"], pos, name, digest, block.siblings(i) + rest, head["subroot"], head["root"]

        yield from gathered(rows(), ["tree", "pos", "name", "digest", *ABOVE], 500)

    return met(nodes.select("tree", "pos", "n", "digest", "name"), above).mapInPandas(down, "tree string, pos long, name string, digest string, path array<string>, subroot string, root string")


def _proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for g in blocks(batches):
            head, g = g.iloc[0], g.iloc[1:]
            block, rest, subroot, root = Block(g["digest"].to_numpy(), int(g["n"].iloc[0])), list(head["path"]), head["subroot"], head["root"]
            for i, (name, digest, other) in enumerate(zip(g["name"], g["digest"], g["tampered"])):
                siblings = block.siblings(i) + rest
                folded = fold(other or digest, siblings)
                yield name, digest, subroot, root, sha256("".join(siblings).encode()).hexdigest(), folded, folded == root

    yield from gathered(rows(), ["name", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs(doc_id, source, lang, n_chars, text)."""
    stored = Stored(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    # sources get a sign in front, so that none is null and the null one sorts first
    source = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit(""))
    hashed = docs.select(*FIELDS).select(source.alias("tree"), "doc_id", leaf().alias("digest"), tampered(docs).alias("tampered"))
    leaves = positions(hashed, ["doc_id", "digest"], stored, "leaves").withColumn("name", F.col("doc_id").cast("string"))
    rounds = climb(leaves, stored, "sources")
    subroots = positions(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], stored, "subroots")
    tops = climb(subroots, stored, "tops")

    none = F.array().cast("array<string>")
    above = tops[-1].select("tree", F.lit(0).cast("long").alias("block"), none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in tops[-2::-1]:
        named = nodes if "name" in nodes.columns else nodes.withColumn("name", F.lit(None).cast("string"))
        above = descend(named, above).select("tree", F.col("pos").alias("block"), "name", "digest", *ABOVE)
    above = stored.keep("above", above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root"))
    for i, nodes in enumerate(rounds[-2:0:-1]):
        above = stored.keep(f"above{i}", descend(nodes.withColumn("name", F.lit(None).cast("string")), above).select("tree", F.col("pos").alias("block"), *ABOVE))
    told = met(leaves.select("tree", "pos", "n", "digest", "name", "tampered"), above).mapInPandas(_proofs, "name string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return told.select(F.col("name").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
