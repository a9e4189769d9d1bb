"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of a fixed number of bytes, the last one padded; every byte of the text is in a window.
Each byte falls into one of 64 classes (letters whatever their case, the common bytes of two-byte letters, the rest
by kind). Filters of several widths slide over a window, the maximum of each over the window goes through a
softmax layer, and the mean over a text's windows is its prediction. A filter's value is a sum of table rows, one
for each byte under it; for speed the tables of neighbouring bytes are added up once into tables of pairs.

Rows whose text is null or has no letter get `und` with a score of 0. Texts are judged one by one: repeated rows
get the same result, empty tables give empty tables, other columns are not read. Of equal probabilities the language
that comes first in the alphabet wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import unused

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 8
CLASSES = 64
#: About the most labelled rows that training takes (never over twice as many), and the windows of each. A hash of the id chooses.
TRAIN_ROWS = 6000
TRAIN_WINDOWS = 2
LETTER = regex.compile(r"\p{L}")


def byte_classes() -> np.ndarray:
    """Class 0 is padding and white space, 1 to 26 letters, 27 digits, 28 other ASCII, 29 lead bytes, 30 to 61 continuation bytes (case of Latin-1 letters folded)."""
    c = np.full(256, 28)
    c[[0, 9, 10, 11, 12, 13, 32]] = 0
    for i in range(26):
        c[65 + i] = c[97 + i] = 1 + i
    c[48:58] = 27
    c[192:] = 29
    c[128:192] = 30 + np.arange(64) % 32
    return c.astype(np.int64)


CLASS_OF = byte_classes()


def windows(raw: bytes) -> np.ndarray:
    """(n, WINDOW) classes; the last window overlaps the one before where the text is long enough, else it is padded."""
    c = CLASS_OF[np.frombuffer(raw, dtype=np.uint8)]
    if len(c) <= WINDOW:
        return np.concatenate([c, np.zeros(WINDOW - len(c), dtype=np.int64)])[None]
    whole = c[: len(c) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return np.concatenate([whole, c[None, -WINDOW:]]) if len(c) % WINDOW else whole


@dataclass
class Network:
    """tables[w]: (w, CLASSES, FILTERS) for width w; bias of each width's filters; softmax layer."""

    tables: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    names: list[str]

    def prepare(self) -> None:
        """Tables of pairs: a width of 4 is two pairs, a width of 3 a pair and a single."""
        self.pairs = {w: [(k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(-1, FILTERS).astype(np.float32)) for k in range(0, w - 1, 2)] for w, t in self.tables.items()}
        self.single = {w: t[w - 1].astype(np.float32) if w % 2 else None for w, t in self.tables.items()}

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(n, widths x FILTERS): the largest value of each filter over each window."""
        pair = x[:, :-1] * CLASSES + x[:, 1:]
        got = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            v = None
            for k, t in self.pairs[w]:
                part = t[pair[:, k : k + n]]
                v = part if v is None else np.add(v, part, out=v)
            if self.single[w] is not None:
                v += self.single[w][x[:, w - 1 : w - 1 + n]]
            got.append(v.max(axis=1))
        return np.maximum(np.concatenate(got, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy of windows (the first of each text given); gradients go back through the one position that held each filter's maximum."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    x, y = [], []
    for t, lang in zip(texts, langs):
        x.append(windows(t.encode())[0])
        y.append(names.index(lang))
    x, y = np.array(x).reshape(-1, WINDOW), np.array(y, dtype=np.int64)
    width = len(WIDTHS) * FILTERS
    p = {f"t{w}": rng.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS} | {"bias": np.zeros(width), "out": rng.normal(0, 0.3, (width, max(1, len(names)))), "out_bias": np.zeros(max(1, len(names)))}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    net = lambda: Network({w: p[f"t{w}"] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"], names)
    step = 0
    share = np.bincount(y, minlength=len(names)).astype(float) if len(y) else np.ones(max(1, len(names)))
    weight = (share.sum() / np.maximum(share, 1)) ** 0.5
    for _ in range(epochs if len(names) > 1 else 0):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb, yb = x[at], y[at]
            n = len(xb)
            pooled, where = [], []
            for w in WIDTHS:
                k = WINDOW - w + 1
                val = sum(p[f"t{w}"][j].astype(np.float32)[xb[:, j : j + k]] for j in range(w))
                where.append(val.argmax(axis=1))
                pooled.append(np.take_along_axis(val, where[-1][:, None, :], 1)[:, 0, :])
            pre = np.concatenate(pooled, axis=1) + p["bias"]
            h = np.maximum(pre, 0)
            z = h @ p["out"] + p["out_bias"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), yb] -= 1
            q *= weight[yb][:, None] / n
            g = {"out": h.T @ q, "out_bias": q.sum(0)}
            gh = (q @ p["out"].T) * (pre > 0)
            g["bias"] = gh.sum(0)
            for i, w in enumerate(WIDTHS):
                gw = gh[:, i * FILTERS : (i + 1) * FILTERS]
                gt = np.zeros_like(p[f"t{w}"])
                for j in range(w):
                    c = np.take_along_axis(xb, where[i] + j, 1)
                    np.add.at(gt[j], (c, np.broadcast_to(np.arange(FILTERS), c.shape)), gw)
                g[f"t{w}"] = gt
            step += 1
            for k, a in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                a -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net()


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """Train on documents with a language and a text whose crc32(doc_id as text) mod 5 is not 0: about `rows` of them.

    A share of the hash range of ids gives about that many rows, and the limit guards the bound where one id is
    repeated. Executors cut a few windows out of each text, at places that a hash chooses.
    """
    part = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) % 5 <> 0")
    places = f"transform(sequence(1, {TRAIN_WINDOWS}), k -> substring(text, CAST(1 + pmod(xxhash64(doc_id, k), greatest(1, length(text) - {WINDOW - 1})) AS INT), {WINDOW}))"
    share = min(1.0, rows / max(1, part.count()))
    few = part.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("lang", F.expr(places).alias("windows")).limit(2 * rows)
    got = few.select("lang", F.explode("windows").alias("text")).toPandas()
    return train(got["text"].tolist(), got["lang"].tolist())


def judge(net: Network) -> Callable[[Column], Column]:
    """A function from a text column to a struct of lang_pred and score."""
    net.prepare()

    @F.pandas_udf("lang_pred string, score double")
    def judged(s: pd.Series) -> pd.DataFrame:
        langs, scores = ["und"] * len(s), np.zeros(len(s))
        held, owner, n = [], [], 0

        def flush() -> None:
            if not held:
                return
            x, own = np.concatenate(held), np.concatenate(owner)
            q = np.concatenate([net.probabilities(x[i : i + 64]) for i in range(0, len(x), 64)])
            np.add.at(total, own, q)
            np.add.at(count, own, 1)
            held.clear(), owner.clear()

        total, count = np.zeros((len(s), max(1, len(net.names)))), np.zeros(len(s))
        for i, t in enumerate(s):
            if t is not None and net.names and LETTER.search(t):
                w = windows(t.encode())
                held.append(w)
                owner.append(np.full(len(w), i))
                n += len(w)
                if n >= 2048:
                    flush()
                    n = 0
        flush()
        for i in np.flatnonzero(count):
            q = total[i] / count[i]
            langs[i], scores[i] = net.names[int(q.argmax())], min(1.0, float(q.max()))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return lambda text: judged(text)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text. Only the text is an input."""
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), judge(net)(F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def confident(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of docs whose language the network tells with a score of at least `least`; rows without a letter go."""
    name = unused(docs, "_language")
    judged = docs.withColumn(name, judge(fit(docs))(F.col("text")))
    return judged.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).select(*docs.columns)
