"""Quality classifier by importance resampling (DSIR; Xie et al., 2023).

Two generative models over hashed n-grams are fitted: one for target text (labelled rows of good quality that are not
toxic), one for raw text (labelled rows of any kind, as they come). A document's importance is the log ratio of the
two over its n-grams, and Gumbel top-k over importances takes the sample: it is drawn without replacement, with
chances in proportion to the weights, by adding noise to the log weights and keeping the k largest.

Both models are fitted on the same rows. A raw model from other rows than the target's was measured too: whatever
stands in many copies among the one and by chance not among the other then outweighs every word (README).

- An n-gram counts once a document; unigrams and bigrams of words and punctuation have buckets of their own.
- The ratios of all n-grams that labelled rows hold count, for a text or against it. Counts are smoothed a little, and
  each log ratio is weighed by its support: one from r rows counts r / (r + SUPPORT) of itself.
- Length is set against evidence: the part `CENTRE` of the mean log ratio of n-grams in target text is taken off each,
  or a bad word would be drowned by the rest of a long text; then what hash collisions alone bring a text of as many
  n-grams is taken off the sum, and the sum is divided by their spread. A text of unseen words has about mean 0 and
  spread below 1 at any length.
- k is the size that rejection sampling would give on average: a document counts min(1, weight x e^SLACK). Noise has
  temperature 1, so documents near the edge are drawn in proportion to their weights, not cut off.
- Noise is a hash of id and seed, so a sample is the same whenever it is drawn again. Ties go to the smaller id.

Fitting takes at most about `FIT_ROWS` labelled rows, chosen by a hash of their id; scores, k and the cut cover all
documents. Rows with null or empty text have an importance of 0 and so are kept; null ids take part like others;
repeated rows are judged alike and stand or fall together except where the k-th place falls between them; without
labels every ratio is 1 and every document is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import cut, unused

BUCKETS = 1 << 19
RESERVED = 11  # buckets of bigrams that no hash falls into: a word after itself, three times running, and the share of such bigrams in eighths
FIT_ROWS = 40_000
SMOOTH, SMOOTH_PAIRS = 0.02, 0.02
DEAD = 0.0  # log ratios below it in size are left out: none is
SUPPORT, SUPPORT_PAIRS = 10.0, 50.0
CENTRE = 0.5
SLACK = 1.0
TEMPERATURE = 1.0
TOKENS = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> np.ndarray:
    """The buckets of a text's unigrams (below BUCKETS) and bigrams (from BUCKETS on), each once; a word after itself is one n-gram whatever the word, and so are one that comes three times running and the share of such bigrams."""
    h = np.array(list(map(xxhash.xxh32_intdigest, TOKENS.findall(text or ""))), dtype=np.uint64)
    again = h[:-1] == h[1:]
    thrice = np.full(int((again[:-1] & again[1:]).any()), BUCKETS + 1, dtype=np.uint64)
    share = np.full(min(1, len(again)), BUCKETS + 2 + int(8 * again.mean()) if len(again) else 0, dtype=np.uint64)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    pair = np.where(again, np.uint64(0), np.uint64(RESERVED) + pair % np.uint64(BUCKETS - RESERVED))
    return np.unique(np.concatenate([h % np.uint64(BUCKETS), np.uint64(BUCKETS) + pair, thrice, share])).astype(np.int64)


def counts(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The buckets that labelled rows hold, how many target rows and rows of any kind hold each, and the share of target rows."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    n = known.count()
    share = min(1.0, rows / max(1, n))
    # a share of the hash range, so about `rows` ids: few enough to send to every executor; the limit only guards that bound
    few = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, raw = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
        n_target = n_raw = 0
        for pdf in batches:
            for text, good in zip(pdf["text"], pdf["good"]):
                f = features(text)
                raw[f] += 1
                n_raw += 1
                if good:
                    target[f] += 1
                    n_target += 1
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": np.append(at, -1), "target": np.append(target[at], n_target), "raw": np.append(raw[at], n_raw)})

    counted = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").mapInPandas(count, "bucket int, target long, raw long")
    sums = cut(counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).where("raw > 0"))
    total = sums.where("bucket < 0").first()
    part = total["target"] / total["raw"] if total and total["target"] else 1.0

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({c: [pdf[c].to_numpy(dtype=np.int32).tobytes()] for c in ("bucket", "target", "raw")})

    # at most one count a bucket, whatever the number of documents, as bytes
    got = sums.where("bucket >= 0").mapInPandas(packed, "bucket binary, target binary, raw binary").collect()
    return *(np.frombuffer(b"".join(r[c] for r in got), dtype=np.int32) for c in ("bucket", "target", "raw")), part


def log_ratios(buckets: np.ndarray, target: np.ndarray, raw: np.ndarray, part: float) -> np.ndarray:
    smooth = np.where(buckets < BUCKETS, SMOOTH, SMOOTH_PAIRS)
    return np.log((target + smooth * part) / (part * (raw + smooth)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that labelled rows hold, and the log ratio of target text to raw text there."""
    buckets, target, raw, part = counts(docs, labels, rows)
    ratios = log_ratios(buckets, target, raw, part)
    telling = np.abs(ratios) >= DEAD
    return buckets[telling], ratios[telling].astype(np.float32)


class Model:
    """Weights of the n-grams, and what collisions bring."""

    def __init__(self, buckets: np.ndarray, target: np.ndarray, raw: np.ndarray, part: float):
        single = buckets < BUCKETS
        ratios = log_ratios(buckets, target, raw, part)
        ratios[np.abs(ratios) < DEAD] = 0
        support = raw / (raw + np.where(single, SUPPORT, SUPPORT_PAIRS))
        weights = ratios * support
        self.mean, self.square = np.zeros(2), np.zeros(2)
        for kind, at in enumerate((single, ~single)):
            if held := float((target * support)[at].sum()):
                weights[at] -= CENTRE * float((target * weights)[at].sum()) / held * support[at]
            # over all buckets: most are empty
            self.mean[kind], self.square[kind] = weights[at].sum() / BUCKETS, (weights[at] ** 2).sum() / BUCKETS
        self.buckets, self.weights = buckets, weights.astype(np.float32)

    def dense(self) -> np.ndarray:
        out = np.zeros(2 * BUCKETS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out

    def score(self, f: np.ndarray, dense: np.ndarray) -> float:
        """The weight of a text of features f, less what collisions bring, in units of their spread (of 1 in short texts)."""
        n = np.array([(singles := int(np.searchsorted(f, BUCKETS))), len(f) - singles])
        return float((dense[f].sum(dtype=np.float64) - n @ self.mean) / np.sqrt(1 + n @ self.square))


def gumbel(id_: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of an id."""
    u = (F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, digit: int = 11) -> int:
    """The k-th largest of a column of longs `key`, a few bits at a time: each step counts the rows by the next bits, in at most 2048 groups."""
    here, top = keys, 0
    for shift in range(55, -1, -digit):
        counts = here.groupBy(F.shiftright("key", shift).alias("d")).count().collect()
        for r in sorted(counts, key=lambda r: -r["d"]):
            if k <= r["count"]:
                top = r["d"]
                break
            k -= r["count"]
        here = keys.where(F.shiftright("key", shift) == F.lit(top))
    return top


def resample(docs: DataFrame, labels: DataFrame, seed: int = 1, temperature: float = TEMPERATURE, slack: float = SLACK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected for every row of docs(doc_id, text), and before them the columns to carry."""
    model = Model(*counts(docs, labels))

    @F.pandas_udf("double")
    def importance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = model.dense()
        for texts in batches:
            yield pd.Series([model.score(features(t), dense) for t in texts], dtype="float64")

    scored = cut(
        docs.select(*carry, "doc_id", importance("text").alias("log_weight"))
        .withColumn("gumbel_key", F.col("log_weight") + temperature * gumbel(F.col("doc_id"), seed))
        .withColumn("key", F.round(F.col("gumbel_key") * float(1 << 24)).cast("long"))
    )
    # summed in whole millionths, so that k is the same whatever the order of rows
    chance = F.round(F.least(F.lit(1.0), F.exp(F.col("log_weight") + slack)) * 1_000_000).cast("long")
    k = round((scored.agg(F.sum(chance)).first()[0] or 0) / 1_000_000)
    if not k:
        return scored.select(*carry, "doc_id", "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    last = kth_largest(scored.select("key"), k)
    above = scored.where(F.col("key") > last).count()
    ties = scored.where(F.col("key") == last).select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("key"))
    # among ties at the k-th place the smaller ids stay
    edge = -kth_largest(ties.select((-F.col("key")).alias("key")), k - above)
    chosen = (F.col("key") > last) | ((F.col("key") == last) & (F.coalesce("doc_id", F.lit(2**63 - 1)) <= edge))
    return scored.select(*carry, "doc_id", "log_weight", "gumbel_key", chosen.alias("selected"))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the sample takes; rows are told apart by a 64-bit hash of id and text, as ids may be null or stand for several texts."""
    row = unused(docs, "_row")
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    gone = cut(resample(marked, labels, carry=(row,))).where("NOT selected").select(row).distinct()
    return marked.join(gone, row, "left_anti").select(*docs.columns)
