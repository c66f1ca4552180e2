"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A word becomes two symbols: its letters, and its shape (case, and the characters around the letters).  Unigrams
and bigrams of both are hashed into 2**bits places; a word that repeats the one before it has a symbol of its
own.  Features are square roots of counts, scaled to unit length, so a document's length does not matter.

Training runs on a bounded sample of labelled rows.  Shards of it are learned apart by FTRL-proximal updates in
a fixed order and their weights averaged, so the model has at most 2**bits numbers whatever the corpus; scoring
is one sparse dot product per text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import Memo, label_sample, per_text

BITS = 18
PER_CLASS = 4000  # labelled rows of a class that are learned from, at most
SHARDS = 4
UPDATES = 6_000  # updates of a shard, at least: a small sample is passed over more often
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.01
_SAME = np.uint64(0x9E3779B97F4A7C15)
_MASK32 = np.uint64(0xFFFFFFFF)


def _symbols(word: str) -> int:
    """Letters in the upper, shape in the lower 32 bits."""
    core = "".join(filter(str.isalnum, word))
    case = "u" if len(core) > 1 and core.isupper() else "t" if core[:1].isupper() else "n" if core.isdigit() else "l"
    first = word.find(core[0]) if core else 0
    rest = [c for c in word if not c.isalnum()]
    shape = f"{case}{min(len(core), 1)}{first > 0}{''.join(rest[:4])}"
    high = xxhash.xxh32_intdigest(core.lower())
    return high << 32 | xxhash.xxh32_intdigest(shape)


class NgramFeatures:
    """Sparse feature vectors of texts."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.memo = Memo(_symbols)

    def _place(self, kind: int, symbols: np.ndarray) -> np.ndarray:
        x = (symbols + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(feature places, values); place 0 is the constant."""
        tokens = text.split()
        if not tokens:
            return np.zeros(1, np.int64), np.ones(1)
        packed = np.fromiter(map(self.memo.__getitem__, tokens), np.uint64, len(tokens))
        letters, shapes = packed >> np.uint64(32), packed & _MASK32
        pairs = letters[:-1] * np.uint64(0x100000001B3) + letters[1:]
        pairs[letters[:-1] == letters[1:]] = _SAME
        forms = shapes[:-1] * np.uint64(0x100000001B3) + shapes[1:]
        parts = [self._place(k, part) for k, part in enumerate((letters, shapes, pairs, forms), 1)]
        places, counts = np.unique(np.concatenate(parts).astype(np.int64), return_counts=True)
        values = np.sqrt(counts)
        values /= np.sqrt(counts.sum())
        return np.append(places, 0), np.append(values, 1.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int, updates: int = UPDATES) -> np.ndarray:
    """Weights after FTRL-proximal passes over the rows in the order given; both classes weigh the same."""
    count = np.bincount(labels, minlength=2)
    mass = len(labels) / (2.0 * np.maximum(count, 1))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(-(-updates // max(1, len(rows)))):
        for (at, x), y in zip(rows, labels):
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = mass[y] * (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << bits))


def train_quality(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_class: int = PER_CLASS,
    bits: int = BITS,
    shards: int = SHARDS,
    updates: int = UPDATES,
) -> np.ndarray:
    """Weights from at most ``per_class`` labelled rows of each class outside the held-out fold.

    Without labelled rows, or with one class only, the weights lead to scores that say so (0.5, or that class).
    """
    sample = label_sample(documents, labels, label, {0: per_class, 1: per_class})
    # One order per shard that mixes the classes; shards hold per_class * 2 / shards rows at most.
    sample = sample.withColumn("_order", F.md5(F.concat(F.lit("order:"), F.col("doc_id").cast("string"))))
    sample = sample.withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards)).cast("int"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "text"])
        features = NgramFeatures(bits)
        w = ftrl([features.of(t) for t in part["text"]], part["label"].tolist(), bits, updates)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "weight": w[at]})

    learned = sample.groupBy("_shard").applyInPandas(learn, "place long, weight double")
    mean = learned.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toPandas()  # 2**bits rows at most
    out = np.zeros(1 << bits)
    out[mean["place"].to_numpy(np.int64)] = mean["weight"].to_numpy(float)
    return out


def score_function(weights: np.ndarray):
    """Column function text -> score (struct of one field)."""
    bits = len(weights).bit_length() - 1
    at = np.flatnonzero(weights)
    values = weights[at]

    def build():
        dense = np.zeros(1 << bits)
        dense[at] = values
        features = NgramFeatures(bits)

        def work(texts: list[str]) -> dict:
            sums = [float(dense[p] @ v) for p, v in map(features.of, texts)]
            return {"score": 1.0 / (1.0 + np.exp(-np.clip(sums, -30, 30)))}

        return work

    return per_text(build, "score double")


def score_quality(docs: DataFrame, weights: np.ndarray):
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row.

    Null and empty texts have only the constant feature and get its score.  Rows are independent: repeated rows
    repeat, other columns are not read, an empty table gives an empty table.
    """
    return docs.select("doc_id", score_function(weights)("text")["score"].alias("score"))


def keep_quality(docs: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose score is ``least`` or more, with their columns as they were."""
    return docs.filter(score_function(weights)("text")["score"] >= least)
