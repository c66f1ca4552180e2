"""Toxicity by a weighted lexicon.

Texts are folded: lower case, accents off, look-alike letters of other scripts to Latin ones, digits and signs
that stand for letters inside a word to those letters.  An Aho-Corasick automaton finds lexicon entries (whole
words or word beginnings) and exception phrases in the folded text; a hit inside an exception does not count.
The weights of the hits are summed, set against the number of words, and mapped to a probability.

Weights are log odds from a bounded sample of labelled rows.  Entries are chosen greedily: each must explain
toxic rows that the ones before it do not, so words that merely go along with a toxic text are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import label_sample, per_text

PER_CLASS = {0: 8000, 1: 4000}  # labelled rows of a class that are learned from, at most
MAX_ENTRIES = 2000  # entries of a lexicon
CANDIDATES = 20_000  # grams that the greedy choice looks at, those with most toxic rows first
LEAST_ROWS = 3  # toxic rows that an entry must add
LEAST_WEIGHT = 2.5  # log odds
PREFIXES = (4, 5, 6, 7)

# Look-alike letters and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
    "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
# Entries to start from where labels say nothing, and phrases in which such words are harmless.
SEED_ENTRIES = ("idiot", "moron", "scum", "loser", "stupid", "pathetic", "worthless", "disgusting", "trash", "clown")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser", "pathetic fallacy")

_INSIDE = re.compile(r"(?<![0-9@$])[0-9@$]++(?=[a-z])|(?<=[a-z])[0-9]++|(?<=[a-z0-9])!(?=[a-z0-9])")
_BREAK = re.compile(r"[\W\d_]+")
_SIGNS = re.compile(r"[0-9@$!]")


class _Fold(dict):
    """Code point -> folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        letter = chr(code).lower()
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        self[code] = value = "".join(HOMOGLYPHS.get(c, c) for c in plain)
        return value


_FOLD = _Fold()
_SUBSTITUTE = str.maketrans(SUBSTITUTES)


def fold(text: str) -> str:
    """Folded words, one space before and after each."""
    out = text.translate(_FOLD)
    if _SIGNS.search(out):
        out = _INSIDE.sub(lambda m: m.group().translate(_SUBSTITUTE), out)
    return " " + _BREAK.sub(" ", out).strip() + " "


def grams(folded: str) -> set[str]:
    """Distinct words (" word ") and word beginnings (" wor") of a folded text."""
    own = set(folded.split())
    return {f" {w} " for w in own} | {f" {w[:k]}" for w in own for k in PREFIXES if len(w) >= k}


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the map from sums to a probability."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    line: tuple[float, float, float]  # constant, factor of log(1 + sum), factor of log(1 + 100 sum / words)


def _numbers(total: float, n_words: int) -> tuple[float, float]:
    return float(np.log1p(total)), float(np.log1p(100.0 * total / max(1, n_words)))


class Matcher:
    """Sums lexicon weights over texts."""

    def __init__(self, lexicon: Lexicon):
        self.line = lexicon.line
        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            folded = fold(phrase)
            self.automaton.add_word(folded, (len(folded), None))
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        self.automaton.make_automaton()

    def numbers(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        hits: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        if len(self.automaton):
            for last, (size, weight) in self.automaton.iter(folded):
                start = last + 1 - size
                if weight is None:
                    harmless.append((start, last))
                else:
                    hits[start] = max(hits.get(start, 0.0), weight)  # one word counts once
        for first, end in harmless:
            for at in [at for at in hits if first <= at < end]:
                del hits[at]
        return _numbers(sum(hits.values()), folded.count(" ") - 1)

    def score(self, text: str) -> float:
        a, b = self.numbers(text)
        z = self.line[0] + self.line[1] * a + self.line[2] * b
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _gram_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for part in parts:
        for text, label in zip(part["text"], part["label"]):
            counts[label].update(grams(fold(text)))
    if counts[0] or counts[1]:
        both = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"gram": both, "n0": [counts[0][g] for g in both], "n1": [counts[1][g] for g in both]})


def choose_entries(rows: list[list[str]], weights: dict[str, float]) -> list[str]:
    """Greedy cover of toxic rows, given the candidate grams of each."""
    where: dict[str, set[int]] = {}
    for i, own in enumerate(rows):
        for g in own:
            where.setdefault(g, set()).add(i)
    chosen: list[str] = []
    while where and len(chosen) < MAX_ENTRIES:
        best = max(where, key=lambda g: (len(where[g]) * weights[g], -len(g), g))
        covered = where.pop(best)
        if len(covered) < LEAST_ROWS:
            break
        chosen.append(best)
        where = {g: left for g, s in where.items() if len(left := s - covered) >= LEAST_ROWS}
    return chosen


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two numbers by Newton steps; classes weigh the same; factors are not negative."""
    if len(set(y.tolist())) < 2:
        return (-3.0, 2.0, 0.5)
    mass = len(y) / (2.0 * np.bincount(y, minlength=2))[y]
    full, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ w, -30, 30)))
        ridge = np.array([1e-2, 1e-1, 1e-1])
        gradient = full.T @ (mass * (p - y)) + ridge * w
        hessian = (full * (mass * p * (1 - p))[:, None]).T @ full + np.diag(ridge) + 1e-3 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def train_lexicon(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: dict[int, int] | None = None,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Lexicon from at most ``per_class`` labelled rows of each class outside the held-out fold.

    The seed entries are always in, with a common weight where the labels give none.
    """
    sample = label_sample(documents, labels, label, per_class or PER_CLASS).select("text", "label")
    sample = sample.dropDuplicates(["text"])
    partial = sample.mapInPandas(_gram_counts, "gram string, n0 long, n1 long")
    counts = partial.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    strong = counts.filter(F.col("n1") >= LEAST_ROWS).withColumn("w", odds).filter(F.col("w") >= LEAST_WEIGHT)
    best = strong.orderBy(F.desc("n1"), F.desc("w"), "gram").limit(CANDIDATES).collect()
    weights = {r["gram"]: float(r["w"]) for r in best}
    names = frozenset(weights)

    def own_grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"own": [sorted(grams(fold(t)) & names) for t in part["text"]]})

    toxic = sample.filter("label = 1").select("text").mapInPandas(own_grams, "own array<string>").collect()
    entries = {g: weights[g] for g in choose_entries([r["own"] for r in toxic], weights)}
    for word in SEED_ENTRIES:
        entries.setdefault(f" {word} ", SEED_WEIGHT)
    lexicon = Lexicon(entries, tuple(exceptions), (0.0, 0.0, 0.0))
    numbers = per_text(lambda: _number_function(lexicon), "a double, b double")
    fitted = sample.select("label", numbers("text").alias("r")).select("label", "r.a", "r.b").collect()
    x = np.array([(r["a"], r["b"]) for r in fitted], float).reshape(-1, 2)
    lexicon.line = _fit_line(x, np.array([r["label"] for r in fitted], int))
    return lexicon


def _number_function(lexicon: Lexicon):
    matcher = Matcher(lexicon)

    def work(texts: list[str]) -> dict:
        pairs = [matcher.numbers(t) for t in texts]
        return {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

    return work


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every row.

    Null and empty texts have no hits and get the score of such texts.  Rows are independent: repeated rows
    repeat, other columns are not read, an empty table gives an empty table.
    """

    def build():
        matcher = Matcher(lexicon)
        return lambda texts: {"score": [matcher.score(t) for t in texts]}

    return docs.select("doc_id", per_text(build, "score double")("text")["score"].alias("score"))
