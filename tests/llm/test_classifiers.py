"""Toxicity matching, FTRL updates and label samples against plain versions."""

import math
import random

import numpy as np
import pytest
from text_cases import HARD, frame, prose

from cohortspark.llm import quality, toxicity
from cohortspark.llm.text import id_fold, label_sample


def plain_sum(folded, lexicon):
    """Every entry and phrase searched for at every place."""
    places = {}
    for entry, weight in lexicon.weights.items():
        for at in range(len(folded)):
            if folded.startswith(entry, at):
                places[at] = max(places.get(at, 0.0), weight)
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for at in range(len(folded)):
            if folded.startswith(phrase, at):
                places = {p: w for p, w in places.items() if not at <= p < at + len(phrase) - 1}
    return sum(places.values()), len(folded.split())


def test_toxicity_equals_plain_search(spark):
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " idio": 2.5, " trash ": 2.0, " moro": 4.0, " loser ": 1.0}, ("trash can", "sore loser"), (-2.0, 0.7, 0.4))
    parts = ["1d10t", "idiot", "IDIOTS", "trash", "trash can", "tr4sh", "a", "moron", "sore loser", "loser", "Ünïcode", "!", "ІDІОТ", "canned trash"]
    texts = [*HARD, *[" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)]]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, texts), lexicon).collect()}
    for i, text in enumerate(texts):
        total, n = plain_sum(toxicity.fold(text or ""), lexicon)
        a, b, c = lexicon.line
        z = a + b * math.log1p(total) + c * math.log1p(100 * total / max(1, n))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-12)


def plain_ftrl(rows, labels, updates):
    """The per-coordinate rule, one number at a time."""
    z, n, w = {}, {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    mass = [len(labels) / (2 * max(1, labels.count(y))) for y in (0, 1)]
    for _ in range(math.ceil(updates / len(rows))):
        for (at, x), y in zip(rows, labels):
            w = {i: weight(i) for i in at.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x.tolist()))))
            for i, v in zip(at.tolist(), x.tolist()):
                g = mass[y] * (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_quality_equals_plain_updates(spark):
    """Training on one shard and scoring by a sum over the features of a text."""
    texts = [prose(i, 20, 50) + (" Junk ###" * 5 if i % 3 == 0 else "") for i in range(60)]
    docs = frame(spark, [*texts, *HARD])
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(60)], "doc_id long, quality int")
    weights = quality.train_quality(docs, labels, bits=12, shards=1, updates=200)
    used = {r.doc_id: r for r in label_sample(docs, labels, "quality", {0: 4000, 1: 4000}).collect()}
    import hashlib

    order = sorted(used, key=lambda i: hashlib.md5(f"order:{i}".encode()).hexdigest())
    features = quality.NgramFeatures(12)
    want = plain_ftrl([features.of(texts[i]) for i in order], [used[i].label for i in order], 200)
    for i, w in enumerate(weights):
        assert w == pytest.approx(want.get(i, 0.0), abs=1e-9)
    for r in quality.score_quality(docs, weights).collect():
        at, x = features.of((texts + HARD)[r.doc_id] or "")
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(weights[a] * v for a, v in zip(at, x)))), rel=1e-9)
    kept = quality.keep_quality(docs, weights, 0.3)
    assert kept.columns == docs.columns


def test_label_sample_of_odd_labels(spark):
    """Ids with two labels take the larger, repeated rows are one, ids of the held-out fold and without a text row are left out."""
    ids = [*range(30), 3, 3, None]
    docs = frame(spark, [f"text {i}" for i in ids], ids)
    rows = [(i, i % 2) for i in range(40)] + [(4, 1), (5, 1), (None, 1), (7, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = label_sample(docs, labels, "quality", {0: 100, 1: 100}).collect()
    held = {r.doc_id for r in docs.filter(id_fold(docs["doc_id"]) == 0).collect()}
    assert {r.doc_id: r.label for r in got} == {i: 1 if i in (4, 5) else i % 2 for i in range(30) if i not in held}
    assert len(got) == len({r.doc_id for r in got})
    few = label_sample(docs, labels.filter("doc_id < 30"), "quality", {0: 3, 1: 2}).collect()
    assert sorted(r.label for r in few) == [0, 0, 0, 1, 1]


def test_no_text_is_scored_alike(spark):
    weights = np.zeros(1 << 8)
    weights[0] = 0.5
    scores = [r.score for r in quality.score_quality(frame(spark, [None, "", "  "]), weights).collect()]
    assert scores == pytest.approx([1 / (1 + math.exp(-0.5))] * 3)
