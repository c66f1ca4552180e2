import os

import numpy as np
import pytest
from text_cases import HARD, frame, prose

from cohortspark.llm import lm_score, quality, toxicity
from cohortspark.llm.text import id_fold

FOLDER = "/root/testdata/sf0.01"
mounted = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not mounted")


def test_fold():
    assert toxicity.fold("1d10t ІDІОТ, idi0t! Écrasé 1984") == " idiot idiot idiot ecrase "
    lexicon = toxicity.Lexicon({" trash ": 3.0, " moro": 2.0}, ("trash can",), (-3.0, 2.0, 0.5))
    own = toxicity.Matcher(lexicon)
    assert own.score("a trash can") == own.score("clean") == own.score("") < 0.5 < own.score("you tr4sh") < own.score("trash, moron")


def test_greedy_choice_leaves_companions_out():
    rows = [["bad", f"friend{i // 4}"] for i in range(40)]
    assert toxicity.choose_entries(rows, {"bad": 4.0, **{f"friend{i}": 4.0 for i in range(10)}}) == ["bad"]


def labelled(spark, n=400):
    texts = [prose(i, 60) + (" vileword vilely" if i % 4 == 0 else "") + (" ###" * 30 if i % 3 == 0 else "") for i in range(n)]
    docs = frame(spark, [*texts, *HARD])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(n)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def held_out_accuracy(scored, labels, label, least):
    held = scored.join(labels.filter(f"{label} is not null"), "doc_id").filter(id_fold(scored["doc_id"]) == 0).collect()
    assert len(held) > 40
    return np.mean([(r.score >= least) == (r[label] == 1) for r in held])


def test_toxicity_learns(spark):
    docs, labels = labelled(spark)
    scored = toxicity.score_toxicity(docs, toxicity.train_lexicon(docs, labels))
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").isEmpty()
    assert held_out_accuracy(scored, labels, "toxic", 0.5) > 0.97
    bare = toxicity.train_lexicon(docs, labels.filter("false"))
    assert toxicity.score_toxicity(docs.filter("false"), bare).count() == 0


def test_quality_learns(spark):
    docs, labels = labelled(spark)
    weights = quality.train_quality(docs, labels, updates=1000)
    scored = quality.score_quality(docs, weights)
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").isEmpty()
    assert held_out_accuracy(scored, labels, "quality", 0.3) > 0.97
    assert quality.keep_quality(docs, weights).columns == docs.columns
    none = quality.train_quality(docs, labels.filter("false"))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}


@mounted
def test_held_out_accuracy_on_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    assert held_out_accuracy(quality.score_quality(docs, quality.train_quality(docs, labels)), labels, "quality", 0.3) > 0.9
    assert held_out_accuracy(toxicity.score_toxicity(docs, toxicity.train_lexicon(docs, labels)), labels, "toxic", 0.5) > 0.85


def brute_losses(texts, target, size):
    """The same models by plain counting, without hashing; words are all in the vocabulary."""
    lists = [(t or "").lower().split() for t in texts]
    names = {w for ws in lists for w in ws}
    out = []
    for i, ws in enumerate(lists):
        per_model = []
        for rows in ([j for j in target if j != i], [j for j in range(len(lists)) if j != i]):
            one, two = {}, {}
            for j in rows:
                for a, b in zip([None, *lists[j]], lists[j]):
                    one[b] = one.get(b, 0) + 1
                    two[a, b] = two.get((a, b), 0) + 1
            total, loss = sum(one.values()), 0.0
            for a, b in zip([None, *ws], ws):
                both, first = two.get((a, b), 0), max(one.get(a, 0), two.get((a, b), 0))
                p = (one.get(b, 0) + 1) / (total + len(names) + 1)
                loss -= np.log2((both + lm_score.SMOOTHING * p) / (first + lm_score.SMOOTHING))
            per_model.append(loss / len(ws) if ws else 0.0)
        out.append(per_model)
    return out


def test_losses_equal_plain_counting(spark):
    texts = [prose(i, 30, 40 if i % 2 else 15) for i in range(30)] + ["", None, "w1"]
    docs, ids = frame(spark, texts), spark.createDataFrame([(i,) for i in range(0, 30, 2)] + [(0,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_documents(docs, ids, lm_score.train_models(docs)).collect()}
    want = brute_losses(texts, list(range(0, 30, 2)), 0)
    for i, (target, background) in enumerate(want):
        assert got[i].target_loss == pytest.approx(target, rel=1e-4)
        assert got[i].background_loss == pytest.approx(background, rel=1e-4)
        assert got[i].score == pytest.approx(target - background, abs=1e-3)
    alike = np.mean([got[i].score for i in range(0, 30, 2)])
    assert alike < np.mean([got[i].score for i in range(1, 30, 2)])


def test_hard_texts(spark):
    docs = frame(spark, HARD)
    nobody = spark.createDataFrame([(None,), (10**9,)], "doc_id long")
    got = lm_score.score_documents(docs, nobody, lm_score.train_models(docs)).collect()
    assert len(got) == len(HARD) and all(np.isfinite(r.score) for r in got)
    none = docs.filter("false")
    assert lm_score.score_documents(none, nobody, lm_score.train_models(none)).count() == 0


@pytest.mark.parametrize("chars, keys", [(10**9, 10**9), (20_000, 5_000)])
def test_losses_of_many_words(spark, chars, keys, monkeypatch):
    """More words than a fixed vocabulary would hold, a repeated row, null ids; one group and bucket, or many."""
    texts = [prose(i, 2500, 10**6) + " " + prose(i % 5, 20, 30) for i in range(24)] + ["", None, "w1", prose(3, 50), prose(3, 50)]
    ids = [*range(28), 27]
    docs = frame(spark, texts, ids)
    docs = docs.unionByName(frame(spark, ["w1 w2"], [None]))
    texts = [*texts, "w1 w2"]
    monkeypatch.setattr(lm_score, "CHUNK", 4000)
    monkeypatch.setattr(lm_score, "GROUP_CHARS", chars)
    monkeypatch.setattr(lm_score, "BUCKET_KEYS", keys)
    ids_of_target = spark.createDataFrame([(i,) for i in range(0, 24, 2)], "doc_id long")
    got = lm_score.score_documents(docs, ids_of_target, lm_score.train_models(docs)).collect()
    want = brute_losses(texts, list(range(0, 24, 2)), 0)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i in [*ids, None])
    by_id = {r.doc_id: r for r in got}
    for i, (target, background) in zip([*ids, None], want):
        assert by_id[i].n_words == len((texts[-1] if i is None else texts[i] or "").split())
        assert by_id[i].target_loss == pytest.approx(target, rel=1e-9)
        assert by_id[i].background_loss == pytest.approx(background, rel=1e-9)


def test_losses_with_more_words_than_a_fixed_vocabulary(spark):
    """40,000 different words: none becomes an unknown word, no pair shares the count of another."""
    texts = [" ".join(f"u{1000 * i + k}" for k in range(1000)) for i in range(40)] * 2
    docs, chosen = frame(spark, texts), spark.createDataFrame([(0,), (40,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_documents(docs, chosen, lm_score.train_models(docs)).collect()}
    for i, (target, background) in enumerate(brute_losses(texts, [0, 40], 0)):
        assert got[i].target_loss == pytest.approx(target, rel=1e-9)
        assert got[i].background_loss == pytest.approx(background, rel=1e-9)
