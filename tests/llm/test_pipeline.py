import os

import pytest
from text_cases import HARD, frame, prose

import corpus_pipeline
from cohortspark.llm import decontaminate, exact_dedup
from cohortspark.llm.queries import ORACLES, QUERIES
from cohortspark.llm.text import words

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not mounted")
def test_stages(spark, folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "exact_dedup":
            assert exact_dedup.exact_duplicates(docs).filter("not kept").isEmpty()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontaminate.contamination_report(docs, benchmark).filter("contaminated").isEmpty()
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    done = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in done} == left and all(r.n_tokens == len(r.token_ids) for r in done)


def plain_groups(texts):
    """One text of each group of near duplicates: the smallest number of those reached over links of 0.8 or more."""

    def shingles(t):
        w = words(t or "")
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    stays, seen = [], set()
    for i in sorted(sets):
        if i in seen:
            continue
        stays.append(i)
        todo = [i]
        while todo:
            a = todo.pop()
            seen.add(a)
            for b in sets:
                both = len(sets[a] & sets[b])
                if b not in seen and both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    todo.append(b)
                    seen.add(b)
    return stays


def contaminated(text, items):
    w = words(text or "")
    hit = set()
    for item in items:
        own = words(item or "")
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if windows and tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_on_hard_rows(spark, folder):
    """Every stage against a plain version: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    bench = [prose(900 + k, 30) for k in range(3)] + ["short item", "", None]
    texts = [*HARD, *[prose(k, 60) for k in range(20)], prose(3, 60).upper(), prose(3, 60), bench[0], prose(50, 40) + " " + bench[1], "a short item here"]
    texts += [prose(70, 80), prose(70, 80) + " more", prose(70, 80) + " word or two", prose(71, 80)]
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, [*texts, texts[15]], [*ids, 15])
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 60, 2)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scored = stages["quality"](spark, docs, folder)
    assert scored.columns == docs.columns

    exact = stages["exact_dedup"](spark, docs, folder)
    assert exact.columns == docs.columns
    best = {}
    for i, t in zip(ids, texts):
        key = (t or "").encode().lower()
        best[key] = max([best.get(key, i), i], key=lambda x: (x is not None, x or 0))
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr) == sorted([(i, texts[ids.index(i)]) for i in best.values()], key=repr)

    near = stages["near_dedup"](spark, docs, folder)
    stays = plain_groups({(i if i is not None else 10**9): t for i, t in zip(ids, texts)})
    assert sorted(((r.doc_id if r.doc_id is not None else 10**9) for r in near.collect())) == stays

    clean = stages["decontaminate"](spark, docs, folder)
    want = sorted([i for i, t in [*zip(ids, texts), (15, texts[15])] if not contaminated(t, bench)], key=repr)
    assert sorted([r.doc_id for r in clean.collect()], key=repr) == want and clean.columns == docs.columns

    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
