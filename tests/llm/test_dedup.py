import hashlib
import random

import pytest
from text_cases import HARD, frame, prose

from cohortspark.llm import exact_dedup, path_join
from cohortspark.llm.components import components
from cohortspark.llm.text import keep_rows, words


def lowered(t):
    return (t or "").encode().lower().decode()


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    low = lambda i: (i is not None, i or 0)
    return sorted(
        ((i, max(groups[lowered(t)], key=low), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows),
        key=repr,
    )


def test_fingerprints_combine():
    own = exact_dedup.Fingerprint(chunk=64)
    data = bytes(random.Random(3).randrange(256) for _ in range(1000))
    for cut in (0, 1, 63, 64, 500, 1000):
        assert own.combine(own.of(data[:cut]), own.of(data[cut:]), len(data) - cut) == own.of(data)
    value = 0
    for b in data:
        value = (value * exact_dedup.BASES[0] + b) % exact_dedup.PRIMES[0]
    assert own.of(data)[0] == value


@pytest.mark.parametrize("primes, bases, chunk", [(exact_dedup.PRIMES, exact_dedup.BASES, 1 << 16), ((3,), (2,), 8)])
def test_exact_copies(spark, primes, bases, chunk):
    """With one tiny prime nearly every fingerprint of a length collides and the comparison has to tell."""
    texts = [*HARD, "abcd", "abdc", "ABCD", "bacd", "same text here for yoU"]
    rows = list(zip([*range(len(texts) - 1), None], texts)) + [(8, HARD[8])]  # a repeated row and a null id
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = exact_dedup.exact_duplicates(docs, primes, bases, chunk).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_exact(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({lowered(t) for _, t in rows})
    stay = keep_rows(docs, exact_dedup.exact_duplicates(docs, primes, bases, chunk).filter("kept"))
    assert stay.columns == docs.columns and stay.count() == len(kept)


def test_no_rows(spark):
    docs = frame(spark, ["a"]).filter("false")
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert path_join.near_duplicates(docs).count() == 0


def shingle_set(t):
    w = words(t or "")
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_near(texts):
    sets = [shingle_set(t) for t in texts]
    links = {i: set() for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (min(seen), len(seen), len(links[i]))
    return out


def changed(text, seed, n):
    own, pick = text.split(" "), random.Random(seed)
    for _ in range(n):
        own[pick.randrange(len(own))] = f"z{pick.randrange(10**6)}"
    return " ".join(own)


@pytest.mark.parametrize("bucket, depth, block", [(64, 8, 256), (4, 3, 8), (4, 6, 8)])
def test_near_copies(spark, bucket, depth, block):
    """Groups of near copies, one of them far larger than a bucket and a block, with a passage many texts share."""
    passage = prose(99, 60)
    texts = list(HARD)
    for g in range(12):
        base = prose(1000 + g, 150)
        texts += [changed(base, 10 * g + k, 3 * k) for k in range(4)]
    texts += [passage + " " + prose(2000 + k, 80) for k in range(90)]
    big = prose(7, 200)
    texts += [changed(big, 5000 + k, 1 + k % 3) for k in range(80)] + [big] * 10
    got = path_join.near_duplicates(frame(spark, texts), bucket=bucket, depth=depth, block=block).collect()
    want = brute_near(texts)
    assert len(got) == len(texts)
    assert {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in got} == want
    assert sum(r.stays for r in got) == len({w[0] for w in want.values()})


def test_repeated_rows_among_near_copies(spark):
    """A row that is there several times, with an id and without one, is counted as so many copies."""
    base = prose(31, 120)
    texts = [base, base, base, changed(base, 1, 1), changed(base, 2, 1), changed(base, 3, 2), prose(32, 90), prose(32, 90)]
    texts += [changed(base, 4, 1)] * 2
    ids = [3, 3, 3, 4, 5, 6, 9, 9, None, None]
    got = path_join.near_duplicates(frame(spark, texts, ids)).collect()
    want = brute_near(texts)
    assert sorted((r.doc_id or 0, r.class_id, r.class_size, r.n_links) for r in got) == sorted(
        (i or 0, ids[want[k][0]], *want[k][1:]) for k, i in enumerate(ids)
    )
    assert sum(r.stays for r in got) == 2


def test_runs_for_recall():
    assert path_join.runs_for(0.5, 1) == 1
    assert path_join.runs_for(0.999, 2) == 11
    assert path_join.runs_for(0.999) == path_join.runs_for(0.999, path_join.FIRST) == 15


def test_pairs_in_deep_buckets(spark, monkeypatch):
    """Pairs just above the threshold among texts that share a passage: runs are asked for as deep as buckets are split."""
    asked, runs_for = [], path_join.runs_for
    monkeypatch.setattr(path_join, "runs_for", lambda recall, levels=2: asked.append(levels) or runs_for(recall, levels))
    passage, texts = prose(77, 70), []
    for k in range(150):
        own = f"{passage} {prose(3000 + k, 90, 5000)}".split(" ")
        other = [*own]
        for at in (100, 116, 132):  # each takes five shingles of 156: a similarity of 141 / 171
            other[at] = f"y{k}"
        texts += [" ".join(own), " ".join(other)]
    pairs = sum(w[2] for w in brute_near(texts).values()) // 2
    assert pairs == 150
    got = path_join.near_duplicates(frame(spark, texts), recall=0.9, bucket=2, depth=8).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 2 * pairs
    assert max(asked) > path_join.FIRST


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
