"""Runs of words against a comparison at every lag."""

import hashlib
import os
import random
import zlib

import pytest
from text_cases import HARD, frame

from cohortspark.llm import periodic
from cohortspark.llm.queries import QUERIES


def plain(words):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in drop)


def cases():
    rng = random.Random(11)
    thue = [b"ab"[bin(i).count("1") & 1 :][:1] for i in range(600)]
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    out = [thue, [c.encode() for c in b], [b"a"] * 400, [b"a"] * 150 + [b"b"] + [b"a"] * 150, ([b"a", b"b"] * 60 + [b"a"]) * 3, [], [b"x"]]
    for _ in range(150):
        words = [str(rng.randrange(rng.choice([1, 2, 3, 20, 200]))).encode() for _ in range(rng.randrange(420))]
        for _ in range(rng.randrange(4) if len(words) > 5 else 0):
            at = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - at) // 2))
            for i in range(at, min(len(words), at + p * rng.randrange(2, 5) + rng.randrange(p))):
                words[i] = words[at + (i - at) % p]
        unit = [str(rng.randrange(3)).encode() for _ in range(rng.randrange(1, 5))] * 200  # two periodic stretches side by side
        words += unit[rng.randrange(4) :][: rng.randrange(150)] + unit[rng.randrange(4) :][: rng.randrange(150)]
        out.append(words)
    return out


def test_runs_equal_those_of_every_lag():
    texts = cases()
    for words, together in zip(texts, periodic.runs_of(texts)):
        assert [tuple(r) for r in together.tolist()] == plain(words)
        alone = periodic.runs_of([words])[0]
        assert alone.tolist() == together.tolist()


def test_equal_hashes_do_no_harm(monkeypatch):
    """With primes so small that different stretches share a hash, runs stay right."""
    monkeypatch.setattr(periodic, "_PRIMES", (7, 11))
    monkeypatch.setattr(periodic, "_BASES", (3, 5))
    texts = cases()[:60]
    for words, runs in zip(texts, periodic.runs_of(texts)):
        got = [tuple(r) for r in runs.tolist()]
        assert set(got) <= set(plain(words))
        assert got == plain(words)


def test_long_texts_take_few_seeds():
    for words in ([b"a"] * 50_000 + [b"b"] + [b"a"] * 50_000, [str(i % 7_000).encode() for i in range(40_000)]):
        runs = periodic.runs_of([words])[0].tolist()
        assert runs == ([[0, 50_000, 1], [50_001, 50_000, 1]] if len(words) > 50_000 else [[0, 40_000, 7_000]])


def test_hard_rows(spark):
    texts = [*HARD, "a b " * 10, "x\x0by\x0cz " * 5, "é é " * 12]
    got = {r.doc_id: r for r in periodic.find_runs(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        own = plain(words) if len(words) < 2000 else None
        assert got[i].n_words == len(words)
        if own is not None:
            assert [tuple(r) for r in got[i].runs] == own and got[i].collapsed.encode() == kept(words, own)
    assert periodic.find_runs(frame(spark, [])).count() == 0
    assert periodic.find_runs(frame(spark, ["a", "a"], [None, None])).count() == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables not mounted")
def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = (row.text or "").encode().split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        want = (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(words, runs)).hexdigest())
        assert got[row.doc_id] == want
