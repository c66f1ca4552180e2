"""Sketches and their estimates against plain computations."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from text_cases import HARD, frame, prose

from cohortspark.llm import fingerprint as fp
from cohortspark.llm import queries


def plain_shingles(text):
    ws = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    size, out = min(5, len(ws)), set()
    for i in range(len(ws) - size + 1 if ws else 0):
        h = 42
        for w in ws[i : i + size]:
            h = xxhash.xxh64_intdigest(w, h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def plain_print(text):
    return "".join(f"{h & (2**64 - 1):016x}" for h in sorted(plain_shingles(text))[: fp.HASHES])


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_hard_rows(spark):
    got = {r.doc_id: r for r in fp.fingerprints(frame(spark, HARD)).collect()}
    for i, text in enumerate(HARD):
        own = plain_shingles(text)
        assert got[i].fingerprint == plain_print(text) and got[i].n_chars == len(text or "")
        assert abs(got[i].n_shingles - len(own)) <= (0.5 * len(own) if len(own) >= fp.HASHES else 0)
    assert fp.fingerprints(frame(spark, [])).count() == 0


def test_parts_merge_to_the_whole(spark):
    words = prose(3, 3000, 5000).split()
    whole = " ".join(words)
    parts = [" ".join(words[max(0, at - 4) : at + 500]) for at in range(0, 3000, 500)]  # parts overlap by four words
    docs = spark.createDataFrame([(1, p) for p in parts] + [(2, ""), (None, "a b c d e"), (None, "f g h i j")], "doc_id long, text string")
    merged = fp.merge_parts(fp.fingerprints(docs).select("doc_id", "sketch"), ["doc_id"])
    got = {r.doc_id: r.sketch for r in merged.collect()}
    assert got[1] == sorted(plain_shingles(whole))[: fp.HASHES]
    assert got[2] == [] and got[None] == sorted(plain_shingles("a b c d e") | plain_shingles("f g h i j"))
    two = fp.with_sketch(spark.createDataFrame([(parts[0], parts[1])], "a string, b string"), "a", "x")
    two = fp.with_sketch(two, "b", "y").select(fp.merged(F.col("x"), F.col("y")).alias("m")).first()
    assert two.m == sorted(plain_shingles(parts[0]) | plain_shingles(parts[1]))[: fp.HASHES]


def test_estimates(spark):
    base = prose(1, 4000, 10**6).split()
    rows = [(" ".join(base[:k]), " ".join(base[:3000])) for k in (3, 20, 300, 1500, 3000, 4000)] + [("", ""), ("", "a b"), ("a b", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    got = df.select(fp.resemblance(x, y).alias("r"), fp.containment(x, y).alias("c"), fp.distinct_count(x).alias("n")).collect()
    for (a, b), r in zip(rows, got):
        p, q = plain_shingles(a), plain_shingles(b)
        assert abs(r.r - share(p, q)) < 0.2 and abs(r.n - len(p)) <= 0.4 * len(p)
        want = len(p & q) / len(p) if p else 1.0
        assert abs(r.c - want) < 0.2 if r.c is not None else len(p) < 100 < len(q)
    assert got[4].r == 1.0


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_next_in_descending_order(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for ids in ([*range(0, 300, 3)], [5], [7, 7, 7, 3, 3, -2], [4, None, None, 9], [None], [2**60, -(2**60), 0]):
            rows = [(i, f"t{k}", k) for k, i in enumerate(ids)]
            docs = spark.createDataFrame(rows, "doc_id long, text string, mark long")
            got = [(r.doc_id, r.mark, r.next.text) for r in fp.with_next(docs, ["text"]).collect()]
            order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
            assert sorted(got, key=repr) == sorted([(r[0], r[2], order[(k + 1) % len(order)][1]) for k, r in enumerate(order)], key=repr)
        assert fp.with_next(docs.limit(0), ["text"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_query(spark, folder):
    texts = [*HARD, *[prose(k, 30 + 7 * k) for k in range(40)], "Ünï " * 100]
    frame(spark, texts).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op13_fingerprints"](spark, folder).collect()}
    order = [t or "" for t in texts][::-1]
    errors = []
    for k, text in enumerate(order):
        after = order[(k + 1) % len(order)]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[len(texts) - 1 - k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain_print(text) and r.edited_fingerprint == plain_print(edited)
        errors.append(r.near_edited - share(plain_shingles(text), plain_shingles(edited)))
        errors.append(r.near_next - share(plain_shingles(text), plain_shingles(after)))
    assert np.abs(errors).max() < 0.25 and np.std(errors) < 0.07
