"""Merkle manifests against a plain computation."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm import merkle

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("tree", "pos", "n", "segment", "root", "row", "level", "digest")],
    ]
)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """Root, and for each leaf the siblings (left, right) of each level."""
    ways, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in own[at + k]:
                    ways[i].append((run[:k], run[k + 1 :]))
            up.append(digest(*run))
            below.append([i for k in range(len(run)) for i in own[at + k]])
        nodes, own = up, below
    return nodes[0], ways


def plain(rows, found):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][3] is not None, (rows[i][3] or "").encode(), rows[i][0] is not None, rows[i][0] or 0, leaf(rows[i], rows[i][1])))
    by_source = {}
    for i in order:
        by_source.setdefault(rows[i][3], []).append(i)
    trees = {s: plain_tree([leaf(rows[i], rows[i][1]) for i in own]) for s, own in by_source.items()}
    root, tops = plain_tree([trees[s][0] for s in by_source])
    out = []
    for top, (source, own) in zip(tops, by_source.items()):
        subroot, ways = trees[source]
        for i, way in zip(own, ways):
            node = leaf(rows[i], found[i])
            for left, right in way + top:
                node = digest(*left, node, *right)
            beside = digest(*[x for left, right in way + top for x in left + right])
            out.append((rows[i][0], leaf(rows[i], rows[i][1]), subroot, root, beside, node, node == root))
    return sorted(out, key=repr)


def check(spark, rows):
    full = [(*r, *["x"] * 8) for r in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    got = merkle.manifest(docs, F.replace("text", F.lit("\n"), F.lit("")))
    got = sorted((tuple(r) for r in got.drop("proof").collect()), key=repr)
    assert got == plain(rows, [t if t is None else t.replace("\n", "") for _, t, *_ in rows])
    return got


def test_manifest_of_many_heights(spark):
    sizes = {None: 5, "": 1, "a": 100, "b": 3, "c": 4, "é": 10, "Z": 28}
    rows, doc_id = [], 0
    for source, n in sizes.items():
        for k in range(n):
            doc_id += 7
            rows.append((doc_id % 1000, "line\n" * (k % 3) + "end", "xx" if k % 4 else None, source, k if k % 5 else None))
    got = check(spark, rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_hard_rows(spark):
    rows = [
        (None, None, None, None, None),
        (None, "", None, None, None),
        (1, "same", "en", "s", 4),
        (1, "same", "en", "s", 4),
        (1, "other\nway", "en", "s", 4),
        (-5, "x" * 200_000 + "\n", "en", "s", 4),
    ]
    check(spark, rows)
    assert check(spark, [(1, None, None, None, None)])[0][-1]


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_jumps_with_salts(spark, monkeypatch):
    """Ancestors with more than SPAN descendants are there several times; each row still meets one."""
    monkeypatch.setattr(merkle, "SPAN", 3)
    rows = [(i, f"t{i}\n", "en", "s" if i % 3 else "t", i) for i in range(300)]
    check(spark, rows)


@pytest.mark.parametrize("n,height", [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (9, 2), (10, 3)])
def test_height(n, height):
    assert merkle.height_of(n) == height
