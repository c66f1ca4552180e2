"""Nearest neighbours and the rounds of the privacy thresholds against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import neighbours, privacy


def frame(spark, m, name, ids=None):
    ids = list(range(len(m))) if ids is None else ids
    kind = "string" if isinstance(ids[0], str) else "bigint"
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], f"{name} {kind}, vector array<double>")


def plain(ask, ref, k):
    with np.errstate(invalid="ignore"):
        total = sum(np.where(ask[:, None, d] == ref[None, :, d], 0.0, (ask[:, None, d] - ref[None, :, d]) ** 2) for d in range(ask.shape[1]))
    order = np.argsort(total, axis=1, kind="stable")[:, :k]
    return order, np.sqrt(np.take_along_axis(total, order, axis=1))


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e8, 0.0), (1e-3, 1e8), (1e160, 0.0)])
def test_values_of_any_size(spark, scale, shift):
    """Differences far below the rounding error of a matrix product decide, ties go to the lowest id."""
    rng = np.random.default_rng(1)
    ref = np.round(rng.normal(size=(500, 3)), 2) * scale + shift
    ask = np.round(rng.normal(size=(80, 3)), 2) * scale + shift
    order, far = plain(ask, ref, 3)
    got = {(r.q, r["rank"]): r for r in neighbours.knn_join(frame(spark, ask, "q"), frame(spark, ref, "r"), "q", "r", k=3).collect()}
    assert len(got) == 240
    for (q, rank), r in got.items():
        assert r.r == order[q, rank - 1] and (r.distance == far[q, rank - 1])


def test_infinite_values_and_text_ids(spark):
    rng = np.random.default_rng(2)
    ref, ask = np.round(rng.normal(size=(60, 3)), 1), np.round(rng.normal(size=(20, 3)), 1)
    ref[::5, 0], ref[1::7, 1], ask[::4, 0], ask[3, :] = np.inf, -np.inf, np.inf, np.inf
    names = [f"stay-{i:03d}" for i in range(60)]
    got = neighbours.knn_join(frame(spark, ask, "q", [f"s{i}" for i in range(20)]), frame(spark, ref, "r", names), "q", "r", k=2).collect()
    order, far = plain(ask, ref, 2)
    assert {(r.q, r["rank"]): (r.r, r.distance) for r in got} == {
        (f"s{i}", j + 1): (names[order[i, j]], far[i, j]) for i in range(20) for j in range(2)
    }


@pytest.mark.parametrize("metric", ["euclidean", "hamming"])
def test_groups_of_queries_meet_shards_of_cells(spark, monkeypatch, metric):
    """A task holds one group and one shard, not a batch of copied blocks; small shards, a crowded cell and ties change nothing."""
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 32)  # blocks of 16 rows
    monkeypatch.setattr(neighbours, "TILE", 3)
    rng = np.random.default_rng(5)
    ref, ask = np.round(rng.normal(size=(400, 4)), 1), np.round(rng.normal(size=(150, 4)), 1)
    ref[200:, :3] = 9.0  # one cell of many
    ref[200:, 3] = np.arange(200) // 2
    if metric == "hamming":
        ref, ask = np.floor(ref), np.floor(ask)
        far = (ask[:, None] != ref[None]).sum(-1) / 4
    else:
        far = sum((ask[:, None, d] - ref[None, :, d]) ** 2 for d in range(4))
    order = np.argsort(far, axis=1, kind="stable")[:, :3]
    far = far if metric == "hamming" else np.sqrt(far)
    joined = neighbours.knn_join(frame(spark, ask, "q"), frame(spark, ref, "r"), "q", "r", k=3, metric=metric, pivots=9)
    got = {(r.q, r["rank"]): (r.r, r.distance) for r in joined.collect()}
    assert got == {(i, j + 1): (order[i, j], far[i, order[i, j]]) for i in range(150) for j in range(3)}
    plan = joined._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_few_references(spark):
    ask = frame(spark, np.zeros((3, 2)), "q")
    assert neighbours.knn_join(ask, frame(spark, np.ones((2, 2)), "r"), "q", "r", k=5).count() == 6
    none = neighbours.knn_join(ask, frame(spark, np.ones((1, 2)), "r").limit(0), "q", "r")
    assert none.count() == 0 and none.columns == ["q", "r", "distance", "rank"]


def test_more_pivots_mean_less_work():
    """References that a query must meet fall as pivots grow with the square root of the references."""
    rng = np.random.default_rng(3)
    ref, ask = rng.normal(size=(20_000, 3)), rng.normal(size=(200, 3))
    bound = np.sqrt(((ask[:, None] - ref[None]) ** 2).sum(-1).min(1))
    work = {}
    for pivots in (1, 12, 141):
        tree = neighbours.PivotTree(ref[:pivots], "euclidean")
        cell, radius, top = tree.place(ref)
        cells = [{"cell": c, "far": radius[cell == c].max(), "top_far": top[cell == c].max()} for c in np.unique(cell)]
        tree.measure(cells)
        sizes = np.bincount(cell, minlength=pivots)
        work[pivots] = sum(sizes[c] * len(rows) for c, rows in tree.visits(ask, bound)) / len(ask) + pivots
    assert work[1] > 20_000 and work[12] < 0.5 * work[1] and work[141] < 0.3 * work[12]
    assert work[141] < 0.06 * len(ref)


def plain_rounds(df, points):
    """Risks of each round from the halves themselves."""
    out = {}
    for round_ in sorted({r["round"] for r in df}):
        half = {h: [r for r in df if r["round"] == round_ and r.half == h] for h in "ab"}
        a, b = (np.array([points[r.id] for r in sorted(half[h], key=lambda r: r.pos)]) for h in "ab")
        d = np.sqrt(sum((b[:, None, k] - a[None, :, k]) ** 2 for k in range(a.shape[1])))
        nearest, best = d.argmin(1), d.min(1)
        np.fill_diagonal(d, np.inf)
        hit = (best < d.min(1)[nearest]).mean()
        same = (best == 0).mean()
        out[round_] = (round(1 - (1 - same) ** 2, 12), round(float(hit), 12))
    return out


@pytest.mark.parametrize("near", [2, 24])
def test_rounds_equal_those_of_their_halves(spark, monkeypatch, near):
    """Short lists are made longer until every round is settled; a third of the rows are copies."""
    monkeypatch.setattr(privacy, "NEAR", near)
    monkeypatch.setattr(privacy.nearest_in_halves, "__defaults__", (near,))
    rng = random.Random(4)
    table = [(f"s{i}", *((1.0, 2.0) if i % 3 == 0 else (float(rng.randrange(30)), float(rng.randrange(30))))) for i in range(121)]
    df = spark.createDataFrame(table, "id string, x double, y double")
    halves = privacy.random_halves(df.select("id"), "id", 5).collect()
    want = plain_rounds(halves, {i: (x, y) for i, x, y in table})
    got = privacy.risk_rounds(df, "id", ["x", "y"], 5).collect()
    assert {r["round"]: (round(r.single_out_risk, 12), round(r.inference_risk, 12)) for r in got} == want


def test_rounds_with_missing_and_infinite_values(spark):
    table = [(i, None if i % 5 == 0 else float("nan") if i % 5 == 1 else float("inf") if i % 7 == 0 else float(i % 11)) for i in range(60)]
    df = spark.createDataFrame(table, "id long, x double").withColumn("y", F.col("id") % 2)
    got = privacy.risk_rounds(df, "id", ["x", "y"], 3).collect()
    assert len(got) == 3 and all(0 <= r.single_out_risk <= 1 and 0 <= r.inference_risk <= 1 for r in got)


@pytest.mark.parametrize("tile", [1, 2, 64])
def test_kernel_means_in_tiles(spark, monkeypatch, tile):
    """Every pair of blocks is met once, in whatever tiles; blocks are copied to a row or a column of tiles."""
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 32)  # blocks of 16 rows
    monkeypatch.setattr(neighbours, "TILE", tile)
    rng = np.random.default_rng(6)
    x, y = np.round(rng.normal(size=(170, 2)), 1), np.round(rng.normal(size=(90, 2)) + 0.4, 1)
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 2).mean()
    got = neighbours.mmd(frame(spark, x, "q"), frame(spark, y, "q")).first()[0]
    assert abs(got - (kernel(x, x) + kernel(y, y) - 2 * kernel(x, y))) < 1e-12


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_kernel_by_matrix_product(monkeypatch, scale):
    """The matrix product serves where its rounding does not matter; large values go coordinate by coordinate."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 8)) + scale
    asked = []
    plainly = neighbours._distances
    monkeypatch.setattr(neighbours, "_distances", lambda *a: asked.append(1) or plainly(*a))
    got = neighbours._kernel(x, x[:20], 1.0)
    assert np.abs(got - np.exp(-((x[:, None] - x[None, :20]) ** 2).sum(-1) / 2)).max() < 1e-11
    assert len(asked) == (scale > 1)
