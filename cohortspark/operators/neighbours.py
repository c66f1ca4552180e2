"""Exact nearest-neighbour joins and kernel means over vector columns.

Neither a cross join nor a per-row pair is produced.  Equal vectors are collapsed first.  Reference vectors are put
in the cells of a two-level pivot tree, about as many cells as the square root of the references, and cells are cut
into blocks of bounded size.  A query first meets the cell of its nearest pivot, which gives it a bound; then it
goes to the cells that can hold something as near (triangle-inequality and bisector bounds on both levels of the
tree).  Cells are gathered in shards and queries in groups of bounded size; a group and a shard meet in one task, which
goes through the cells with the bounds as they shrink and returns at most k candidates per query.  Distances are a
matrix product; whatever is within its rounding error of the k nearest is computed again coordinate by coordinate,
so the result is exact for every metric below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import settled

BLOCK_CELLS = 1 << 16  # numbers per packed block: half a megabyte
PIVOT_NUMBERS = 1 << 22  # numbers of all pivots, which every task holds: 32 megabytes
TILE = 64  # blocks on a side of a tile of block pairs: 32 megabytes
FOUND = 1 << 22  # candidates of a group of queries in a shard
SLACK = 1e-9


def vector_of(columns: Sequence[str], fill: float = -1.0) -> Column:
    """Row vector with missing values replaced."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill)) for c in columns])


def _gap(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """What a coordinate adds; equal values, infinite ones too, add nothing."""
    if metric != "euclidean":
        return a != b
    with np.errstate(invalid="ignore", over="ignore"):
        gap = a - b
        return np.where(a == b, 0.0, gap * gap)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared Euclidean distances, or the share of differing coordinates; summed in coordinate order."""
    out = np.zeros((len(a), len(b)), float if metric == "euclidean" else np.int16 if a.shape[1] < 32768 else np.int64)
    for d in range(a.shape[1]):
        out += _gap(np.ascontiguousarray(a[:, d])[:, None], np.ascontiguousarray(b[:, d])[None, :], metric)
    return out if metric == "euclidean" else out / a.shape[1]


def _lowest(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k lowest (d, j) of each i, in order, with their place from 0; NaN is the largest distance."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], d[place < k], place[place < k]


def _near(a: np.ndarray, b: np.ndarray, k: int, metric: str, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance as in ``_distances``): all pairs that can be of the k nearest and no farther than ``cut``."""
    if metric == "euclidean" and np.isfinite(a).all() and np.isfinite(b).all():
        with np.errstate(over="ignore", invalid="ignore"):
            a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
            about = a @ (-2.0 * b.T)
            about += a2[:, None]
            about += b2[None, :]
            error = 4.0 * (a.shape[1] + 4) * np.finfo(float).eps * (a2 + b2.max())
            last = cut + error
            wide = ~np.isfinite(cut)
            if wide.any() and len(b) > k:
                last[wide] = np.partition(about[wide], k - 1, axis=1)[:, k - 1] + 2.0 * error[wide]
            i, j = np.nonzero(~(about > last[:, None]))  # overflown ones stay
            exact = np.zeros(len(i))
            for d in range(a.shape[1]):
                exact += _gap(a[i, d], b[j, d], metric)
    else:
        exact = _distances(a, b, metric)
        last = cut.copy()
        wide = ~np.isfinite(cut)
        if wide.any() and len(b) > k:
            last[wide] = np.partition(exact[wide], k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(~(exact > last[:, None]))
        exact = exact[i, j]
    return i, j, exact


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers in place of values, equal where the values are; NaN equals nothing."""
    codes = np.empty((len(a) + len(b), a.shape[1]), np.int32)
    for d in range(a.shape[1]):
        codes[:, d] = np.unique(np.concatenate([a[:, d], b[:, d]]), return_inverse=True, equal_nan=False)[1]
    small = np.int8 if codes.max(initial=0) < 128 else np.int16 if codes.max(initial=0) < 32768 else np.int32
    codes = codes.astype(small)
    return codes[: len(a)], codes[len(a) :]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The runs of sorted keys: their keys and places."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], [slice(x, y) for x, y in zip(starts, [*starts[1:], len(keys)])]


def _metric(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    d = _distances(a, b, metric)
    return np.sqrt(d) if metric == "euclidean" else d


def _rows(dim: int) -> int:
    return max(16, BLOCK_CELLS // max(dim, 1))


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64).reshape(-1, dim)


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, dim)


class PivotTree:
    """Pivots on two levels: every leaf pivot belongs to the nearest of about the square root as many top pivots."""

    def __init__(self, points: np.ndarray, metric: str):
        """:param points: distinct vectors in an order that has nothing to do with their values."""
        self.metric = metric
        self.tops = points[: max(1, isqrt(len(points)))]
        top = _metric(points, self.tops, metric).argmin(axis=1)
        order = np.argsort(top, kind="stable")
        self.leaves, self.top = points[order], top[order]
        self.starts = np.searchsorted(self.top, np.arange(len(self.tops) + 1))
        self.far = self.reach = None

    def under(self, top: int) -> slice:
        return slice(self.starts[top], self.starts[top + 1])

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to it, distance to its top) of vectors: the nearest leaf of the nearest top pivot."""
        near = _metric(v, self.tops, self.metric)
        top = near.argmin(axis=1)
        leaf, radius = np.zeros(len(v), np.int64), np.zeros(len(v))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            d = _metric(v[rows], self.leaves[self.under(t)], self.metric)
            leaf[rows] = self.starts[t] + d.argmin(axis=1)
            radius[rows] = d.min(axis=1)
        return leaf, radius, near[np.arange(len(v)), top]

    def measure(self, cells: Sequence) -> None:
        """Take the largest distances (cell, far, top_far) of the references from their leaf and top pivots."""
        self.far, self.reach = np.full(len(self.leaves), -1.0), np.full(len(self.tops), -1.0)
        for c in cells:
            self.far[c["cell"]] = c["far"]
            self.reach[self.top[c["cell"]]] = max(self.reach[self.top[c["cell"]]], c["top_far"])

    def home(self, v: np.ndarray) -> np.ndarray:
        """A cell with references near each vector."""
        near = np.where(self.reach >= 0, _metric(v, self.tops, self.metric), np.inf)
        top = np.where(np.isfinite(near.min(axis=1)), near.argmin(axis=1), np.flatnonzero(self.reach >= 0)[0])
        cell = np.zeros(len(v), np.int64)
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            used = np.flatnonzero(self.far[self.under(t)] >= 0) + self.starts[t]
            cell[rows] = used[_metric(v[rows], self.leaves[used], self.metric).argmin(axis=1)]
        return cell

    def visits(self, v: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows of v that can have a reference there within their bound), for all or the ``wanted`` cells.

        ``bounds`` may shrink meanwhile; they are looked at again for each top pivot.
        """
        wanted = self.far >= 0 if wanted is None else wanted
        tops = [t for t in np.flatnonzero(self.reach >= 0) if wanted[self.under(t)].any()]
        near = _metric(v, self.tops[tops], self.metric)
        with np.errstate(invalid="ignore", divide="ignore"):
            for at, t in enumerate(tops):
                bound = bounds * (1 + SLACK) + SLACK
                rows = np.flatnonzero(~(near[:, at] - self.reach[t] > bound))
                if not len(rows):
                    continue
                cells = np.arange(self.starts[t], self.starts[t + 1])
                d = _metric(v[rows], self.leaves[cells], self.metric)
                far = self.far[cells][None, :]
                low = d - far
                if self.metric == "euclidean":  # references here are no nearer to another leaf of this top
                    best = d.argmin(axis=1)
                    own = d[np.arange(len(rows)), best]
                    between = _metric(self.leaves[cells], self.leaves[cells], self.metric)[best]
                    low = np.fmax(low, np.where(between > 0, (d * d - (own * own)[:, None]) / (2 * between), 0.0))
                low = np.where(np.isfinite(d) & np.isfinite(far) & np.isfinite(d.min(axis=1))[:, None], low, -np.inf)
                open_cells = wanted[cells][None, :] & ~(low > bound[rows][:, None])
                for c in np.flatnonzero(open_cells.any(axis=0)):
                    yield int(cells[c]), rows[open_cells[:, c]]


def _pivot_tree(kept: DataFrame, metric: str, pivots: int | None) -> PivotTree | None:
    """Tree over a hash-ordered sample of about the square root of the references; None if there are none."""
    found = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not found["n"]:
        return None
    wanted = pivots or max(1, isqrt(found["n"]))
    wanted = max(1, min(wanted, PIVOT_NUMBERS // max(found["d"], 1)))
    seeds = kept.orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    points = np.array([s["v"] for s in seeds], dtype=np.float64).reshape(len(seeds), found["d"])
    _, first = np.unique(points, axis=0, return_index=True)
    return PivotTree(points[np.sort(first)], metric)


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    query_id: str,
    ref_id: str,
    vector: str = "vector",
    k: int = 1,
    metric: str = "euclidean",
    pivots: int | None = None,
) -> DataFrame:
    """(query_id, ref_id, distance, rank): the k nearest references of each query, lowest id first on ties.

    Ids are numbers or text, unique in their table; vectors hold no nulls.  ``pivots`` are about the square root of
    the references unless given.  Equal infinite coordinates are no distance apart.  No references give no rows.
    """
    spark = queries.sparkSession
    q_type, r_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (refs, ref_id)))
    same = Window.partitionBy("v").orderBy("r")
    kept = (
        refs.select(F.col(ref_id).alias("r"), F.col(vector).cast("array<double>").alias("v"))
        .withColumn("_c", F.row_number().over(same))
        .filter(F.col("_c") <= k)
        .drop("_c")
    )
    kept = settled(kept)
    asked = queries.select(F.col(query_id).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    tree = _pivot_tree(kept, metric, pivots)
    if tree is None:
        return spark.createDataFrame([], f"`{query_id}` {q_type}, `{ref_id}` {r_type}, distance double, rank int")
    dim = tree.leaves.shape[1]
    block = _rows(dim)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, radius, top_radius = tree.place(_matrix(batch["v"], dim))
                yield batch.assign(cell=cell.astype(np.int32), radius=radius, top_radius=top_radius)

    placed = settled(kept.mapInPandas(assign, f"r {r_type}, v array<double>, cell int, radius double, top_radius double"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("far"), F.max("top_radius").alias("top_far"))
    cells = sorted(sizes.collect(), key=lambda c: c["cell"])  # one row for each pivot at most
    tree.measure(cells)
    distinct = settled(asked.groupBy("v").agg(F.min("qid").alias("q")))
    n_asked = distinct.count()
    side = min(TILE, ceil(ceil(max(n_asked, sum(c["n"] for c in cells)) / block) ** 0.5)) * block
    groups = ceil(max(n_asked, 1) / max(1, min(side, FOUND // k)))

    # Neighbouring cells share a shard of at most ``side`` references or so; a larger cell is spread over shards of its own.
    deal, shard, filled = [], 0, 0
    for c in cells:
        if filled and filled + c["n"] > side:
            shard, filled = shard + 1, 0
        parts = ceil(c["n"] / side)
        deal.append((c["cell"], shard, parts))
        shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + c["n"])
    dealt = spark.createDataFrame(deal, "cell int, shard int, parts int")
    shards_of = np.zeros((len(tree.leaves), 2), np.int64)  # first shard and number of shards of a cell
    shards_of[[d[0] for d in deal]] = [d[1:] for d in deal]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (shard, cell), g in batch.groupby(["shard", "cell"], sort=False):
                for at in range(0, len(g), block):
                    piece = g.iloc[at : at + block]
                    yield pd.DataFrame({"shard": [shard], "cell": [cell], "rid": [piece["r"].tolist()], "rv": [_matrix(piece["v"], dim).tobytes()]})

    spread = placed.join(F.broadcast(dealt), "cell").withColumn("shard", (F.col("shard") + F.pmod(F.xxhash64("r"), F.col("parts"))).cast("int"))
    spread = spread.select("shard", "cell", "r", "v").repartition("shard", "cell")
    ref_blocks = settled(spread.mapInPandas(pack, f"shard int, cell int, rid array<{r_type}>, rv binary"))

    id_kinds = [object if t == "string" else None for t in (q_type, r_type)]

    def meet(key: tuple, asks: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(refs):
            return pd.DataFrame({"q": pd.Series([], dtype=id_kinds[0] or "int64"), "r": pd.Series([], dtype=id_kinds[1] or "int64"), "d": pd.Series([], dtype=float)})
        ask = np.concatenate([_unpack(raw, dim) for raw in asks["qv"]])
        cut_all = np.concatenate([np.frombuffer(raw) for raw in asks["cut"]])
        rid = np.concatenate([np.asarray(r, id_kinds[1]) for r in refs["rid"]])
        cell_of = np.repeat(refs["cell"].to_numpy(), [len(r) for r in refs["rid"]])
        order = np.argsort(rid, kind="stable")
        rid, cell_of = rid[order], cell_of[order]
        ref = np.concatenate([_unpack(raw, dim) for raw in refs["rv"]])[order]
        ask_codes, ref_codes = (ask, ref) if metric == "euclidean" else _coded(ask, ref)
        by_cell = np.argsort(cell_of, kind="stable")  # inside a cell by id
        held = {int(c): by_cell[at] for c, at in zip(*_runs(cell_of[by_cell]))}
        wanted = np.zeros(len(tree.leaves), bool)
        wanted[list(held)] = True
        q_at, r_at, found = [], [], []
        size = max(1, min(block, FOUND // k))
        for at in range(0, len(ask), size):
            v, codes, cut = ask[at : at + size], ask_codes[at : at + size], cut_all[at : at + size].copy()
            bound = np.sqrt(cut) if metric == "euclidean" else cut.copy()
            far, who = np.full((len(v), min(k, len(ref))), np.nan), np.full((len(v), min(k, len(ref))), -1)

            def look(cell: int, rows: np.ndarray) -> None:
                there = held[cell]
                for begin in range(0, len(there), block):
                    some = there[begin : begin + block]
                    i, j, d = _near(codes[rows], ref_codes[some], k, metric, cut[rows])
                    if not len(i):
                        continue
                    i, j = rows[i], some[j]
                    touched = np.unique(i)
                    old, slot = np.nonzero(who[touched] >= 0)
                    old = touched[old]
                    slots = (old, slot)
                    i, j, d, place = _lowest(np.concatenate([old, i]), np.concatenate([who[slots], j]), np.concatenate([far[slots], d]), k)
                    far[i, place], who[i, place] = d, j
                    if far.shape[1] == k:
                        last = np.where((who[touched, -1] >= 0) & ~np.isnan(far[touched, -1]), far[touched, -1], np.inf)
                        cut[touched] = np.minimum(cut[touched], last)
                        bound[touched] = np.sqrt(cut[touched]) if metric == "euclidean" else cut[touched]

            home = tree.home(v)
            for c in np.unique(home):
                if int(c) in held:
                    look(int(c), np.flatnonzero(home == c))
            for c, rows in tree.visits(v, bound, wanted):
                rows = rows[home[rows] != c]
                if len(rows):
                    look(c, rows)
            rows, slot = np.nonzero(who >= 0)
            q_at.append(at + rows), r_at.append(who[rows, slot]), found.append(far[rows, slot])
        qid = np.concatenate([np.asarray(q, id_kinds[0]) for q in asks["qid"]])
        q_ids, r_ids = qid[np.concatenate(q_at)], rid[np.concatenate(r_at)]
        return pd.DataFrame({"q": pd.Series(q_ids, dtype=q_ids.dtype), "r": pd.Series(r_ids, dtype=r_ids.dtype), "d": np.concatenate(found)})

    def met(asks: DataFrame) -> DataFrame:
        """Candidates (q, r, d) of packed queries (shard, part, qid, qv, cut); a shard is handed to every group of queries."""
        each = ref_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        both = asks.groupBy("shard", "part").cogroup(each.groupBy("shard", "part"))
        return both.applyInPandas(meet, f"q {q_type}, r {r_type}, d double")

    def routed(shards) -> Callable:
        """``shards(vectors, bounds)`` gives (shard, rows); the queries of a batch for a shard are packed together."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part, g in batch.groupby("part", sort=False):
                    for begin in range(0, len(g), block):
                        some = g.iloc[begin : begin + block]
                        ids, v, cut = some["q"].to_numpy(), _matrix(some["v"], dim), some["cut"].fillna(np.inf).to_numpy(np.float64)
                        for shard, pick in shards(v, np.sqrt(cut) if metric == "euclidean" else cut):
                            one = {"shard": shard, "part": part, "qid": [ids[pick].tolist()], "qv": [v[pick].tobytes()], "cut": [cut[pick].tobytes()]}
                            yield pd.DataFrame(one)

        return run

    def at_home(v: np.ndarray, bound: np.ndarray):
        first = shards_of[tree.home(v), 0]
        return ((int(s), np.flatnonzero(first == s)) for s in np.unique(first))

    def elsewhere(v: np.ndarray, bound: np.ndarray):
        to = np.zeros((shard + 1, len(v)), bool)
        for c, rows in tree.visits(v, bound):
            first, parts = shards_of[c]
            for s in range(first, first + parts):
                to[s, rows] = True
        to[shards_of[tree.home(v), 0], np.arange(len(v))] = False  # been there
        return ((s, np.flatnonzero(to[s])) for s in np.flatnonzero(to.any(axis=1)))

    packed = f"shard int, part int, qid array<{q_type}>, qv binary, cut binary"
    w = Window.partitionBy("q").orderBy("d", "r")
    top = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    grouped = distinct.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
    unbound = grouped.withColumn("cut", F.lit(None).cast("double"))
    first = settled(top(met(unbound.select("q", "v", "part", "cut").mapInPandas(routed(at_home), packed))))
    bounds = first.filter(F.col("rank") == k).select("q", F.col("d").alias("cut"))  # fewer than k so far: no bound
    others = met(grouped.join(bounds, "q", "left").select("q", "v", "part", "cut").mapInPandas(routed(elsewhere), packed))
    best = top(first.select("q", "r", "d").unionByName(others))
    distance = F.sqrt("d") if metric == "euclidean" else F.col("d")
    members = asked.join(distinct, "v").select("qid", "q")
    return members.join(best, "q").select(F.col("qid").alias(query_id), F.col("r").alias(ref_id), distance.alias("distance"), "rank")


# ---- kernel means -------------------------------------------------------------------------------


def _kernel(u: np.ndarray, v: np.ndarray, sigma: float) -> np.ndarray:
    """exp(-|a-b|² / 2σ²) by one matrix product where its rounding error is below 1e-11, else coordinate by coordinate."""
    scale = 1.0 / (2 * sigma * sigma)
    with np.errstate(over="ignore", invalid="ignore"):
        u2, v2 = (u * u).sum(axis=1), (v * v).sum(axis=1)
        error = 4.0 * (u.shape[1] + 4) * np.finfo(float).eps * (u2.max(initial=0.0) + v2.max(initial=0.0)) * scale
    if not error < 1e-11:
        return np.exp(-_distances(u, v, "euclidean") * scale)
    one = np.ones((len(u), 1)), np.ones((len(v), 1))
    power = np.hstack([u * (2 * scale), (-scale * u2)[:, None], one[0]]) @ np.hstack([v, one[1], (-scale * v2)[:, None]]).T
    return np.exp(np.minimum(power, 0.0, out=power), out=power)


def _kernel_total(x: DataFrame, y: DataFrame, dim: int, nx: int, ny: int, sigma: float, symmetric: bool) -> DataFrame:
    """Sum of weight · weight · exp(-|a-b|² / 2σ²), one partial sum per tile.

    Blocks are laid out in tiles of ``side`` blocks of x by ``side`` of y.  A block goes to one row or one column of tiles,
    not to each block it meets: with side about the square root of the blocks, the bytes grow with the power
    1.5 of the rows, and a task holds 2 · side blocks.
    """
    block = _rows(dim)
    parts = [max(1, ceil(n / block)) for n in (nx, ny)]
    side = min(TILE, ceil(max(parts) ** 0.5))
    tiles = [ceil(p / side) for p in parts]

    def blocks(df: DataFrame, parts: int) -> DataFrame:
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for part, g in batch.groupby("part", sort=False):
                    for at in range(0, len(g), block):
                        piece = g.iloc[at : at + block]
                        rows.append((part, piece["w"].to_numpy(np.float64).tobytes(), _matrix(piece["v"], dim).tobytes()))
                if rows:
                    yield pd.DataFrame(rows)

        spread = df.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")).repartition("part")
        return spread.select("part", "w", "v").mapInPandas(pack, "part int, w binary, v binary")

    place = F.floor(F.col("part") / side).cast("int")
    left, right = blocks(x, parts[0]).withColumn("row", place), blocks(y, parts[1]).withColumn("column", place)
    first = F.col("row") if symmetric else F.lit(0)
    last = F.col("column") if symmetric else F.lit(tiles[0] - 1)
    left = left.withColumn("column", F.explode(F.sequence(first, F.lit(tiles[1] - 1))))
    right = right.withColumn("row", F.explode(F.sequence(F.lit(0), last)))

    def total(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        for xp, xw, xv in zip(a["part"], a["w"], a["v"]):
            u, wu = _unpack(xv, dim), np.frombuffer(xw, np.float64)
            for yp, yw, yv in zip(b["part"], b["w"], b["v"]):
                if symmetric and xp > yp:  # a tile on the diagonal; the pair is met the other way round
                    continue
                kernel = _kernel(u, _unpack(yv, dim), sigma)
                one = float(wu @ kernel @ np.frombuffer(yw, np.float64))
                total += 2 * one if symmetric and xp != yp else one
        return pd.DataFrame({"s": [total]})

    met = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInPandas(total, "s double")
    return met.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))


def mmd(x: DataFrame, y: DataFrame, vector: str = "vector", sigma: float = 1.0) -> DataFrame:
    """Maximum mean discrepancy with a Gaussian kernel, as a one-row frame (mmd).

    A kernel mean is a sum over all pairs by definition; equal vectors are weighted once, and only one number
    leaves each tile of block pairs.
    """

    def weighed(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col(vector).cast("array<double>").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))

    wx, wy = settled(weighed(x)), settled(weighed(y))
    size = lambda w: w.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("t"), F.max(F.size("v")).alias("d")).first()
    sx, sy = size(wx), size(wy)
    dim = int(sx["d"])
    xx = _kernel_total(wx, wx, dim, sx["n"], sx["n"], sigma, True).withColumn("c", F.lit(1.0 / (sx["t"] * sx["t"])))
    yy = _kernel_total(wy, wy, dim, sy["n"], sy["n"], sigma, True).withColumn("c", F.lit(1.0 / (sy["t"] * sy["t"])))
    xy = _kernel_total(wx, wy, dim, sx["n"], sy["n"], sigma, False).withColumn("c", F.lit(-2.0 / (sx["t"] * sy["t"])))
    return xx.unionByName(yy).unionByName(xy).agg(F.sum(F.col("s") * F.col("c")).alias("mmd"))
