"""Near-duplicate join on word shingles by chosen paths.

A text is its set of hashed word 5-grams; texts with the same set are one point with a number of copies.  A point
is embedded as minhash tokens.  In every run each node of a tree samples the tokens on which it goes on, by a
hash of the path so far and the token, with mean 1 / similarity tokens per point; points that share a sampled
token go down together.  All points go down FIRST levels at once, before buckets are looked at: what only shares a
passage or a chance shingle is mostly apart by then.  Buckets that are small enough are compared by brute force on
the embedded tokens; larger ones are split further.  Points as similar as the threshold stay together with a chance that no run can fix, and
that falls with every level, so runs are repeated until the wanted share of pairs is found at the level where they
are compared (``runs_for``): points that are split at deeper levels than others go through more runs.

Tokens are needed only to choose paths.  What is compared in buckets is a sketch of four bits a token, an eighth of
their size, and only points of large buckets are joined with their tokens again.

What the buckets link loosely are candidate groups.  Inside each, all pairs are compared on the full shingle sets,
in blocks of bounded size; only link counts and a spanning forest leave a block, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.components import components
from cohortspark.llm.text import discard, first_of_each, mix64, per_text, stored, stored_at, word_hashes, words
from cohortspark.session import safe_unions, settled

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999  # of pairs at the threshold itself, at the level where they are compared
TOKENS = 128  # minhash tokens of a point
LOOSE = 0.5  # similarity by sketches that makes a candidate: eight deviations below the threshold
LEAVES = 0.84  # similarity to a pivot by sketches from which a point need not be split further
PIVOTS = 4  # choices of a pivot in one group; which of them a bucket has depends on its path
BUCKET = 2000  # points of a bucket that are compared at once
SALTS = 32  # keys over which the rows of one pivot are spread; a pivot stands for more than BUCKET rows
FIRST = 3  # levels that all points go down
DEPTH = 8  # levels; what is still larger then is compared in full as one candidate group
BLOCK = 1024  # points of a block in the exact comparison
MEMO = 100_000  # words whose hashes a task remembers
STRIP, WIDTH = 256, 512  # rows and shared shingles that are multiplied at once
BLOCK_SHINGLES = 250_000  # shingles of a block; long texts make blocks of fewer points
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
_MULTIPLY = (_RNG.integers(1, 1 << 32, TOKENS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)
_PLACES = (np.arange(1, TOKENS + 1, dtype=np.uint64)) << np.uint64(33)


def runs_for(recall: float, levels: int = FIRST) -> int:
    """Runs after which a pair at the threshold has met with chance ``recall``.

    Such a pair goes down together as a critical branching process: the chance to survive k levels is
    s(k) = 1 - exp(-s(k - 1)).
    """
    survive = 1.0
    for _ in range(levels):
        survive = 1.0 - math.exp(-survive)
    return math.ceil(math.log(1.0 - recall) / math.log(1.0 - survive))


def shingles(text_words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words are one shingle; none give none."""
    n = len(text_words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = mix64(total + _STEP) + text_words[k : n - size + 1 + k] * np.uint64(2 * k + 3)
    return np.unique(mix64(total))


def minhash(own: np.ndarray) -> np.ndarray:
    """TOKENS smallest values of multiply-add hashes of a shingle set."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        h = part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, h.min(axis=1))
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Lowest four bits of each token, two tokens in a byte."""
    low = (tokens & np.uint32(15)).astype(np.uint8)
    return low[0::2] | (low[1::2] << np.uint8(4))


def _places(column: pd.Series) -> np.ndarray:
    """Sketches as rows of TOKENS small numbers."""
    packed = np.frombuffer(b"".join(column), np.uint8).reshape(-1, TOKENS // 2)
    return np.concatenate([packed & 15, packed >> 4], axis=1)


def _similarity(equal: np.ndarray) -> np.ndarray:
    """Similarity by the number of equal places of two sketches; of different tokens one in 16 is equal there."""
    return (equal / TOKENS - 1 / 16) * (16 / 15)


def _set_function(embed: bool):
    def build():
        hashed = word_hashes(MEMO)

        def work(texts: list[str]) -> dict:
            sets = [shingles(hashed(words(t))) for t in texts]
            if not embed:
                return {"own": [s.tobytes() for s in sets]}
            tokens = [minhash(s) for s in sets]
            return {
                "n": [len(s) for s in sets],
                "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "tokens": [t.tobytes() for t in tokens],
                "sketch": [sketch(t).tobytes() for t in tokens],
            }

        return work

    return per_text(build, "n long, key binary, tokens binary, sketch binary" if embed else "own binary")


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, TOKENS).astype(np.uint64)


def _children(tokens: np.ndarray, starts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the tokens that nodes sample."""
    h = mix64(mix64((tokens + _PLACES) * _STEP) + starts[:, None])
    row, place = np.nonzero(h < np.uint64(2**64 / (similarity * TOKENS)))
    return row, mix64(h[row, place] + _STEP).view(np.int64)


def _roots(similarity: float, levels: int):
    """(key, tokens, done, runs) -> (path, key): the nodes ``levels`` levels down in the runs from ``done`` to ``runs``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 2000):
                rows = part.iloc[at : at + 2000]
                tokens, keys = _tokens(rows["tokens"]), rows["key"].to_numpy()
                done, runs = rows["done"].to_numpy(), rows["runs"].to_numpy()
                for k in range(int(done.min()), int(runs.max())):
                    own = (done <= k) & (k < runs)
                    if own.any():
                        seed = mix64(np.array([k + 1], np.uint64) * np.uint64(0x51ED2701))
                        at, path = np.flatnonzero(own), np.repeat(seed, own.sum())
                        for _ in range(levels):
                            row, path = _children(tokens[at], path.view(np.uint64), similarity)
                            at = at[row]
                        yield pd.DataFrame({"path": path.view(np.int64), "key": keys[at]})

    return run


def _likeness(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, pivot, sketch, pivot_sketch) -> (key, pivot, near, stays): near tells a link to the pivot.

    Points stay in the bucket that are not like the pivot enough to leave it.
    """
    for part in parts:
        if not len(part):
            continue
        alike = _similarity((_places(part["sketch"]) == _places(part["pivot_sketch"])).sum(axis=1))
        near = (alike >= LOOSE) & (part["key"] != part["pivot"]).to_numpy(bool)
        yield pd.DataFrame({"key": part["key"], "pivot": part["pivot"], "near": near, "stays": alike < LEAVES})


def _descend(similarity: float):
    """(path, key, tokens) -> children (path, key) of points that are split further."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 2000):
                rows = part.iloc[at : at + 2000]
                starts = rows["path"].to_numpy(np.int64).view(np.uint64)
                row, path = _children(_tokens(rows["tokens"]), starts, similarity)
                yield pd.DataFrame({"path": path, "key": rows["key"].to_numpy()[row]})

    return run


def _groups(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of a partition sorted by ``by``; a group may reach over batches."""
    rest = None
    for part in parts:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        change = np.zeros(len(part), bool)
        for c in by:
            values = part[c].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change)]
        for a, b in zip(cuts, cuts[1:]):
            yield part.iloc[a:b]
        rest = part.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield rest


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member reachable from each of n members over the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket_links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Loose links inside small buckets, as stars."""
    a, b = [], []
    for group in _groups(parts, ["path"]):
        n = len(group)
        if n > 1:
            places, left, right = _places(group["sketch"]), [], []
            for top in range(0, n, 64):
                equal = (places[top : top + 64, None, :] == places[None, top:, :]).sum(axis=2)
                i, j = np.nonzero(_similarity(equal) >= LOOSE)
                left.append(i[j > i] + top)
                right.append(j[j > i] + top)
            left, right = np.concatenate(left), np.concatenate(right)
            if len(left):
                keys, root = group["key"].to_numpy(), _forest(n, left, right)
                far = np.flatnonzero(root != np.arange(n))
                a.extend(keys[far])
                b.extend(keys[root[far]])
        if len(a) >= 10_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": a, "b": b}, columns=["a", "b"])


def pivot_likeness(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, pivot, near, stays) for the different pairs of point and pivot in large buckets (path, key, pivot).

    Points like the pivot are linked to it, and those that are very like it leave the bucket: by the triangle
    inequality of the Jaccard distance, what is similar to them is linked to the pivot too.  So a large group of
    near copies is a few stars after one level.  Points that are less like it are linked all the same, and so are in one
    candidate group; they only go on to meet those that are not linked: at once if these are few, else in the
    buckets below.  The pivot of
    a bucket is the key with the smallest hash, by one of PIVOTS hashes that the path chooses, so the buckets of one
    group mostly have one of a few, and a pair is compared once for all buckets of a level.  A point that leaves by a
    chance of the sketches at one pivot is met again at another.  A pivot's rows are spread over SALTS keys.
    """
    pairs = large.select("key", "pivot").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    held = settled(pairs.join(sketches, "key"))
    chosen = held.filter(F.col("key") == F.col("pivot")).select("pivot", F.col("sketch").alias("pivot_sketch"), salts)
    salted = held.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    met = salted.join(chosen, ["pivot", "salt"]).select("key", "pivot", "sketch", "pivot_sketch")
    return met.mapInPandas(_likeness, "key binary, pivot binary, near boolean, stays boolean")


def _run_links(
    tokens: DataFrame, sketches: DataFrame, similarity: float, bucket: int, depth: int
) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Runs of the points (key, tokens, done, runs): buckets (path, key) to compare, links to pivots (a, b), and for
    each level the points (key) that are split there and so are compared deeper."""
    start = min(FIRST, depth)
    spark = tokens.sparkSession
    paths, paths_at = stored_at(tokens.mapInPandas(_roots(similarity, start), "path long, key binary"))
    tokens = tokens.select("key", "tokens")
    small, links, deeper = [], [], []
    for level in range(start, depth + 1):
        first = F.min(F.struct(F.xxhash64("key", F.pmod("path", F.lit(PIVOTS))), "key")).getItem("key").alias("pivot")
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1")
        placed = settled(paths.join(sizes, "path"))
        discard(spark, paths_at)
        small.append(placed.filter(F.col("n") <= bucket).select("path", "key"))
        large = placed.filter(F.col("n") > bucket).select("path", "key", "pivot")
        if large.isEmpty():
            break
        if level == depth:
            links.append(large.select(F.col("key").alias("a"), F.col("pivot").alias("b")).filter("a <> b"))
            break
        likeness = settled(pivot_likeness(large, sketches))
        links.append(likeness.filter("near").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        # Points linked to the pivot are in one candidate group.  What stays has to meet the points that are not linked.
        judged = large.join(likeness, ["key", "pivot"]).withColumn("apart", ~F.col("near") & (F.col("key") != F.col("pivot")))
        counts = judged.groupBy("path").agg(F.sum(F.col("apart").cast("int")).alias("u"), F.sum(F.col("stays").cast("int")).alias("s"))
        open_ = settled(judged.filter("stays").join(counts.filter("u > 0"), "path").select("path", "key", "apart", "u", "s"))
        few = open_.filter(F.col("u") <= bucket).withColumn("parts", F.ceil(F.col("s") / bucket).cast("int"))
        part = F.when(F.col("apart"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
        small.append(few.select("path", "key", F.explode(part).alias("part")).select(F.xxhash64("path", "part").alias("path"), "key"))
        on = open_.filter(F.col("u") > bucket).select("path", "key")
        # What is split at later levels is split here too, so the tokens and sketches needed only become fewer.
        split_keys = stored(on.select("key").distinct())
        deeper.append(split_keys)
        tokens = settled(tokens.join(split_keys, "key", "left_semi"))
        sketches = settled(sketches.join(split_keys, "key", "left_semi"))
        split = on.join(tokens, "key").select("path", "key", "tokens")
        paths, paths_at = stored_at(split.mapInPandas(_descend(similarity), "path long, key binary"))
    return small, links, deeper


def candidate_links(points: DataFrame, similarity: float, recall: float, bucket: int, depth: int) -> DataFrame:
    """Loose links (a, b) between points (key, tokens, sketch), from the buckets of all runs.

    The first runs are enough for pairs that are compared at level FIRST.  A pair that is compared deeper is in a
    bucket split there, so both its points are among those split there; they go through as many runs as the deepest
    level needs.
    """
    sketches, first = points.select("key", "sketch"), min(FIRST, depth)
    base, most = runs_for(recall, first), runs_for(recall, depth)
    todo = points.select("key", "tokens", F.lit(0).alias("done"), F.lit(base).alias("runs"))
    members, out = None, None
    while True:
        small, links, deeper = _run_links(todo, sketches, similarity, bucket, depth)
        for more in small:
            members = more if members is None else members.unionByName(more)
        for more in links:
            out = more if out is None else out.unionByName(more)
        if base == most or not deeper or deeper[0].isEmpty():
            break
        more = points.select("key", "tokens").join(deeper[0], "key", "left_semi")
        todo = settled(more.withColumns({"done": F.lit(base), "runs": F.lit(most)}))
        base = most
    full = members.join(sketches, "key").select("path", "key", "sketch")
    found = full.repartition("path").sortWithinPartitions("path").mapInPandas(_bucket_links, "a binary, b binary")
    return (found if out is None else found.unionByName(out)).distinct()


def _meet(similarity: float):
    """Exact comparison inside a pair of blocks: link counts (key, links) and forest edges (key, other)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[str, list] = {"key": [], "links": [], "other": []}
        for group in _groups(parts, ["root", "low", "high"]):
            sets = [np.frombuffer(s, np.uint64) for s in group["own"]]
            n, sizes = len(sets), np.array([len(s) for s in sets])
            if n < 2:
                continue
            blocks = group["block"].to_numpy()
            _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), sizes)
            again = seen[column] > 1
            row, column = row[again], np.cumsum(seen > 1)[column[again]] - 1
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            shared = int(column[-1]) + 1 if len(column) else 0
            inside = group["low"].iloc[0] == group["high"].iloc[0]  # pairs inside one block have a group of their own
            copies, counts = group["copies"].to_numpy(np.int64), np.zeros(n, np.int64)
            left, right = [], []
            for top in range(0, n, STRIP):
                rows = min(STRIP, n - top)
                common = np.zeros((rows, n), np.float32)
                for start in range(0, shared, WIDTH):
                    a, b = np.searchsorted(column, [start, start + WIDTH])
                    dense = np.zeros((n, WIDTH), np.float32)
                    dense[row[a:b], column[a:b] - start] = 1
                    common += dense[top : top + rows] @ dense.T
                # common >= similarity * (sizes of both - common), solved for the common ones
                least = (sizes[top : top + rows, None] + sizes[None, :]) * (similarity / (1 + similarity))
                linked = common >= least - 1e-6
                at = np.arange(rows)
                linked[at, top + at] = False
                if not inside:
                    linked &= blocks[top : top + rows, None] != blocks[None, :]
                counts[top : top + rows] = linked @ copies
                i, j = np.nonzero(linked)
                left.append((i + top)[j > i + top])
                right.append(j[j > i + top])
            left, right = np.concatenate(left), np.concatenate(right)
            if not len(left):
                continue
            keys, root = group["key"].to_numpy(), _forest(n, left, right)
            some, far = np.flatnonzero(counts), np.flatnonzero(root != np.arange(n))
            out["key"] += [*keys[some], *keys[far]]
            out["links"] += [*counts[some].tolist(), *([0] * len(far))]
            out["other"] += [*([None] * len(some)), *keys[root[far]]]
            if len(out["key"]) >= 10_000:
                yield pd.DataFrame(out)
                out = {"key": [], "links": [], "other": []}
        yield pd.DataFrame(out)

    return run


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    bucket: int = BUCKET,
    depth: int = DEPTH,
    block: int = BLOCK,
) -> DataFrame:
    """Groups of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    :param docs: doc_id, text and any other columns, which are not read.
    :return: one row per input row: doc_id, class_id (smallest doc_id of the rows linked with it directly or
        over others), class_size, n_links (other rows that are similar enough, copies counted one by one),
        stays (one row of a class: the one with class_id), text_hash (xxhash64 of the text).

    Texts without a word, null and empty ones among them, are similar to nothing and are classes of their own.
    A null doc_id is larger than others.  Repeated rows are copies of each other; one of them stays.  An empty
    table gives an empty table.
    """
    safe_unions(docs.sparkSession)
    embed = _set_function(True)("text")
    named = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        embed.alias("r"),
    )
    embedded, embedded_at = stored_at(named.select("doc_id", "row", "text_hash", "r.*"))
    full = embedded.filter("n > 0")
    points = settled(
        full.groupBy("key").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("n").alias("n"),
            F.min("tokens").alias("tokens"),  # the same in all rows of a key, as the sketch is
            F.min("sketch").alias("sketch"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")).alias("one"),
        )
    )
    rows = settled(embedded.drop("tokens", "sketch"))
    discard(docs.sparkSession, embedded_at)
    full = rows.filter("n > 0")
    loose = components(candidate_links(points, similarity, recall, bucket, depth))

    # Full sets of the candidates, from the text of one row each.
    chosen = settled(loose.join(points.drop("tokens", "sketch"), loose["node"] == points["key"]))
    group_size = chosen.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("_blocks")
    )
    chosen = chosen.join(group_size, "root").select(
        "root",
        "key",
        "copies",
        F.col("one.doc_id").alias("_id"),
        F.col("one.text_hash").alias("_hash"),
        "_blocks",
    )
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("_text_hash", F.xxhash64("text"))
    chosen = stored(chosen).hint("merge")  # the same plan at every size
    found = texts.join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    found = first_of_each(found, ["key"])  # a row that is there twice is found twice
    placed = found.withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")).withColumn(
        "own", _set_function(False)("text")["own"]
    )
    spread = placed.select("root", "key", "copies", "block", "own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"))
    spread = spread.select(
        "root", "key", "copies", "block", "own", F.least("block", "_b").alias("low"), F.greatest("block", "_b").alias("high")
    )
    meetings = spread.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    met = settled(meetings.mapInPandas(_meet(similarity), "key binary, links long, other binary"))
    groups = components(met.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = met.groupBy("key").agg(F.sum("links").alias("links"))

    # Back to rows: points carry their class and links, rows join their point.
    labelled = (
        points.select("key", "copies", F.col("one").alias("first"))
        .join(groups.withColumnRenamed("node", "key"), "key", "left")
        .join(links, "key", "left")
        .select(
            "key",
            "copies",
            "first",
            F.coalesce("root", "key").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    labelled = settled(labelled)
    classes = labelled.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    points_out = labelled.drop("first").join(classes, "root").select("key", "n_links", "first", "class_size")
    out = full.join(points_out, "key").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        "n_links",
        (F.col("row") == F.col("first.row")).alias("stays"),
        "text_hash",
    )
    alone = rows.filter("n = 0").select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(True).alias("stays"),
        "text_hash",
    )
    return out.unionByName(alone)
