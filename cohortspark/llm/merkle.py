"""Merkle manifest of a table, with a proof for every row.

A row's leaf is the digest of its fields.  The leaves of a source, ascending by doc_id, are hashed upwards in runs
of three consecutive nodes until one is left, the source's subroot; the subroots, ordered by source, are hashed
alike to the root.  A row's proof is what stands beside it on the way to the root: the other nodes of each run.

Nothing is gathered by source.  Rows are numbered by a range sort and sums of counts.  Four levels of a tree are
hashed in one pass over blocks of 81 neighbours.  Proofs come by pointer jumping: every node starts with the
siblings on its way to its parent; a self-join gives a node at distance d what its ancestor there holds, which
doubles the distance, and the segments are put together, until leaves hold all the way to the root.  Before a
join with distance d only nodes at levels divisible by 2 d go on, as no other will be asked for again.

A segment holds for each level one byte, 16 times the number of siblings on the left plus the number on the right,
and the siblings' digests from left to right.  Segments one after the other are a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import safe_unions, settled

FAN = 3
STEP = 4  # levels hashed in one pass
SPAN = FAN**8  # rows that meet one row in a join; an ancestor or a source with more is there once for each SPAN of them
DIGEST = 32


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest (binary) of the fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def height_of(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with pos, the number of a row among those of its tree from 0, and n, how many these are.

    Rows are dealt by ranges of (tree, order), counted in each range, and numbered by what stands before; the only
    window is over the counts, one for each range that a tree reaches into.  ``order`` must tell all rows apart.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = settled(dealt.withColumn("_range", F.shiftright("_at", 33)))
    counts = dealt.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        tree,
        "_range",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_n").over(whole).alias("n"),
    )
    return dealt.join(starts, [tree, "_range"]).withColumn("pos", F.col("_at") + F.col("_start")).drop("_at", "_range", "_start")


def _climb(level: int):
    """(tree, n, block, digests) -> the nodes of STEP levels of a block: those with a segment to their parent, and the
    node on top, which is the root or goes on to the next pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for tree, n, block, digests in zip(part["tree"], part["n"], part["block"], part["digests"]):
                nodes = [digests[at : at + 2 * DIGEST] for at in range(0, len(digests), 2 * DIGEST)]
                left = -(-n // FAN**level)  # nodes of the whole tree at this level
                first = block * FAN**STEP
                k = level
                while left > 1 and k < level + STEP:
                    above = []
                    for at in range(0, len(nodes), FAN):
                        own = nodes[at : at + FAN]
                        for place in range(len(own)):
                            beside = bytes.fromhex("".join(own[:place] + own[place + 1 :]))
                            mark = bytes([16 * place + len(own) - 1 - place])
                            out.append((tree, n, k, first + at + place, None, mark + beside, False))
                        above.append(hashlib.sha256("".join(own).encode()).hexdigest())
                    nodes, left, first, k = above, -(-left // FAN), first // FAN, k + 1
                out.append((tree, n, k, first, bytes.fromhex(nodes[0]), None, left == 1))
            yield pd.DataFrame(out, columns=["tree", "n", "level", "pos", "digest", "segment", "root"])

    return run


def hashed_up(leaves: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Trees over leaves (tree, pos, n, digest), the highest of ``height`` levels: nodes below the roots
    (tree, n, level, pos, segment) and roots (tree, n, digest)."""
    nodes = roots = None
    schema = "tree string, n long, level int, pos long, digest binary, segment binary, root boolean"
    for level in range(0, max(height, 1), STEP):
        run = F.sort_array(F.collect_list(F.struct("pos", "digest")))  # at most FAN ** STEP
        digests = F.array_join(F.transform(run, lambda x: F.lower(F.hex(x["digest"]))), "").alias("digests")
        blocks = leaves.groupBy("tree", "n", F.floor(F.col("pos") / FAN**STEP).alias("block")).agg(digests)
        made = settled(blocks.mapInPandas(_climb(level), schema))
        below = made.filter(F.col("segment").isNotNull()).drop("digest", "root")
        top = made.filter(F.col("segment").isNull()).drop("segment")
        nodes = below if nodes is None else nodes.unionByName(below)
        done = top.filter("root").select("tree", "n", "digest")
        roots = done if roots is None else roots.unionByName(done)
        leaves = top.filter("not root").select("tree", "n", "pos", "digest")
    return nodes, roots


def jumped(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, pos, segment) of all leaves below a root, the segments reaching to the root."""
    distance = 1
    while distance < height:
        to = FAN**distance
        left = nodes.filter(F.col("level") % (2 * distance) == 0).withColumn("salt", F.floor((F.col("pos") % to) / SPAN))
        salts = F.sequence(F.lit(0).cast("long"), F.floor((F.least(F.lit(to), F.col("n")) - 1) / SPAN))
        right = nodes.filter(F.col("level") % (2 * distance) == distance).select(
            F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("segment").alias("_rest"), F.explode(salts).alias("_salt")
        )
        same = (F.col("tree") == F.col("_tree")) & (F.col("level") + distance == F.col("_level"))
        same &= (F.floor(F.col("pos") / to) == F.col("_pos")) & (F.col("salt") == F.col("_salt"))
        met = left.join(right, same, "left")  # nodes whose way is over meet nothing
        longer = F.concat("segment", F.coalesce("_rest", F.lit(b"")))
        nodes = settled(met.select("tree", "n", "level", "pos", longer.alias("segment")))
        distance *= 2
    return nodes.select("tree", "pos", "segment")


def steps(segment: bytes) -> Iterator[tuple[list[str], list[str]]]:
    """Siblings (hex) on the left and on the right at each level of a segment."""
    at = 0
    while at < len(segment):
        left, right = divmod(segment[at], 16)
        own = segment[at + 1 : at + 1 + DIGEST * (left + right)].hex()
        cut = 2 * DIGEST
        sides = [own[k : k + cut] for k in range(0, len(own), cut)]
        yield sides[:left], sides[left:]
        at += 1 + DIGEST * (left + right)


def _folded(digest: pd.Series, proof: pd.Series) -> pd.DataFrame:
    """Digest of a proof's siblings, and the root that a leaf's digest gives with them."""
    out = []
    for own, segment in zip(digest, proof):
        node, beside = own.hex(), hashlib.sha256()
        for left, right in steps(segment):
            beside.update("".join(left + right).encode())
            node = hashlib.sha256("".join([*left, node, *right]).encode()).hexdigest()
        out.append((beside.hexdigest(), node))
    return pd.DataFrame(out, columns=["proof_sha256", "folded_root"])


def manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """Leaf, way to the root and verification of every row.

    :param docs: doc_id, source, lang, n_chars, text and any other columns, which are not read.
    :param found_text: the text as it is found when the row is verified, an expression over ``docs``; the row's own
        if not given.
    :return: one row per input row: doc_id, leaf, subroot, root (hex), proof (a segment), proof_sha256 (digest of
        the siblings' hex from the leaf to the root), folded_root (root that the found row gives with the proof),
        verified (whether that is the root).

    A null field is a field of its own kind; null sources are one source, before all others; null ids come first.
    Rows with one id are ordered by their leaves, and rows that are equal in all fields stand beside each other.  A
    source with one row has the leaf as subroot, a table with one source the subroot as root; an empty table
    gives an empty table.
    """
    safe_unions(docs.sparkSession)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    found = F.col("text") if found_text is None else found_text
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # null before all others
    own = leaf_digest([*fields, F.col("text")])
    rows = docs.select(
        "doc_id",
        source.alias("tree"),
        F.monotonically_increasing_id().alias("row"),
        own.alias("digest"),
        F.when(~found.eqNullSafe(F.col("text")), leaf_digest([*fields, found])).alias("changed"),
    )
    placed = settled(numbered(settled(rows), "tree", ["doc_id", "digest", "row"]))
    most = placed.agg(F.max("n")).first()[0] or 0
    height = height_of(most)
    nodes, subroots = hashed_up(placed.select("tree", "pos", "n", "digest"), height)
    ways = jumped(nodes, height)

    # The tree over the sources, one leaf for each.
    tops = subroots.select(F.col("tree").alias("own"), F.lit("").alias("tree"), F.col("n").alias("rows"), "digest")
    tops = settled(numbered(tops, "tree", ["own"]))
    height = height_of(tops.agg(F.max("n")).first()[0] or 0)
    nodes, root = hashed_up(tops.select("tree", "pos", "n", "digest"), height)
    last = tops.join(jumped(nodes, height).select("pos", "segment"), "pos", "left")
    known = root.first()  # one digest, or none of an empty table
    spread = last.select(
        F.col("own").alias("tree"),
        F.col("digest").alias("subroot"),
        F.lit(known["digest"] if known else b"").alias("root"),
        F.coalesce("segment", F.lit(b"")).alias("last"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SPAN))).alias("salt"),
    )
    rows = placed.withColumn("salt", F.floor(F.col("pos") / SPAN)).join(spread, ["tree", "salt"])
    rows = rows.join(ways, ["tree", "pos"], "left").withColumn("proof", F.concat(F.coalesce("segment", F.lit(b"")), "last"))
    rows = rows.withColumn("f", F.pandas_udf(_folded, "proof_sha256 string, folded_root string")(F.coalesce("changed", "digest"), "proof"))
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id",
        hexed("digest").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        "proof",
        "f.proof_sha256",
        "f.folded_root",
        (F.col("f.folded_root") == hexed("root")).alias("verified"),
    )
