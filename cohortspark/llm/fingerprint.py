"""Document fingerprints: the k smallest hashes of a text's word shingles.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of all runs of five words.  Sketches of parts
merge to the sketch of the whole: the k smallest of both.  Two sketches estimate the resemblance of the shingle sets
(the share of the k smallest hashes of the union that both have), their containment and their sizes; sets of at
most k shingles are there whole, and then the figures are exact.

All is made of built-in functions.  A text's neighbour in the order of ids is found without a window over the
table: ids are cut into ranges by quantiles, a window runs inside each range, and the first row of a range is a
guest at the end of the range before.  So each text is shuffled once, with its sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
HASHES = 64  # k: the standard error of a resemblance is at most 1 / (2 sqrt(k)) = 0.0625
RANGES_A_PARTITION = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, letters and all beyond ASCII, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _SPACE), lambda w: w != "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; fewer words are one shingle, none give none.  ``words`` is a column name's
    column, as it is read several times."""
    n = F.size(words)
    last = F.greatest(n - size, F.lit(0))
    one = lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def smallest(hashes: Column, k: int = HASHES) -> Column:
    """The k smallest distinct values, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, sketch: str, k: int = HASHES) -> DataFrame:
    """``df`` with the sketch of a text column."""
    held = df.withColumn("_words", words_of(F.col(text)))
    return held.withColumn(sketch, smallest(shingle_hashes(F.col("_words")), k)).drop("_words")


def merged(a: Column, b: Column, k: int = HASHES) -> Column:
    """Sketch of the union of two sets."""
    return smallest(F.concat(a, b), k)


def merge_parts(parts: DataFrame, keys: list[str], sketch: str = "sketch", k: int = HASHES) -> DataFrame:
    """(keys, sketch): the union of the sketches of each key's parts, in any number.

    The hashes of a key are made distinct and cut to the k smallest in each task before they are shuffled.  Null keys
    are a key; parts without hashes add nothing, and a key with no hashes at all has an empty sketch.
    """
    each = parts.select(*keys, F.explode(sketch).alias("_h")).distinct()
    rank = Window.partitionBy(*keys).orderBy("_h")
    top = each.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= k)
    found = top.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("_found"))
    own = parts.groupBy(*keys).agg(F.lit(True).alias("_there"))
    renamed = found.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    empty = F.array().cast("array<bigint>")
    return own.join(renamed, same, "left").select(*keys, F.coalesce("_found", empty).alias("sketch"))


def distinct_count(sketch: Column, k: int = HASHES) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(sketch, F.lit(k)).cast("double") + 2.0**63 + 1.0) / 2.0**64  # the k-th smallest as a share of all values
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / top)


def resemblance(a: Column, b: Column, k: int = HASHES) -> Column:
    """Estimated share of the shingles of either text that both have; 1 for two texts without a word."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = HASHES) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 if the first has none.

    Up to the smaller of the sketches' ends (no end where a sketch is the whole set) both sketches hold all there is,
    so the first one's hashes up to there are a sample of it.  A set so small beside the other that the sample is
    empty gives null.
    """
    whole = F.lit(2**63 - 1)
    end = lambda x: F.when(F.size(x) < k, whole).otherwise(F.array_max(x))
    sample = F.filter(a, lambda h: h <= F.least(end(a), end(b)))
    share = F.try_divide(F.size(F.array_intersect(sample, b)), F.size(sample))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def as_text(sketch: Column) -> Column:
    """A sketch as one string: its values in hexadecimal."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _range_of(edges: list[int], value: Column) -> Column:
    """Number of the edges that are at most ``value``; edges are looked through in groups, so the work follows the
    square root of their number."""
    if not edges:
        return F.lit(0)
    width = max(1, round(len(edges) ** 0.5))
    groups = [edges[i : i + width] for i in range(0, len(edges), width)]
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    table = F.array(*[F.array(*[F.lit(e) for e in g]) for g in groups])
    group = F.size(F.filter(firsts, lambda e: e <= value))
    inside = F.size(F.filter(F.get(table, group - 1), lambda e: e <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def with_next(docs: DataFrame, columns: list[str], order: str = "doc_id", ties: str = "mark") -> DataFrame:
    """``docs`` with the struct ``next`` of the ``columns`` of the next row in descending order of ``order``, then
    ``ties`` (two whole numbers); the last row is followed by the first, a single row by itself.

    The edges of the ranges and the first rows of the ranges, one each, pass the driver: a few numbers for each
    shuffle partition.  Nulls in ``order`` come last and are one range.
    """
    spark = docs.sparkSession
    parts = RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    edges = docs.agg(F.percentile_approx(order, shares, 100 * parts)).first()[0] or []
    placed = docs.withColumn("_range", F.coalesce(_range_of(sorted(set(edges)), F.col(order)) + 1, F.lit(0)))
    top = F.max(F.struct(order, ties)).alias("top")
    firsts = sorted(((r["_range"], *r["top"]) for r in placed.groupBy("_range").agg(top).collect()), reverse=True)
    if not firsts:
        return docs.withColumn("next", F.struct(*columns))
    # The first row of each range is a guest of the range before it, that of the first range a guest of the last one.
    heads = [
        F.struct(F.lit(r).alias("_own"), F.lit(o).cast("long").alias("_o"), F.lit(t).cast("long").alias("_t"), F.lit(firsts[i - 1][0]).alias("_host"))
        for i, (r, o, t) in enumerate(firsts)
    ]
    placed = placed.join(F.broadcast(spark.range(1).select(F.inline(F.array(*heads)))), F.col("_range") == F.col("_own"))
    is_head = F.col(order).eqNullSafe(F.col("_o")) & (F.col(ties) == F.col("_t"))
    here = F.struct(F.col("_range").alias("at"), F.lit(0).alias("guest"))
    there = F.struct(F.col("_host").alias("at"), F.lit(1).alias("guest"))
    stands = F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here)))
    dealt = placed.select(*docs.columns, stands.alias("_s"))
    w = Window.partitionBy("_s.at").orderBy("_s.guest", F.col(order).desc_nulls_last(), F.col(ties).desc())
    # Each column by itself: a struct of them would be made, and shuffled, beside them.
    after = dealt.select(*docs.columns, "_s", *[F.lead(c).over(w).alias(f"_next_{c}") for c in columns])
    after = after.filter(F.col("_s.guest") == 0)
    return after.select(*docs.columns, F.struct(*[F.col(f"_next_{c}").alias(c) for c in columns]).alias("next"))


def fingerprints(docs: DataFrame, k: int = HASHES) -> DataFrame:
    """Sketches of texts.

    :param docs: doc_id, text and any other columns, which are not read.
    :return: one row per input row: doc_id, n_chars (code points), sketch (array), fingerprint (the sketch as a
        string), n_shingles (estimated number of distinct shingles).

    Null text counts as empty.  Texts without a word have an empty sketch and fingerprint; a text of fewer words than
    a shingle is one shingle.  Equal texts have equal fingerprints; repeated rows repeat; an empty table gives an
    empty table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_sketch(rows, "text", "sketch", k)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "sketch",
        as_text(F.col("sketch")).alias("fingerprint"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )
