"""Privacy metrics and attacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.neighbours import knn_join, vector_of
from cohortspark.operators.ordered import ranked
from cohortspark.operators.utility import roc_auc
from cohortspark.session import settled

NEAR = 24  # points in a list of nearest points; in about 3 of a million fewer than two of them are in a random half


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def k_anonymity(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Smallest class size; rows with a missing quasi-identifier are left out."""
    return _complete(df, quasi).groupBy(*quasi).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("k_anonymity"))


def l_diversity(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """Smallest number of distinct sensitive values in a class.

    Values are made distinct first, so a large class is never held as one set.
    """
    pairs = _complete(df, quasi).groupBy(*quasi, sensitive).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(*quasi).agg(F.count(sensitive).alias("_l")).agg(F.min("_l").alias("l_diversity"))


def t_closeness(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """Largest divergence Σ p ln(p/q) of a class's sensitive distribution from the whole table's."""
    known = df.filter(F.col(sensitive).isNotNull())
    cells = known.groupBy(*quasi, sensitive).agg(F.count(F.lit(1)).alias("_n"))
    globe = cells.groupBy(sensitive).agg(F.sum("_n").alias("_g"))
    total = globe.groupBy().agg(F.sum("_g")).scalar()
    inside = _complete(cells, quasi)
    classes = inside.groupBy(*quasi).agg(F.sum("_n").alias("_c"))
    p, q = F.col("_n") / F.col("_c"), F.col("_g") / total
    joined = inside.join(classes, list(quasi)).join(globe, sensitive)
    kl = joined.groupBy(*quasi).agg(F.sum(p * F.log(p / q)).alias("_kl"))
    return kl.agg(F.greatest(F.max("_kl"), F.lit(0.0)).alias("t_closeness"))


def single_out_risk(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of synthetic rows equal to some original row, nulls equal to nulls.

    Both tables are counted per distinct row in one grouping, so copies collapse before the shuffle.
    """
    a = original.select(*by, *columns, F.lit(1).alias("_o"), F.lit(0).alias("_s"))
    b = synthetic.select(*by, *columns, F.lit(0).alias("_o"), F.lit(1).alias("_s"))
    rows = a.unionByName(b).groupBy(*by, *columns).agg(F.sum("_o").alias("_no"), F.sum("_s").alias("_ns"))
    hits = F.sum(F.when(F.col("_no") > 0, F.col("_ns")).otherwise(0))
    return rows.groupBy(*by).agg((hits / F.nullif(F.sum("_ns"), F.lit(0))).alias("single_out_risk"))


def inferential_risk(original: DataFrame, synthetic: DataFrame, row_id: str, vector: str = "vector", mode: str = "as_written") -> DataFrame:
    """Share of synthetic rows closer to their nearest original than that original's own reference distance.

    Row ids pair the two tables.  ``as_written``: the reference distance of row i is from synthetic row i to
    the nearest original other than i.  ``original``: from original row i to the nearest other original.
    """
    s = synthetic.select(F.col(row_id).alias("_q"), vector)
    o = original.select(F.col(row_id).alias("_r"), vector)
    first = knn_join(s, o, "_q", "_r", vector, 1).select("_q", F.col("_r").alias("_c"), F.col("distance").alias("_ds"))
    asked = s if mode == "as_written" else o.select(F.col("_r").alias("_q"), vector)
    two = knn_join(asked, o, "_q", "_r", vector, 2).filter(F.col("_q") != F.col("_r"))
    reference = two.groupBy(F.col("_q").alias("_c")).agg(F.min("distance").alias("_do"))
    joined = first.join(reference, "_c", "left")
    hit = F.coalesce((F.col("_ds") < F.col("_do")).cast("double"), F.lit(0.0))
    return joined.agg(F.avg(hit).alias("inference_risk"))


def attribution_probability(
    original: DataFrame, synthetic: DataFrame, row_id: str, quasi: str = "quasi", sensitive: str = "sensitive"
) -> DataFrame:
    """Share of synthetic rows whose nearest original on the quasi-identifier vector has the same sensitive vector."""
    s = synthetic.select(F.col(row_id).alias("_q"), F.col(quasi).alias("vector"), F.col(sensitive).alias("_t"))
    o = original.select(F.col(row_id).alias("_r"), F.col(quasi).alias("vector"), F.col(sensitive).alias("_u"))
    near = knn_join(s, o, "_q", "_r", "vector", 1).select("_q", "_r")
    joined = near.join(s.select("_q", "_t"), "_q").join(o.select("_r", "_u"), "_r")
    return joined.agg(F.avg(F.coalesce((F.col("_t") == F.col("_u")).cast("double"), F.lit(0.0))).alias("cap"))


# ---- null thresholds ----------------------------------------------------------------------------


def random_halves(df: DataFrame, row_id: str, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(round, half, pos, ...): ``rounds`` random halves as a column; an odd row is left out.

    ``pos`` numbers the rows of a half from 1.
    """
    copies = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    order = ranked(copies, ["round"], row_id, F.concat(F.lit(f"half {seed} "), F.col("round").cast("string")))
    size = F.floor(F.col("rank_of") / 2)
    half = F.when(F.col("rank") <= size, "a").when(F.col("rank") <= 2 * size, "b")
    pos = F.when(F.col("rank") <= size, F.col("rank")).otherwise(F.col("rank") - size)
    out = order.withColumns({"half": half, "pos": pos})
    return out.filter(F.col("half").isNotNull()).drop("rank", "rank_of")


def _lowest_two(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)


def nearest_in_halves(points: DataFrame, halves: DataFrame, near: int = NEAR) -> DataFrame:
    """For every round and every point with a row in half b, the two nearest rows of half a.

    :param points: (point, vector), the distinct vectors.
    :param halves: (round, half, pos, point).
    :return: (round, point, d1, c1, d2): distance and pos of the nearest row, distance of the next one, the lowest pos
        first among rows at one distance; null where half a has no such row.

    Distances do not depend on the round, only who is in half a does.  So each point's nearest points are looked up
    once for all rounds; in a list of ``near`` about half are in half a.  A round is settled if two of them are and
    nothing as near can be beyond the end of the list; the points of the few that are not get longer lists, in the
    end all there is.
    """
    n = points.count()
    members = _lowest_two(halves.filter("half = 'a'").select("point", "round", "pos"), ["point", "round"], ["pos"])
    members = settled(members.select(F.col("point").alias("_other"), "round", F.col("pos").alias("_pos")))
    open_ = settled(halves.filter("half = 'b'").select("point", "round").distinct())
    refs, out = points.select(F.col("point").alias("_other"), "vector"), None
    while True:
        asked = open_.select("point").distinct().join(points, "point")
        lists = settled(knn_join(asked, refs, "point", "_other", "vector", near))
        ends = lists.groupBy("point").agg(F.max("distance").alias("_end"))
        met = lists.select("point", "_other", "distance").join(members, "_other").join(open_, ["point", "round"], "left_semi")
        best = _lowest_two(met, ["point", "round"], ["distance", "_pos"])
        at = lambda k, c: F.max(F.when(F.col("_rn") == k, F.col(c)))
        best = best.groupBy("point", "round").agg(at(1, "distance").alias("d1"), at(1, "_pos").alias("c1"), at(2, "distance").alias("d2"))
        found = open_.join(best, ["point", "round"], "left").join(ends, "point")
        sure = F.lit(True) if near >= n else F.coalesce(F.col("d2") < F.col("_end"), F.lit(False))
        found = settled(found.withColumn("_sure", sure).drop("_end"))
        done = found.filter("_sure").drop("_sure")
        out = done if out is None else out.unionByName(done)
        if near >= n:
            return out
        open_ = settled(found.filter("not _sure").select("point", "round"))
        if open_.isEmpty():
            return out
        near *= 8


def _points(df: DataFrame, row_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (point, vector), named by the lowest row id, and the rows of ``df`` with their point."""
    points = settled(df.groupBy(F.col(vector).alias("vector")).agg(F.min(row_id).alias("point")))
    rows = df.withColumnRenamed(vector, "vector").join(points, "vector").drop("vector")
    return points, settled(rows)


def _thresholds(risks: DataFrame, value: str, quantiles: Sequence[float], name: str) -> DataFrame:
    """(metric, quantile, threshold): percentiles over the rounds, rounded to three decimals."""
    q = risks.groupBy().agg(F.percentile(value, [float(p) for p in quantiles]).alias("p"))
    cells = [F.struct(F.lit(float(p)).alias("quantile"), F.round(F.col("p")[i], 3).alias("threshold")) for i, p in enumerate(quantiles)]
    return q.select(F.lit(name).alias("metric"), F.explode(F.array(*cells)).alias("c")).select("metric", "c.*")


def twice(risk: Column) -> Column:
    """Risk of at least one hit in two halves: 1 - (1 - r)²."""
    return F.lit(1.0) - (F.lit(1.0) - risk) * (F.lit(1.0) - risk)


def risk_rounds(df: DataFrame, row_id: str, columns: Sequence[str], rounds: int = 100, seed: int = 0) -> DataFrame:
    """(round, single_out_risk, inference_risk) of random halves of the original table; missing values count as -1."""
    whole = F.array(*[F.nanvl(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(-1.0)), F.lit(-1.0)) for c in columns])
    points, rows = _points(df.select(row_id, whole.alias("_v")), row_id, "_v")
    halves = settled(random_halves(rows, row_id, rounds, seed).select("round", "half", "pos", "point"))
    near = settled(nearest_in_halves(points, halves))
    own = halves.filter("half = 'b'").join(near, ["round", "point"])
    own = own.withColumn("_do", F.when(F.col("c1") == F.col("pos"), F.col("d2")).otherwise(F.col("d1")))
    other = own.select("round", F.col("pos").alias("c1"), F.col("_do").alias("_reference"))
    inference = own.join(other, ["round", "c1"], "left").groupBy("round")
    hit = F.coalesce((F.col("d1") < F.col("_reference")).cast("double"), F.lit(0.0))
    same = F.coalesce((F.col("d1") == 0).cast("double"), F.lit(0.0))  # equal vectors are one point
    return inference.agg(twice(F.avg(same)).alias("single_out_risk"), F.avg(hit).alias("inference_risk"))


def risk_thresholds(
    df: DataFrame, row_id: str, columns: Sequence[str], rounds: int = 100, quantiles: Sequence[float] = (0.9, 0.95, 0.99), seed: int = 0
) -> DataFrame:
    risks = risk_rounds(df, row_id, columns, rounds, seed)
    return _thresholds(risks, "single_out_risk", quantiles, "single_out_risk").unionByName(
        _thresholds(risks, "inference_risk", quantiles, "inference_risk")
    )


def attribution_rounds(
    df: DataFrame, row_id: str, quasi: Sequence[str], sensitive: Sequence[str], rounds: int = 100, seed: int = 0
) -> DataFrame:
    """(round, cap) of random halves, each adjusted to two halves."""
    rows = df.select(row_id, vector_of(quasi).alias("_k"), vector_of(sensitive).alias("_s"))
    points, rows = _points(rows, row_id, "_k")
    halves = settled(random_halves(rows, row_id, rounds, seed).select("round", "half", "pos", "point", "_s"))
    near = nearest_in_halves(points, halves).select("round", "point", "c1")
    own = halves.filter("half = 'b'").join(near, ["round", "point"])
    other = halves.filter("half = 'a'").select("round", F.col("pos").alias("c1"), F.col("_s").alias("_u"))
    same = F.coalesce((F.col("_s") == F.col("_u")).cast("double"), F.lit(0.0))
    return own.join(other, ["round", "c1"], "left").groupBy("round").agg(twice(F.avg(same)).alias("cap"))


def attribution_thresholds(
    df: DataFrame,
    row_id: str,
    quasi: Sequence[str],
    sensitive: Sequence[str],
    rounds: int = 100,
    quantiles: Sequence[float] = (0.9, 0.95, 0.99),
    seed: int = 0,
) -> DataFrame:
    caps = attribution_rounds(df, row_id, quasi, sensitive, rounds, seed)
    return _thresholds(caps, "cap", quantiles, "attribution_probability")


# ---- attacks ------------------------------------------------------------------------------------


def membership_attack(
    train: DataFrame, holdout: DataFrame, synthetic: DataFrame, row_id: str, vector: str = "vector", threshold: float = 0.5
) -> DataFrame:
    """Accuracy of "a real row was trained on if some synthetic row differs in at most this share of coordinates"."""
    real = train.select(row_id, vector, F.lit(1).alias("_y")).unionByName(holdout.select(row_id, vector, F.lit(0).alias("_y")))
    # ids may repeat between the two tables, so the label is part of the id
    real = real.withColumn("_q", F.concat(F.col("_y").cast("string"), F.col(row_id).cast("string")))
    near = knn_join(real.select("_q", vector), synthetic.select(F.col(row_id).alias("_r"), vector), "_q", "_r", vector, 1, "hamming")
    said = (F.col("distance") <= threshold).cast("int")
    return near.agg(F.avg((said == F.substring("_q", 1, 1).cast("int")).cast("double")).alias("accuracy"))


def reidentification_attack(
    train: DataFrame, holdout: DataFrame, synthetic: DataFrame, row_id: str, first: Sequence[str], second: Sequence[str]
) -> DataFrame:
    """(source, consistency): share of rows whose nearest train row is the same on both feature subsets."""

    def consistency(df: DataFrame, name: str) -> DataFrame:
        found = []
        for i, columns in enumerate((first, second)):
            v = vector_of(columns).alias("vector")
            q, r = df.select(F.col(row_id).alias("_q"), v), train.select(F.col(row_id).alias("_r"), v)
            found.append(knn_join(q, r, "_q", "_r").select("_q", F.col("_r").alias(f"_r{i}")))
        same = (F.col("_r0") == F.col("_r1")).cast("double")
        return found[0].join(found[1], "_q").agg(F.avg(same).alias("consistency")).select(F.lit(name).alias("source"), "consistency")

    return consistency(holdout, "holdout").unionByName(consistency(synthetic, "synthetic"))


def knn_class_shares(
    train: DataFrame, test: DataFrame, row_id: str, target: str, vector: str = "vector", k: int = 5
) -> DataFrame:
    """(row_id, level, share): class shares among the k nearest train rows; absent classes have share 0."""
    near = knn_join(test.select(F.col(row_id).alias("_q"), vector), train.select(F.col(row_id).alias("_r"), vector), "_q", "_r", vector, k)
    voted = near.join(train.select(F.col(row_id).alias("_r"), F.col(target).alias("level")), "_r")
    counts = voted.groupBy("_q", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("_q").agg(F.sum("n").alias("t"))
    return counts.join(totals, "_q").select(F.col("_q").alias(row_id), "level", (F.col("n") / F.col("t")).alias("share"))


def attribute_attack(
    train: DataFrame, test: DataFrame, row_id: str, target: str, vector: str = "vector", k: int = 5, classes: Sequence | None = None
) -> DataFrame:
    """Mean one-vs-rest ROC-AUC of the k-nearest-neighbour class shares (two classes: the second one's)."""
    levels = sorted(classes) if classes is not None else sorted(r[0] for r in train.select(target).distinct().collect())
    used = levels[1:] if len(levels) == 2 else levels
    shares = knn_class_shares(train, test, row_id, target, vector, k)
    wide = shares.groupBy(row_id).pivot("level", levels).agg(F.max("share"))
    joined = test.select(row_id, F.col(target).alias("_y")).join(wide, row_id)
    cells = [
        F.struct(F.lit(str(v)).alias("level"), (F.col("_y") == F.lit(v)).cast("int").alias("label"), F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias("score"))
        for v in used
    ]
    long = joined.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return roc_auc(long, "label", "score", ["level"]).agg(F.avg("auc").alias("auc"))
