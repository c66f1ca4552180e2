"""Outcome prediction, exact ranking metrics, significance tests and result tables."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.stats import two_sided_p
from cohortspark.functions.text import significance_stars
from cohortspark.operators.ordered import running_sum
from cohortspark.operators.sampling import incremental_samples, match_class_shares, stratified_folds, stratified_rows
from cohortspark.session import settled

# Vitals, labs and age used by the outcome task; hours of the stay it sees.
TASK_HOURS = 24
MODEL_ORDER = ("GBDT", "Random Forest", "Logistic Regression")
METRIC_ORDER = ("AUC", "AP")


def _counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: rows and positives, with the sums over smaller scores."""
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")
    )
    return running_sum(counts, by, ["score"], ["n", "p"])


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc): exact, ties counted half; null when a class is missing."""
    c = _counts(df, label, score, by)
    midrank = F.col("n_before") + (F.col("n") + 1) / 2.0
    out = c.groupBy(*by).agg(F.sum(midrank * F.col("p")).alias("s"), F.max("p_total").alias("P"), F.max("n_total").alias("N"))
    p = F.col("P").cast("double")
    neg = F.col("N") - p
    auc = F.try_divide(F.col("s") - p * (p + 1) / 2.0, p * neg)
    return out.select(*by, auc.alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, ap): one step per distinct score from the top, Σ (recall gain) · precision."""
    c = _counts(df, label, score, by)
    above_p = F.col("p_total") - F.col("p_before")
    above_n = F.col("n_total") - F.col("n_before")
    step = F.col("p") / F.nullif(F.col("p_total"), F.lit(0)) * above_p / above_n
    return c.groupBy(*by).agg(F.sum(step).alias("ap"))


def delong(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """One row: auc1, auc2, their variances and covariance, z and the two-sided p of equal AUCs.

    Placement values are found per distinct score; rows are collapsed to (label, first, second) before the
    scores are joined back.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull())
    rows = rows.select(F.col(label).cast("int").alias("y"), F.col(first).cast("double").alias("s1"), F.col(second).cast("double").alias("s2"))
    cells = rows.groupBy("y", "s1", "s2").agg(F.count(F.lit(1)).alias("w"))

    def placement(name: str, out: str) -> DataFrame:
        counts = cells.groupBy(F.col(name).alias("score")).agg(F.sum("w").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("p"))
        c = running_sum(counts, [], ["score"], ["n", "p"])
        q, q_before = F.col("n") - F.col("p"), F.col("n_before") - F.col("p_before")
        q_total = (F.col("n_total") - F.col("p_total")).cast("double")
        # midrank among all minus midrank inside the class is the (half-counted) number of the other class below
        pos = (q_before + q / 2.0) / F.nullif(q_total, F.lit(0.0))
        neg = F.lit(1.0) - (F.col("p_before") + F.col("p") / 2.0) / F.nullif(F.col("p_total").cast("double"), F.lit(0.0))
        return c.select(F.col("score").alias(name), pos.alias(f"{out}p"), neg.alias(f"{out}n"))

    joined = cells.join(placement("s1", "a"), "s1").join(placement("s2", "b"), "s2")
    v1 = F.when(F.col("y") == 1, F.col("ap")).otherwise(F.col("an"))
    v2 = F.when(F.col("y") == 1, F.col("bp")).otherwise(F.col("bn"))
    w = F.col("w").cast("double")
    sums = joined.groupBy("y").agg(
        F.sum(w).alias("n"),
        F.sum(w * v1).alias("x"),
        F.sum(w * v2).alias("z"),
        F.sum(w * v1 * v1).alias("xx"),
        F.sum(w * v2 * v2).alias("zz"),
        F.sum(w * v1 * v2).alias("xz"),
    )
    n1 = F.col("n") - 1

    def cov(s: str, a: str, b: str) -> Column:
        return (F.col(s) - F.col(a) * F.col(b) / F.col("n")) / n1 / F.col("n")

    parts = sums.select("y", "n", "x", "z", cov("xx", "x", "x").alias("v11"), cov("zz", "z", "z").alias("v22"), cov("xz", "x", "z").alias("v12"))
    one = parts.agg(
        F.max(F.when(F.col("y") == 1, F.col("x") / F.col("n"))).alias("auc1"),
        F.max(F.when(F.col("y") == 1, F.col("z") / F.col("n"))).alias("auc2"),
        F.sum("v11").alias("var1"),
        F.sum("v22").alias("var2"),
        F.sum("v12").alias("cov12"),
    )
    spread = F.sqrt(F.greatest(F.col("var1") + F.col("var2") - 2 * F.col("cov12"), F.lit(0.0)))
    z = F.try_divide(F.abs(F.col("auc1") - F.col("auc2")), spread)
    return one.withColumn("z", z).withColumn("p_value", two_sided_p("z"))


def wilcoxon(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, w, z, p_value): signed-rank test of pairs; zero differences dropped, normal approximation with
    tie correction and no continuity correction."""
    d = F.col(first).cast("double") - F.col(second).cast("double")
    rows = df.select(*by, d.alias("d")).filter((F.col("d").isNotNull()) & (F.col("d") != 0))
    counts = rows.groupBy(*by, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("d") > 0).cast("int")).alias("p"))
    c = running_sum(counts, by, ["size"], ["n"])
    midrank = F.col("n_before") + (F.col("n") + 1) / 2.0
    n3 = F.col("n").cast("double")
    sums = c.groupBy(*by).agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(midrank * F.col("p")).alias("plus"),
        F.sum(midrank * (F.col("n") - F.col("p"))).alias("minus"),
        F.sum(n3 * n3 * n3 - n3).alias("ties"),
    )
    n = F.col("n")
    w = F.least("plus", "minus")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.try_divide(w - n * (n + 1) / 4.0, F.sqrt(var))
    out = sums.select(*by, n.cast("bigint").alias("n"), w.alias("w"), z.alias("z"))
    return out.withColumn("p_value", two_sided_p("z"))


# ---- models -------------------------------------------------------------------------------------


def default_models(seed: int = 42) -> dict[str, Estimator]:
    return {
        "Logistic Regression": LogisticRegression(maxIter=1000),
        "Random Forest": RandomForestClassifier(numTrees=100, seed=seed),
        "GBDT": GBTClassifier(maxIter=100, seed=seed),
    }


def model_from_params(name: str, params: Mapping, seed: int = 42, rows: int | None = None) -> Estimator:
    """Estimator of a name with tuned parameters, for training on ``rows`` rows that :func:`assemble` made."""
    own = spark_params(params, rows)
    if name == "Logistic Regression":
        return LogisticRegression(standardization=False, **own)
    if name == "Random Forest":
        return RandomForestClassifier(seed=seed, **own)
    return GBTClassifier(seed=seed, **own)


def spark_params(params: Mapping, rows: int | None = None) -> dict:
    """Drawn parameters under Spark's names.

    ``C`` weighs the summed loss against half the squared weights; Spark weighs the squared weights against the mean
    loss, so ``regParam`` is 1 / (C · rows).  ``balanced`` chooses the column of class weights, else of ones.
    """
    own = dict(params)
    if "C" in own:
        own["regParam"] = 1.0 / (own.pop("C") * rows)
    if "balanced" in own:
        own["weightCol"] = "balanced" if own.pop("balanced") else "plain"
    return own


def assemble(df: DataFrame, target: str, keep: Sequence[str] = ()) -> DataFrame:
    inputs = [c for c in df.columns if c not in (target, *keep)]
    out = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(df)
    return out.select(*keep, "features", F.col(target).cast("double").alias("label"))


def with_class_weights(rows: DataFrame) -> DataFrame:
    """Assembled rows with ``plain``, a column of ones, and ``balanced``: rows / (2 · rows of the own class)."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1.0).alias("p")).first()
    weight = lambda k: sizes["n"] / (2.0 * max(1, k))
    balanced = F.when(F.col("label") == 1.0, weight(sizes["p"])).otherwise(weight(sizes["n"] - sizes["p"]))
    return rows.withColumns({"plain": F.lit(1.0), "balanced": balanced})


def predict(model: Estimator, train: DataFrame, test: DataFrame, row_id: str) -> DataFrame:
    """(row_id, label, score): fit on assembled train rows, positive-class probability on assembled test rows."""
    scored = model.fit(train).transform(test)
    return scored.select(row_id, "label", vector_to_array("probability")[1].alias("score"))


def evaluate_models(
    train: DataFrame, test: DataFrame, target: str, row_id: str, models: Mapping[str, Estimator] | None = None
) -> DataFrame:
    """(model, auc, ap) of every model fitted on train and scored on test.

    Every fit scans its training rows many times, so they are kept for the duration of the fits.
    """
    rows = assemble(train.drop(row_id), target).persist()
    held = settled(assemble(test, target, [row_id]))
    try:
        scored = [predict(m, rows, held, row_id).withColumn("model", F.lit(name)) for name, m in (models or default_models()).items()]
    finally:
        rows.unpersist()
    both = settled(reduce(DataFrame.unionByName, scored))
    return roc_auc(both, "label", "score", ["model"]).join(average_precision(both, "label", "score", ["model"]), "model")


def bootstrap_scores(
    real: DataFrame,
    synthetic: DataFrame,
    target: str,
    row_id: str,
    models: Callable[[int], Mapping[str, Estimator]] = default_models,
    rates: Sequence[float] = (0.0, 0.1, 0.25, 0.5),
    rounds: int = 100,
    train_share: float = 0.8,
    even: bool = False,
    seed: int = 42,
) -> DataFrame:
    """(round, setting, model, auc, ap).  Settings: 'synthetic' (train synthetic, test real) and one per rate of
    synthetic rows added to the real training rows.

    Rounds are independent model fits, so they are a loop of Spark jobs; only scores come back.
    """
    columns = [c for c in real.columns if c != row_id]
    results = []
    rng = random.Random(seed)
    for i in range(rounds):
        s = seed if rounds == 1 else rng.randrange(1000)
        parts = settled(stratified_rows(real, row_id, target, train_share, s))
        train, test = parts.filter(F.col("part") == "train").drop("part"), parts.filter(F.col("part") == "test").drop("part")
        matched = match_class_shares(real, synthetic, target, row_id, s)
        own = settled(stratified_rows(matched, row_id, target, train_share, s).filter(F.col("part") == "train"))
        settings = {"synthetic": own.select(row_id, *columns)}
        added = [r for r in rates if r > 0]
        draws = settled(incremental_samples(real, synthetic, target, row_id, added, even, s)) if added else None
        for r in rates:
            extra = None if r == 0 else draws.filter(F.col("rate") == float(r)).select(row_id, *columns)
            settings[str(r)] = train if extra is None else train.select(row_id, *columns).unionByName(extra)
        for name, rows in settings.items():
            scores = evaluate_models(rows, test, target, row_id, models(s))
            results.append(scores.select(F.lit(i).alias("round"), F.lit(name).alias("setting"), "model", "auc", "ap"))
    return settled(reduce(DataFrame.unionByName, results))


def bootstrap_table(scores: DataFrame, target: str) -> DataFrame:
    """One row per model and metric, one column per setting: 'mean ± population deviation' with three decimals."""
    settings = sorted(r[0] for r in scores.select("setting").distinct().collect())
    long = scores.select(
        "setting", "model", F.explode(F.array(F.struct(F.lit("AUC").alias("metric"), F.col("auc").alias("v")), F.struct(F.lit("AP").alias("metric"), F.col("ap").alias("v")))).alias("c")
    ).select("setting", "model", "c.*")
    text = F.format_string("%.3f ± %.3f", F.avg("v"), F.stddev_pop("v"))
    wide = long.groupBy("model", "metric").pivot("setting", settings).agg(text)
    return wide.select(F.lit(target).alias("target"), "model", "metric", *[F.col(f"`{s}`") for s in settings])


def bootstrap_tests(scores: DataFrame, base: str = "0.0") -> DataFrame:
    """(setting, model, metric, p_value): signed-rank test of each setting's scores against the base setting."""
    a = scores.filter(F.col("setting") == base).select("round", "model", F.col("auc").alias("auc0"), F.col("ap").alias("ap0"))
    b = scores.filter(F.col("setting") != base)
    joined = b.join(a, ["round", "model"])
    out = []
    for metric, x, y in (("AUC", "auc", "auc0"), ("AP", "ap", "ap0")):
        out.append(wilcoxon(joined, x, y, ["setting", "model"]).select("setting", "model", F.lit(metric).alias("metric"), "p_value"))
    return out[0].unionByName(out[1])


def result_table(table: DataFrame, tests: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Scores with significance stars appended: unpivot, join on (model, metric, setting), pivot back."""
    keys = ["target", "model", "metric"]
    cells = [F.struct(F.lit(s).alias("setting"), F.col(f"`{s}`").alias("score")) for s in settings]
    long = table.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    starred = long.join(tests.select("model", "metric", "setting", significance_stars("p_value").alias("stars")), ["model", "metric", "setting"], "left")
    shown = F.concat_ws(" ", "score", F.nullif(F.col("stars"), F.lit("")))
    return starred.groupBy(*keys).pivot("setting", list(settings)).agg(F.max(shown))


# ---- tuning -------------------------------------------------------------------------------------


def random_params(name: str, rng: random.Random) -> dict:
    """One random draw of the search space.  Fixed values: ranges of the parameters.

    Spark's trees have at most 30 levels and no least number of rows for a split but that of a leaf; its logistic
    regression has one solver.
    """
    log = lambda lo, hi: lo * (hi / lo) ** rng.random()
    if name == "Logistic Regression":
        return {"C": log(1e-4, 1e2), "balanced": rng.choice([False, True]), "maxIter": rng.randint(300, 2000)}
    if name == "Random Forest":
        return {
            "numTrees": rng.randint(100, 800),
            "maxDepth": rng.randint(2, 30),
            "minInstancesPerNode": rng.randint(1, 20),
            "featureSubsetStrategy": rng.choice(["sqrt", "log2", "all"]),
            "balanced": rng.choice([False, True]),
        }
    return {
        "maxIter": rng.randint(100, 800),
        "stepSize": log(0.01, 0.3),
        "maxDepth": rng.randint(1, 5),
        "subsamplingRate": rng.uniform(0.6, 1.0),
        "minInstancesPerNode": rng.randint(1, 20),
    }


def plateaued(values: Sequence[float], window: int = 30, gain: float = 0.002) -> bool:
    """True when none of the last ``window`` trials improved the best earlier score by ``gain``."""
    if len(values) <= window:
        return False
    best, improved = values[0], False
    for i, v in enumerate(values[1:], start=1):
        if i >= len(values) - window and v - best >= gain:
            improved = True
        best = max(best, v)
    return not improved


def tune(
    df: DataFrame,
    target: str,
    row_id: str,
    name: str,
    trials: int = 100,
    folds: int = 5,
    seed: int = 42,
    batch: int = 4,
    draw: Callable[[str, random.Random], dict] = random_params,
) -> tuple[dict, float]:
    """Best random parameters by mean AUC over stratified folds; stops when the search levels off."""
    rows = stratified_folds(df, row_id, target, folds, seed)
    data = with_class_weights(assemble(rows.drop(row_id), target, ["fold"])).cache()
    trained_on = data.count() * (folds - 1) // folds
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    rng = random.Random(seed)
    best: tuple[dict, float] = ({}, float("-inf"))
    scores: list[float] = []
    try:
        while len(scores) < trials and not plateaued(scores):
            params = [draw(name, rng) for _ in range(min(batch, trials - len(scores)))]
            model = model_from_params(name, {}, seed)
            maps = [{model.getParam(k): v for k, v in spark_params(p, trained_on).items()} for p in params]
            cv = CrossValidator(
                estimator=model, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=len(maps)
            )
            for p, score in zip(params, cv.fit(data).avgMetrics):
                scores.append(score)
                if score > best[1]:
                    best = (p, score)
    finally:
        data.unpersist()
    return best
