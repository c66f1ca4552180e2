"""Utility queries: labels of documents with scores from their length; models on customers' order summaries."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from cohortspark.catalog.registry import Tables, query, rnd
from cohortspark.operators import sampling, utility
from cohortspark.session import settled

_SCORED = """WITH d AS (SELECT doc_id, l.quality, l.toxic, lang, CAST(n_chars // 50 AS DOUBLE) AS s1, CAST(length(text) % 97 AS DOUBLE) AS s2 FROM labels l JOIN documents USING (doc_id))"""


def _scored(t: Tables):
    d = t.labels.join(t.documents, "doc_id")
    s1, s2 = F.floor(F.col("n_chars") / 50).cast("double"), (F.length("text") % 97).cast("double")
    return d.select("doc_id", "quality", "toxic", "lang", s1.alias("s1"), s2.alias("s2"))


@query(
    "roc_auc",
    f"""{_SCORED} SELECT round(sum((p.s1 > n.s1)::INT + 0.5::DOUBLE * (p.s1 = n.s1)::INT) / count(*), 9) AS auc FROM d p, d n WHERE p.quality = 1 AND n.quality = 0""",
)
def roc_auc(t: Tables):
    return utility.roc_auc(_scored(t), "quality", "s1").select(rnd("auc", 9).alias("auc"))


@query(
    "roc_auc_by_group",
    f"""{_SCORED} SELECT p.lang, round(sum((p.s2 > n.s2)::INT + 0.5::DOUBLE * (p.s2 = n.s2)::INT) / count(*), 9) AS auc FROM d p JOIN d n ON p.lang = n.lang
    WHERE p.quality = 1 AND n.quality = 0 GROUP BY p.lang""",
)
def roc_auc_by_group(t: Tables):
    return utility.roc_auc(_scored(t), "quality", "s2", ["lang"]).filter("auc IS NOT NULL").withColumn("auc", rnd("auc", 9))


@query(
    "average_precision",
    f"""{_SCORED}, c AS (SELECT s1, count(*) AS n, sum(quality) AS p FROM d GROUP BY s1),
    w AS (SELECT p, sum(p) OVER (ORDER BY s1 DESC) AS tp, sum(n) OVER (ORDER BY s1 DESC) AS k, sum(p) OVER () AS total FROM c)
    SELECT round(sum(p / total * tp / k), 9) AS ap FROM w""",
)
def average_precision(t: Tables):
    return utility.average_precision(_scored(t), "quality", "s1").select(rnd("ap", 9).alias("ap"))


_PSI = "((p.{s} > n.{s})::INT + 0.5::DOUBLE * (p.{s} = n.{s})::INT)"


@query(
    "delong",
    f"""{_SCORED}, x AS (SELECT p.doc_id AS i, n.doc_id AS j, {_PSI.format(s='s1')} AS a, {_PSI.format(s='s2')} AS b FROM d p, d n WHERE p.quality = 1 AND n.quality = 0),
    vp AS (SELECT avg(a) AS a, avg(b) AS b FROM x GROUP BY i), vn AS (SELECT avg(a) AS a, avg(b) AS b FROM x GROUP BY j),
    s AS (SELECT (SELECT avg(a) FROM x) AS auc1, (SELECT avg(b) FROM x) AS auc2,
      (SELECT var_samp(a) / count(*) FROM vp) + (SELECT var_samp(a) / count(*) FROM vn) AS var1,
      (SELECT var_samp(b) / count(*) FROM vp) + (SELECT var_samp(b) / count(*) FROM vn) AS var2,
      (SELECT covar_samp(a, b) / count(*) FROM vp) + (SELECT covar_samp(a, b) / count(*) FROM vn) AS cov12)
    SELECT round(auc1, 8) AS auc1, round(auc2, 8) AS auc2, round(var1, 10) AS var1, round(var2, 10) AS var2, round(cov12, 10) AS cov12, round(abs(auc1 - auc2) / sqrt(var1 + var2 - 2 * cov12), 6) AS z FROM s""",
)
def delong(t: Tables):
    out = utility.delong(_scored(t), "quality", "s1", "s2")
    return out.select(rnd("auc1", 8).alias("auc1"), rnd("auc2", 8).alias("auc2"), *[rnd(c, 10).alias(c) for c in ("var1", "var2", "cov12")], rnd("z").alias("z"))


@query(
    "wilcoxon",
    f"""{_SCORED}, x AS (SELECT s1 - s2 AS d FROM d WHERE s1 <> s2), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS mr FROM x),
    t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY abs(d))), s AS (SELECT count(*) AS n, least(sum(mr) FILTER (d > 0), sum(mr) FILTER (d < 0)) AS w FROM r)
    SELECT n, w, round((w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48), 7) AS z FROM s, t""",
)
def wilcoxon(t: Tables):
    return utility.wilcoxon(_scored(t), "s1", "s2").select("n", "w", rnd("z", 7).alias("z"))


def _outcomes(t: Tables):
    """One row per customer: order summaries and whether any order has the top priority."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("o_totalprice").alias("spend"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("target"),
    )
    return t.customer.join(o, "c_custkey").select("c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), "n", (F.col("spend") / 100000).alias("spend"), "target")


@query("mortality_models")
def mortality_models(t: Tables):
    """Three fitted models scored on held-out rows: rows only."""
    parts = settled(sampling.stratified_rows(_outcomes(t), "c_custkey", "target", 0.8, 1))
    train, test = parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")
    return utility.evaluate_models(train, test, "target", "c_custkey")


@query("bootstrap_table")
def bootstrap_table(t: Tables):
    """Two bootstrap rounds of one model: rows only."""
    rows = _outcomes(t)
    synthetic = rows.withColumns({"balance": F.col("balance") * 1.05, "spend": F.col("spend") + 0.01})
    scores = utility.bootstrap_scores(
        rows, synthetic, "target", "c_custkey", lambda seed: {"Logistic Regression": LogisticRegression()}, (0.0, 0.5), 2, seed=5
    )
    return utility.bootstrap_table(scores, "target")
