"""Privacy queries: customers with quasi-identifiers; embeddings as real and synthetic vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import Tables, query, rnd
from cohortspark.operators import neighbours, privacy

_PEOPLE = """WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 4000) AS BIGINT) AS bracket FROM customer)"""


def _people(t: Tables):
    return t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 4000).alias("bracket"))


@query("k_anonymity", f"{_PEOPLE} SELECT min(n) AS k_anonymity FROM (SELECT count(*) AS n FROM c GROUP BY c_nationkey, c_mktsegment)")
def k_anonymity(t: Tables):
    return privacy.k_anonymity(_people(t), ["c_nationkey", "c_mktsegment"])


@query("l_diversity", f"{_PEOPLE} SELECT min(n) AS l_diversity FROM (SELECT count(DISTINCT bracket) AS n FROM c GROUP BY c_nationkey, c_mktsegment)")
def l_diversity(t: Tables):
    return privacy.l_diversity(_people(t), ["c_nationkey", "c_mktsegment"], "bracket")


@query(
    "t_closeness",
    f"""{_PEOPLE}, g AS (SELECT bracket, count(*) / sum(count(*)) OVER () AS q FROM c GROUP BY bracket),
    p AS (SELECT c_nationkey, c_mktsegment, bracket, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey, c_mktsegment) AS p FROM c GROUP BY c_nationkey, c_mktsegment, bracket)
    SELECT round(max(kl), 9) AS t_closeness FROM (SELECT sum(p * ln(p / q)) AS kl FROM p JOIN g USING (bracket) GROUP BY c_nationkey, c_mktsegment)""",
)
def t_closeness(t: Tables):
    return privacy.t_closeness(_people(t), ["c_nationkey", "c_mktsegment"], "bracket").select(rnd("t_closeness", 9).alias("t_closeness"))


@query(
    "single_out",
    f"""WITH o AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_linenumber FROM lineitem WHERE l_linestatus = 'O')
    SELECT round(avg((o.l_quantity IS NOT NULL)::INT), 9) AS single_out_risk FROM (SELECT * FROM lineitem WHERE l_linestatus = 'F') s LEFT JOIN o
    ON s.l_quantity = o.l_quantity AND s.l_discount = o.l_discount AND s.l_tax = o.l_tax AND s.l_linenumber = o.l_linenumber""",
)
def single_out(t: Tables):
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    out = privacy.single_out_risk(t.lineitem.filter("l_linestatus = 'O'"), t.lineitem.filter("l_linestatus = 'F'"), columns)
    return out.select(rnd("single_out_risk", 9).alias("single_out_risk"))


# ---- vectors ------------------------------------------------------------------------------------
# original: the first half of each embedding; synthetic: the second half of the same row

_VEC = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  o AS (SELECT vec_id, label, v[1:32] AS v FROM e), s AS (SELECT vec_id, label, v[33:64] AS v FROM e)"""
_D = "list_sum([(p.v[i] - q.v[i]) * (p.v[i] - q.v[i]) FOR i IN range(1, 33)])"


def _vectors(t: Tables):
    v = F.col("embedding").cast("array<double>")
    o = t.embeddings.select("vec_id", "label", F.slice(v, 1, 32).alias("vector"))
    s = t.embeddings.select("vec_id", "label", F.slice(v, 33, 32).alias("vector"))
    return o, s


@query(
    "nearest_neighbour",
    f"""{_VEC} SELECT q.vec_id AS query_id, arg_min(p.vec_id, ({_D}, p.vec_id)) AS ref_id, round(sqrt(min({_D})), 7) AS distance FROM s q, o p GROUP BY q.vec_id""",
)
def nearest_neighbour(t: Tables):
    o, s = _vectors(t)
    near = neighbours.knn_join(s.withColumnRenamed("vec_id", "query_id"), o.withColumnRenamed("vec_id", "ref_id"), "query_id", "ref_id")
    return near.select("query_id", "ref_id", rnd("distance", 7).alias("distance"))


@query(
    "k_nearest",
    f"""{_VEC}, d AS (SELECT q.vec_id AS query_id, p.vec_id AS ref_id, {_D} AS d FROM s q, o p)
    SELECT query_id, ref_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS INT) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) <= 5""",
)
def k_nearest(t: Tables):
    o, s = _vectors(t)
    near = neighbours.knn_join(s.withColumnRenamed("vec_id", "query_id"), o.withColumnRenamed("vec_id", "ref_id"), "query_id", "ref_id", k=5)
    return near.select("query_id", "ref_id", "rank")


@query(
    "inferential_risk",
    f"""{_VEC}, d AS (SELECT q.vec_id AS i, p.vec_id AS j, {_D} AS d FROM s q, o p),
    n AS (SELECT i, min(d) AS ds, arg_min(j, (d, j)) AS c FROM d GROUP BY i), r AS (SELECT i, min(d) AS dr FROM d WHERE i <> j GROUP BY i)
    SELECT avg((ds < dr)::INT) AS inference_risk FROM n JOIN r ON n.c = r.i""",
)
def inferential_risk(t: Tables):
    return privacy.inferential_risk(*_vectors(t), "vec_id")


@query(
    "inferential_risk_original",
    f"""{_VEC}, d AS (SELECT q.vec_id AS i, p.vec_id AS j, {_D} AS d FROM s q, o p), d2 AS (SELECT q.vec_id AS i, p.vec_id AS j, {_D} AS d FROM o q, o p WHERE q.vec_id <> p.vec_id),
    n AS (SELECT i, min(d) AS ds, arg_min(j, (d, j)) AS c FROM d GROUP BY i), r AS (SELECT i, min(d) AS dr FROM d2 GROUP BY i)
    SELECT avg((ds < dr)::INT) AS inference_risk FROM n JOIN r ON n.c = r.i""",
)
def inferential_risk_original(t: Tables):
    return privacy.inferential_risk(*_vectors(t), "vec_id", mode="original")


@query(
    "cap",
    f"""{_VEC}, n AS (SELECT q.vec_id AS i, q.label AS a, arg_min(p.label, ({_D}, p.vec_id)) AS b FROM s q, o p GROUP BY ALL) SELECT avg((a = b)::INT) AS cap FROM n""",
)
def cap(t: Tables):
    o, s = _vectors(t)
    shape = lambda df: df.select("vec_id", F.col("vector").alias("quasi"), F.array("label").alias("sensitive"))
    return privacy.attribution_probability(shape(o), shape(s), "vec_id")


# 100 random halves over all 64 coordinates; distances are taken once, the halves differ in who may be met.
_ROUNDS = 100
_HALVES = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  dist AS (SELECT p.vec_id AS i, q.vec_id AS j, sqrt(list_sum([(p.v[k] - q.v[k]) * (p.v[k] - q.v[k]) FOR k IN range(1, 65)])) AS d FROM e p, e q),
  x AS (SELECT *, r AS round, row_number() OVER (PARTITION BY r ORDER BY md5('half 0 ' || r || ':' || vec_id), vec_id) AS rank, count(*) OVER (PARTITION BY r) // 2 AS h
    FROM (SELECT vec_id, label FROM e), range(1, {_ROUNDS + 1}) t(r)),
  a AS (SELECT round, rank AS pos, vec_id, label FROM x WHERE rank <= h), b AS (SELECT round, rank - h AS pos, vec_id, label FROM x WHERE rank > h AND rank <= 2 * h),
  m AS (SELECT q.round, q.pos AS i, p.pos AS j, q.label AS s, p.label AS u, d FROM b q JOIN a p ON p.round = q.round JOIN dist ON dist.i = q.vec_id AND dist.j = p.vec_id)"""
_RISKS = f"""{_HALVES}, n AS (SELECT round, i, min(d) AS ds, arg_min(j, (d, j)) AS c FROM m GROUP BY ALL),
  r AS (SELECT round, i, min(d) AS dr FROM m WHERE i <> j GROUP BY ALL), so AS (SELECT round, avg((ds = 0)::INT) AS r FROM n GROUP BY round),
  inf AS (SELECT n.round, avg((ds < dr)::INT) AS inference_risk FROM n JOIN r ON n.round = r.round AND n.c = r.i GROUP BY n.round),
  risks AS (SELECT round, 1 - (1 - so.r) * (1 - so.r) AS single_out_risk, inference_risk FROM so JOIN inf USING (round))"""
_COLUMNS = [f"v{i}" for i in range(64)]


def _wide(t: Tables):
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_COLUMNS)])


@query("risk_rounds", f"{_RISKS} SELECT round, round(single_out_risk, 9) AS single_out_risk, round(inference_risk, 9) AS inference_risk FROM risks")
def risk_rounds(t: Tables):
    out = privacy.risk_rounds(_wide(t), "vec_id", _COLUMNS, _ROUNDS)
    return out.select(F.col("round").cast("bigint").alias("round"), rnd("single_out_risk", 9).alias("single_out_risk"), rnd("inference_risk", 9).alias("inference_risk"))


@query(
    "attribution_rounds",
    f"""{_HALVES}, n AS (SELECT round, i, any_value(s) AS s, arg_min(u, (d, j)) AS u FROM m GROUP BY ALL)
    SELECT round, round(1 - (1 - avg((s = u)::INT)) * (1 - avg((s = u)::INT)), 9) AS cap FROM n GROUP BY round""",
)
def attribution_rounds(t: Tables):
    out = privacy.attribution_rounds(_wide(t), "vec_id", _COLUMNS, ["label"], _ROUNDS)
    return out.select(F.col("round").cast("bigint").alias("round"), rnd("cap", 9).alias("cap"))


@query(
    "risk_thresholds",
    f"""{_RISKS}, q AS (SELECT unnest([0.9, 0.95, 0.99])::DOUBLE AS quantile),
    long AS (SELECT 'single_out_risk' AS metric, single_out_risk AS v FROM risks UNION ALL SELECT 'inference_risk', inference_risk FROM risks),
    l AS (SELECT metric, list_sort(list(v)) AS v FROM long GROUP BY metric),
    p AS (SELECT metric, quantile, v, (len(v) - 1) * quantile AS place FROM l, q)
    SELECT metric, quantile, round(v[floor(place)::INT + 1] + (place - floor(place)) * (v[ceil(place)::INT + 1] - v[floor(place)::INT + 1]), 3) AS threshold FROM p""",
)
def risk_thresholds(t: Tables):
    return privacy.risk_thresholds(_wide(t), "vec_id", _COLUMNS, _ROUNDS)


_COARSE = """WITH e AS (SELECT vec_id, label, [floor(v * 8) FOR v IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings)"""
_HAMMING = "list_sum([(p.v[i] <> q.v[i])::INT FOR i IN range(1, 65)]) / 64"


def _coarse(t: Tables):
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 8).cast("double")).alias("vector"))


@query(
    "membership",
    f"""{_COARSE}, d AS (SELECT q.vec_id, q.label < 3 AS y, min({_HAMMING}) AS d FROM (SELECT * FROM e WHERE label < 6) q, (SELECT * FROM e WHERE label >= 6) p GROUP BY ALL)
    SELECT avg(((d <= 0.4) = y)::INT) AS accuracy FROM d""",
)
def membership(t: Tables):
    e = _coarse(t)
    return privacy.membership_attack(e.filter("label < 3"), e.filter("label >= 3 AND label < 6"), e.filter("label >= 6"), "vec_id", threshold=0.4)


@query(
    "reident",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), tr AS (SELECT * FROM e WHERE label < 4),
    n AS (SELECT q.vec_id, q.label < 7 AS h, arg_min(p.vec_id, (list_sum([(p.v[i] - q.v[i]) * (p.v[i] - q.v[i]) FOR i IN range(1, 33)]), p.vec_id)) AS a,
      arg_min(p.vec_id, (list_sum([(p.v[i] - q.v[i]) * (p.v[i] - q.v[i]) FOR i IN range(33, 65)]), p.vec_id)) AS b FROM e q, tr p WHERE q.label >= 4 GROUP BY ALL)
    SELECT CASE WHEN h THEN 'holdout' ELSE 'synthetic' END AS source, round(avg((a = b)::INT), 9) AS consistency FROM n GROUP BY h""",
)
def reident(t: Tables):
    e = _wide(t)
    parts = e.filter("label < 4"), e.filter("label >= 4 AND label < 7"), e.filter("label >= 7")
    out = privacy.reidentification_attack(*parts, "vec_id", _COLUMNS[:32], _COLUMNS[32:])
    return out.withColumn("consistency", rnd("consistency", 9))


@query(
    "attribute_knn",
    f"""{_VEC}, d AS (SELECT q.vec_id AS i, p.label AS l, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D}, p.vec_id) AS k FROM s q, o p),
    sh AS (SELECT i, c AS level, avg((l = c)::INT) AS score FROM d, range(0, 10) t(c) WHERE k <= 5 GROUP BY ALL),
    y AS (SELECT sh.*, (e.label = level)::INT AS y FROM sh JOIN e ON e.vec_id = i),
    r AS (SELECT level, y, rank() OVER (PARTITION BY level ORDER BY score) + (count(*) OVER (PARTITION BY level, score) - 1) / 2.0::DOUBLE AS mr FROM y)
    SELECT round(avg(a), 8) AS auc FROM (SELECT level, (sum(mr) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS a FROM r GROUP BY level)""",
)
def attribute_knn(t: Tables):
    return privacy.attribute_attack(*_vectors(t), "vec_id", "label").select(rnd("auc", 8).alias("auc"))
