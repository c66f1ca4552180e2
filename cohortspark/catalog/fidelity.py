"""Fidelity queries: line items with status O as the real table, F as the synthetic one; users' events over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import NUDGE_SQL, Tables, query, rnd, snap
from cohortspark.catalog.roles import hours_sql
from cohortspark.functions.text import correlation_band
from cohortspark.operators import fidelity, grid, neighbours
from cohortspark.operators.impute import hour_index

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pair(t: Tables):
    li = t.lineitem.withColumn("bulk", (F.col("l_quantity") > 25).cast("int"))
    return li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'")


def _long(where: str = "TRUE", extra: str = "l_linestatus AS s") -> str:
    return " UNION ALL ".join(f"SELECT {extra}, '{c}' AS feature, {c} AS value FROM lineitem WHERE {where}" for c in NUMBERS)


_KS = f"""l AS ({_long()}), n AS (SELECT feature, count(*) FILTER (s = 'O') AS n1, count(*) FILTER (s = 'F') AS n2 FROM l GROUP BY 1),
  c AS (SELECT feature, value, count(*) FILTER (s = 'O') AS a, count(*) FILTER (s = 'F') AS b FROM l GROUP BY ALL),
  e AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM c WINDOW w AS (PARTITION BY feature ORDER BY value)),
  ks AS (SELECT feature, max(abs(ca / n1 - cb / n2)) AS ks, any_value(n1) AS n1, any_value(n2) AS n2 FROM e JOIN n USING (feature) GROUP BY feature),
  lam AS (SELECT *, ks * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM ks),
  p AS (SELECT feature, ks, least(greatest(2 * list_sum([CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * lam * lam) FOR k IN range(1, 101)]), 0), 1) AS p_value FROM lam)"""


@query("ks_stat", f"WITH {_KS} SELECT feature, round(ks, 9) AS ks, round(p_value, 7) AS p_value FROM p")
def ks_stat(t: Tables):
    out = fidelity.ks_table(*_pair(t), NUMBERS, None)
    return out.select("feature", rnd("ks", 9).alias("ks"), rnd("p_value", 7).alias("p_value"))


@query(
    "data_statistics",
    f"""WITH {_KS} SELECT feature, round(avg(value) FILTER (s = 'O'), 5) AS mean_real, round(avg(value) FILTER (s = 'F'), 5) AS mean_synthetic,
    round(stddev_samp(value) FILTER (s = 'O'), 5) AS std_real, round(stddev_samp(value) FILTER (s = 'F'), 5) AS std_synthetic,
    0.0::DOUBLE AS missing_rate_real, 0.0::DOUBLE AS missing_rate_synthetic, round(any_value(ks), 5) AS ks, round(any_value(p_value), 5) AS p_value
    FROM l JOIN p USING (feature) GROUP BY feature""",
)
def data_statistics(t: Tables):
    return fidelity.data_statistics(*_pair(t), NUMBERS, decimals=5)


@query(
    "dimension_probability",
    """SELECT feature, round(avg(v) FILTER (s = 'O'), 8) AS p_real, round(avg(v) FILTER (s = 'F'), 8) AS p_synthetic FROM (
    SELECT l_linestatus AS s, unnest(['n1', 'n2', 'rf']) AS feature, unnest([(l_linenumber = 1)::INT, (l_linenumber = 2)::INT, (l_returnflag = 'R')::INT]) AS v FROM lineitem) GROUP BY feature""",
)
def dimension_probability(t: Tables):
    out = fidelity.dimension_probability(*_flags(t))
    return out.select("feature", rnd("p_real", 8).alias("p_real"), rnd("p_synthetic", 8).alias("p_synthetic"))


def _flags(t: Tables):
    made = lambda df: df.withColumns(
        {"n1": (F.col("l_linenumber") == 1).cast("int"), "n2": (F.col("l_linenumber") == 2).cast("int"), "rf": (F.col("l_returnflag") == "R").cast("int")}
    )
    a, b = _pair(t)
    return made(a), made(b), ["n1", "n2", "rf"]


@query(
    "probability_summary",
    """WITH p AS (SELECT feature, avg(v) FILTER (s = 'O') AS x, avg(v) FILTER (s = 'F') AS y FROM (
    SELECT l_linestatus AS s, unnest(['n1', 'n2', 'rf']) AS feature, unnest([(l_linenumber = 1)::INT, (l_linenumber = 2)::INT, (l_returnflag = 'R')::INT]) AS v FROM lineitem) GROUP BY feature)
    SELECT round(corr(x, y), 7) AS correlation, round(sqrt(avg((x - y) * (x - y))), 9) AS rmse, round(avg(abs(x - y)), 9) AS mean_abs_diff,
    avg((abs(x - y) <= 0.01)::INT) AS within_01, avg((abs(x - y) <= 0.05)::INT) AS within_05 FROM p""",
)
def probability_summary(t: Tables):
    s = fidelity.probability_summary(fidelity.dimension_probability(*_flags(t)))
    return s.select(rnd("correlation", 7).alias("correlation"), rnd("rmse", 9).alias("rmse"), rnd("mean_abs_diff", 9).alias("mean_abs_diff"), "within_01", "within_05")


def _pairs_sql(where: str) -> str:
    parts = []
    for i, a in enumerate(NUMBERS):
        for b in NUMBERS[i + 1 :]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM lineitem WHERE {where}")
    return " UNION ALL ".join(parts)


@query("pearson_pairs", f"SELECT a, b, n, round(r, 7) AS r FROM ({_pairs_sql('TRUE')})")
def pearson_pairs(t: Tables):
    return fidelity.pearson_pairs(t.lineitem, NUMBERS).withColumn("r", rnd("r", 7))


@query(
    "matrix_compare",
    f"""WITH x AS ({_pairs_sql("l_linestatus = 'O'")}), y AS ({_pairs_sql("l_linestatus = 'F'")})
    SELECT round(avg(abs(x.r - y.r)), 7) AS mad, avg((abs(x.r - y.r) <= 0.05)::INT) AS coverage, round(avg((sign(x.r) = sign(y.r))::INT) * 100, 6) AS sign_agreement
    FROM x JOIN y USING (a, b)""",
)
def matrix_compare(t: Tables):
    a, b = _pair(t)
    m = fidelity.matrix_compare(fidelity.pearson_pairs(a, NUMBERS), fidelity.pearson_pairs(b, NUMBERS))
    return m.select(rnd("mad", 7).alias("mad"), "coverage", rnd("sign_agreement").alias("sign_agreement"))


_BAND = "CASE WHEN {r} < -0.5 THEN 0 WHEN {r} < -0.3 THEN 1 WHEN {r} < -0.1 THEN 2 WHEN {r} < 0.1 THEN 3 WHEN {r} < 0.3 THEN 4 WHEN {r} < 0.5 THEN 5 ELSE 6 END"


@query(
    "band_agreement",
    f"""WITH x AS ({_pairs_sql("l_linestatus = 'O'")}), y AS ({_pairs_sql("l_linestatus = 'F'")})
    SELECT (sum(({_BAND.format(r='x.r')} = {_BAND.format(r='y.r')})::INT) * 2 + 4) / 16 AS band_agreement, round(sum(abs(x.r - y.r)) * 2 / 16, 7) AS mean_abs_diff FROM x JOIN y USING (a, b)""",
)
def band_agreement(t: Tables):
    a, b = _pair(t)
    m = fidelity.band_agreement(fidelity.pearson_pairs(a, NUMBERS), fidelity.pearson_pairs(b, NUMBERS), 4)
    return m.withColumn("mean_abs_diff", rnd("mean_abs_diff", 7))


@query("correlation_bands", f"SELECT a, b, {_BAND.format(r='r')} AS band FROM ({_pairs_sql('TRUE')})")
def correlation_bands(t: Tables):
    return fidelity.pearson_pairs(t.lineitem, NUMBERS).select("a", "b", correlation_band("r").alias("band"))


def _cramer_sql(a: str, b: str) -> str:
    return f"""(WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS o FROM d GROUP BY ALL), rx AS (SELECT x, sum(o) AS rx FROM c GROUP BY x), cy AS (SELECT y, sum(o) AS cy FROM c GROUP BY y),
    g AS (SELECT coalesce(o, 0) AS o, rx * cy / (SELECT sum(o) FROM c) AS e FROM rx CROSS JOIN cy LEFT JOIN c USING (x, y)),
    k AS (SELECT (SELECT count(*) FROM rx) AS r, (SELECT count(*) FROM cy) AS k, (SELECT sum(o) FROM c)::DOUBLE AS n),
    s AS (SELECT sum(pow(abs(o - e) - CASE WHEN r = 2 AND k = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2 FROM g, k),
    v AS (SELECT n, greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS phi, r - (r - 1) * (r - 1) / (n - 1) AS rc, k - (k - 1) * (k - 1) / (n - 1) AS kc FROM s, k)
    SELECT '{a}' AS a, '{b}' AS b, CAST(n AS BIGINT) AS n, round(CASE WHEN least(rc, kc) > 1 THEN sqrt(phi / (least(rc, kc) - 1)) ELSE 0 END, 7) AS r FROM v)"""


@query(
    "cramers_v",
    "WITH d AS (SELECT l_returnflag, l_linenumber, l_linestatus, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS bulk, CASE WHEN l_discount > 0.05 AND l_quantity > 20 THEN 1 ELSE 0 END AS promo FROM lineitem) "
    + " UNION ALL ".join(
        _cramer_sql(a, b)
        for i, a in enumerate(["l_returnflag", "l_linenumber", "l_linestatus", "bulk", "promo"])
        for b in ["l_returnflag", "l_linenumber", "l_linestatus", "bulk", "promo"][i + 1 :]
    ),
)
def cramers_v(t: Tables):
    d = t.lineitem.withColumns(
        {"bulk": (F.col("l_quantity") > 25).cast("int"), "promo": ((F.col("l_discount") > 0.05) & (F.col("l_quantity") > 20)).cast("int")}
    )
    return fidelity.cramers_v(d, ["l_returnflag", "l_linenumber", "l_linestatus", "bulk", "promo"]).withColumn("r", rnd("r", 7))


# ---- over time ----------------------------------------------------------------------------------

_CLOCK = f"""WITH us AS (SELECT user_id, min(ts) AS intime FROM events GROUP BY user_id),
  ev AS (SELECT e.user_id, e.event_id, e.value, length(e.props) + e.event_id % 7 AS size, e.event_type, {hours_sql('e.ts', 'us.intime')} AS hours FROM events e JOIN us USING (user_id))"""


def _clocked(t: Tables):
    stays = t.events.groupBy("user_id").agg(F.min("ts").alias("intime"))
    e = t.events.withColumn("size", (F.length("props") + F.col("event_id") % 7).cast("double"))
    return grid.on_stay_clock(e, stays, ["user_id"], "ts")


_EVERY = 60


def _steps(e) -> int:
    """Whole windows up to the last hour of the table."""
    return (e.agg(F.max("hours")).first()[0] // _EVERY + 1) * _EVERY


def _temporal_sql(where: str) -> str:
    means = " UNION ALL ".join(f"SELECT user_id, '{c}' AS c, hours // {_EVERY} AS k, avg({c}) AS v FROM ev WHERE {where} GROUP BY ALL" for c in ("value", "size"))
    return f"""(WITH long AS ({means}),
    names AS (SELECT c, k, i * 10000 + k AS place, c || '_' || (k * {_EVERY}) || '-' || (k * {_EVERY} + {_EVERY} - 1) AS label
      FROM (VALUES (0, 'value'), (1, 'size')) t(i, c), range(0, (SELECT max(hours) // {_EVERY} + 1 FROM ev)) r(k)),
    met AS (SELECT x.c AS c, x.k AS k, y.c AS d, y.k AS m, count(*) AS n,
      CASE WHEN count(*) >= 2 THEN CASE WHEN min(x.v) = max(x.v) OR min(y.v) = max(y.v) THEN 0 ELSE corr(x.v, y.v) END END AS r FROM long x JOIN long y USING (user_id) GROUP BY ALL)
    SELECT a.label AS a, b.label AS b, coalesce(n, 0) AS n, r FROM names a JOIN names b ON a.place <= b.place
    LEFT JOIN met ON met.c = a.c AND met.k = a.k AND met.d = b.c AND met.m = b.k)"""


@query("temporal_corr", f"{_CLOCK} SELECT a, b, n, round(r, 6) AS r FROM {_temporal_sql('TRUE')}")
def temporal_corr(t: Tables):
    e = _clocked(t)
    return fidelity.temporal_correlation(e, "user_id", "hours", ["value", "size"], _EVERY, _steps(e)).withColumn("r", rnd("r"))


def _halves(t: Tables):
    e = _clocked(t)
    real, synth = e.filter("event_type < 'f'"), e.filter("event_type > 'f'")
    steps = _steps(e)
    return [fidelity.temporal_correlation(x, "user_id", "hours", ["value", "size"], _EVERY, steps) for x in (real, synth)]


_REAL, _SYNTH = _temporal_sql("event_type < 'f'"), _temporal_sql("event_type > 'f'")
_HALVES = f"x AS {_REAL}, y AS {_SYNTH}"


@query(
    "temporal_compare",
    f"""{_CLOCK}, {_HALVES} SELECT round(sum((sign(x.r) = sign(y.r))::INT * CASE WHEN a = b THEN 1 ELSE 2 END) / sum(CASE WHEN a = b THEN 1 ELSE 2 END), 7) AS sign_accuracy,
    round(sum(abs(x.r - y.r) * CASE WHEN a = b THEN 1 ELSE 2 END) / sum(CASE WHEN a = b THEN 1 ELSE 2 END), 6) AS mean_abs_diff FROM x JOIN y USING (a, b)""",
)
def temporal_compare(t: Tables):
    out = fidelity.temporal_compare(*_halves(t))
    return out.select(rnd("sign_accuracy", 7).alias("sign_accuracy"), rnd("mean_abs_diff").alias("mean_abs_diff"))


@query(
    "window_errors",
    f"""{_CLOCK}, {_HALVES} SELECT regexp_extract(a, '_(\\d+-\\d+)$', 1) AS "window", round(avg(abs(x.r - y.r)), 6) AS mad, round(stddev_pop(abs(x.r - y.r)), 6) AS mad_std,
    avg((sign(x.r) = sign(y.r))::INT) AS sign_accuracy FROM x JOIN y USING (a, b) WHERE a <> b AND regexp_extract(a, '_(\\d+-\\d+)$', 1) = regexp_extract(b, '_(\\d+-\\d+)$', 1) GROUP BY 1""",
)
def window_errors(t: Tables):
    out = fidelity.window_errors(*_halves(t))
    return out.select("window", rnd("mad").alias("mad"), rnd("mad_std").alias("mad_std"), "sign_accuracy")


_PEOPLE = """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step, o_totalprice, o_orderkey % 97 AS code FROM orders"""
_FLAT = f"""WITH s AS ({_PEOPLE}), f AS (SELECT * FROM s WHERE step < 4),
  g AS (SELECT o_custkey, unnest(range(0, 4)) AS step FROM (SELECT DISTINCT o_custkey FROM f)),
  i AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS i FROM (SELECT DISTINCT o_custkey FROM f)),
  x AS (SELECT i * 4 + step AS pos, coalesce(o_totalprice, 0) AS o_totalprice, coalesce(code, 0)::DOUBLE AS code FROM g JOIN i USING (o_custkey) LEFT JOIN f USING (o_custkey, step))"""


def _flat(t: Tables):
    s = grid.clip_pad(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4)
    s = s.select("o_custkey", "step", F.coalesce("o_totalprice", F.lit(0.0)).alias("o_totalprice"), F.coalesce(F.col("o_orderkey") % 97, F.lit(0)).cast("double").alias("code"))
    return fidelity.flat_positions(s, "o_custkey", "step", 4)


def _acf_sql(table: str, column: str, lag: int) -> str:
    return f"""SELECT '{column}' AS feature, {lag} AS lag, (SELECT sum((a.{column} - m) * (b.{column} - m)) FROM {table} a JOIN {table} b ON b.pos = a.pos + {lag}, (SELECT avg({column}) AS m FROM {table}))
    / (SELECT sum(({column} - m) * ({column} - m)) FROM {table}, (SELECT avg({column}) AS m FROM {table})) AS acf"""


_LAGS = (1, 12, 24, 29)
_SYNTHETIC = "y AS (SELECT pos, o_totalprice * (1 + pos % 3) AS o_totalprice, code + pos % 5 AS code FROM x)"
_ACF = (
    f"{_FLAT}, {_SYNTHETIC}, a AS ("
    + " UNION ALL ".join(_acf_sql("x", c, k) for c in ("o_totalprice", "code") for k in _LAGS)
    + "), b AS ("
    + " UNION ALL ".join(_acf_sql("y", c, k) for c in ("o_totalprice", "code") for k in _LAGS)
    + "), pair AS (SELECT feature, lag, a.acf AS acf_real, b.acf AS acf_synthetic, abs(a.acf - b.acf) AS abs_diff FROM a JOIN b USING (feature, lag))"
)


def _acf_tables(t: Tables):
    x = _flat(t)
    y = x.withColumns({"o_totalprice": F.col("o_totalprice") * (1 + F.col("pos") % 3), "code": F.col("code") + F.col("pos") % 5})
    return fidelity.acf_table(x, y, "pos", ["o_totalprice", "code"], _LAGS)


@query("acf_table", f"{_ACF} SELECT feature, lag, round(acf_real, 7) AS acf_real, round(acf_synthetic, 7) AS acf_synthetic, round(abs_diff, 7) AS abs_diff FROM pair")
def acf_table(t: Tables):
    return _acf_tables(t).withColumns({c: rnd(c, 7) for c in ("acf_real", "acf_synthetic", "abs_diff")})


@query(
    "acf_pivot",
    f"{_ACF} SELECT feature, " + ", ".join(f"round(max(abs_diff) FILTER (lag = {k}), 7) AS lag_{k}" for k in _LAGS) + " FROM pair GROUP BY feature",
)
def acf_pivot(t: Tables):
    wide = fidelity.acf_pivot(_acf_tables(t), "abs_diff", _LAGS)
    return wide.select("feature", *[rnd(f"`{k}`", 7).alias(f"lag_{k}") for k in _LAGS])


@query(
    "window_summary",
    f"""{_CLOCK}, {_HALVES}, e AS (SELECT regexp_extract(a, '_(\\d+-\\d+)$', 1) AS w, avg(abs(x.r - y.r)) AS mad, avg(CASE WHEN x.r IS NULL OR y.r IS NULL THEN 0 ELSE (sign(x.r) = sign(y.r))::INT END) AS s
      FROM x JOIN y USING (a, b) WHERE a <> b AND regexp_extract(a, '_(\\d+-\\d+)$', 1) = regexp_extract(b, '_(\\d+-\\d+)$', 1) GROUP BY 1)
    SELECT round(avg(mad), 6) AS mad_mean, round(stddev_pop(mad), 6) AS mad_std, round(avg(s), 6) AS sign_mean, round(stddev_pop(s), 6) AS sign_std FROM e""",
)
def window_summary(t: Tables):
    out = fidelity.window_summary(fidelity.window_errors(*_halves(t)))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query(
    "acf_rmse",
    f"{_FLAT}, y AS (SELECT pos, o_totalprice * (1 + pos % 3) AS o_totalprice FROM x), a AS ("
    + " UNION ALL ".join(_acf_sql("x", "o_totalprice", k) for k in range(5))
    + "), b AS ("
    + " UNION ALL ".join(_acf_sql("y", "o_totalprice", k) for k in range(5))
    + ") SELECT feature, round(sqrt(avg((a.acf - b.acf) * (a.acf - b.acf))), 7) AS rmse FROM a JOIN b USING (feature, lag) GROUP BY feature",
)
def acf_rmse(t: Tables):
    x = _flat(t).select("pos", "o_totalprice")
    y = x.withColumn("o_totalprice", F.col("o_totalprice") * (1 + F.col("pos") % 3))
    return fidelity.acf_rmse(x, y, "pos", ["o_totalprice"], 4).withColumn("rmse", rnd("rmse", 7))


@query(
    "lagged_correlation",
    f"""WITH s AS ({_PEOPLE}), a AS (SELECT o_totalprice AS x, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY step) AS y FROM s WHERE code < 50),
    b AS (SELECT o_totalprice AS x, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY step) AS y FROM s WHERE code >= 50)
    SELECT 'o_totalprice' AS feature, (SELECT round(corr(x, y), 7) FROM a) AS r_real, (SELECT round(corr(x, y), 7) FROM b) AS r_synthetic""",
)
def lagged_correlation(t: Tables):
    s = hour_index(t.orders.withColumn("code", F.col("o_orderkey") % 97), ["o_custkey"], ["o_orderdate", "o_orderkey"], "step")
    out = fidelity.lagged_correlation(s.filter("code < 50"), s.filter("code >= 50"), ["o_custkey"], "step", ["o_totalprice"])
    return out.select("feature", rnd("r_real", 7).alias("r_real"), rnd("r_synthetic", 7).alias("r_synthetic"))


@query(
    "trajectory",
    f"""{_CLOCK} SELECT event_type AS source, 'value' AS feature, hours, round(avg(value) + {NUDGE_SQL}, 6) AS mean, round(stddev_pop(value) + {NUDGE_SQL}, 6) AS std, min(value) AS min, max(value) AS max
    FROM ev GROUP BY event_type, hours""",
)
def trajectory(t: Tables):
    out = fidelity.trajectory(_clocked(t).withColumn("source", F.col("event_type")), "hours", ["value"])
    return out.withColumns({"mean": snap("mean"), "std": snap("std")})


@query(
    "count_share",
    "SELECT l_linestatus AS source, l_returnflag AS level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 8) AS share FROM lineitem GROUP BY l_linestatus, l_returnflag",
)
def count_share(t: Tables):
    return fidelity.count_share(t.lineitem.withColumn("source", F.col("l_linestatus")), "l_returnflag").withColumn("share", rnd("share", 8))


@query(
    "histogram",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    h AS (SELECT l_linestatus AS source, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n, any_value((hi - lo) / 20) AS w FROM lineitem, b GROUP BY ALL)
    SELECT source, 'l_extendedprice' AS feature, bin, n, round(n / (sum(n) OVER (PARTITION BY source) * w), 12) AS density FROM h""",
)
def histogram(t: Tables):
    out = fidelity.histogram(t.lineitem.withColumn("source", F.col("l_linestatus")), ["l_extendedprice"], 20, ["source"])
    return out.withColumn("density", rnd("density", 12))


@query(
    "ecdf",
    "SELECT DISTINCT l_linestatus AS source, 'l_quantity' AS feature, l_quantity AS value, round(cume_dist() OVER (PARTITION BY l_linestatus ORDER BY l_quantity), 9) AS ecdf FROM lineitem",
)
def ecdf(t: Tables):
    return fidelity.ecdf(t.lineitem.withColumn("source", F.col("l_linestatus")), ["l_quantity"], ["source"]).withColumn("ecdf", rnd("ecdf", 9))


@query(
    "box_by_group",
    """SELECT event_type, 'value' AS feature, count(*) AS n, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY event_type""",
)
def box_by_group(t: Tables):
    out = fidelity.box_statistics(t.events, ["value"], ["event_type"])
    return out.withColumns({c: rnd(c) for c in ("q1", "median", "q3")})


@query("outcome_rate", "SELECT l_linestatus AS source, l_linenumber AS level, round(avg((l_returnflag = 'R')::INT), 8) AS rate, count(*) AS n FROM lineitem GROUP BY ALL")
def outcome_rate(t: Tables):
    li = t.lineitem.withColumns({"source": F.col("l_linestatus"), "back": (F.col("l_returnflag") == "R").cast("int")})
    return fidelity.outcome_rate(li, "l_linenumber", "back").withColumn("rate", rnd("rate", 8))


@query(
    "confusion_counts",
    """WITH g AS (SELECT a.v AS actual, p.v AS predicted FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) p(v))
    SELECT actual, predicted, (SELECT count(*) FROM labels WHERE quality = actual AND toxic = predicted) AS n FROM g""",
)
def confusion_counts(t: Tables):
    return fidelity.confusion_counts(t.labels, "quality", "toxic", [0, 1])


# ---- vectors ------------------------------------------------------------------------------------

_VECTORS = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT * FROM e WHERE label < 5), y AS (SELECT * FROM e WHERE label >= 5)"""


def _kernel(a: str, b: str) -> str:
    return f"(SELECT avg(exp(-pow(list_distance(p.v, q.v), 2) / 2)) FROM {a} p, {b} q)"


@query("mmd", f"{_VECTORS} SELECT round({_kernel('x', 'x')} + {_kernel('y', 'y')} - 2 * {_kernel('x', 'y')}, 9) AS mmd")
def mmd(t: Tables):
    e = t.embeddings.select("label", F.col("embedding").alias("vector"))
    return neighbours.mmd(e.filter("label < 5"), e.filter("label >= 5")).select(rnd("mmd", 9).alias("mmd"))


@query(
    "moment_distance",
    f"""{_VECTORS}, m AS (SELECT label < 5 AS s, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL),
    c AS (SELECT label < 5 AS s, i, j, covar_samp(v[i], v[j]) AS c FROM e, range(1, 65) r(i), range(1, 65) q(j) GROUP BY ALL)
    SELECT round((SELECT avg(pow(a.m - b.m, 2)) FROM m a JOIN m b ON a.i = b.i AND a.s AND NOT b.s)
    + (SELECT avg(pow(a.c - b.c, 2)) FROM c a JOIN c b ON a.i = b.i AND a.j = b.j AND a.s AND NOT b.s), 12) AS moment_distance""",
)
def moment_distance(t: Tables):
    cols = [f"v{i}" for i in range(64)]
    e = t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return fidelity.moment_distance(e.filter("label < 5"), e.filter("label >= 5"), cols).select(rnd("moment_distance", 12).alias("moment_distance"))


@query(
    "group_distance",
    """WITH a AS (SELECT c_nationkey AS a, c_mktsegment AS b, min(c_acctbal) AS distance FROM customer GROUP BY ALL),
    b AS (SELECT c_nationkey AS a, c_mktsegment AS b, max(c_acctbal) AS distance FROM customer GROUP BY ALL)
    SELECT a, b, round(a.distance, 2) AS first, round(b.distance, 2) AS second, round(round(a.distance, 2) - round(b.distance, 2), 2) AS difference FROM a JOIN b USING (a, b)""",
)
def group_distance(t: Tables):
    by = t.customer.groupBy(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"))
    return fidelity.distance_difference(by.agg(F.min("c_acctbal").alias("distance")), by.agg(F.max("c_acctbal").alias("distance")), decimals=2)


# ---- top-k --------------------------------------------------------------------------------------


@query("top_pairs", f"SELECT a, b, round(abs(r), 7) AS strength FROM ({_pairs_sql('TRUE')}) ORDER BY abs(r) DESC, a, b LIMIT 3")
def top_pairs(t: Tables):
    return fidelity.top_pairs(fidelity.pearson_pairs(t.lineitem, NUMBERS), 3).select("a", "b", rnd("strength", 7).alias("strength"))


@query("pair_variables", f"SELECT DISTINCT unnest([a, b]) AS feature FROM (SELECT a, b FROM ({_pairs_sql('TRUE')}) ORDER BY abs(r), a, b LIMIT 1)")
def pair_variables(t: Tables):
    return fidelity.pair_variables(fidelity.pearson_pairs(t.lineitem, NUMBERS), 1, highest=False)
