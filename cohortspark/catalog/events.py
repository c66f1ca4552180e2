"""Hourly grids, interval events, time joins, types, outliers and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import NUDGE_SQL, Tables, query, rnd, snap
from cohortspark.catalog.roles import CLINICAL, events, hours_sql, items, stays
from cohortspark.functions import flags, times
from cohortspark.operators import filters, grid, impute, joins, rollup
from cohortspark.plans import episodes

TYPES = ["click", "error", "purchase", "signup", "view"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _user_stays(t: Tables):
    """One stay per user: first to last event."""
    return t.events.groupBy("user_id").agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))


_USER = "us AS (SELECT user_id, min(ts) AS intime, max(ts) AS outtime FROM events GROUP BY user_id)"
_CLOCK = f"WITH {_USER}, ev AS (SELECT e.*, {hours_sql('e.ts', 'us.intime')} AS hours FROM events e JOIN us USING (user_id))"


def _clocked(t: Tables):
    return grid.on_stay_clock(t.events, _user_stays(t), ["user_id"], "ts")


@query("stay_hours", f"{_CLOCK} SELECT event_id, hours, round((epoch_us(ev.ts) - epoch_us(us.intime)) / 3600000000.0::DOUBLE, 6) AS elapsed FROM ev JOIN us USING (user_id)")
def stay_hours(t: Tables):
    e = t.events.join(_user_stays(t), "user_id")
    return e.select("event_id", times.whole_hours("ts", "intime").alias("hours"), rnd(times.fractional_hours("ts", "intime")).alias("elapsed"))


@query(
    "hourly_pivot_mean",
    f"{_CLOCK} SELECT user_id, hours, " + ", ".join(f"round(avg(value) FILTER (event_type = '{v}'), 6) AS {v}" for v in TYPES) + " FROM ev GROUP BY user_id, hours",
)
def hourly_pivot_mean(t: Tables):
    wide = rollup.hourly_pivot_mean(_clocked(t), ["user_id"], "event_type", values=TYPES)
    return wide.select("user_id", "hours", *[rnd(v).alias(v) for v in TYPES])


@query("hourly_mean", f"{_CLOCK} SELECT user_id, event_type, hours, round(avg(value), 6) AS value FROM ev GROUP BY ALL")
def hourly_mean(t: Tables):
    return rollup.hourly_mean(_clocked(t), ["user_id"], "event_type").withColumn("value", rnd("value"))


@query("hourly_first", f"{_CLOCK} SELECT user_id, hours, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, hours ORDER BY ts, event_type) = 1")
def hourly_first(t: Tables):
    return rollup.hourly_first(_clocked(t), ["user_id"], value="event_type", order=["ts"])


@query(
    "pivot_last",
    "SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (event_type = '{v}') AS {v}" for v in TYPES) + " FROM events GROUP BY user_id",
)
def pivot_last(t: Tables):
    return rollup.pivot_last(t.events, ["user_id"], "event_type", "value", ["ts", "event_id"], TYPES)


@query(
    "events_by_label",
    """SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'look' ELSE 'act' END AS label, round(stddev_samp(value), 6) AS value FROM events
    WHERE event_type <> 'error' GROUP BY ALL""",
)
def events_by_label(t: Tables):
    mapping = t.spark.createDataFrame([("click", "look"), ("view", "look"), ("purchase", "act"), ("signup", "act")], "itemid string, new_label string")
    e = joins.relabel_items(t.events.select("user_id", "value", F.col("event_type").alias("itemid"), F.col("event_type").alias("label")), mapping)
    return rollup.by_label(e, ["user_id"], (), fn="std").withColumn("value", rnd("value"))


@query(
    "hourly_median",
    f"{_CLOCK} SELECT user_id, greatest(hours, 24) AS hours, round(median(value), 6) AS value FROM ev GROUP BY ALL",
)
def hourly_median(t: Tables):
    return rollup.by_hour(_clocked(t), ["user_id"], ["value"], floor=24).withColumn("value", rnd("value"))


# ---- intervals ----------------------------------------------------------------------------------

_SPANS = f"""{CLINICAL}, spans AS (SELECT e.stay_id, p_type AS label, amount, patientweight,
  {hours_sql('e.starttime', 's.intime')} AS start_hours, {hours_sql('e.endtime', 's.intime')} AS end_hours
  FROM events_ e JOIN stays s USING (stay_id) JOIN items USING (itemid))"""
_HOURS = "unnest(CASE WHEN end_hours >= greatest(start_hours, 0) THEN range(greatest(start_hours, 0), end_hours + 1) ELSE []::BIGINT[] END) AS hours"


def _spans(t: Tables):
    e = events(t).join(items(t).select("itemid", F.col("p_type").alias("label")), "itemid").drop("subject_id", "hadm_id")
    return grid.intervals_on_stay_clock(e, stays(t), ["stay_id"])


@query(
    "interval_explode_mean",
    f"""{_SPANS}, one AS (SELECT stay_id, label, start_hours, end_hours, avg(amount) AS amount FROM spans GROUP BY ALL),
    hourly AS (SELECT stay_id, label, amount, {_HOURS} FROM one)
    SELECT stay_id, hours, """
    + ", ".join(f"round(avg(amount) FILTER (label = '{v}') + {NUDGE_SQL}, 4) AS {v}" for v in PART_TYPES)
    + " FROM hourly GROUP BY stay_id, hours",
)
def interval_explode_mean(t: Tables):
    wide = rollup.interval_mean(_spans(t), ["stay_id"], "label", "amount", values=PART_TYPES)
    return wide.select("stay_id", "hours", *[snap(v, 4).alias(v) for v in PART_TYPES])


@query(
    "interval_explode_flag",
    f"""{_SPANS}, hourly AS (SELECT stay_id, label, {_HOURS} FROM spans)
    SELECT stay_id, hours, """
    + ", ".join(f"max(CASE WHEN label = '{v}' THEN 1 ELSE 0 END) AS proc_{v}" for v in PART_TYPES)
    + " FROM hourly GROUP BY stay_id, hours",
)
def interval_explode_flag(t: Tables):
    return rollup.interval_flag(_spans(t), ["stay_id"], "label", values=PART_TYPES)


@query(
    "interval_weight",
    f"""{_SPANS}, one AS (SELECT stay_id, label, start_hours, end_hours, avg(patientweight) AS w FROM spans GROUP BY ALL),
    hourly AS (SELECT stay_id, w, {_HOURS} FROM one), a AS (SELECT stay_id, hours, avg(w) AS w FROM hourly GROUP BY ALL),
    b AS (SELECT stay_id, start_hours AS hours, avg(amount / 1000) AS w FROM spans WHERE start_hours >= 0 GROUP BY ALL)
    SELECT stay_id, hours, round(avg(w) + {NUDGE_SQL}, 6) AS patientweight FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""",
)
def interval_weight(t: Tables):
    s = _spans(t)
    a = rollup.interval_weight(s, ["stay_id"])
    b = filters.non_negative_hours(s.withColumn("hours", F.col("start_hours"))).groupBy("stay_id", "hours").agg(F.avg(F.col("amount") / 1000).alias("patientweight"))
    return rollup.merge_weights([a, b], ["stay_id"]).withColumn("patientweight", snap("patientweight"))


@query(
    "containment_join",
    """WITH i AS (SELECT user_id, event_id AS interval_id, ts AS s, ts + to_hours(CAST(floor(value) AS BIGINT) % 72) AS e FROM events WHERE event_type = 'signup')
    SELECT p.event_id, i.interval_id FROM events p JOIN i ON p.user_id = i.user_id AND p.ts >= i.s AND p.ts <= i.e WHERE p.event_type = 'purchase'""",
)
def containment_join(t: Tables):
    e = t.events
    end = F.col("ts") + F.make_dt_interval(F.lit(0), (F.floor("value").cast("bigint") % 72).cast("int"))
    i = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("interval_id"), F.col("ts").alias("s"), end.alias("e"))
    p = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return joins.interval_join(p, i, ["user_id"], "ts", "s", "e").select("event_id", "interval_id")


@query(
    "episode_lookup",
    """WITH i AS (SELECT user_id, event_id AS op_id, ts AS s, ts + to_hours(CAST(floor(value) AS BIGINT) % 72) AS e FROM events WHERE event_type = 'signup'),
    r AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN event_id END AS op_id FROM events WHERE event_type <> 'signup')
    SELECT r.event_id, coalesce(r.op_id, min(i.op_id)) AS op_id FROM r LEFT JOIN i ON r.user_id = i.user_id AND r.ts BETWEEN i.s AND i.e GROUP BY r.event_id, r.op_id""",
)
def episode_lookup(t: Tables):
    e = t.events
    end = F.col("ts") + F.make_dt_interval(F.lit(0), (F.floor("value").cast("bigint") % 72).cast("int"))
    i = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("op_id"), F.col("ts").alias("s"), end.alias("e"))
    r = e.filter("event_type <> 'signup'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 == 0, F.col("event_id")).alias("op_id"))
    return joins.episode_lookup(r, i, "event_id", "user_id", "s", "e", "ts", "op_id").select("event_id", "op_id")


@query(
    "sample_timepoints",
    f"""WITH {_USER}, w AS (SELECT user_id, intime + to_hours(48) AS s, intime + to_hours(240) AS e FROM us),
    d AS (SELECT DISTINCT e.user_id, ts FROM events e JOIN w ON e.user_id = w.user_id AND ts >= w.s AND ts < w.e)
    SELECT user_id, epoch_us(ts) AS micros FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) <= 5""",
)
def sample_timepoints(t: Tables):
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    w = _user_stays(t).select("user_id", (F.col("intime") + hours(48)).alias("s"), (F.col("intime") + hours(240)).alias("e"))
    out = joins.sample_timepoints(t.events.select("user_id", "ts"), w, ["user_id"], ["user_id"], "ts", "s", "e", 5)
    return out.select("user_id", times.micros("ts").alias("micros"))


# ---- grid ---------------------------------------------------------------------------------------

_GRID = f"WITH {_USER}, grid AS (SELECT user_id, unnest(range(0, {hours_sql('outtime', 'intime')} + 1)) AS hours FROM us)"


@query("hour_grid", f"{_GRID} SELECT user_id, hours FROM grid")
def hour_grid(t: Tables):
    return grid.hour_grid(_user_stays(t), ["user_id"])


@query(
    "grid_assemble",
    f"""{_GRID}, ev AS (SELECT e.user_id, event_type, value, {hours_sql('e.ts', 'us.intime')} AS hours FROM events e JOIN us USING (user_id)),
    a AS (SELECT user_id, hours, avg(value) AS v FROM ev WHERE event_type = 'click' GROUP BY ALL),
    b AS (SELECT user_id, hours, max(value) AS v FROM ev WHERE event_type = 'view' GROUP BY ALL),
    c AS (SELECT user_id, hours, count(*) AS v FROM ev WHERE event_type = 'error' GROUP BY ALL)
    SELECT user_id, hours, round(a.v, 6) AS click, b.v AS view, c.v AS errors FROM grid LEFT JOIN a USING (user_id, hours)
    LEFT JOIN b USING (user_id, hours) LEFT JOIN c USING (user_id, hours)""",
)
def grid_assemble(t: Tables):
    e, on = _clocked(t), ["user_id", "hours"]
    a = e.filter("event_type = 'click'").groupBy(*on).agg(rnd(F.avg("value")).alias("click"))
    b = e.filter("event_type = 'view'").groupBy(*on).agg(F.max("value").alias("view"))
    c = e.filter("event_type = 'error'").groupBy(*on).agg(F.count(F.lit(1)).alias("errors"))
    return grid.assemble(grid.hour_grid(_user_stays(t), ["user_id"]), [a, b, c], on)


@query(
    "grid_assemble_long",
    f"""{_GRID}, ev AS (SELECT e.user_id, event_type, value, {hours_sql('e.ts', 'us.intime')} AS hours FROM events e JOIN us USING (user_id)),
    w AS (SELECT user_id, hours, """
    + ", ".join(f"round(avg(value) FILTER (event_type = '{v}'), 6) AS {v}" for v in TYPES)
    + " FROM ev GROUP BY ALL) SELECT * FROM grid LEFT JOIN w USING (user_id, hours)",
)
def grid_assemble_long(t: Tables):
    e = _clocked(t)
    parts = [e.filter(F.col("event_type") == v).select("user_id", "hours", F.lit(v).alias("feature"), "value") for v in TYPES]
    out = grid.assemble_long(grid.hour_grid(_user_stays(t), ["user_id"]), parts, ["user_id", "hours"], TYPES)
    return out.select("user_id", "hours", *[rnd(v).alias(v) for v in TYPES])


@query(
    "long_stays",
    f"{_GRID} SELECT user_id, hours FROM grid WHERE user_id IN (SELECT user_id FROM grid GROUP BY user_id HAVING max(hours) >= 700)",
)
def long_stays(t: Tables):
    return filters.stays_with_hours(grid.hour_grid(_user_stays(t), ["user_id"]), ["user_id"], 700)


@query(
    "short_stays",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) <= 65)",
)
def short_stays(t: Tables):
    return filters.stays_with_few_rows(t.events, ["user_id"], 65).select("event_id", "user_id")


@query(
    "clip_pad",
    """WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step FROM orders),
    k AS (SELECT DISTINCT o_custkey, unnest(range(0, 12)) AS step FROM orders)
    SELECT k.o_custkey, k.step, o_orderkey, o_totalprice FROM k LEFT JOIN n USING (o_custkey, step)""",
)
def clip_pad(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return grid.clip_pad(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 12).select("o_custkey", "step", "o_orderkey", "o_totalprice")


@query(
    "extend_hours",
    """WITH h AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) * 2 AS hours, o_totalprice AS v FROM orders),
    s AS (SELECT o_custkey, max(hours) AS m, count(*) AS n FROM h GROUP BY ALL)
    SELECT o_custkey, hours, v FROM h UNION ALL SELECT o_custkey, unnest(range(m + 1, m + 10 - n + 1)), NULL FROM s WHERE n < 10""",
)
def extend_hours(t: Tables):
    o = impute.hour_index(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "i")
    h = o.select("o_custkey", ((F.col("i") + 1) * 2).alias("hours"), F.col("o_totalprice").alias("v"))
    return grid.extend_hours(h, ["o_custkey"], 10)


@query(
    "repeat_static",
    "SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey",
)
def repeat_static(t: Tables):
    static = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return joins.repeat_static(static, t.orders.select("o_orderkey", "o_custkey"), "o_custkey")


@query(
    "static_join",
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent FROM orders GROUP BY 1)
    SELECT c_custkey AS subject_id, n, urgent FROM customer LEFT JOIN n ON c_custkey = n.o_custkey LEFT JOIN u ON c_custkey = u.o_custkey
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
)
def static_join(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "subject_id")
    n = o.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    u = o.groupBy("subject_id").agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    wide = joins.static_with_codes(t.customer.select(F.col("c_custkey").alias("subject_id")), [n, u], ["subject_id"])
    return joins.present_in(wide, o.filter("o_orderstatus = 'F'"), ["subject_id"])


@query(
    "observation_table",
    f"""WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, {", ".join(f"avg(value) FILTER (event_type = '{v}') AS {v}" for v in TYPES)} FROM events GROUP BY ALL)
    SELECT user_id, CAST(day AS VARCHAR) AS day, """
    + ", ".join(f"round(CASE WHEN {v} <= 200 THEN {v} END + {NUDGE_SQL}, 6) AS {v}, CASE WHEN {v} <= 200 THEN 1 ELSE 0 END AS {v}_mask" for v in TYPES)
    + " FROM w",
)
def observation_table(t: Tables):
    e = t.events.select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("item_name"), "value")
    out, _ = episodes.observations(e, ["user_id"], ["day"], thresholds={v: (0, 200) for v in TYPES}, fill=None)
    return out.withColumns({v: snap(v) for v in TYPES})


@query(
    "medication_presence",
    """WITH k AS (SELECT l_orderkey, p_type || '_' || l_returnflag AS a, CASE WHEN l_linenumber > 3 THEN p_brand || '_' || l_returnflag END AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
    n AS (SELECT name FROM (SELECT a AS name FROM k UNION ALL SELECT b FROM k) WHERE name IS NOT NULL GROUP BY name
      HAVING count(*) >= 0.02::DOUBLE * (SELECT count(a) + count(b) FROM k)),
    r AS (SELECT l_orderkey, min([coalesce(a, ''), coalesce(b, '')]) AS one FROM k WHERE a IN (SELECT name FROM n) OR b IN (SELECT name FROM n) GROUP BY 1)
    SELECT l_orderkey, count(*) AS flags FROM (SELECT DISTINCT l_orderkey, unnest(one) AS name FROM r) WHERE name <> '' GROUP BY 1""",
)
def medication_presence(t: Tables):
    k = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", F.col("p_type").alias("d1"), F.when(F.col("l_linenumber") > 3, F.col("p_brand")).alias("d2"), F.col("l_returnflag").alias("route")
    )
    wide = episodes.medication_flags(k, ["l_orderkey"], [], ["d1", "d2"], "route", 0.02)
    flags = F.array(F.lit(0), *[F.col(f"`{c}`") for c in wide.columns if c != "l_orderkey"])  # one long sum would not be compiled
    return wide.select("l_orderkey", F.aggregate(flags, F.lit(0), lambda a, x: a + x).cast("bigint").alias("flags"))


@query(
    "diagnosis_presence",
    """WITH n AS (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 0.04::DOUBLE * (SELECT count(*) FROM lineitem))
    SELECT l_orderkey, count(DISTINCT p_brand) AS codes FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM n) GROUP BY 1""",
)
def diagnosis_presence(t: Tables):
    k = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("icd10_cm"))
    wide = episodes.diagnosis_flags(k, ["l_orderkey"], [], min_share=0.04)
    total = sum((F.col(f"`{c}`") for c in wide.columns if c != "l_orderkey"), F.lit(0))
    return wide.select("l_orderkey", total.cast("bigint").alias("codes"))


# ---- types, outliers, masks ---------------------------------------------------------------------


@query(
    "type_inference",
    "WITH l AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS late FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CASE WHEN bool_and({c} IN (0, 1)) THEN 'Binary' WHEN bool_and({c} = floor({c})) AND count(DISTINCT {c}) <= 7
        THEN 'Categorical' ELSE 'Numerical' END AS feature_type FROM l"""
        for c in ("l_orderkey", "l_linenumber", "l_discount", "late", "l_quantity")
    )
    + " UNION ALL SELECT column_name, CASE WHEN column_type = 'VARCHAR' THEN 'Categorical' ELSE 'Other' END FROM (SELECT unnest(['l_returnflag', 'l_shipdate']) AS column_name,"
    " unnest([typeof(any_value(l_returnflag)), typeof(any_value(l_shipdate))]) AS column_type FROM l)",
)
def type_inference(t: Tables):
    li = t.lineitem.withColumn("late", (F.col("l_linestatus") == "F").cast("int"))
    return rollup.type_table(li, ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_shipdate", "late", "l_quantity"])


@query(
    "typed_aggregate",
    """SELECT l_orderkey, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS late, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS l_returnflag,
    round(avg(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY l_orderkey""",
)
def typed_aggregate(t: Tables):
    li = t.lineitem.withColumn("late", (F.col("l_linestatus") == "F").cast("int"))
    types = {"late": "Binary", "l_returnflag": "Categorical", "l_quantity": "Numerical"}
    return rollup.typed_aggregate(li, ["l_orderkey"], types, ["l_linenumber", "l_partkey", "l_suppkey"]).withColumn("l_quantity", rnd("l_quantity"))


@query(
    "stay_summary",
    f"""{_CLOCK}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev WHERE hours < 240 GROUP BY ALL),
    m AS (SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
    SELECT user_id, round(avg(value) + {NUDGE_SQL}, 6) AS value, any_value(m.event_type) AS event_type, max(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS flag
    FROM ev JOIN m USING (user_id) WHERE hours < 240 GROUP BY user_id""",
)
def stay_summary(t: Tables):
    e = _clocked(t).withColumn("flag", (F.col("value") > 200).cast("int"))
    return rollup.stay_summary(e, "user_id", ["value"], ["event_type"], ["flag"], 240).withColumn("value", snap("value"))


@query(
    "outlier_limits",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 AND l_quantity <= 45 THEN l_quantity END AS l_quantity,
    CASE WHEN l_discount >= 0.02 THEN l_discount END AS l_discount, CASE WHEN l_tax < 0.07 THEN l_tax END AS l_tax FROM lineitem""",
)
def outlier_limits(t: Tables):
    limits = {
        "l_quantity": {"lower_limit": 5, "upper_limit": 45, "include_upper": 1},
        "l_discount": {"lower_limit": 0.02, "include_lower": 1},
        "l_tax": {"upper_limit": 0.07},
    }
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return filters.null_outside_limits(li, limits)


@query(
    "outlier_percentile",
    """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END AS l_extendedprice FROM lineitem, b""",
)
def outlier_percentile(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return filters.null_outside_percentiles(li, ["l_extendedprice"])


@query(
    "percentile_bounds",
    "SELECT 'value' AS feature, round(quantile_cont(value, 0.001), 6) AS lower_bound, round(quantile_cont(value, 0.999), 6) AS upper_bound FROM events",
)
def percentile_bounds(t: Tables):
    return filters.percentile_bounds(t.events, ["value"]).select("feature", rnd("lower_bound").alias("lower_bound"), rnd("upper_bound").alias("upper_bound"))


@query(
    "mask_table",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 45 THEN 1 ELSE 0 END AS l_quantity_mask, CASE WHEN l_tax < 0.07 THEN 1 ELSE 0 END AS l_tax_mask FROM lineitem""",
)
def mask_table(t: Tables):
    li = filters.null_outside_limits(t.lineitem, {"l_quantity": {"upper_limit": 45, "include_upper": 1}, "l_tax": {"upper_limit": 0.07}})
    return flags.missing_mask(li, ["l_quantity", "l_tax"], ["l_orderkey", "l_linenumber"], "_mask")


@query(
    "threshold_outliers",
    """SELECT event_id, CASE WHEN value BETWEEN 1 AND 200 THEN value END AS value, CASE WHEN value BETWEEN 1 AND 200 THEN 1 ELSE 0 END AS value_mask FROM events""",
)
def threshold_outliers(t: Tables):
    masked = flags.add_masks(t.events.select("event_id", "value"), ["value"])
    return filters.outliers_to_missing(masked, {"value": (1, 200)})


@query(
    "any_observed",
    "SELECT event_id FROM events WHERE value <= 30 OR event_type = 'view'",
)
def any_observed(t: Tables):
    e = t.events.select("event_id", (F.col("value") <= 30).cast("int").alias("a"), (F.col("event_type") == "view").cast("int").alias("b"))
    return filters.any_observed(e, ["a", "b"]).select("event_id")


@query(
    "flag_family_fill",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS proc_a, 1 AS proc_Others FROM orders",
)
def flag_family_fill(t: Tables):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 1).alias("proc_a"))
    return flags.fill_flag_family(o, "proc_")


# ---- imputation ---------------------------------------------------------------------------------

_GAPS = """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 OR user_id % 10 = 0 THEN NULL ELSE value END AS v,
  CASE WHEN event_id % 3 = 1 OR user_id % 10 = 0 THEN NULL ELSE event_type END AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""
_UP = "OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DOWN = "OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_NEAR = f"""n AS (SELECT *, last_value(v IGNORE NULLS) {_UP} AS av, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) {_UP} AS ap,
  first_value(v IGNORE NULLS) {_DOWN} AS bv, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) {_DOWN} AS bp FROM g)"""
_LINEAR = "CASE WHEN v IS NOT NULL THEN v WHEN av IS NULL THEN bv WHEN bv IS NULL THEN av ELSE av + (bv - av) * (pos - ap) / (bp - ap) END"


def _gaps(t: Tables):
    gone = F.col("user_id") % 10 == 0
    return t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.to_date("ts").alias("day"),
        F.when(~((F.col("event_id") % 3 == 0) | gone), F.col("value")).alias("v"),
        F.when(~((F.col("event_id") % 3 == 1) | gone), F.col("event_type")).alias("k"),
    )


@query("impute_linear", f"{_GAPS}, {_NEAR} SELECT event_id, round(coalesce({_LINEAR}, (SELECT avg(v) FROM g)), 6) AS v FROM n")
def impute_linear(t: Tables):
    return impute.impute_linear(_gaps(t), ["user_id"], ["ts", "event_id"], ["v"], "mean", "day").select("event_id", rnd("v").alias("v"))


@query("impute_forward", f"{_GAPS}, {_NEAR} SELECT event_id, round(coalesce({_LINEAR}, (SELECT median(v) FROM g)), 6) AS v FROM n")
def impute_forward(t: Tables):
    return impute.impute_forward(_gaps(t), ["user_id"], ["ts", "event_id"], ["v"], "median").select("event_id", rnd("v").alias("v"))


@query(
    "impute_by_type",
    f"""{_GAPS}, {_NEAR}, m AS (SELECT user_id, avg(v) AS m FROM g GROUP BY user_id)
    SELECT event_id, round(coalesce(CASE WHEN av IS NULL THEN NULL ELSE {_LINEAR} END, m, (SELECT avg(v) FROM g)), 6) AS v, coalesce(k, 'NA') AS k FROM n JOIN m USING (user_id)""",
)
def impute_by_type(t: Tables):
    out = impute.impute_by_type(_gaps(t), ["user_id"], ["ts", "event_id"], {"v": "Numerical", "k": "Categorical"}, chunk="day")
    return out.select("event_id", rnd("v").alias("v"), "k")


@query(
    "impute_category",
    f"""{_GAPS}, mode AS (SELECT k FROM g WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)
    SELECT event_id, coalesce(last_value(k IGNORE NULLS) {_UP}, first_value(k IGNORE NULLS) {_DOWN}, (SELECT k FROM mode)) AS k FROM g""",
)
def impute_category(t: Tables):
    return impute.impute_category(_gaps(t), ["user_id"], ["ts", "event_id"], ["k"], "day").select("event_id", "k")


@query("forward_fill", f"{_GAPS} SELECT event_id, last_value(v IGNORE NULLS) {_UP} AS v FROM g")
def forward_fill(t: Tables):
    return impute.forward_fill(_gaps(t), ["user_id"], ["ts", "event_id"], ["v"]).select("event_id", "v")


@query(
    "midrank",
    "SELECT l_quantity, count(*) AS n, min(r) + (count(*) - 1) / 2.0::DOUBLE AS midrank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1",
)
def midrank(t: Tables):
    return impute.midrank(t.lineitem.select("l_quantity"), [], "l_quantity").select("l_quantity", "n", "midrank")
