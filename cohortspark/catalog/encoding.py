"""Encoding, normalisation, sampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.catalog.registry import Tables, query, rnd
from cohortspark.functions import flags
from cohortspark.operators import encode, sampling

FLAGS = ["A", "N", "R"]


@query(
    "onehot",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END AS flag_{v}" for v in FLAGS) + " FROM lineitem",
)
def onehot(t: Tables):
    return flags.one_hot(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", "flag")


@query("onehot_argmax", "SELECT l_orderkey, max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS r, CASE max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) WHEN 3 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS flag FROM lineitem GROUP BY l_orderkey")
def onehot_argmax(t: Tables):
    wide = flags.one_hot(t.lineitem.select("l_orderkey", "l_returnflag"), "l_returnflag", "f", FLAGS)
    top = wide.groupBy("l_orderkey").agg(*[F.max(f"f_{v}").alias(f"f_{v}") for v in FLAGS])
    flag = flags.first_maximum([f"f_{v}" for v in FLAGS], FLAGS)
    return top.select("l_orderkey", F.when(flag == "A", 3).when(flag == "N", 2).otherwise(1).alias("r"), flag.alias("flag"))


@query(
    "minmax",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo) * 2 - 1, 8) AS scaled, round(l_extendedprice, 4) AS back FROM lineitem, b""",
)
def minmax(t: Tables):
    lo, hi = encode.fit_min_max(t.lineitem, ["l_extendedprice"])["l_extendedprice"]
    scaled = encode.min_max(F.col("l_extendedprice"), lo, hi, (-1.0, 1.0))
    back = encode.min_max_inverse(scaled, lo, hi, (-1.0, 1.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", rnd(scaled, 8).alias("scaled"), rnd(back, 4).alias("back"))


@query(
    "standardize",
    """WITH b AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 7) AS z FROM lineitem, b""",
)
def standardize(t: Tables):
    m, s = encode.fit_standard(t.lineitem, ["l_quantity"])["l_quantity"]
    return t.lineitem.select("l_orderkey", "l_linenumber", rnd(encode.standardize(F.col("l_quantity"), m, s), 7).alias("z"))


_FIT = """c AS (SELECT feature, value, count(*) AS n FROM (SELECT 'l_quantity' AS feature, round_even(l_quantity, 2) AS value FROM lineitem
    UNION ALL SELECT 'l_extendedprice', round_even(l_extendedprice, 2) FROM lineitem) GROUP BY ALL),
  w AS (SELECT *, pow(1.0::DOUBLE + n / sum(n) OVER (PARTITION BY feature), 2.0) AS w FROM c),
  p AS (SELECT feature, value, n, (sum(w) OVER (PARTITION BY feature ORDER BY value) - w) / sum(w) OVER (PARTITION BY feature) AS lo,
    sum(w) OVER (PARTITION BY feature ORDER BY value) / sum(w) OVER (PARTITION BY feature) AS hi FROM w)"""
_NUMBERS = ["l_quantity", "l_extendedprice"]


@query("stochastic_fit", f"WITH {_FIT} SELECT feature, value, n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM p")
def stochastic_fit(t: Tables):
    p = encode.stochastic_fit(t.lineitem, _NUMBERS)
    return p.select("feature", "value", "n", rnd("lo").alias("lo"), rnd("hi").alias("hi"))


@query(
    "stochastic_inverse",
    f"""WITH {_FIT}, u AS (SELECT o_orderkey, ((o_orderkey * 7919) % 100003 + 0.5::DOUBLE) / 100003 AS u FROM orders)
    SELECT o_orderkey, value AS l_quantity FROM u JOIN p ON p.feature = 'l_quantity' AND u.u > p.lo AND u.u <= p.hi""",
)
def stochastic_inverse(t: Tables):
    p = encode.stochastic_fit(t.lineitem, ["l_quantity"])
    u = t.orders.select("o_orderkey", ((F.col("o_orderkey") * 7919 % 100003 + 0.5) / 100003).alias("l_quantity"))
    return encode.stochastic_inverse(u, p, ["l_quantity"])


_UNIFORM = "('0x' || substr(md5({name}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_LINES = ["l_orderkey", "l_linenumber"]


def _draw_sql(c: str, p: str) -> str:
    draw = _UNIFORM.format(name=f"'7:{c}:' || l_orderkey || ':' || l_linenumber")
    return f"round({p}.lo + {draw} * ({p}.hi - {p}.lo), 6) AS {c}"


@query(
    "stochastic_transform",
    f"""WITH {_FIT} SELECT l_orderkey, l_linenumber, {_draw_sql('l_quantity', 'a')}, {_draw_sql('l_extendedprice', 'b')} FROM lineitem
    JOIN p a ON a.feature = 'l_quantity' AND a.value = round_even(l_quantity, 2) JOIN p b ON b.feature = 'l_extendedprice' AND b.value = round_even(l_extendedprice, 2)""",
)
def stochastic_transform(t: Tables):
    p = encode.stochastic_fit(t.lineitem, _NUMBERS)
    out = encode.stochastic_transform(t.lineitem.select(*_LINES, *_NUMBERS), p, _NUMBERS, 7, keys=_LINES)
    return out.select(*_LINES, *[rnd(c).alias(c) for c in _NUMBERS])


@query(
    "stochastic_roundtrip",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity, 2) AS l_quantity, round_even(l_extendedprice, 2) AS l_extendedprice FROM lineitem",
)
def stochastic_roundtrip(t: Tables):
    p = encode.stochastic_fit(t.lineitem, _NUMBERS)
    u = encode.stochastic_transform(t.lineitem.select(*_LINES, *_NUMBERS), p, _NUMBERS, 7, unseen=False, keys=_LINES)
    return encode.stochastic_inverse(u, p, _NUMBERS)


@query(
    "nearest_known",
    f"""WITH {_FIT.replace("FROM lineitem", "FROM lineitem WHERE l_linestatus = 'O'")}, k AS (SELECT value FROM p WHERE feature = 'l_extendedprice'),
    u AS (SELECT DISTINCT round_even(l_extendedprice, 2) AS value FROM lineitem WHERE l_linestatus = 'F'), f AS (SELECT value FROM u EXCEPT SELECT value FROM k),
    j AS (SELECT f.value, l.value AS l FROM f ASOF LEFT JOIN k l ON f.value >= l.value),
    r AS (SELECT j.value, j.l, k2.value AS r FROM j ASOF LEFT JOIN k k2 ON j.value <= k2.value)
    SELECT 'l_extendedprice' AS feature, value, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN abs(value - r) < abs(value - l) THEN r ELSE l END AS known FROM r""",
)
def nearest_known(t: Tables):
    p = encode.stochastic_fit(t.lineitem.filter("l_linestatus = 'O'"), ["l_extendedprice"])
    fresh = t.lineitem.filter("l_linestatus = 'F'").select(F.lit("l_extendedprice").alias("feature"), F.bround("l_extendedprice", 2).alias("value"))
    return encode.nearest_known(fresh, p)


_KINDS = {"l_quantity": "Numerical", "l_returnflag": "Categorical", "l_linestatus": "Binary", "flag_a": "Listwise", "flag_b": "Listwise"}


def _encoder(t: Tables):
    li = t.lineitem.withColumns({"flag_a": (F.col("l_linenumber") == 1).cast("int"), "flag_b": (F.col("l_linenumber") > 5).cast("int")})
    return li, encode.Encoder.fit(li, _KINDS, families=("flag_",))


@query(
    "encode_table",
    """WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 8) AS e1, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END::DOUBLE AS e2,
    CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS e3, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS e4,
    CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS e5, CASE WHEN l_linenumber > 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS e6 FROM lineitem, b""",
)
def encode_table(t: Tables):
    li, enc = _encoder(t)
    out = enc.transform(li, ["l_orderkey", "l_linenumber"])
    cells = [F.element_at("encoded", i) for i in range(1, 7)]
    return out.select("l_orderkey", "l_linenumber", rnd(cells[0], 8).alias("e1"), *[c.alias(f"e{i + 1}") for i, c in enumerate(cells) if i])


@query(
    "decode_table",
    """SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, CASE l_returnflag WHEN 'A' THEN 'N' ELSE l_returnflag END AS l_returnflag, l_linestatus,
    CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS flag_a, CASE WHEN l_linenumber > 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS flag_b FROM lineitem""",
)
def decode_table(t: Tables):
    """The dropped first level decodes to the first kept one, as the maximum of an all-zero block."""
    li, enc = _encoder(t)
    out = enc.inverse(enc.transform(li, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", rnd("l_quantity").alias("l_quantity"), "l_returnflag", "l_linestatus", "flag_a", "flag_b")


@query(
    "evaluation_encoder",
    """WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS r FROM lineitem),
    m AS (SELECT avg(q) AS m FROM f), s AS (SELECT m, sqrt(sum((coalesce(q, m) - m) * (coalesce(q, m) - m)) / count(*)) AS s FROM f, m GROUP BY m),
    k AS (SELECT r AS mode FROM f WHERE r IS NOT NULL GROUP BY r ORDER BY count(*) DESC, r LIMIT 1)
    SELECT l_orderkey, l_linenumber, round((coalesce(q, m) - m) / s, 7) AS q, """
    + ", ".join(f"CASE WHEN coalesce(r, mode) = '{v}' THEN 1 ELSE 0 END AS r_{v}" for v in FLAGS)
    + " FROM f, s, k",
)
def evaluation_encoder(t: Tables):
    li = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag")).alias("r"),
    )
    enc = encode.EvaluationEncoder.fit(li, ["q"], ["r"])
    return enc.apply(li, ["l_orderkey", "l_linenumber"]).withColumn("q", rnd("q", 7))


# All 64 coordinates: 15 blocks of four levels and four flags.
_LEVEL_BLOCKS = 15


def _block_sql(i: int) -> tuple[str, str]:
    """(index of the first maximum, share of the first level) of a block of four."""
    cells = [f"a[{4 * i + k}]" for k in range(1, 5)]
    return (
        f"CASE greatest({', '.join(cells)}) WHEN {cells[0]} THEN '0' WHEN {cells[1]} THEN '1' WHEN {cells[2]} THEN '2' ELSE '3' END",
        f"exp({cells[0]}) / ({' + '.join(f'exp({c})' for c in cells)})",
    )


@query(
    "logit_decode",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)
    SELECT vec_id, {' || '.join(_block_sql(i)[0] for i in range(_LEVEL_BLOCKS))} AS levels,
    round({' + '.join(_block_sql(i)[1] for i in range(_LEVEL_BLOCKS))}, 7) AS first_shares,
    {' || '.join(f"CASE WHEN 1 / (1 + exp(-a[{k}])) >= 0.5 THEN '1' ELSE '0' END" for k in range(61, 65))} AS flags FROM e""",
)
def logit_decode(t: Tables):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    kinds = [(4, "softmax", None)] * _LEVEL_BLOCKS + [(1, "sigmoid", 0.5)] * 4
    d = v.select("vec_id", flags.activate_blocks("a", kinds).alias("d"))
    block = flags.split_blocks("d", [w for w, _, _ in kinds])
    shares = sum((F.element_at(b, 1) for b in block[1:_LEVEL_BLOCKS]), F.element_at(block[0], 1))
    return d.select(
        "vec_id",
        F.concat(*[flags.block_argmax(b).cast("string") for b in block[:_LEVEL_BLOCKS]]).alias("levels"),
        rnd(shares, 7).alias("first_shares"),
        F.concat(*[F.element_at(b, 1).cast("int").cast("string") for b in block[_LEVEL_BLOCKS:]]).alias("flags"),
    )


# ---- sampling -----------------------------------------------------------------------------------

_HASH = "md5('{seed}:' || {id})"


def _h(column: str, seed: int) -> str:
    return _HASH.format(id=column, seed=seed)


@query(
    "patient_split",
    f"""WITH p AS (SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS label FROM orders GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h('o_custkey', 11)}, o_custkey) AS rank, count(*) OVER (PARTITION BY label) AS n FROM p),
    k AS (SELECT *, floor(0.7::DOUBLE * n) AS tr, floor(0.2::DOUBLE * floor(0.7::DOUBLE * n)) AS va, floor(0.3::DOUBLE * n) AS te FROM r)
    SELECT o_orderkey, CASE WHEN rank <= tr - va THEN 'train' WHEN rank <= tr THEN 'val' WHEN rank <= tr + te THEN 'test' END AS split
    FROM orders JOIN k USING (o_custkey)""",
)
def patient_split(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return sampling.patient_split(o, "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"], 0.7, 0.3, None, 11).select("o_orderkey", "split")


@query(
    "patient_sample",
    f"""WITH p AS (SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS label FROM orders GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h('o_custkey', 5)}, o_custkey) AS rank, count(*) OVER (PARTITION BY label) AS n FROM p)
    SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM r WHERE rank <= floor(0.4::DOUBLE * n))""",
)
def patient_sample(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return sampling.patient_sample(o, "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"], 0.4, 5).select("o_orderkey")


@query(
    "holdout_split",
    f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_h('c_custkey', 3)}, c_custkey) AS rank, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, CASE WHEN rank <= n - ceil(0.5::DOUBLE * n) THEN 'train' ELSE 'holdout' END AS part FROM r""",
)
def holdout_split(t: Tables):
    return sampling.holdout_split(t.customer.select("c_custkey"), "c_custkey", 0.5, 3)


@query(
    "stratified_folds",
    f"SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_h('c_custkey', 9)}, c_custkey) - 1) % 5 AS INT) AS fold FROM customer",
)
def stratified_folds(t: Tables):
    return sampling.stratified_folds(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5, 9)


@query(
    "stratified_rows",
    f"""WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_h('c_custkey', 4)}, c_custkey) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_custkey, CASE WHEN rank <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def stratified_rows(t: Tables):
    return sampling.stratified_rows(t.customer, "c_custkey", "c_mktsegment", 0.8, 4).select("c_custkey", "part")


_LABELS = """real AS (SELECT doc_id, quality FROM labels WHERE toxic = 1), synth AS (SELECT doc_id, quality FROM labels WHERE toxic = 0),
  c AS (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS t FROM real GROUP BY 1)"""


@query(
    "match_class_shares",
    f"""WITH {_LABELS}, q AS (SELECT quality, CAST(round_even(n / t * floor(1.0::DOUBLE * t), 0) AS BIGINT) AS quota FROM c),
    r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', 6)}, doc_id) AS rank FROM synth)
    SELECT doc_id, r.quality FROM r JOIN q USING (quality) WHERE rank <= quota""",
)
def match_class_shares(t: Tables):
    l = t.labels.select("doc_id", "quality", "toxic")
    return sampling.match_class_shares(l.filter("toxic = 1"), l.filter("toxic = 0"), "quality", "doc_id", 6).select("doc_id", "quality")


@query(
    "incremental_sample",
    f"""WITH {_LABELS}, rates AS (SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS rate),
    q AS (SELECT quality, rate, CAST(round_even(n / t * floor(rate * t), 0) AS BIGINT) AS quota FROM c, rates),
    m AS (SELECT quality, unnest(range(1, max(quota) + 1)) AS draw FROM q GROUP BY quality),
    s AS (SELECT quality, count(*) AS size FROM synth GROUP BY 1),
    pool AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', 42)}, doc_id) AS rank FROM synth),
    d AS (SELECT quality, draw, ('0x' || substr(md5('draw 42 ' || quality || ':' || draw), 1, 13))::BIGINT % size + 1 AS rank FROM m JOIN s USING (quality))
    SELECT rate, d.quality, draw, doc_id FROM d JOIN pool USING (quality, rank) JOIN q USING (quality) WHERE draw <= quota""",
)
def incremental_sample(t: Tables):
    l = t.labels.select("doc_id", "quality", "toxic")
    out = sampling.incremental_samples(l.filter("toxic = 1"), l.filter("toxic = 0"), "quality", "doc_id", [0.1, 0.25, 0.5])
    return out.select("rate", "quality", "draw", "doc_id")


@query(
    "downsample",
    f"""SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {_h('o_orderkey', 8)}, o_orderkey) <= (SELECT count(*) FROM customer)""",
)
def downsample(t: Tables):
    return sampling.downsample_to(t.orders.select("o_orderkey"), "o_orderkey", t.customer, 8)


@query("repeat_conditions", "SELECT c_custkey, unnest(range(1, 4)) AS copy FROM customer")
def repeat_conditions(t: Tables):
    return sampling.repeat_rows(t.customer.select("c_custkey"), 3)


@query(
    "bootstrap_padding",
    f"""WITH pat AS (SELECT c_custkey AS pattern, c_nationkey % 5 + 1 AS length, row_number() OVER (ORDER BY {_h('c_custkey', 2)}, c_custkey) AS rank, count(*) OVER () AS n FROM customer),
    s AS (SELECT l_orderkey, l_linenumber - 1 AS step, l_quantity, l_partkey FROM lineitem),
    k AS (SELECT l_orderkey, length FROM (SELECT DISTINCT l_orderkey, ('0x' || substr(md5('draw 2:' || l_orderkey), 1, 13))::BIGINT % (SELECT count(*) FROM customer) + 1 AS rank FROM s) JOIN pat USING (rank))
    SELECT l_orderkey, step, l_partkey, CASE WHEN step < length THEN l_quantity END AS l_quantity FROM s JOIN k USING (l_orderkey)""",
)
def bootstrap_padding(t: Tables):
    s = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("step"), "l_partkey", "l_quantity")
    p = t.customer.select(F.col("c_custkey").alias("pattern"), (F.col("c_nationkey") % 5 + 1).alias("length"))
    return sampling.bootstrap_padding(s, p, "l_orderkey", "step", ["l_quantity"], seed=2).select("l_orderkey", "step", "l_partkey", "l_quantity")


def _made(c: str, i: str) -> str:
    """The interval of one drawn feature, none where it is missing by the rate of its condition."""
    missing, value = (_UNIFORM.format(name=f"'3:{what}:{c}:' || l_orderkey || ':' || l_linenumber") for what in ("missing", "value"))
    return f"""JOIN rates r{i} ON r{i}.l_returnflag = w.l_returnflag AND r{i}.feature = '{c}'
      LEFT JOIN ends {i} ON {i}.l_returnflag = w.l_returnflag AND {i}.feature = '{c}' AND {missing} >= r{i}.rate AND {value} > {i}.lo AND {value} <= {i}.hi"""


# A tenth of the quantities is missing; flags and states are the conditions and a category.
_GENERATE = f"""WITH src AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN l_quantity END AS l_quantity,
    l_extendedprice, list_position(['F', 'O'], l_linestatus)::DOUBLE AS l_linestatus FROM lineitem),
  long AS (SELECT l_returnflag, 'l_quantity' AS feature, l_quantity AS v FROM src UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM src
    UNION ALL SELECT l_returnflag, 'l_linestatus', l_linestatus FROM src),
  rates AS (SELECT l_returnflag, feature, avg((v IS NULL)::INT) AS rate FROM long GROUP BY ALL),
  c AS (SELECT l_returnflag, feature, round_even(v, 2) AS value, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
  x AS (SELECT *, pow(1.0::DOUBLE + n / sum(n) OVER (PARTITION BY l_returnflag, feature), 2.0) AS w FROM c),
  upper AS (SELECT l_returnflag, feature, value, sum(w) OVER (PARTITION BY l_returnflag, feature ORDER BY value) / sum(w) OVER (PARTITION BY l_returnflag, feature) AS hi FROM x),
  ends AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY l_returnflag, feature ORDER BY value), -1) AS lo FROM upper),
  w AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem)
  SELECT w.l_orderkey, w.l_linenumber, w.l_returnflag, a.value AS l_quantity, b.value AS l_extendedprice, ['F', 'O'][c.value::INT] AS l_linestatus
  FROM w {_made('l_quantity', 'a')} {_made('l_extendedprice', 'b')} {_made('l_linestatus', 'c')}"""


@query("generate_rows", _GENERATE)
def generate_rows(t: Tables):
    quantity = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 != 0, F.col("l_quantity")).alias("l_quantity")
    li = t.lineitem.select(*_LINES, "l_returnflag", quantity, "l_extendedprice", "l_linestatus")
    wanted = li.select(*_LINES, "l_returnflag")
    return sampling.generate_rows(li, wanted, ["l_returnflag"], ["l_quantity", "l_extendedprice"], ["l_linestatus"], 1, 3, _LINES)


@query("score_batches", "SELECT doc_id, CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents")
def score_batches(t: Tables):
    def model(batch):
        return batch[["doc_id"]].assign(score=(batch["n_chars"] > 500).astype(float))

    return sampling.score_batches(t.documents.select("doc_id", "n_chars"), model, "doc_id bigint, score double")
