"""Fit, transform and inverse of mixed-type encodings; fitted state is small frames and dicts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.functions.flags import apply_masks, block_argmax, levels_of, pick_level
from cohortspark.operators.filters import unpivot
from cohortspark.operators.impute import nearest_observed, overall_mode
from cohortspark.operators.joins import spread_join
from cohortspark.operators.ordered import hash_number, portable_hash, running_sum
from cohortspark.session import settled

DECIMALS = 2
TEMPERATURE = 0.5


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---- stochastic normalisation -------------------------------------------------------------------


def stochastic_fit(
    df: DataFrame,
    columns: Sequence[str],
    temperature: float = TEMPERATURE,
    decimals: int = DECIMALS,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, feature, value, n, lo, hi): disjoint intervals of [0, 1], one per distinct rounded value, in value order.

    The width of an interval is proportional to (1 + share) ** (1 / temperature).
    """
    group = [*by, "feature"]
    long = unpivot(df, columns, by)
    counts = long.groupBy(*group, F.bround("value", decimals).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_N"))
    weighed = counts.join(totals, group).withColumn(
        "w", F.pow(F.lit(1.0) + F.col("n") / F.col("_N"), F.lit(1.0 / temperature))
    )
    sums = running_sum(weighed.drop("_N"), group, ["value"], ["w"])
    return sums.select(
        *group,
        "value",
        "n",
        (F.col("w_before") / F.col("w_total")).alias("lo"),
        ((F.col("w_before") + F.col("w")) / F.col("w_total")).alias("hi"),
    )


def nearest_known(values: DataFrame, params: DataFrame) -> DataFrame:
    """Map each distinct (feature, value) to the nearest fitted value, the lower one on ties."""
    known = params.select("feature", "value", F.col("value").alias("k"))
    fresh = values.select("feature", "value").distinct().join(params, ["feature", "value"], "left_anti")
    both = known.unionByName(fresh, allowMissingColumns=True)
    near = nearest_observed(both, ["feature"], ["value"], ["k"])
    left, right, v = F.col("_p0")["x"], F.col("_n0")["x"], F.col("value")
    nearest = F.when(left.isNull(), right).when(right.isNull(), left)
    nearest = nearest.when(F.abs(v - right) < F.abs(v - left), right).otherwise(left)
    return near.filter(F.col("k").isNull()).select("feature", "value", nearest.alias("known"))


def named_rows(df: DataFrame, keys: Sequence[str] | None) -> DataFrame:
    """``df``, settled, with ``_row``, a number that tells rows apart, and ``_name``, which draws follow: the ``keys`` as
    text (rows with equal keys have equal draws), or the number without keys."""
    rows = settled(df.withColumn("_row", F.monotonically_increasing_id()))
    if keys:
        name = F.concat_ws(":", *[F.coalesce(_q(c).cast("string"), F.lit("")) for c in keys])
    else:
        name = F.col("_row").cast("string")
    return rows.withColumn("_name", name)


def uniform(name: Column, seed: int) -> Column:
    """Draw from [0, 1) that any SQL engine can repeat: the first 52 bits of ``md5(seed || ':' || name)``."""
    return hash_number(portable_hash(name, seed)).cast("double") / F.lit(float(1 << 52))


def _back(rows: DataFrame, long: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` from the long form (_row, feature, value); what is not there is null."""
    wide = long.groupBy("_row").agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in columns])
    return rows.drop(*columns, "_name").join(wide, "_row", "left").select(*[_q(c) for c in names])


def stochastic_transform(
    df: DataFrame,
    params: DataFrame,
    columns: Sequence[str],
    seed: int = 0,
    decimals: int = DECIMALS,
    unseen: bool = True,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Each value becomes a uniform draw inside the interval of its rounded value; null stays null.

    The draw of a value follows the seed, the column and the row's ``keys`` (the row's place if not given).
    Unseen values use the nearest fitted value; they are resolved once per distinct value.  All columns meet their
    intervals in one join over the long form, in which values of many rows are broadcast and the rest is shuffled.
    """
    rows = named_rows(df, keys)
    long = unpivot(rows, columns, ["_row", "_name"]).withColumn("value", F.bround("value", decimals))
    counts = settled(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n")))
    params = settled(params.select("feature", "value", "lo", "hi"))
    lookup = counts.join(params, ["feature", "value"])
    if unseen:
        known = nearest_known(counts, params)
        near = known.join(params.withColumnRenamed("value", "known"), ["feature", "known"]).select("feature", "value", "lo", "hi")
        lookup = lookup.unionByName(counts.join(near, ["feature", "value"]))
    met = spread_join(long, settled(lookup), ["feature", "value"], "_n")
    draw = uniform(F.concat_ws(":", "feature", "_name"), seed)
    drawn = met.select("_row", "feature", (F.col("lo") + draw * (F.col("hi") - F.col("lo"))).alias("value"))
    return _back(rows, drawn, columns, df.columns)


def next_interval(draws: DataFrame, params: DataFrame, group: Sequence[str]) -> DataFrame:
    """(_row, feature, value): for each draw (group, _row, u) the value of the first interval whose upper end is at least u.

    Intervals and draws are dealt together by ranges of (group, place), the highest place first, and each range is
    read in one pass that carries the last interval along.  What is carried over the border of two ranges is
    found from one row of each range, which pass the driver.  Draws above the last end, or NaN, have no value.
    """
    texts = [_q(c).cast("string") for c in group]
    parts = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    name = F.concat(*parts).alias("_g")  # one text for each group, whatever is in its columns
    place = F.col("u").cast("double").alias("_p")
    asked = draws.select(name, place, F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("value"), "_row", "feature")
    nobody = F.lit(None).cast("bigint")
    given = params.select(name, F.col("hi").alias("_p"), F.lit(0).alias("_kind"), "value", nobody.alias("_row"), "feature")
    order = [F.col("_g"), F.col("_p").desc(), F.col("_kind"), F.col("_row")]
    dealt = given.unionByName(asked).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = settled(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop("_p"))
    ends = dealt.groupBy("_part").agg(
        F.min_by("_g", "_at").alias("first"),
        F.max_by("_g", "_at").alias("last"),
        F.max_by(F.struct("_g", "value"), F.when(F.col("_kind") == 0, F.col("_at"))).alias("interval"),
    )
    carried: dict[int, float | None] = {}
    before, end = None, None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row for each range
        came = end if before is not None and before == r["first"] else None
        carried[r["_part"]] = came
        if r["interval"] is not None and r["interval"]["_g"] == r["last"]:
            end = r["interval"]["value"]
        elif r["first"] != r["last"]:
            end = None
        else:
            end = came
        before = r["last"]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = last = None
        for batch in batches:
            if not len(batch):
                continue
            g, kind, value = (batch[c].to_numpy() for c in ("_g", "_kind", "value"))
            if group is None:
                group, last = g[0], carried.get(batch["_part"].iloc[0])
            at = np.arange(len(batch))
            change = np.zeros(len(batch), bool)
            change[0] = g[0] != group
            if g[0] != g[-1]:  # sorted, so most batches hold one group
                change[1:] = g[1:] != g[:-1]
            start = np.maximum.accumulate(np.where(change, at, 0))
            seen = np.maximum.accumulate(np.where(kind == 0, at, -1))
            own = seen >= start
            out = np.where(own, value[np.maximum(seen, 0)], np.nan)
            here = own.copy()
            if last is not None:
                head = ~own & ~np.logical_or.accumulate(change)
                out[head], here[head] = last, True
            group, last = g[-1], (out[-1] if here[-1] else None)
            asked = kind == 1
            found = np.where(here[asked], out[asked], np.nan)  # NaN leaves as null
            yield pd.DataFrame({"_row": batch["_row"].to_numpy()[asked].astype(np.int64), "feature": batch["feature"].to_numpy()[asked], "value": found})

    return dealt.mapInPandas(fill, "_row bigint, feature string, value double")


def stochastic_inverse(df: DataFrame, params: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Value of the first interval whose upper end is at least u; above the last end the result is null.

    All columns are looked up in one sorted pass.
    """
    rows = named_rows(df, None)
    group = [*by, "feature"]
    long = unpivot(rows, columns, ["_row", *by]).withColumnRenamed("value", "u")
    found = next_interval(long, params.select(*group, "value", "hi"), group)
    return _back(rows, found, columns, df.columns)


# ---- scaling ------------------------------------------------------------------------------------


def fit_min_max(df: DataFrame, columns: Sequence[str], supplied: Mapping[str, tuple[float, float]] | None = None) -> dict:
    todo = [c for c in columns if not supplied or c not in supplied]
    out = {c: tuple(supplied[c]) for c in columns if supplied and c in supplied}
    if todo:
        aggs = [f(_q(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(todo) for k, f in (("a", F.min), ("b", F.max))]
        row = df.agg(*aggs).first()
        out.update({c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(todo)})
    return {c: out[c] for c in columns}


def min_max(c: Column, low: float, high: float, span: tuple[float, float] = (0.0, 1.0)) -> Column:
    a, b = span
    width = F.nullif(F.lit(float(high - low)) if low is not None else F.lit(None).cast("double"), F.lit(0.0))
    return (c - F.lit(low)) / width * (b - a) + a


def min_max_inverse(c: Column, low: float, high: float, span: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Inverse, clamped to the range; null stays null."""
    a, b = span
    clamped = F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(a))), F.lit(float(b))))
    return (clamped - a) / (b - a) * (high - low) + low


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict:
    aggs = [f(_q(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def standardize(c: Column, mean: float, std: float) -> Column:
    return (c - F.lit(mean)) / F.nullif(F.lit(std), F.lit(0.0))


def standardize_inverse(c: Column, mean: float, std: float) -> Column:
    return c * F.lit(std) + F.lit(mean)


# ---- categories ---------------------------------------------------------------------------------


def one_hot_array(c: Column, levels: Sequence, drop_first: bool = False) -> Column:
    """0/1 vector over the levels; an unknown level is all zero, null is all null."""
    names = list(levels)[1:] if drop_first and len(levels) > 1 else list(levels)
    return F.array(*[F.when(c.isNotNull(), (c == F.lit(v)).cast("double")) for v in names])


def binary_array(c: Column, levels: Sequence) -> Column:
    """One column: 1 for the second of two levels (or for the only level)."""
    hit = levels[1] if len(levels) > 1 else levels[0]
    return F.array(F.when(c.isNotNull(), (c == F.lit(hit)).cast("double")))


def category_from_array(a: Column, levels: Sequence, drop_first: bool = False) -> Column:
    """Level of the first maximum; null when any part is null."""
    names = list(levels)[1:] if drop_first and len(levels) > 1 else list(levels)
    return pick_level(names, block_argmax(a) + 1)


def binary_from_array(a: Column, levels: Sequence) -> Column:
    """Second level when the value is at least 0.5 of the way, else the first; null stays null."""
    x = F.element_at(a, 1)
    if len(levels) == 1:
        return F.when(x.isNotNull(), F.lit(levels[0]))
    return F.when(x > 0.5, F.lit(levels[1])).when(x.isNotNull(), F.lit(levels[0]))


# ---- whole tables -------------------------------------------------------------------------------


@dataclass
class Block:
    """One encoded block: a column, or a prefix family of flag columns."""

    column: str
    kind: str
    width: int
    levels: list = field(default_factory=list)
    low: float | None = None
    high: float | None = None

    @property
    def is_mask(self) -> bool:
        return "mask" in self.column


@dataclass
class Encoder:
    """Fitted encoding of a table.  ``params`` holds stochastic intervals and is None for other transforms."""

    numerical: str = "minmax"
    span: tuple[float, float] = (0.0, 1.0)
    drop_first: bool = True
    families: tuple[str, ...] = ()
    blocks: list[Block] = field(default_factory=list)
    params: DataFrame | None = None

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        types: Mapping[str, str],
        numerical: str = "minmax",
        span: tuple[float, float] = (0.0, 1.0),
        drop_first: bool = True,
        families: Sequence[str] = ("icd-10-cm_", "icd-10-pcs_", "proc_"),
        supplied: Mapping[str, tuple[float, float]] | None = None,
    ) -> "Encoder":
        if numerical not in ("minmax", "stochastic", "standard"):
            raise ValueError("numerical is minmax, stochastic or standard")
        known = [c for c in df.columns if c in types]
        numbers = [c for c in known if types[c] == "Numerical"]
        bounds: dict = {}
        if numbers and numerical == "minmax":
            bounds = fit_min_max(df, numbers, supplied)
        elif numbers and numerical == "standard":
            bounds = fit_standard(df, numbers)
        params = settled(stochastic_fit(df, numbers)) if numbers and numerical == "stochastic" else None
        blocks = []
        for c in known:
            kind = types[c]
            if kind == "Listwise":
                continue
            if kind == "Numerical":
                low, high = bounds.get(c, (None, None))
                blocks.append(Block(c, kind, 1, [], low, high))
            elif kind in ("Categorical", "Binary"):
                levels = levels_of(df, c)
                shrink = 1 if len(levels) > 1 and (kind == "Binary" or drop_first) else 0
                if kind == "Binary" and len(levels) > 2:
                    raise ValueError(f"{c} is Binary but has {len(levels)} levels")
                blocks.append(Block(c, kind, len(levels) - shrink, levels))
            else:
                raise ValueError(f"unknown feature type {kind}")
        for prefix in families:
            members = [c for c in types if types[c] == "Listwise" and c.startswith(prefix)]
            if members:
                blocks.append(Block(prefix, "Listwise", len(members), members))
        ordered = [b for b in blocks if not b.is_mask] + [b for b in blocks if b.is_mask]
        return cls(numerical, tuple(span), drop_first, tuple(families), ordered, params)

    @property
    def numbers(self) -> list[str]:
        return [b.column for b in self.blocks if b.kind == "Numerical"]

    def _block(self, b: Block) -> Column:
        c = _q(b.column)
        if b.kind == "Numerical":
            x = c.cast("double")
            if self.numerical == "minmax":
                x = min_max(x, b.low, b.high, self.span)
            elif self.numerical == "standard":
                x = standardize(x, b.low, b.high)
            return F.array(x)
        if b.kind == "Binary":
            return binary_array(c, b.levels)
        if b.kind == "Categorical":
            return one_hot_array(c, b.levels, self.drop_first)
        return F.array(*[_q(m).cast("double") for m in b.levels])

    def transform(self, df: DataFrame, keys: Sequence[str] = (), seed: int = 0, name: str = "encoded") -> DataFrame:
        """(keys, encoded): one vector per row, features before masks."""
        if self.params is not None:
            df = stochastic_transform(df, self.params, self.numbers, seed, keys=keys)
        return df.select(*keys, F.concat(*[self._block(b) for b in self.blocks]).alias(name))

    def inverse(self, df: DataFrame, keys: Sequence[str] = (), name: str = "encoded", blocks: Sequence[Block] | None = None) -> DataFrame:
        """(keys, columns) back from the vectors."""
        out, at = [], 0
        for b in blocks or self.blocks:
            part = F.slice(F.col(name), at + 1, b.width)
            at += b.width
            if b.kind == "Numerical":
                x = F.element_at(part, 1)
                if self.numerical == "minmax":
                    x = min_max_inverse(x, b.low, b.high, self.span)
                elif self.numerical == "standard":
                    x = standardize_inverse(x, b.low, b.high)
                out.append(x.alias(b.column))
            elif b.kind == "Binary":
                out.append(binary_from_array(part, b.levels).alias(b.column))
            elif b.kind == "Categorical":
                out.append(category_from_array(part, b.levels, self.drop_first).alias(b.column))
            else:
                out += [F.element_at(part, i + 1).alias(m) for i, m in enumerate(b.levels)]
        wide = df.select(*keys, *out)
        if self.params is not None:
            wide = stochastic_inverse(wide, self.params, [c for c in self.numbers if c in wide.columns])
        return wide

    def layout(self, spark: SparkSession, types: Mapping[str, str] | None = None) -> DataFrame:
        """(position, family, column, width, offset) in encoded order; the offset is a running sum of widths."""
        rows = [(i, "mask" if b.is_mask else b.kind, b.column, b.width) for i, b in enumerate(self.blocks)]
        frame = spark.createDataFrame(rows, "position int, family string, column string, width int")
        w = Window.partitionBy(F.lit(0)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn("offset", F.coalesce(F.sum("width").over(w), F.lit(0)).cast("int"))

    def family_parts(self, name: str = "encoded") -> dict[str, Column]:
        """Categorical, numerical and listwise values and their masks as array columns."""
        kinds = {"Numerical": "num", "Categorical": "cat", "Binary": "cat", "Listwise": "list"}
        own = {b.column: kinds[b.kind] for b in self.blocks if not b.is_mask}
        parts: dict[str, list[Column]] = {}
        at = 0
        for b in self.blocks:
            piece = F.slice(F.col(name), at + 1, b.width)
            at += b.width
            if b.is_mask:
                base = b.column.replace("_mask", "")
                family = own.get(base) or ("list" if base.startswith(self.families) else None)
                if family is None:
                    raise ValueError(f"mask {b.column} has no feature")
                parts.setdefault(f"{family}_mask", []).append(piece)
            else:
                parts.setdefault(own[b.column], []).append(piece)
        return {k: F.concat(*v) for k, v in parts.items()}

    def widths(self, kind: str) -> list[int]:
        return [b.width for b in self.blocks if b.kind == kind and not b.is_mask]

    # -- state ------------------------------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        """Blocks as a one-row-per-block Parquet table, intervals beside it."""
        meta = {"numerical": self.numerical, "span": list(self.span), "drop_first": self.drop_first, "families": list(self.families)}
        rows = [(i, json.dumps(asdict(b)), json.dumps(meta)) for i, b in enumerate(self.blocks)]
        spark.createDataFrame(rows, "position int, block string, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")
        if self.params is not None:
            self.params.write.mode("overwrite").parquet(f"{path}/intervals")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Encoder":
        rows = spark.read.parquet(f"{path}/blocks").orderBy("position").collect()
        meta = json.loads(rows[0]["meta"])
        out = cls(meta["numerical"], tuple(meta["span"]), meta["drop_first"], tuple(meta["families"]))
        out.blocks = [Block(**json.loads(r["block"])) for r in rows]
        if out.numerical == "stochastic" and out.numbers:
            out.params = spark.read.parquet(f"{path}/intervals")
        return out


# ---- evaluation encoder -------------------------------------------------------------------------


@dataclass
class EvaluationEncoder:
    """Fill, one-hot with fixed columns, standardise: fitted on one table, applied to others."""

    numeric: list[str]
    categorical: list[str]
    flags: list[str]
    fill: dict
    scale: dict
    levels: dict
    drop_first: bool = False
    normalize: bool = True
    encode: bool = True

    @classmethod
    def fit(cls, df: DataFrame, numeric, categorical, flags=(), drop_first=False, normalize=True, encode=True) -> "EvaluationEncoder":
        aggs = []
        for i, c in enumerate(numeric):
            x = _q(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.count(x).alias(f"n{i}")]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs, *[overall_mode(df, c).alias(f"c{i}") for i, c in enumerate(categorical)]).first()
        fill = {c: row[f"m{i}"] for i, c in enumerate(numeric)} | {c: row[f"c{i}"] for i, c in enumerate(categorical)}
        scale = {}
        for i, c in enumerate(numeric):
            # filling with the mean adds rows without deviation
            std = (row[f"v{i}"] * row[f"n{i}"] / row["rows"]) ** 0.5 if row[f"n{i}"] else 0.0
            scale[c] = (row[f"m{i}"], std if std else 1.0)
        levels = {c: levels_of(df, c) or ["__missing__"] for c in categorical}
        return cls(list(numeric), list(categorical), list(flags), fill, scale, levels, drop_first, normalize, encode)

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns (key, target), numbers, flags, then one 0/1 column per level."""
        out = [_q(c) for c in keep]
        for c in self.numeric:
            x = F.coalesce(_q(c).cast("double"), F.lit(self.fill[c]))
            out.append((standardize(x, *self.scale[c]) if self.normalize else x).alias(c))
        out += [F.coalesce(_q(c), F.lit(0)).alias(c) for c in self.flags]
        for c in self.categorical:
            fallback = F.lit(self.fill[c] if self.fill[c] is not None else self.levels[c][0])
            x = F.when(_q(c).isin(self.levels[c]), _q(c)).otherwise(fallback)
            if not self.encode:
                out.append(x.alias(c))
                continue
            names = self.levels[c][1:] if self.drop_first else self.levels[c]
            out += [(x == F.lit(v)).cast("int").alias(f"{c}_{v}") for v in names]
        return df.select(*out)


# ---- model-ready table --------------------------------------------------------------------------


def model_ready(
    static: DataFrame,
    temporal: DataFrame,
    keys: Sequence[str],
    static_encoder: Encoder,
    temporal_encoder: Encoder,
    steps: int,
    step: str = "step",
    condition: Column | None = None,
    pad_value: float = -1.0,
    seed: int = 0,
) -> DataFrame:
    """One row per stay: encoded static vector, (steps × features) sequence with padding value, condition class.

    Nulls inside the vectors become the padding value; the masks tell them apart.
    """
    filled = lambda a: F.transform(a, lambda x: F.coalesce(x, F.lit(pad_value)))
    tagged = static if condition is None else static.withColumn("_cond", condition)
    extra = [] if condition is None else ["_cond"]
    s = static_encoder.transform(tagged, [*keys, *extra], seed, "static").withColumn("static", filled(F.col("static")))
    t = temporal_encoder.transform(temporal.filter(F.col(step) < steps), [*keys, step], seed + 1000, "row")
    rows = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), filled(F.col("row")).alias("v")))).alias("_a"))
    seq = rows.select(*keys, F.transform("_a", lambda r: r["v"]).alias("sequence"))
    out = s.join(seq, list(keys))
    return out.withColumnRenamed("_cond", "condition") if condition is not None else out


def masked_inverse(encoder: Encoder, df: DataFrame, keys: Sequence[str], name: str = "encoded") -> DataFrame:
    """Inverse followed by masking: a value whose decoded mask is not 1 becomes null."""
    wide = encoder.inverse(df, keys, name)
    columns = [c[: -len("_mask")] for c in wide.columns if c.endswith("_mask") and c[: -len("_mask")] in wide.columns]
    return apply_masks(wide, columns, drop=False)
