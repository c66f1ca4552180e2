"""Aggregations, pivots, rare-category folding and type inference."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.flags import levels_of
from cohortspark.functions.times import explode_hours
from cohortspark.operators.ordered import RANGE_ROWS
from cohortspark.session import settled

# Fluids whose share is computed apart from the other medications.
FLUIDS = ("Plasma solution A", "Dextrose 5% & Na K2", "Hartmann", "Normal saline", "Dextrose 5%")

TASK_HOURS = 1 << 19  # hours that a task spreads

Aggregate = Callable[[Column], Column]

AGGREGATES: dict[str, Aggregate] = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def aggregate_fn(fn: str | Aggregate) -> Aggregate:
    return AGGREGATES[fn] if isinstance(fn, str) else fn


# ---- pivots -------------------------------------------------------------------------------------


def pivot(df: DataFrame, keys: Sequence[str], column: str, agg: Column, values: Sequence | None = None) -> DataFrame:
    """Pivot with stated values, so the plan is one aggregation; values are looked up once when not given."""
    names = list(values) if values is not None else levels_of(df, column)
    return df.groupBy(*keys).pivot(column, names).agg(agg)


def code_flags(
    df: DataFrame, keys: Sequence[str], code: str, prefix: str = "icd_", values: Sequence | None = None, fill: int | None = 0
) -> DataFrame:
    """0/1 column per code, one row per key."""
    names = list(values) if values is not None else levels_of(df, code)
    wide = pivot(df, keys, code, F.max(F.lit(1)), names)
    cells = [F.col(f"`{v}`") for v in names]
    cells = cells if fill is None else [F.coalesce(c, F.lit(fill)) for c in cells]
    return wide.select(*keys, *[c.alias(f"{prefix}{v}") for c, v in zip(cells, names)])


def hourly_mean(df: DataFrame, keys: Sequence[str], label: str = "label", hour: str = "hours", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, label, hour).agg(F.avg(value).alias(value))


def hourly_pivot_mean(
    df: DataFrame, keys: Sequence[str], label: str = "label", hour: str = "hours", value: str = "value", values=None
) -> DataFrame:
    """Mean per (keys, hour, label) with one column per label, in one aggregation."""
    return pivot(df, [*keys, hour], label, F.avg(value), values)


def hourly_first(
    df: DataFrame, keys: Sequence[str], hour: str = "hours", value: str = "value", order: Sequence[str] = ("charttime",)
) -> DataFrame:
    """First value of the hour by time, then by value."""
    rank = F.struct(*[F.col(c) for c in order], F.col(value))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, hour).agg(F.min_by(value, rank).alias(value))


def pivot_last(
    df: DataFrame, keys: Sequence[str], label: str, value: str, order: Sequence[str], values=None, fill=None
) -> DataFrame:
    """Last non-null value per (keys, label) by the stated order."""
    rank = F.struct(*[F.col(c) for c in order])
    wide = pivot(df.filter(F.col(value).isNotNull()), keys, label, F.max_by(value, rank), values)
    return wide if fill is None else wide.fillna(fill)


def _hourly(intervals: DataFrame, spans: DataFrame, keys: Sequence[str], start: str, end: str) -> tuple[DataFrame, list[str]]:
    """``intervals`` spread over their hours from 0 on, dealt by (keys, day), and the columns that name an hour.

    An interval goes to each day it touches and is spread there, so what follows by (keys, day, hour) needs no other
    exchange.  The tasks follow the hours of ``spans``, the rows behind the intervals: about TASK_HOURS each at most.
    """
    first, last = F.greatest(F.col(start), F.lit(0)).cast("bigint"), F.col(end).cast("bigint")
    hours = spans.agg(F.sum(F.greatest(last - first + 1, F.lit(0)))).first()[0]
    parts = max(1, ceil((hours or 0) / TASK_HOURS))
    days = intervals.filter(last >= first).withColumns({"_first": F.floor(first / 24), "_last": F.floor(last / 24)})
    dealt = explode_hours(days, "_first", "_last", "_day").repartition(parts, *[F.col(f"`{k}`") for k in keys], F.col("_day"))
    inside = {"_from": F.greatest(first, F.col("_day") * 24), "_to": F.least(last, F.col("_day") * 24 + 23)}
    return explode_hours(dealt.withColumns(inside).drop(start, end), "_from", "_to"), [*keys, "_day", "hours"]


def interval_mean(
    df: DataFrame, keys: Sequence[str], label: str, amount: str, start: str = "start_hours", end: str = "end_hours", values=None
) -> DataFrame:
    """Mean amount per interval and label, spread over the interval's hours, mean again per hour."""
    per_interval = df.groupBy(*keys, start, end, label).agg(F.avg(amount).alias(amount))
    hourly, by = _hourly(per_interval, df, keys, start, end)
    return pivot(hourly, by, label, F.avg(amount), values).drop("_day")


def interval_flag(
    df: DataFrame, keys: Sequence[str], label: str, prefix: str = "proc_", start: str = "start_hours", end: str = "end_hours", values=None
) -> DataFrame:
    """1 in every hour an interval of the label covers, 0 in hours that only other labels cover."""
    once = df.select(*keys, label, start, end).distinct()
    hourly, by = _hourly(once, df, keys, start, end)
    return code_flags(hourly, by, label, prefix, values).drop("_day")


def interval_weight(
    df: DataFrame, keys: Sequence[str], weight: str = "patientweight", start: str = "start_hours", end: str = "end_hours",
    label: str | None = "label",
) -> DataFrame:
    """Weight per hour: mean per interval (and label), spread, mean per hour, nulls left out."""
    group = [*keys, start, end, *([label] if label else [])]
    per_interval = df.groupBy(*group).agg(F.avg(weight).alias(weight)).filter(F.col(weight).isNotNull())
    hourly, by = _hourly(per_interval, df, keys, start, end)
    return hourly.groupBy(*by).agg(F.avg(weight).alias(weight)).drop("_day")


def merge_weights(streams: Sequence[DataFrame], keys: Sequence[str], weight: str = "patientweight") -> DataFrame:
    stacked = reduce(DataFrame.unionByName, [s.select(*keys, "hours", weight) for s in streams])
    return stacked.groupBy(*keys, "hours").agg(F.avg(weight).alias(weight))


def presence_pivot_many(
    df: DataFrame, keys: Sequence[str], name_columns: Sequence[str], value_column: str, min_share: float = 0.01, fill: int = 0
) -> DataFrame:
    """0/1 column per '<name>_<value>' over several name columns, rare names dropped.

    Frequencies are summed over the name columns; the same name in two columns is one output column.  The rows
    kept are one per key (the smallest in column order, stated because a frame has no row order).
    """
    tags = {f"_t{i}": F.concat_ws("_", F.col(c), F.col(value_column)) for i, c in enumerate(name_columns)}
    tags = {t: F.when(F.col(c).isNotNull() & F.col(value_column).isNotNull(), v) for (t, v), c in zip(tags.items(), name_columns)}
    tagged = df.withColumns(tags)
    long = tagged.select(*keys, F.explode(F.array(*tags)).alias("_name"))
    shares = category_shares(long.filter(F.col("_name").isNotNull()), "_name")
    often = shares.filter(F.col("n") >= F.col("total") * min_share).select("_name", "total").collect()  # at most 1 / min_share
    names = [r["_name"] for r in often]
    some = reduce(Column.__or__, [F.coalesce(F.col(t).isin(names), F.lit(False)) for t in tags])
    kept = tagged.filter(some).select(*keys, F.array(*tags).alias("_all"))
    # smallest arrays are found by sorting, so no task gets more than a range of rows, whatever a task before it read
    parts = max(1, ceil(often[0]["total"] / RANGE_ROWS)) if often else 1
    dealt = kept.repartition(parts, *[F.col(f"`{k}`") for k in keys], F.col("_all"))
    one = settled(dealt.groupBy(*keys).agg(F.min("_all").alias("_all")))
    found = levels_of(one.select(F.explode("_all").alias("_name")), "_name")
    if not found:
        return one.select(*keys)
    places = {f"_p{i}": F.array_position(F.array(*[F.lit(v) for v in found]), F.col("_all")[i]) for i in range(len(tags))}
    placed = one.select(*keys, *[p.alias(name) for name, p in places.items()])
    here = lambda at: reduce(Column.__or__, [F.col(p) == F.lit(at) for p in places])
    flags = [F.when(here(at), F.lit(1)).otherwise(F.lit(fill)).alias(v) for at, v in enumerate(found, 1)]
    return placed.select(*keys, *flags)


def frequent_levels(df: DataFrame, column: str, min_share: float) -> list:
    """Levels whose count is at least ``min_share`` of the non-null rows: at most 1 / min_share of them."""
    shares = category_shares(df, column)
    rows = shares.filter(F.col("n") >= F.col("total") * min_share).select(column).collect()
    return sorted(r[0] for r in rows)


# ---- shares and folding -------------------------------------------------------------------------


def category_shares(df: DataFrame, column: str, by: Sequence[str] = (), count_null_rows: bool = False) -> DataFrame:
    """(by, column, n, total, share).  Nulls are outside the denominator unless asked for."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    if not count_null_rows:
        counts = counts.filter(F.col(column).isNotNull())
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        out = counts.join(totals, list(by))
    else:
        total = counts.groupBy().agg(F.sum("n").alias("t")).scalar()
        out = counts.withColumn("total", total)
    out = out.withColumn("share", F.col("n") / F.col("total"))
    return out.filter(F.col(column).isNotNull()) if count_null_rows else out


def fold_rare(
    df: DataFrame,
    column: str,
    threshold: float = 0.01,
    others: str = "Others",
    fold_null: bool = False,
    output: str | None = None,
) -> DataFrame:
    """Categories below the share threshold become ``others`` when more than one is rare."""
    return fold_rare_many(df, {column: others}, threshold, fold_null, {column: output or column})


def fold_rare_many(
    df: DataFrame, others: Mapping[str, str], threshold: float = 0.01, fold_null: bool = False, outputs: Mapping[str, str] | None = None
) -> DataFrame:
    """Fold the rare categories of several text columns; ``others`` maps a column to its collective level.

    All columns are counted in one pass over the table.  At most 1 / threshold categories of a column reach the
    threshold, so the kept levels are read as one scalar map and tested in place: the table itself is neither
    joined nor shuffled.
    """
    if not others:
        return df
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("v")) for c in others]
    counts = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").filter(F.col("v").isNotNull())
    counts = counts.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "feature").withColumn("share", F.col("n") / F.col("total"))  # one row per column
    stats = shares.groupBy("feature").agg(
        F.collect_list(F.when(F.col("share") >= threshold, F.col("v"))).alias("keep"),
        F.count_if(F.col("share") < threshold).alias("rare"),
    )
    table = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("keep", "rare"))))).scalar()
    out = {}
    for c, rest in others.items():
        value, info = F.col(f"`{c}`"), F.try_element_at(table, F.lit(c))
        few = F.coalesce(info["rare"], F.lit(0)) <= 1
        stays = few | F.coalesce(F.array_contains(info["keep"], value.cast("string")), F.lit(False))
        stays = stays if fold_null else stays | value.isNull()
        out[(outputs or {}).get(c, c)] = F.when(stays, value).otherwise(F.lit(rest))
    return df.withColumns(out)


def share_cutoff(df: DataFrame, column: str = "itemid", threshold: float = 0.01, group: Column | None = None) -> DataFrame:
    """Rows whose category share, rounded half-even to two decimals first, reaches the threshold.

    With ``group`` the share is taken inside each group (fluids apart from other medications).  The kept
    categories number at most 1 / (threshold - 0.005) per group, or are all categories when that is not positive.
    """
    if group is None:
        shares = category_shares(df, column)
        keep = shares.filter(F.bround("share", 2) >= threshold).select(column)
        return df.join(F.broadcast(keep) if threshold >= 0.01 else keep, column, "left_semi")
    tagged = df.withColumn("_g", group)
    shares = category_shares(tagged, column, ["_g"])
    keep = shares.filter(F.bround("share", 2) >= threshold).select("_g", column)
    return tagged.join(keep, ["_g", column], "left_semi").drop("_g")


def medication_cutoff(df: DataFrame, column: str = "medication", threshold: float = 0.01) -> DataFrame:
    """Share cutoff taken separately for fluids and for other medications."""
    return share_cutoff(df, column, threshold, F.col(column).isin(*FLUIDS).cast("int"))


def ratio_cutoff(df: DataFrame, column: str = "itemid", threshold: float = 0.01) -> DataFrame:
    """Rows whose item count is at least the threshold share of all rows, without rounding."""
    total = df.groupBy().agg(F.count(F.lit(1)).alias("t")).scalar()
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.filter(F.col("_n") / total >= threshold).select(column)
    return df.join(F.broadcast(keep) if threshold >= 0.001 else keep, column, "left_semi")


def top_levels(df: DataFrame, column: str, max_categories: int = 6) -> list | None:
    """The most frequent max_categories - 1 levels (ties by level), or None when there are fewer levels."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.orderBy(F.desc("_n"), column).limit(max_categories).collect()
    return None if len(rows) < max_categories else [r[0] for r in rows[: max_categories - 1]]


def keep_top_categories(
    df: DataFrame, columns: Sequence[str], max_categories: int = 6, fitted: Mapping[str, Sequence] | None = None
) -> tuple[DataFrame, dict[str, list]]:
    """Keep the top categories of each column, the rest become 'Others'.  Returns the map for other splits."""
    if fitted is None:
        found = {c: top_levels(df, c, max_categories) for c in columns}
        fitted = {c: v for c, v in found.items() if v is not None}
    out = {
        c: F.when(F.col(c).isin(list(v)), F.col(c)).otherwise(F.lit("Others")) for c, v in fitted.items() if c in columns
    }
    return (df.withColumns(out) if out else df), {c: list(v) for c, v in fitted.items()}


# ---- groups -------------------------------------------------------------------------------------


def by_label(
    df: DataFrame, keys: Sequence[str], time: Sequence[str] = ("hours",), label: str = "label", value: str = "value", fn="mean"
) -> DataFrame:
    return df.groupBy(*keys, *time, label).agg(aggregate_fn(fn)(F.col(value)).alias(value))


def by_hour(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], hour: str = "hours", fn="median", floor: int | None = 0
) -> DataFrame:
    """Truncate the hour, lift hours below the floor to it, aggregate every column."""
    h = F.col(hour).cast("bigint")
    h = h if floor is None else F.greatest(h, F.lit(floor).cast("bigint"))
    f = aggregate_fn(fn)
    return df.withColumn(hour, h).groupBy(*keys, hour).agg(*[f(F.col(c)).alias(c) for c in columns])


def typed_aggregate(
    df: DataFrame, group: Sequence[str], types: Mapping[str, str], order: Sequence[str], time: Sequence[str] = ()
) -> DataFrame:
    """Binary max, Categorical first non-null by ``order``, Numerical mean.  Null keys form a group."""
    rank = F.struct(*[F.col(c) for c in order])
    aggs = []
    for name, kind in types.items():
        c = F.col(f"`{name}`")
        if kind == "Binary":
            aggs.append(F.max(c).alias(name))
        elif kind == "Categorical":
            aggs.append(F.min_by(c, F.when(c.isNotNull(), rank)).alias(name))
        elif kind == "Numerical":
            aggs.append(F.avg(c).alias(name))
        else:
            raise ValueError(f"unknown feature type {kind}")
    return df.groupBy(*group, *time).agg(*aggs)


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows and duplicates, on all or some columns."""
    names = list(columns) if columns else df.columns
    groups = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def attrition(tagged: DataFrame, steps: Sequence[str], columns: Mapping[str, str], passed: str = "_passed") -> DataFrame:
    """One row per step: distinct counts of the named columns and rows.  ``columns``: output name -> column.

    ``passed`` is the position of the last step that a row passes.  A value is there in a step if one of its rows
    gets as far, so one grouping of (column, value) by its furthest row serves all steps and columns, and the
    table is read once.
    """
    cells = [F.struct(F.lit(n).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for n, c in columns.items()]
    cells.append(F.struct(F.lit("rows").alias("name"), F.col(passed).cast("string").alias("value")))
    long = tagged.select(F.col(passed).alias("last"), F.explode(F.array(*cells)).alias("c")).select("last", "c.*")
    furthest = long.filter(F.col("value").isNotNull()).groupBy("name", "value").agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("name") == "rows", F.col("n")).otherwise(1)
    ends = furthest.groupBy("name", "last").agg(F.sum(weight).alias("n"))
    each = ends.withColumn("position", F.explode(F.sequence(F.lit(0), "last")))
    totals = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).cast("long").alias(n) for n in (*columns, "rows")]
    found = each.groupBy("position").agg(*totals)
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(s).alias("step")) for k, s in enumerate(steps)])).alias("s")
    every = tagged.sparkSession.range(1).select(names).select("s.*")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in (*columns, "rows")}
    return every.join(found, "position", "left").withColumns(zero).select("position", "step", *columns, "rows")


def length_summary(df: DataFrame, column: str = "los") -> DataFrame:
    return df.agg(
        F.min(column).alias(f"{column}_min"), F.avg(column).alias(f"{column}_mean"), F.max(column).alias(f"{column}_max")
    )


# ---- types --------------------------------------------------------------------------------------

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def infer_types(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: int = 7, nulls_count: bool = False, batch: int = 100
) -> dict[str, str]:
    """Feature type per column: Binary, Categorical, Numerical or Other.

    Binary: only 0/1.  Categorical: text, or whole numbers with at most ``threshold`` levels.  One map-side
    aggregation finds the flags, the whole-number test and a distinct estimate; an exact distinct count
    follows only for whole-number columns whose estimate is near the threshold, so no column with many
    values is ever shuffled.  With ``nulls_count`` a null breaks the flag and whole-number tests.
    """
    kinds = dict(df.dtypes)
    names = list(columns) if columns else df.columns
    out: dict[str, str] = {}
    numbers = []
    for c in names:
        if kinds[c].startswith(_NUMERIC):
            numbers.append(c)
        else:
            out[c] = {"boolean": "Binary", "string": "Categorical"}.get(kinds[c], "Other")
    few = []
    for start in range(0, len(numbers), batch):
        part = numbers[start : start + batch]
        aggs = []
        for i, c in enumerate(part):
            v = F.col(f"`{c}`").cast("double")
            absent = F.lit(not nulls_count)
            aggs += [
                F.every(F.coalesce(v.isin(0.0, 1.0), absent)).alias(f"flag{i}"),
                F.every(F.coalesce(v == F.floor(v), absent)).alias(f"whole{i}"),
                F.approx_count_distinct(v, 0.05).alias(f"near{i}"),
            ]
        row = df.agg(*aggs).first()
        for i, c in enumerate(part):
            if row[f"flag{i}"] in (True, None):
                out[c] = "Binary"
            elif row[f"whole{i}"] and row[f"near{i}"] <= 4 * threshold:
                few.append(c)
            else:
                out[c] = "Numerical"
    for start in range(0, len(few), batch):
        part = few[start : start + batch]
        cells = [F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").cast("double").alias("v")) for c in part]
        long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("v").isNotNull())
        found = long.distinct().groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
        out.update({r["f"]: "Categorical" if r["n"] <= threshold else "Numerical" for r in found})
    return {c: out[c] for c in names}


def type_table(df: DataFrame, columns: Sequence[str] | None = None, threshold: int = 7, nulls_count: bool = False) -> DataFrame:
    """(feature, feature_type) as a frame, one row per column."""
    types = infer_types(df, columns, threshold, nulls_count)
    return df.sparkSession.createDataFrame(list(types.items()), "feature string, feature_type string")


def dimension_table(df: DataFrame, types: Mapping[str, str], families: Sequence[str]) -> DataFrame:
    """(feature, width): levels of a flag or category, members of a prefix family, 1 for numbers.

    The levels of all columns are made distinct together in long form; a column with many is combined in each task.
    """
    fixed: dict[str, int] = {}
    for name, kind in types.items():
        family = next((p for p in families if name.startswith(p)), None)
        if family:
            fixed[family] = fixed.get(family, 0) + 1
        if kind in ("Numerical", "Other"):
            fixed[name] = 1
    levels = [c for c, k in types.items() if k in ("Binary", "Categorical", "Listwise") and not any(c.startswith(p) for p in families)]
    kinds = dict(df.dtypes)
    one = lambda c: F.col(f"`{c}`") + F.lit(0) if kinds[c] in ("double", "float") else F.col(f"`{c}`")  # noqa: E731  -0.0 is 0.0
    cells = [F.struct(F.lit(c).alias("feature"), one(c).cast("string").alias("level")) for c in levels]
    there = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in [*levels, *fixed]])).alias("feature"))
    widths = F.create_map(*[x for c, n in fixed.items() for x in (F.lit(c), F.lit(n).cast("long"))]) if fixed else F.lit(None).cast("map<string,bigint>")
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*") if levels else None
    if long is None:
        return there.select("feature", F.try_element_at(widths, F.col("feature")).alias("width"))
    counts = long.filter(F.col("level").isNotNull()).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    width = F.coalesce(F.try_element_at(widths, F.col("feature")), F.col("_n"), F.lit(0).cast("long"))
    return there.join(counts, "feature", "left").select("feature", width.alias("width"))


def output_dimensions(df: DataFrame, types: Mapping[str, str], families: Sequence[str]) -> dict[str, int]:
    """Width of each feature, as :func:`dimension_table` gives it."""
    return {r["feature"]: r["width"] for r in dimension_table(df, types, families).collect()}


def stay_summary(
    df: DataFrame,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    flags: Sequence[str] = (),
    hours: int | None = None,
    hour: str = "hours",
) -> DataFrame:
    """One row per stay over its first hours: mean, smallest mode, max."""
    rows = df if hours is None else df.filter(F.col(hour) < hours)
    q = lambda c: F.col(f"`{c}`")
    return rows.groupBy(key).agg(
        *[F.avg(q(c)).alias(c) for c in numeric],
        *[F.mode(q(c), True).alias(c) for c in categorical],
        *[F.max(q(c)).alias(c) for c in flags],
    )
