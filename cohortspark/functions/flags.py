"""Flags, masks, one-hot blocks, outcome classes and decoding of encoded arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def levels_of(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Sorted distinct non-null levels.  Refuses to make more columns than a plan can carry."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} levels; fold rare levels first")
    return sorted(r[0] for r in rows)


def one_hot(
    df: DataFrame, column: str, prefix: str, levels: Sequence | None = None, drop_first: bool = False, keep: bool = False
) -> DataFrame:
    """0/1 column per level, named ``<prefix>_<level>``; a null row is all zero."""
    names = list(levels) if levels is not None else levels_of(df, column)
    names = names[1:] if drop_first else names
    flags = [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in names]
    kept = [c for c in df.columns if keep or c != column]
    return df.select(*kept, *flags)


def first_maximum(columns: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Name of the first column holding the row maximum; null when every column is null."""
    names = [f"`{c}`" for c in columns]
    top = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    out = None
    for name, label in zip(names, labels or columns):
        hit = F.col(name) == top
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def missing_mask(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """Mask table: 1 observed, 0 missing."""
    return df.select(*keys, *[F.col(f"`{c}`").isNotNull().cast("int").alias(f"{c}{suffix}") for c in columns])


def add_masks(df: DataFrame, columns: Sequence[str], suffix: str = "_mask") -> DataFrame:
    return df.select("*", *[F.col(f"`{c}`").isNotNull().cast("int").alias(f"{c}{suffix}") for c in columns])


def apply_masks(df: DataFrame, columns: Sequence[str], suffix: str = "_mask", drop: bool = True) -> DataFrame:
    """Value where its mask is 1, else null."""
    masked = {c: F.when(F.col(f"`{c}{suffix}`") == 1, F.col(f"`{c}`")) for c in columns}
    out = df.withColumns(masked)
    return out.drop(*[f"{c}{suffix}" for c in columns]) if drop else out


def fill_flag_family(df: DataFrame, prefix: str, others: str = "Others") -> DataFrame:
    """Flag columns of a family: ``<prefix>Others`` null -> 1 (created when absent), other members null -> 0."""
    family = [c for c in df.columns if prefix in c]
    if not family:
        return df
    rest = f"{prefix}{others}"
    if rest not in family:
        df = df.withColumn(rest, F.lit(None).cast("int"))
    fills = {c: F.coalesce(F.col(f"`{c}`"), F.lit(1 if c == rest else 0)) for c in [*family, rest]}
    return df.withColumns(fills)


def family_mask(columns: Sequence[str]) -> Column:
    """Mask of a prefix family: 1 if any member is observed."""
    names = [F.col(f"`{c}`") for c in columns]
    return F.greatest(*names) if len(names) > 1 else names[0]


def cast_by_type(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Binary to int, Categorical to text (missing becomes the level 'nan'), Numerical to double."""
    casts = {}
    for name, kind in types.items():
        if name not in df.columns:
            continue
        c = F.col(f"`{name}`")
        if kind == "Binary":
            casts[name] = c.cast("int")
        elif kind == "Categorical":
            casts[name] = F.coalesce(c.cast("string"), F.lit("nan"))
        elif kind == "Numerical":
            casts[name] = c.cast("double")
    return df.withColumns(casts) if casts else df


def dtypes_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def restore_dtypes(df: DataFrame, dtypes: Mapping[str, str], decimals: int = 2) -> DataFrame:
    """Cast back to stored types where the value allows, then round floating columns."""
    out = {}
    kinds = dict(df.dtypes)
    for name in df.columns:
        kind = dtypes.get(name, kinds[name])
        c = F.col(f"`{name}`")
        if kind in ("int", "bigint", "smallint", "tinyint") and kinds[name] == "string":
            c = c.try_cast("double").cast(kind)
        elif kind != kinds[name]:
            c = c.try_cast(kind)
        if kind in ("double", "float"):
            c = F.bround(c, decimals)
        out[name] = c
    return df.select(*[c.alias(n) for n, c in out.items()])


def cast_keys(df: DataFrame, keys: Sequence[str], dtype: str = "string") -> DataFrame:
    return df.withColumns({k: F.col(k).cast(dtype) for k in keys if k in df.columns})


def outcome_group(icu_flag: Column | str, hospital_flag: Column | str) -> Column:
    """Outcome text; unit death wins over hospital death."""
    return (
        F.when(_col(icu_flag) == 1, "ICU mortality").when(_col(hospital_flag) == 1, "Hospital mortality").otherwise("Alive")
    )


def condition_class(icu_flag: Column | str, hospital_flag: Column | str) -> Column:
    """0 alive, 1 death in the unit, 2 death in hospital."""
    return F.when(_col(icu_flag) == 1, 1).when(_col(hospital_flag) == 1, 2).otherwise(0)


def condition_one_hot(condition: Column | str, classes: int = 3) -> Column:
    return F.array(*[(_col(condition) == i).cast("double") for i in range(classes)])


def condition_flags(condition: Column | str) -> tuple[Column, Column]:
    """(unit death flag, hospital death flag) from a class; a unit death is also a hospital death."""
    c = _col(condition)
    return (c == 1).cast("int"), c.isin(1, 2).cast("int")


def operation_durations(df: DataFrame) -> DataFrame:
    """Lengths of stay and mortality flags of surgical episodes."""
    return df.withColumns(
        {
            "los": F.col("discharge_time") - F.col("admission_time"),
            "icu_los": F.col("icuout_time") - F.col("icuin_time"),
            "inhosp_mortality": F.col("inhosp_death_time").isNotNull().cast("int"),
            "allcause_mortality": F.col("allcause_death_time").isNotNull().cast("int"),
        }
    )


# ---- arrays ------------------------------------------------------------------------------------

DOUBLES = T.ArrayType(T.DoubleType())


def slice_block(array: Column | str, offset: int, width: int) -> Column:
    """Block of an encoded row, ``offset`` counted from 0."""
    return F.slice(_col(array), offset + 1, width)


def split_blocks(array: Column | str, widths: Sequence[int]) -> list[Column]:
    """Cut an encoded row into consecutive blocks."""
    out, at = [], 0
    for width in widths:
        out.append(slice_block(array, at, width))
        at += width
    return out


def softmax(array: Column | str) -> Column:
    a = _col(array)
    top = F.array_max(a)
    grown = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(grown, lambda x: x / total)


def sigmoid(array: Column | str) -> Column:
    return F.transform(_col(array), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def at_least(array: Column | str, threshold: float = 0.5) -> Column:
    return F.transform(_col(array), lambda x: (x >= threshold).cast("double"))


def activate(array: Column | str, kind: str, threshold: float | None = None) -> Column:
    """Decode one block: softmax, sigmoid (optionally thresholded to 0/1) or identity."""
    decoded = {"softmax": softmax, "sigmoid": sigmoid, "identity": _col}[kind](array)
    return decoded if threshold is None else at_least(decoded, threshold)


def activate_blocks(array: Column | str, blocks: Sequence[tuple[int, str, float | None]]) -> Column:
    """Decode an encoded row block by block; ``blocks`` holds (width, kind, threshold)."""
    parts = split_blocks(array, [w for w, _, _ in blocks])
    return F.concat(*[activate(p, kind, t) for p, (_, kind, t) in zip(parts, blocks)])


def block_argmax(array: Column | str) -> Column:
    """0-based index of the first maximum of a block, null when any part is null."""
    a = _col(array)
    complete = ~F.exists(a, lambda x: x.isNull())
    return F.when(complete, F.array_position(a, F.array_max(a)) - 1)


def pick_level(levels: Sequence, position: Column) -> Column:
    """Level at a 1-based position.  The null test is stated: an element lookup in a literal array does not make
    one of its own for the position."""
    return F.when(position.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in levels]), position.cast("int")))


def one_hot_indices(array: Column | str, widths: Sequence[int]) -> Column:
    """Index per one-hot block, as an array."""
    return F.array(*[block_argmax(b) for b in split_blocks(array, widths)])
