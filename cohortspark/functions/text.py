"""Text rules as column expressions: ages, numbers, rates, amounts, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_IN_YEAR = 365.25
MONTHS_IN_YEAR = 12

NUMBER_PATTERN = r"^\s*[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?\s*$"

# Words a number parser also accepts.
NUMBER_WORDS = ("nan", "inf", "infinity")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or_null(c: Column | str) -> Column:
    """Numeric text as double; anything else, and NaN, is null.  Suffixes such as '5d' are not numbers."""
    text = _col(c).cast("string")
    value = F.when(text.rlike(NUMBER_PATTERN), F.regexp_replace(text, r"[\s_]", "")).try_cast("double")
    return value


def is_number(c: Column | str) -> Column:
    """True for text a number parser accepts, the special words included."""
    text = _col(c).cast("string")
    special = F.regexp_replace(F.lower(F.trim(text)), r"^[+-]", "").isin(*NUMBER_WORDS)
    return F.coalesce(text.rlike(NUMBER_PATTERN) | special, F.lit(False))


def clean_key(c: Column | str, dtype: str = "string") -> Column:
    """Key text without a trailing '.0'; 'nan' and empty text become null."""
    text = F.trim(_col(c).cast("string"))
    text = F.regexp_replace(text, r"\.0$", "")
    return F.when(F.lower(text).isin("nan", "none", ""), F.lit(None)).otherwise(text).try_cast(dtype)


def lower_trim(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c).cast("string")))


def unknown_if_nan(c: Column | str, text: str = "Unknown") -> Column:
    """Missing values and the literal text 'nan' become a named level."""
    value = _col(c).cast("string")
    return F.when(value.isNull() | (value == "nan"), F.lit(text)).otherwise(value)


def age_in_years(c: Column | str) -> Column:
    """'63 years', '10 months', '20 days' to years; unknown units give null."""
    text = _col(c).cast("string")
    number = F.regexp_extract(text, r"(\d+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([a-zA-Z]+)", 1)
    return (
        F.when(unit == "days", number / DAYS_IN_YEAR)
        .when(unit == "months", number / MONTHS_IN_YEAR)
        .when(unit == "years", number)
    )


def rate_pattern(time_unit: str) -> str:
    """A number, a letter unit, optionally per (weight) kg, then the time unit."""
    return r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+(?:/\d*\.?\d*kg|/kg)?" + time_unit + ")"


def rate_value(c: Column | str, time_unit: str) -> Column:
    return _rate_part(_col(c), time_unit, 1)


def rate_unit(c: Column | str, time_unit: str) -> Column:
    return _rate_part(_col(c), time_unit, 2)


def _rate_part(text: Column, time_unit: str, group: int) -> Column:
    """Whole-text match first, then a match anywhere; no match gives null."""
    whole = F.nullif(F.regexp_extract(text, "^" + rate_pattern(time_unit) + "$", group), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(text, rate_pattern(time_unit), group), F.lit(""))
    return F.coalesce(whole, anywhere)


def amount_or_cc(c: Column | str) -> Column:
    """Numeric amounts as they are; otherwise the digits in front of 'cc'."""
    text = _col(c).cast("string")
    digits = F.nullif(F.regexp_extract(text, r"(\d+)\s*cc", 1), F.lit("")).try_cast("double")
    return F.coalesce(number_or_null(text), digits)


def race_class(c: Column | str) -> Column:
    """Free race text to six classes; the first matching rule wins, missing text is OTHER."""
    text = F.coalesce(_col(c).cast("string"), F.lit("nan"))
    # Class, pattern searched anywhere; then whole texts.
    return (
        F.when(text.contains("ASIAN"), "ASIAN")
        .when(text.contains("WHITE"), "WHITE")
        .when(text.contains("BLACK"), "BLACK")
        .when(text.contains("HISPANIC/LATINO") | (text == "HISPANIC OR LATINO"), "HISPANIC/LATINO")
        .when(text.isin("UNABLE TO OBTAIN", "UNKNOWN"), "UNKNOWN")
        .otherwise("OTHER")
    )


def transform_static(df: DataFrame, race_col: str = "race") -> DataFrame:
    return df.withColumn(race_col, race_class(race_col))


def text_flag(c: Column | str, text: str) -> Column:
    """1 when the column equals the text, else 0 (null included)."""
    return F.coalesce((_col(c) == text).cast("int"), F.lit(0))


def significance_stars(p: Column | str) -> Column:
    """p-value to stars; not significant or missing gives empty text.  Fixed values: 0.001, 0.01, 0.05."""
    value = _col(p)
    return F.when(value < 0.001, "***").when(value < 0.01, "**").when(value < 0.05, "*").otherwise("")


def significance_text(p: Column | str) -> Column:
    value = _col(p)
    return (
        F.when(value < 0.001, "p < 0.001").when(value < 0.01, "p < 0.01").when(value < 0.05, "p < 0.05").otherwise("")
    )


def correlation_band(c: Column | str) -> Column:
    """Correlation to seven bands 0 (strong negative) .. 6 (strong positive)."""
    value = _col(c)
    # Upper ends of bands 0..5.
    edges = (-0.5, -0.3, -0.1, 0.1, 0.3, 0.5)
    out = F.when(value < edges[0], 0)
    for band, edge in enumerate(edges[1:], start=1):
        out = out.when(value < edge, band)
    return F.when(value.isNotNull(), out.otherwise(6))
