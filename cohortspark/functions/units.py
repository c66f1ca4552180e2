"""Unit clean-up and conversion as column expressions driven by small fixed tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import compute_once

# Misspelt unit -> unit, tried in this order.  A unit matches an entry when it is a
# substring of the misspelt text (so the empty text matches the first entry).
UNIT_SPELLINGS = (
    ("c/hr", "cc/hr"),
    ("ccc/hr", "cc/hr"),
    ("cxc/hr", "cc/hr"),
    ("units/hr", "unit/hr"),
    ("u/hr", "unit/hr"),
    ("unti/hr", "unit/hr"),
    ("ui/hr", "unit/hr"),
)

# Spellings of a volume rate.
VOLUME_RATE_UNITS = ("cc/hr", "c/hr", "ccc/hr", "cch/hr", "cxc/hr")

# Fixed values: (standard unit, unit) -> (multiply, divide, power of the body weight).
RATE_FACTORS = {
    ("mcg/kg/min", "mcg/kg/min"): (1, 1, 0),
    ("mcg/kg/min", "mcg/min"): (1, 1, -1),
    ("mcg/kg/min", "mcg/hr"): (1, 60, -1),
    ("mcg/kg/min", "mg/hr"): (1000, 60, -1),
    ("mg/hr", "mg/hr"): (1, 1, 0),
    ("mg/hr", "mcg/min"): (60, 1000, 0),
    ("mg/hr", "mcg/kg/min"): (60, 1000, 1),
    ("mg/hr", "mcg/hr"): (1, 1000, 0),
    ("unit/hr", "unit/hr"): (1, 1, 0),
    ("unit/hr", "unit/min"): (60, 1, 0),
    ("unit/min", "unit/min"): (1, 1, 0),
    ("unit/min", "unit/hr"): (1, 60, 0),
    **{("cc/hr", spelling): (1, 1, 0) for spelling in VOLUME_RATE_UNITS},
}

WEIGHT_IN_UNIT = r"^mcg/([\d.]+)kg/min"

# Medication -> (low, high) bounds on the converted rate; outside rows are dropped.
RATE_BOUNDS = {"Plasma solution A": (0.11, None), "Remifentanil": (None, 2.0)}

# Medication whose decimal point slips.
SLIP_MEDICATION = "Dexmedetomidine"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_unit(c: Column | str) -> Column:
    """Lower-case, trim and repair a unit; unknown units stay, null stays null."""
    unit = F.lower(F.trim(_col(c)))
    out = F.when(unit.isNull(), F.lit(None).cast("string"))
    for wrong, right in UNIT_SPELLINGS:
        out = out.when(F.contains(F.lit(wrong), unit), right)
    return out.otherwise(unit)


def reading_for_standard(standard_unit: Column | str, hourly: Column | str, per_minute: Column | str) -> Column:
    """The hourly reading for an hourly standard unit, the minute reading for a minute one."""
    unit = _col(standard_unit)
    return F.when(unit.contains("hr"), _col(hourly)).when(unit.contains("min"), _col(per_minute))


def convert_rates(
    df: DataFrame,
    rate: str,
    medication: str = "medication",
    unit: str = "unit",
    standard_unit: str = "standard_unit",
    weight: str = "patientweight",
    output: str | None = None,
) -> DataFrame:
    """Infusion rate in the medication's standard unit; null when no rule applies or a needed weight is missing."""
    tidy = lambda c: F.lower(F.trim(F.col(c)))
    read = compute_once(
        df,
        {
            "_u": tidy(unit),
            "_std": tidy(standard_unit),
            "_kg": F.nullif(F.col(weight).cast("double"), F.lit(0.0)),
            "_v": F.col(rate).cast("double"),
        },
    )
    u, std, kg, value, med = F.col("_u"), F.col("_std"), F.col("_kg"), F.col("_v"), F.col(medication)
    named = u.rlike(WEIGHT_IN_UNIT)
    named_kg = F.nullif(F.regexp_extract(u, WEIGHT_IN_UNIT, 1), F.lit("")).try_cast("double")

    cells = []
    for (standard, given), (times, over, power) in RATE_FACTORS.items():
        cells += [F.lit(f"{standard} {given}"), F.struct(F.lit(float(times)).alias("t"), F.lit(float(over)).alias("o"), F.lit(power).alias("p"))]
    read = compute_once(read, {"_f": F.try_element_at(F.create_map(*cells), F.concat_ws(" ", std, u)), "_named": named, "_named_kg": named_kg})
    factor, named, named_kg = F.col("_f"), F.col("_named"), F.col("_named_kg")

    scaled = value * factor["t"] / factor["o"]
    general = (
        F.when(factor["p"] == 0, scaled)
        .when(factor["p"] == 1, scaled * kg)
        .when(factor["p"] == -1, scaled / kg)
        .when((std == "mcg/kg/min") & named, value)
    )
    # The three drug rules and their thresholds.
    norepinephrine = F.when(
        std == "mcg/min",
        F.when(u == "mcg/min", value)
        .when(u == "mcg/kg/min", F.when(value < 1, value * kg).otherwise(value))
        .when(named, value * named_kg),
    )
    remifentanil = F.when(
        std == "mcg/kg/min",
        F.when(u == "mcg/kg/min", F.when(value >= 5, F.lit(0.05)).otherwise(value))
        .when(u == "mcg/min", F.when(value < 1, value).otherwise(value / kg))
        .when(named, value),
    )
    propofol = F.when((std == "mcg/kg/min") & (u.isin("mcg/kg/min", "mcg/min") | named), value)
    converted = (
        F.when(med == "Norepinephrine", norepinephrine)
        .when(med == "Remifentanil", remifentanil)
        .when(med == "Propofol", propofol)
        .otherwise(general)
    )
    return compute_once(read, {output or rate: converted}).drop("_u", "_std", "_kg", "_v", "_f", "_named", "_named_kg")


def repair_decimal_slip(medication: Column | str, rate: Column | str) -> Column:
    """Rates of one drug that are ten or a hundred times too large.  Fixed values: 20 -> /100, 2 -> /10."""
    value = _col(rate)
    repaired = F.when(value >= 20, value / 100).when(value >= 2, value / 10).otherwise(value)
    return F.when(_col(medication) == SLIP_MEDICATION, repaired).otherwise(value)


def within_rate_bounds(
    medication: Column | str, rate: Column | str, bounds: Mapping[str, tuple[float | None, float | None]] = RATE_BOUNDS
) -> Column:
    """Filter condition: false only for a bounded medication outside its bounds."""
    med, value = _col(medication), _col(rate)
    bad = F.lit(False)
    for name, (low, high) in bounds.items():
        if low is not None:
            bad = bad | ((med == name) & (value < low))
        if high is not None:
            bad = bad | ((med == name) & (value > high))
    return ~F.coalesce(bad, F.lit(False))


def convert_measurement(df: DataFrame, label: str = "label", unit: str = "valueuom", value: str = "value") -> DataFrame:
    """Weights to kg, heights to cm, temperatures to Celsius, found by words in the label and the unit."""
    # Label word, unit word, factor, shift before the factor; applied in this order.
    rules = (
        ("weight", "oz", 0.45359237 / 16.0, 0.0),
        ("weight", "lbs", 0.45359237, 0.0),
        ("height", "in", 2.54, 0.0),
        ("temperature", "f", 5.0 / 9.0, -32.0),
    )
    name, uom = F.lower(F.coalesce(F.col(label), F.lit(""))), F.lower(F.coalesce(F.col(unit), F.lit("")))
    out = F.col(value)
    for word, unit_word, factor, shift in rules:
        applies = name.contains(word) & (name.contains(unit_word) | uom.contains(unit_word))
        out = F.when(applies, (out + F.lit(shift)) * F.lit(factor)).otherwise(out)
    return df.withColumn(value, out)
