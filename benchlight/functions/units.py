"""Units as data: a symbol, its scale to SI base units and its exponents.

The table is generated from base units and prefixes. Small config tables
(calibrations) look units up in a constant map; large tables join the units
table on the symbol.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlight.session import literal_rows

# --- fixed values: exponents of (metre, kilogram, second, ampere, kelvin) ----
_PREFIXABLE = {
    # symbol: (name, scale to SI, exponents)
    "m": ("meter", 1.0, (1, 0, 0, 0, 0)),
    "g": ("gram", 1e-3, (0, 1, 0, 0, 0)),
    "s": ("second", 1.0, (0, 0, 1, 0, 0)),
    "A": ("ampere", 1.0, (0, 0, 0, 1, 0)),
    "K": ("kelvin", 1.0, (0, 0, 0, 0, 1)),
    "Hz": ("hertz", 1.0, (0, 0, -1, 0, 0)),
    "N": ("newton", 1.0, (1, 1, -2, 0, 0)),
    "Pa": ("pascal", 1.0, (-1, 1, -2, 0, 0)),
    "bar": ("bar", 1e5, (-1, 1, -2, 0, 0)),
    "J": ("joule", 1.0, (2, 1, -2, 0, 0)),
    "W": ("watt", 1.0, (2, 1, -3, 0, 0)),
    "V": ("volt", 1.0, (2, 1, -3, -1, 0)),
    "Ω": ("ohm", 1.0, (2, 1, -3, -2, 0)),
    "T": ("tesla", 1.0, (0, 1, -2, -1, 0)),
}
_PREFIXES = {
    # symbol: (name, factor)
    "p": ("pico", 1e-12),
    "n": ("nano", 1e-9),
    "µ": ("micro", 1e-6),
    "m": ("milli", 1e-3),
    "c": ("centi", 1e-2),
    "k": ("kilo", 1e3),
    "M": ("mega", 1e6),
    "G": ("giga", 1e9),
    "T": ("tera", 1e12),
}
_PLAIN = {
    # symbol: (name, scale to SI, exponents, offset unit)
    "": ("dimensionless", 1.0, (0, 0, 0, 0, 0), False),
    "min": ("minute", 60.0, (0, 0, 1, 0, 0), False),
    "h": ("hour", 3600.0, (0, 0, 1, 0, 0), False),
    "d": ("day", 86400.0, (0, 0, 1, 0, 0), False),
    "torr": ("torr", 101325.0 / 760.0, (-1, 1, -2, 0, 0), False),
    "Δ°C": ("delta_degC", 1.0, (0, 0, 0, 0, 1), False),
    "Δ°F": ("delta_degF", 5.0 / 9.0, (0, 0, 0, 0, 1), False),
    "°C": ("degC", 1.0, (0, 0, 0, 0, 1), True),
    "°F": ("degF", 5.0 / 9.0, (0, 0, 0, 0, 1), True),
}

UNIT_TYPE = "struct<symbol:string,scale:double,dims:array<int>,offset_unit:boolean>"
VOLT_DIMS = list(_PREFIXABLE["V"][2])
TIME_DIMS = list(_PREFIXABLE["s"][2])


@functools.cache
def unit_rows() -> tuple[tuple[str, str, float, tuple[int, ...], bool], ...]:
    """Every accepted spelling as (spelling, symbol, scale, exponents, offset unit)."""
    rows = {}
    for symbol, (name, scale, dims, offset) in _PLAIN.items():
        for spelling in (symbol, name):
            rows[spelling] = (symbol, scale, dims, offset)
    for symbol, (name, scale, dims) in _PREFIXABLE.items():
        for spelling in (symbol, name):
            rows[spelling] = (symbol, scale, dims, False)
        for prefix, (prefix_name, power) in _PREFIXES.items():
            entry = (prefix + symbol, _scaled(scale, power), dims, False)
            rows[prefix + symbol] = entry
            rows[prefix_name + name] = entry
            if prefix == "µ":
                rows["u" + symbol] = entry
                rows["μ" + symbol] = entry
    return tuple((spelling, *entry) for spelling, entry in rows.items())


def _scaled(scale: float, power: float) -> float:
    """The product as the nearest decimal, so a millibar is exactly 100 pascal."""
    return float(f"{scale * power:.15g}")


def units_table(spark: SparkSession) -> DataFrame:
    """The units as rows, for joins against large tables."""
    names = ("spelling", "symbol", "scale", "dims", "offset_unit")
    return literal_rows(
        spark,
        [dict(zip(names, row)) for row in unit_rows()],
        "spelling string, symbol string, scale double, dims array<int>, offset_unit boolean",
    )


@functools.cache
def _units_json() -> str:
    return json.dumps(
        {
            spelling: {"symbol": symbol, "scale": scale, "dims": dims, "offset_unit": offset}
            for spelling, symbol, scale, dims, offset in unit_rows()
        }
    )


def lookup(spellings: dict[str, Column | str]) -> Column:
    """The units several spellings name, as an array in that order.

    For small config tables: the units are one constant map. A spelling that names
    no unit gives NULL, a NULL spelling the dimensionless unit.
    """
    units = F.from_json(F.lit(_units_json()), f"map<string,{UNIT_TYPE}>")
    texts = F.array(*[F.expr(c) if isinstance(c, str) else c for c in spellings.values()])
    return F.transform(
        texts, lambda t: F.try_element_at(units, F.coalesce(F.trim(t), F.lit("")))
    )


def dims_lit(dims: list[int]) -> Column:
    return F.expr(dims_sql(dims))


def dims_sql(dims: list[int]) -> str:
    return f"array({','.join(map(str, dims))})"


def convert_units(
    df: DataFrame, to: str, value: str = "value", unit: str = "unit"
) -> DataFrame:
    """``value`` of every row in the unit ``to``, as ``converted``.

    ``violation`` is true, and ``converted`` NULL, where the dimensions differ,
    the unit is unknown, or scaling would be ambiguous (an offset unit).
    """
    spark = df.sparkSession
    table = {row[0]: row for row in unit_rows()}
    if to not in table:
        raise ValueError(f"unknown unit {to!r}")
    _, symbol, scale, dims, offset = table[to]
    known = units_table(spark).select(
        F.col("spelling").alias("_spelling"),
        F.col("scale").alias("_scale"),
        ((F.col("dims") == dims_lit(list(dims))) & ~F.col("offset_unit")).alias("_fits"),
    )
    fits = F.coalesce(F.col("_fits"), F.lit(False)) & F.lit(not offset)
    return (
        df.join(known, F.coalesce(F.col(unit), F.lit("")) == F.col("_spelling"), "left")
        .withColumn("converted", F.when(fits, F.col(value) * (F.col("_scale") / F.lit(scale))))
        .withColumn("converted_unit", F.lit(symbol))
        .withColumn("violation", ~fits)
        .drop("_spelling", "_scale", "_fits")
    )
