"""Colours from heights, noise and time, unit names and text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a unit.
UNITS = {"meters": 1.0, "m": 1.0, "centimeters": 0.01, "cm": 0.01, "millimeters": 0.001, "mm": 0.001, "decimeters": 0.1, "kilometers": 1000.0, "km": 1000.0, "inches": 0.0254, "in": 0.0254, "feet": 0.3048, "ft": 0.3048, "yards": 0.9144, "miles": 1609.344}


def unit_factor(unit: Column) -> Column:
    """Metres in a named unit; null for unknown names."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv]), F.lower(F.trim(unit)))


def signed_byte(value: Column) -> Column:
    """Integer part wrapped to -128..127."""
    return (F.pmod(value.cast("long") + 128, F.lit(256)) - 128).cast("int")


def height_colour(z: Column, period: float = 1.0) -> Column:
    """Cyclic colour of a height: struct of red, green, blue from 0 to 255, the bytes wrapping round as signed ones do."""
    step = signed_byte(z * (256.0 / period))
    part = lambda shift: F.pmod(step + shift, F.lit(256)).cast("int")
    return F.struct(part(0).alias("r"), part(85).alias("g"), part(170).alias("b"))


def noise_colour(stddev: Column, top: float = 0.1) -> Column:
    """Blue without noise to red at `top` or more."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), stddev / top))
    return F.struct(F.floor(255 * f).cast("int").alias("r"), F.lit(0).alias("g"), F.floor(255 * (1 - f)).cast("int").alias("b"))


def time_colour(time: Column, start: Column, end: Column) -> Column:
    """Red over green to blue along a path."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(time - start, end - start), F.lit(0.0))))
    ramp = lambda c: F.floor(255 * F.greatest(F.lit(0.0), 1 - F.abs(f - c) * 2)).cast("int")
    return F.struct(ramp(0.0).alias("r"), ramp(0.5).alias("g"), ramp(1.0).alias("b"))


def palette(name: str, value: Column) -> Column:
    """Colour of a value from 0 to 1 in a named palette: grey, hot, jet or cool; struct of red, green, blue from 0 to 255."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    ramp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    rules = {
        "grey": (v, v, v),
        "hot": (ramp(3 * v), ramp(3 * v - 1), ramp(3 * v - 2)),
        "jet": tuple(ramp(1.5 - F.abs(4 * v - k)) for k in (3, 2, 1)),
        "cool": (v, 1 - v, F.lit(1.0)),
    }
    if name not in rules:
        raise ValueError(f"unknown palette {name}")
    return F.struct(*[F.floor(255 * c).cast("int").alias(n) for c, n in zip(rules[name], "rgb")])


def dataset_name(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def latex_text(text: Column) -> Column:
    """Text with the characters that TeX reserves escaped."""
    out = F.regexp_replace(text, r"\\", r"\\textbackslash ")
    return F.regexp_replace(out, "([" + re.escape("&%$#_{}") + "])", r"\\$1")
