"""Mappers of single points: f(value, tick, lat, lon, elev, **parameters) gives the new value, null to drop the point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.scalars import SCALARS
from tidemark.model import Series

MAPPERS: dict[str, Callable[..., Column]] = {}

_COMPARE = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}
_PARTS = {"": lambda p: p["value"], ".tick": lambda p: p["tick"], ".lat": lambda p: p["lat"], ".lon": lambda p: p["lon"], ".elev": lambda p: p["elev"], ".hhcode": lambda p: geo.hhcode(p["lat"], p["lon"])}
for _op, _f in _COMPARE.items():
    for _part, _get in _PARTS.items():
        MAPPERS[f"mapper.{_op}{_part}"] = (lambda f, get: lambda p, threshold: F.when(f(get(p), F.lit(threshold)), p["value"]))(_f, _get)

MAPPERS |= {
    "mapper.replace": lambda p, value: F.lit(value),
    "mapper.add": lambda p, value: p["value"] + value,
    "mapper.mul": lambda p, value: p["value"] * value,
    "mapper.pow": lambda p, power: F.pow(p["value"], F.lit(float(power))),
    "mapper.sqrt": lambda p: SCALARS["SQRT"](p["value"]),
    "mapper.exp": lambda p, base: F.pow(F.lit(float(base)), p["value"]),
    "mapper.log": lambda p, base: F.when(p["value"] > 0, F.log(float(base), p["value"])),
    "mapper.min.x": lambda p, value: F.least(p["value"], F.lit(value)),
    "mapper.max.x": lambda p, value: F.greatest(p["value"], F.lit(value)),
    "mapper.parsedouble": lambda p: p["value"].try_cast("double"),
    "mapper.tick": lambda p: p["tick"],
    "mapper.lat": lambda p: p["lat"],
    "mapper.lon": lambda p: p["lon"],
    "mapper.elev": lambda p: p["elev"],
    "mapper.npdf": lambda p, mu, sigma: SCALARS["NPDF"](p["value"], F.lit(float(mu)), F.lit(float(sigma))),
    "mapper.abs": lambda p: F.abs(p["value"]),
    "mapper.ceil": lambda p: F.ceil(p["value"]),
    "mapper.floor": lambda p: F.floor(p["value"]),
    "mapper.round": lambda p: SCALARS["ROUND"](p["value"]),
    "mapper.finite": lambda p: F.when(~F.isnan(p["value"].cast("double")) & (F.abs(p["value"].cast("double")) != float("inf")), p["value"]),
    "mapper.toboolean": lambda p: p["value"].cast("boolean"),
    "mapper.tolong": lambda p: p["value"].cast("bigint"),
    "mapper.todouble": lambda p: p["value"].cast("double"),
    "mapper.tostring": lambda p: p["value"].cast("string"),
    "mapper.tanh": lambda p: F.tanh(p["value"]),
    "mapper.sigmoid": lambda p: SCALARS["SIGMOID"](p["value"]),
    "mapper.mod": lambda p, modulus: p["value"] % modulus,
    "mapper.regexp.match": lambda p, pattern: F.when(p["value"].rlike(f"^(?:{pattern})$"), p["value"]),
    "mapper.regexp.replace": lambda p, pattern, by: F.regexp_replace(p["value"], pattern, by),
    "mapper.geo.within": lambda p, shape: F.when(shape(p["lat"], p["lon"]), p["value"]),
    "mapper.geo.outside": lambda p, shape: F.when(~shape(p["lat"], p["lon"]), p["value"]),
    "mapper.geo.fence": lambda p, shape: F.coalesce(shape(p["lat"], p["lon"]), F.lit(False)),
}
for _name in ("YEAR", "MONTH", "DAY", "WEEKDAY", "HOUR", "MINUTE", "SECOND"):
    MAPPERS[f"mapper.{_name.lower()}"] = (lambda n: lambda p: SCALARS[n](p["tick"]))(_name)


def map_points(s: Series, name: str, **params) -> Series:
    """A mapper by its name over every point."""
    p = {c: F.col(c) for c in s.place} | {"value": F.col(s.value), "tick": F.col(s.tick)}
    rows = s.df.withColumn("_v", MAPPERS[name](p, **params))
    return s.with_df(rows.withColumn(s.value, F.col("_v")).drop("_v").where(F.col(s.value).isNotNull()))


def geo_approximate(s: Series, resolution: int) -> Series:
    lat, lon = geo.approximate(F.col("lat"), F.col("lon"), resolution)
    return s.with_df(s.df.withColumn("_a", lat).withColumn("_o", lon).withColumn("lat", F.col("_a")).withColumn("lon", F.col("_o")).drop("_a", "_o"))


def geo_clear(s: Series) -> Series:
    return s.with_df(s.df.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")))
