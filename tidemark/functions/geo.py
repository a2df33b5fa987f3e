"""Geo expressions over latitude and longitude columns, in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import Series

#: Mean earth radius in metres.
RADIUS = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def rhumb(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance along the line of constant course, in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    d_lon = F.radians(F.abs(lon2 - lon1))
    d_lon = F.least(d_lon, 6.283185307179586 - d_lon)
    stretch = F.log(F.tan(0.7853981633974483 + p2 / 2) / F.tan(0.7853981633974483 + p1 / 2))
    q = F.when(F.abs(stretch) > 1e-12, (p2 - p1) / F.when(stretch != 0, stretch)).otherwise(F.cos(p1))
    return RADIUS * F.sqrt(F.pow(p2 - p1, F.lit(2)) + F.pow(q * d_lon, F.lit(2)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course of the great circle, 0 to 360 degrees."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def _spread(x: Column) -> Column:
    """32 bits to every other bit of 64."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def hhcode(lat: Column, lon: Column) -> Column:
    """64-bit code of interleaved 32-bit latitude and longitude, latitude on the higher bit of each pair."""
    whole = lambda v, low, width: F.least(F.floor((v - low) / width * 4294967296.0), F.lit(4294967295)).cast("bigint")
    y, x = whole(lat, -90.0, 180.0), whole(lon, -180.0, 360.0)
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return x


def hhcode_lat(code: Column) -> Column:
    return _gather(F.shiftrightunsigned(code, 1)) / 4294967296.0 * 180.0 - 90.0


def hhcode_lon(code: Column) -> Column:
    return _gather(code) / 4294967296.0 * 360.0 - 180.0


def cell(lat: Column, lon: Column, resolution: int) -> Column:
    """Prefix of the code as hexadecimal text; ``resolution`` bits, even, from 2 to 32, halved per axis."""
    return F.substring(F.lower(F.lpad(F.hex(hhcode(lat, lon)), 16, "0")), 1, max(1, resolution // 2))


def approximate(lat: Column, lon: Column, resolution: int) -> tuple[Column, Column]:
    """The place moved to the corner of its cell."""
    keep = F.lit((-1 << (64 - 2 * resolution)) if resolution < 32 else -1)
    code = hhcode(lat, lon).bitwiseAND(keep)
    return hhcode_lat(code), hhcode_lon(code)


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, length: int = 9) -> Column:
    """The usual geohash: bits of longitude and latitude in turn, five to a letter."""
    bits = 5 * length
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * float(1 << nx)), F.lit((1 << nx) - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << ny)), F.lit((1 << ny) - 1)).cast("bigint")
    letters = []
    for k in range(length):
        value = F.lit(0)
        for j in range(5):
            b = 5 * k + j
            source, at = (x, nx - 1 - b // 2) if b % 2 == 0 else (y, ny - 1 - b // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1))
        letters.append(F.substr(F.lit(_BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def from_geohash(text: Column, length: int = 9) -> Column:
    """(lat, lon) of the corner of a geohash of so many letters."""
    bits = 5 * length
    x, y = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for k in range(length):
        value = F.instr(F.lit(_BASE32), F.lower(F.substr(text, F.lit(k + 1), F.lit(1)))) - 1
        for j in range(5):
            bit = F.shiftright(value, 4 - j).bitwiseAND(F.lit(1))
            if (5 * k + j) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    return F.struct((y / float(1 << bits // 2) * 180.0 - 90.0).alias("lat"), (x / float(1 << (bits + 1) // 2) * 360.0 - 180.0).alias("lon"))


def from_hhcode(code: Column) -> Column:
    return F.struct(hhcode_lat(code).alias("lat"), hhcode_lon(code).alias("lon"))


def hhcode_text(lat: Column, lon: Column) -> Column:
    return F.lower(F.lpad(F.hex(hhcode(lat, lon)), 16, "0"))


def within_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def within_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a ring of (lat, lon)."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def bbox(s: Series) -> DataFrame:
    return s.df.groupBy(*s.keys).agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def all_within(s: Series, inside: Column) -> DataFrame:
    """Series whose located points all lie inside; a series needs one."""
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return s.df.where(known).groupBy(*s.keys).agg(F.bool_and(inside).alias("within"), F.bool_or(inside).alias("intersects"))


def _steps(s: Series):
    w = s.over()
    at = lambda c: F.lag(c).over(w)
    return at("lat"), at("lon"), F.col("lat"), F.col("lon")


def distance(s: Series) -> Series:
    """Metres travelled so far, along rhumb lines."""
    rows = s.df.where("lat is not null and lon is not null")
    base = s.with_df(rows)
    rows = rows.withColumn("_d", F.coalesce(rhumb(*_steps(base)), F.lit(0.0)))
    total = F.sum("_d").over(s.over().rowsBetween(Window.unboundedPreceding, 0))
    return s.with_df(rows.withColumn("_v", total).withColumn(s.value, F.col("_v")).drop("_v", "_d"))


def speed(s: Series) -> Series:
    """Metres a second since the point before."""
    base = s.with_df(s.df.where("lat is not null and lon is not null"))
    seconds = (F.col(s.tick) - F.lag(s.tick).over(s.over())) / 1e6
    value = rhumb(*_steps(base)) / F.when(seconds != 0, seconds)
    return s.with_df(base.df.withColumn("_v", value).withColumn(s.value, F.col("_v")).drop("_v").where(F.col(s.value).isNotNull()))


def course(s: Series) -> Series:
    base = s.with_df(s.df.where("lat is not null and lon is not null"))
    return s.with_df(base.df.withColumn("_v", bearing(*_steps(base))).withColumn(s.value, F.col("_v")).drop("_v").where(F.col(s.value).isNotNull()))
