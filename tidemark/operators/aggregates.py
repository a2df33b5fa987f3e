"""Aggregators, each a builder of one Column over the points of a bucket, a window or a tick.

The same builders serve as bucketizers, mappers and reducers: ``build(name, p, **params)`` gives an
expression that works in groupBy().agg() and, where Spark allows the function there, over a window.
``p`` names the columns of a point.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Point:
    tick: Column
    value: Column
    lat: Column | None = None
    lon: Column | None = None
    elev: Column | None = None
    #: Number of series of the partition, where nulls matter (reducers).
    series: Column | None = None
    seq: Column | None = None
    #: The window that aggregates are put over; none in groupBy().
    window: WindowSpec | None = None

    def of(self, aggregate: Column) -> Column:
        return aggregate if self.window is None else aggregate.over(self.window)

    @property
    def first_key(self) -> Column:
        return F.struct(self.tick, self.seq) if self.seq is not None else self.tick


BUILDERS: dict[str, Callable[..., Column]] = {}


def builder(*names: str):
    def keep(f):
        for n in names:
            BUILDERS[n] = f
        return f

    return keep


def _v(p: Point) -> Column:
    return p.value


@builder("count")
def _count(p: Point) -> Column:
    return p.of(F.count(p.value))


@builder("count.include-nulls")
def _count_all(p: Point) -> Column:
    return p.series if p.series is not None else p.of(F.count(F.lit(1)))


@builder("sum")
def _sum(p: Point) -> Column:
    return p.of(F.sum(p.value))


@builder("mean")
def _mean(p: Point) -> Column:
    return p.of(F.avg(p.value))


@builder("min")
def _min(p: Point) -> Column:
    return p.of(F.min(p.value))


@builder("max")
def _max(p: Point) -> Column:
    return p.of(F.max(p.value))


@builder("first")
def _first(p: Point) -> Column:
    return p.of(F.min_by(p.value, p.first_key))


@builder("last")
def _last(p: Point) -> Column:
    # Of equal newest ticks the one inserted first.
    key = F.struct(p.tick, -p.seq) if p.seq is not None else p.tick
    return p.of(F.max_by(p.value, key))


@builder("median")
def _median(p: Point) -> Column:
    return p.of(F.percentile(p.value, F.lit(0.5)))


@builder("percentile")
def _percentile(p: Point, q: float = 50, kind: int = 1) -> Column:
    """Type 1: the value at ceil(q * n); type 7: interpolated; 2 to 9 as Hyndman and Fan number them."""
    q = q / 100
    if kind == 7:
        return p.of(F.percentile(p.value, F.lit(q)))
    values = F.sort_array(p.of(F.collect_list(p.value)))
    n = F.size(values)
    at = lambda k: F.element_at(values, F.greatest(F.lit(1), F.least(n, k)).cast("int"))
    if kind in (1, 2, 3):
        exact = n * F.lit(q)
        if kind == 1:
            return F.when(n > 0, at(F.ceil(exact)))
        if kind == 2:
            return F.when(n > 0, F.when(exact == F.floor(exact), (at(F.floor(exact)) + at(F.floor(exact) + 1)) / 2).otherwise(at(F.ceil(exact))))
        return F.when(n > 0, at(F.bround(exact, 0)))
    a, b = {4: (0.0, 1.0), 5: (0.5, 0.5), 6: (0.0, 0.0), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}[kind]
    m = a + F.lit(q) * (1 - a - b)
    place = n * F.lit(q) + m
    low = F.floor(place)
    share = place - low
    return F.when(n > 0, at(low) * (1 - share) + at(low + 1) * share)


@builder("mad")
def _mad(p: Point) -> Column:
    # Each array is sorted once, by way of an array of one: an expression named again within a lambda is evaluated at each element.
    values = F.array(F.sort_array(p.of(F.collect_list(p.value.cast("double")))))
    off = lambda s: F.transform(F.array(_middle(s)), lambda m: F.sort_array(F.transform(s, lambda x: F.abs(x - m))))[0]
    return F.transform(F.transform(values, off), _middle)[0]


def _middle(s: Column) -> Column:
    """The median of a sorted array, null if it is empty."""
    n = F.size(s)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, F.greatest(low, F.lit(1))) + F.element_at(s, F.greatest(F.least(high, n), F.lit(1)))) / 2)


@builder("and")
def _and(p: Point) -> Column:
    return p.of(F.bool_and(p.value.cast("boolean")))


@builder("or")
def _or(p: Point) -> Column:
    return p.of(F.bool_or(p.value.cast("boolean")))


@builder("join")
def _join(p: Point, separator: str = ",") -> Column:
    key = p.first_key
    rows = F.array_sort(p.of(F.collect_list(F.struct(key.alias("k"), p.value.cast("string").alias("v")))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


@builder("mean.circular")
def _circular(p: Point, period: float = 360.0) -> Column:
    turn = 2 * math.pi / period
    angle = F.atan2(p.of(F.avg(F.sin(p.value * turn))), p.of(F.avg(F.cos(p.value * turn)))) / turn
    return F.when(angle < 0, angle + period).otherwise(angle)


@builder("rms")
def _rms(p: Point) -> Column:
    return F.sqrt(p.of(F.avg(p.value * p.value)))


@builder("var", "var.welford")
def _var(p: Point, bessel: bool = True) -> Column:
    n = p.of(F.count(p.value))
    return F.when(n == 1, F.lit(0.0)).otherwise(p.of(F.var_samp(p.value)) if bessel else p.of(F.var_pop(p.value)))


@builder("sd", "sd.welford")
def _sd(p: Point, bessel: bool = True) -> Column:
    n = p.of(F.count(p.value))
    return F.when(n == 1, F.lit(0.0)).otherwise(p.of(F.stddev_samp(p.value)) if bessel else p.of(F.stddev_pop(p.value)))


@builder("highest")
def _highest(p: Point) -> Column:
    return p.of(F.max_by(p.value, F.struct(p.elev, p.tick)))


@builder("lowest")
def _lowest(p: Point) -> Column:
    return p.of(F.min_by(p.value, F.struct(p.elev, -p.tick)))


@builder("delta")
def _delta(p: Point) -> Column:
    return _last(p) - _first(p)


@builder("rate")
def _rate(p: Point) -> Column:
    span = (p.of(F.max(p.tick)) - p.of(F.min(p.tick))) / F.lit(1e6)
    return F.when(span == 0, _delta(p).cast("double")).otherwise(_delta(p) / F.when(span != 0, span))


@builder("vspeed")
def _vspeed(p: Point) -> Column:
    span = (p.of(F.max(p.tick)) - p.of(F.min(p.tick))) / F.lit(1e6)
    rise = (p.of(F.max_by(p.elev, p.tick)) - p.of(F.min_by(p.elev, p.tick))) / F.lit(1000.0)
    return F.when(span == 0, F.lit(0.0)).otherwise(rise / F.when(span != 0, span))


@builder("vdist")
def _vdist(p: Point) -> Column:
    """Metres climbed and sunk; elevations are in millimetres."""
    rows = F.array_sort(p.of(F.collect_list(F.when(p.elev.isNotNull(), F.struct(p.tick.alias("t"), p.elev.alias("e"))))))
    steps = F.zip_with(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda a, b: F.abs(b["e"] - a["e"]))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.lit(1000.0)


@builder("product")
def _product(p: Point) -> Column:
    return p.of(F.product(p.value))


@builder("entropy.0", "shannonentropy.0")
def _entropy0(p: Point) -> Column:
    return _entropy(p, 0.0)


@builder("entropy.1", "shannonentropy.1")
def _entropy1(p: Point) -> Column:
    return _entropy(p, 1.0)


def _entropy(p: Point, alone: float) -> Column:
    """Of the values taken as counts, divided by the log of how many there are."""
    n, total = p.of(F.count(p.value)), p.of(F.sum(p.value)).cast("double")
    h = F.log(total) - p.of(F.sum(p.value * F.log(F.when(p.value > 0, p.value)))) / total
    return F.when(n == 1, F.lit(alone)).otherwise(h / F.log(F.when(n > 1, n.cast("double"))))


@builder("range")
def _range(p: Point) -> Column:
    return p.of(F.max(p.value)) - p.of(F.min(p.value))


@builder("mode")
def _mode(p: Point) -> Column:
    return p.of(F.mode(p.value, True))


SKIP = ".exclude-nulls", ".nonnull", ".ignore-nulls"


def build(name: str, p: Point, **params) -> Column:
    """The Column of an aggregator by its name, with or without a role before it and a null rule behind it.

    ``forbid-nulls`` gives null where a series of the partition has no value at the tick; that
    needs p.series. The other rules skip missing values, which aggregation does by itself.
    """
    bare = name
    for role in ("bucketizer.", "mapper.", "reducer."):
        bare = bare.removeprefix(role)
    strict = bare.endswith(".forbid-nulls")
    for rule in (*SKIP, ".forbid-nulls"):
        if bare not in BUILDERS:
            bare = bare.removesuffix(rule)
    if bare == "join.urlencoded":
        p = replace(p, value=F.url_encode(p.value.cast("string")))
        bare = "join"
    if bare not in BUILDERS:
        raise KeyError(f"no aggregator named {name!r}")
    out = BUILDERS[bare](p, **params)
    return F.when(p.of(F.count(p.value)) == p.series, out) if strict and p.series is not None else out
