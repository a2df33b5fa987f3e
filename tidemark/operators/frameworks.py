"""Bucketize, window map, reduce, apply, filter, fill, pivot and partition, as relational plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import Grid, Series
from tidemark.operators.aggregates import Point, build

# --- bucketize ------------------------------------------------------------------------------------


def bucket_end(tick: Column, span: int, last: Column) -> Column:
    """End of the right-closed bucket (end - span, end] of a tick."""
    return tick + F.pmod(last - tick, F.lit(span))


def point_of(s: Series, series: Column | None = None) -> Point:
    c = lambda n: F.col(n) if n in s.df.columns else None
    return Point(F.col(s.tick), F.col(s.value), c("lat"), c("lon"), c("elev"), series, c("seq"))


def bucketize(s: Series, name: str, span: int = 0, last: int = 0, count: int = 0, **params) -> Series:
    """One value per series and bucket. last 0: the series' own last tick; span 0: from count; count 0: from the first tick on.

    With neither last nor count given, the last bucket is rounded up to a multiple of span.
    """
    if not span and not count:
        raise ValueError("a span or a count is needed")
    df = s.df
    own_last, own_first = F.max(s.tick), F.min(s.tick)
    if span and last:
        end = bucket_end(F.col(s.tick), span, F.lit(last))
        kept = df.where(F.col(s.tick) <= last)
        if count:
            kept = kept.where(F.col(s.tick) > last - span * count)
        rows = kept.withColumn("_end", end)
    else:
        edges = df.groupBy(*s.keys).agg(own_last.alias("_last"), own_first.alias("_first"))
        if last:
            edges = edges.withColumn("_last", F.lit(last))
        if span:
            if not count:
                edges = edges.withColumn("_last", bucket_end(F.col("_last"), span, F.lit(0)))
            edges = edges.withColumn("_span", F.lit(span).cast("bigint"))
        else:
            length = F.col("_last") - F.col("_first") + 1
            edges = edges.withColumn("_span", F.expr(f"(_last - _first + 1) div {count}") + F.when(length % count > 0, 1).otherwise(0))
        rows = df.join(edges, list(s.keys)).where(F.col(s.tick) <= F.col("_last"))
        if count:
            rows = rows.where(F.col(s.tick) > F.col("_last") - F.col("_span") * count)
        rows = rows.withColumn("_end", F.col(s.tick) + F.pmod(F.col("_last") - F.col(s.tick), F.col("_span")))
    out = rows.groupBy(*s.keys, F.col("_end").alias("_bucket")).agg(build(name, point_of(s), **params).alias(s.value))
    out = out.withColumnRenamed("_bucket", s.tick).where(F.col(s.value).isNotNull())
    return Series(out, s.keys, s.tick, s.value, Grid(span, last or None, count or None) if span else None)


def bucketize_calendar(s: Series, name: str, months: int = 0, days: int = 0, zone: str = "UTC", **params) -> Series:
    """Calendar buckets of whole months or days; the tick of a bucket is its index from the epoch."""
    local = F.from_utc_timestamp(F.timestamp_micros(F.col(s.tick)), zone)
    if months:
        index = F.floor(((F.year(local) - 1970) * 12 + F.month(local) - 1) / F.lit(months))
    else:
        index = F.floor(F.datediff(local.cast("date"), F.lit("1970-01-01").cast("date")) / F.lit(days))
    rows = s.df.withColumn("_end", index.cast("bigint"))
    out = rows.groupBy(*s.keys, F.col("_end").alias("_bucket")).agg(build(name, point_of(s), **params).alias(s.value))
    return Series(out.withColumnRenamed("_bucket", s.tick).where(F.col(s.value).isNotNull()), s.keys, s.tick, s.value)


def unbucketize_calendar(s: Series, months: int = 0, days: int = 0, zone: str = "UTC") -> Series:
    """Bucket indices turned back into the last microsecond of their bucket."""
    after = F.col(s.tick) + 1
    start = F.add_months(F.lit("1970-01-01").cast("date"), (after * months).cast("int")) if months else F.date_add(F.lit("1970-01-01").cast("date"), (after * days).cast("int"))
    tick = F.unix_micros(F.to_utc_timestamp(start.cast("timestamp"), zone)) - 1
    return s.with_df(s.df.withColumn(s.tick, tick), grid=None)


def unbucketize(s: Series) -> Series:
    return s.with_df(s.df, grid=None)


def scaffold(s: Series) -> DataFrame:
    """Every bucket of every series, with a null value where it is empty."""
    if s.grid is None:
        raise ValueError("the series has no grid")
    g = s.grid
    edges = s.df.groupBy(*s.keys).agg(F.min(s.tick).alias("_first"), F.max(s.tick).alias("_own"))
    last = F.lit(g.last) if g.last else F.col("_own")
    first = last - g.span * (g.count - 1) if g.count else last - F.floor((last - F.col("_first")) / g.span) * g.span
    ticks = edges.select(*s.keys, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(g.span).cast("bigint"))).alias(s.tick))
    return ticks.join(s.df, [*s.keys, s.tick], "left")


# --- map ------------------------------------------------------------------------------------------


def frame(s: Series, pre: int = 0, post: int = 0):
    """Sliding window of a point: counts of points if positive, time spans if negative, nothing if 0."""
    if pre <= 0 and post <= 0 and (pre or post):
        return s.over(F.col(s.tick)).rangeBetween(pre, -post)
    if pre < 0 or post < 0:
        raise ValueError("points and time can't be mixed in one window")
    return s.over().rowsBetween(-pre, post)


def window_map(s: Series, name: str, pre: int = 0, post: int = 0, occurrences: int = 0, step: int = 1, **params) -> Series:
    """An aggregator over the window of each point. Duplicate ticks should be removed first.

    occurrences: so many newest (negative) or oldest results only. step: every so many points.
    On a grid the window moves over all buckets, empty ones included.
    """
    base = Series(scaffold(s), s.keys, s.tick, s.value) if s.grid is not None else s
    w = frame(base, pre, post)
    out = base.df.withColumn("_value", windowed(name, point_of(base), w, **params))
    if occurrences or step > 1:
        number = F.row_number().over(base.over(F.col(s.tick).desc() if occurrences < 0 else F.col(s.tick)))
        out = out.withColumn("_n", number).where((F.col("_n") - 1) % step == 0)
        if occurrences:
            out = out.where(F.col("_n") <= abs(occurrences) * step)
        out = out.drop("_n")
    out = out.withColumn(s.value, F.col("_value")).drop("_value").where(F.col(s.value).isNotNull())
    return s.with_df(out)


def window_maps(s: Series, maps: dict[str, dict], pre: int = 0, post: int = 0, label: str = "mapper") -> Series:
    """Several aggregators {name: parameters} over the same windows, as window_map gives them one by one: a row for each of
    a point's results, named by the key ``label``. The points are read and sorted once for all of them."""
    base = Series(scaffold(s), s.keys, s.tick, s.value) if s.grid is not None else s
    w, p = frame(base, pre, post), point_of(base)
    names = {f"_r{k}": n for k, n in enumerate(maps)}
    rows = base.df.withColumns({c: windowed(n, p, w, **maps[n]) for c, n in names.items()})
    results = F.array(*[F.struct(F.lit(n).alias(label), F.col(c).alias(s.value)) for c, n in names.items()])
    others = [c for c in base.df.columns if c != s.value]
    out = rows.select(*others, F.explode(results).alias("_r")).select(*others, f"_r.{label}", f"_r.{s.value}")
    return Series(out.where(F.col(s.value).isNotNull()), (*s.keys, label), s.tick, s.value, s.grid)


def windowed(name: str, p: Point, w, **params) -> Column:
    """An aggregator as a window expression: its aggregates are put over the frame one by one."""
    if name.removeprefix("mapper.").startswith("dotproduct"):
        weights = params["weights"]
        values = F.collect_list(p.value).over(w)
        dot = F.aggregate(F.zip_with(values, F.array(*[F.lit(float(x)) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        after = {"tanh": F.tanh, "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "positive": lambda x: F.greatest(x, F.lit(0.0))}.get(name.rpartition(".")[2], lambda x: x)
        return F.when(F.size(values) == len(weights), after(dot))
    return build(name, replace(p, window=w), **params)


def strict(s: Series, name: str, least: int, most: int, pre: int = 0, post: int = 0, **params) -> Series:
    """As window_map, but nothing unless the window holds least to most points, or spans so much time if they are negative."""
    w = frame(s, pre, post)
    if least < 0 or most < 0:
        size = F.max(s.tick).over(w) - F.min(s.tick).over(w)
        ok = (size >= abs(least)) & (size <= abs(most))
    else:
        size = F.count(s.value).over(w)
        ok = (size >= least) & (size <= most)
    value = F.when(ok, windowed(name, point_of(s), w, **params))
    return s.with_df(s.df.withColumn("_value", value).withColumn(s.value, F.col("_value")).drop("_value").where(F.col(s.value).isNotNull()))


KERNELS: dict[str, Callable[[Column], Column]] = {
    "uniform": lambda u: F.lit(0.5),
    "triangular": lambda u: 1 - F.abs(u),
    "epanechnikov": lambda u: 0.75 * (1 - u * u),
    "quartic": lambda u: 15 / 16 * F.pow(1 - u * u, F.lit(2)),
    "triweight": lambda u: 35 / 32 * F.pow(1 - u * u, F.lit(3)),
    "tricube": lambda u: 70 / 81 * F.pow(1 - F.pow(F.abs(u), F.lit(3)), F.lit(3)),
    "cosine": lambda u: 0.7853981633974483 * F.cos(u * 1.5707963267948966),
    "gaussian": lambda u: F.exp(-u * u / 2) / 2.5066282746310002,
    "logistic": lambda u: 1 / (F.exp(u) + 2 + F.exp(-u)),
    "silverman": lambda u: 0.5 * F.exp(-u / 1.4142135623730951) * F.sin(0.7853981633974483 * u / 1.4142135623730951),
}


def kernel(s: Series, name: str, step: int, width: int, pre: int, post: int) -> Series:
    """Weighted mean of the window's values. A point floor(|distance| / step) steps away has the kernel's weight at
    that number over half the (odd) width, and none beyond half the width."""
    half = width >> 1
    rows = s.df.withColumn("_near", F.collect_list(F.struct(F.col(s.tick).alias("t"), F.col(s.value).cast("double").alias("v"))).over(frame(s, pre, post)))

    def weight(r: Column) -> Column:
        steps = F.floor(F.abs(r["t"] - F.col(s.tick)) / F.lit(step))
        return F.when(steps <= half, KERNELS[name](steps / F.lit(float(half)))).otherwise(0.0)

    parts = F.transform("_near", lambda r: F.struct(weight(r).alias("k"), r["v"].alias("v")))
    top = F.aggregate(parts, F.lit(0.0), lambda a, r: a + r["k"] * r["v"])
    low = F.aggregate(parts, F.lit(0.0), lambda a, r: a + r["k"])
    return s.with_df(rows.withColumn(s.value, top / F.when(low != 0, low)).drop("_near").where(F.col(s.value).isNotNull()))


# --- reduce, apply --------------------------------------------------------------------------------


def reduce_series(s: Series, by: Sequence[str], name: str, **params) -> Series:
    """One series per partition: an aggregator over the series' values at each tick."""
    needs_count = "forbid-nulls" in name or "include-nulls" in name
    rows, series = s.df, None
    if needs_count:
        counts = s.df.select(*s.keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_series"))
        rows = rows.join(counts, list(by)) if by else rows.crossJoin(counts)  # one row
        series = F.max("_series")
    if name.removeprefix("reducer.") in ("argmin", "argmax"):
        return _arg(s, by, name.endswith("max"), **params)
    out = rows.groupBy(*by, s.tick).agg(build(name, point_of(s, series), **params).alias(s.value))
    return Series(out.where(F.col(s.value).isNotNull()), tuple(by), s.tick, s.value, s.grid)


def _arg(s: Series, by: Sequence[str], most: bool, label: str | None = None, count: int = 0) -> Series:
    """The label values of the series that attain the extreme at each tick, joined by commas; the first ``count``, or all ties."""
    label = label or next(k for k in s.keys if k not in by)
    w = Window.partitionBy(*by, s.tick)
    order = F.col(s.value).desc() if most else F.col(s.value)
    if count:
        rows = s.df.withColumn("_r", F.row_number().over(w.orderBy(order, label))).where(F.col("_r") <= count)
        value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(label).cast("string").alias("l")))), lambda x: x["l"]), ",")
    else:
        rows = s.df.withColumn("_r", F.rank().over(w.orderBy(order))).where("_r = 1")
        value = F.array_join(F.array_sort(F.collect_list(F.col(label).cast("string"))), ",")
    return Series(rows.groupBy(*by, s.tick).agg(value.alias(s.value)), tuple(by), s.tick, s.value)


def aligned(left: Series, right: Series, by: Sequence[str], how: str) -> DataFrame:
    """Rows (by, tick, a, b) of two sets of series, joined on labels and tick."""
    on = [*by, "tick"]
    a = left.df.select(*by, F.col(left.tick).alias("tick"), F.col(left.value).alias("a"), F.lit(True).alias("_a"))
    b = right.df.select(*by, F.col(right.tick).alias("tick"), F.col(right.value).alias("b"), F.lit(True).alias("_b"))
    return a.join(b, on, how)


_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "ge": lambda a, b: a >= b}


def apply_op(left: Series, right: Series, by: Sequence[str], op: str) -> Series:
    """A binary op of two sets of series aligned on labels and tick.

    Arithmetic needs both values, unless the name ends in ``.ignore-nulls``; comparisons give false
    where one is missing; mask keeps right values where left is true, negmask where it is false or missing.
    """
    bare = op.removeprefix("op.")
    loose = bare.endswith(".ignore-nulls")
    bare = bare.removesuffix(".ignore-nulls")
    a, b = F.col("a"), F.col("b")
    if bare in _COMPARE:
        rows, value = aligned(left, right, by, "full"), F.coalesce(_COMPARE[bare](a, b), F.lit(False))
    elif bare == "mask":
        rows, value = aligned(left, right, by, "inner"), F.when(a.cast("boolean"), b)
    elif bare == "negmask":
        rows, value = aligned(left, right, by, "right"), F.when(~F.coalesce(a.cast("boolean"), F.lit(False)), b)
    elif bare in ("and", "or"):
        f = (lambda x, y: x & y) if bare == "and" else (lambda x, y: x | y)
        rows = aligned(left, right, by, "full" if loose else "inner")
        x, y = a.cast("boolean"), b.cast("boolean")
        value = F.coalesce(f(x, y), x, y) if loose else f(x, y)
        if loose:
            value = F.when(a.isNull(), y).when(b.isNull(), x).otherwise(f(x, y))
    else:
        f = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))}[bare]
        if loose:
            rows = aligned(left, right, by, "full")
            value = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))
        else:
            rows, value = aligned(left, right, by, "inner"), f(a, b)
    out = rows.select(*by, "tick", value.alias("value")).where(F.col("value").isNotNull())
    return Series(out, tuple(by), "tick", "value", left.grid)


def apply_all(sets: Sequence[Series], by: Sequence[str], op: str) -> Series:
    """add, mul, and, or over any number of sets."""
    return fold(lambda x, y: apply_op(x, y, by, op), sets)


def common_ticks(s: Series, by: Sequence[str] = ()) -> Series:
    """Points at ticks at which every series of the partition has one."""
    series = s.df.select(*s.keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    at = s.df.select(*s.keys, s.tick).distinct().groupBy(*by, s.tick).agg(F.count(F.lit(1)).alias("_n"))
    both = at.join(series, list(by)) if by else at.crossJoin(series)  # one row
    return s.with_df(s.df.join(both.where("_n = _all").select(*by, s.tick), [*by, s.tick], "left_semi"))


# --- filter ---------------------------------------------------------------------------------------


def keep_series(s: Series, kept: DataFrame) -> Series:
    on = [s.df[k].eqNullSafe(kept[k]) for k in s.keys]
    return s.with_df(s.df.join(kept, on, "left_semi"))


def filter_series(s: Series, name: str, *args, **params) -> Series:
    """Series that pass a filter by name: byclass, bylabels, bysize, last.*, any.*, all.*, latencies."""
    bare = name.removeprefix("filter.")
    v = F.col(s.value)
    if bare == "byclass":
        return s.with_df(s.df.where(text_match(F.col(params.get("column", "class")), args[0])))
    if bare in ("bylabels", "byattr", "bylabelsattr", "byselector"):
        cond = fold(lambda a, b: a & b, [text_match(F.col(k).cast("string"), p) for k, p in args[0].items()], F.lit(True))
        return s.with_df(s.df.where(cond))
    if bare == "bymetadata":
        return keep_series(s, args[0].select(*s.keys).distinct())
    if bare == "bysize":
        kept = s.df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(*args))
        return keep_series(s, kept)
    kind, op = bare.split(".")
    threshold = args[0]
    if kind == "last":
        last = build("last", point_of(s))
        if isinstance(threshold, int) and dict(s.df.dtypes)[s.value] in ("double", "float"):
            last = last.cast("bigint")  # a whole threshold compares whole values
        kept = s.df.groupBy(*s.keys).agg(last.alias("_last")).where(_COMPARE[op](F.col("_last"), F.lit(threshold)))
        return keep_series(s, kept)
    test = _COMPARE[op](v, F.lit(threshold))
    agg = F.bool_or(test) if kind == "any" else F.bool_and(test)
    return keep_series(s, s.df.groupBy(*s.keys).agg(agg.alias("_ok")).where("_ok"))


def text_match(c: Column, pattern: str) -> Column:
    """``=text`` or text: equal; ``~regex``: the regex matches the whole string."""
    if pattern.startswith("~"):
        return c.rlike(f"^(?:{pattern[1:]})$")
    return c == F.lit(pattern.removeprefix("="))


def latencies(requests: Series, answers: Series, by: Sequence[str], least: int, most: int) -> DataFrame:
    """Pairs of points of two sets whose distance in time lies within least..most: (by, tick, latency).

    Both are dealt to buckets of ``most`` ticks, so the join is an equi-join on labels and bucket.
    """
    width = max(1, most)
    a = requests.df.select(*by, F.col(requests.tick).alias("tick"), F.expr(f"floor({requests.tick} / {width})").alias("_cell"))
    b = answers.df.select(*by, F.col(answers.tick).alias("after"), F.explode(F.array(F.expr(f"floor({answers.tick} / {width})"), F.expr(f"floor({answers.tick} / {width}) - 1"))).alias("_cell"))
    rows = a.join(b, [*by, "_cell"]).where((F.col("after") - F.col("tick")).between(least, most))
    return rows.select(*by, "tick", (F.col("after") - F.col("tick")).alias("latency"))


# --- fill -----------------------------------------------------------------------------------------


def _before(s: Series, c: Column | str):
    return F.last(c, ignorenulls=True).over(s.over(F.col(s.tick)).rowsBetween(Window.unboundedPreceding, 0))


def _after(s: Series, c: Column | str):
    # In descending order the frame runs along; one to the end of the series would be evaluated anew for each row.
    return F.last(c, ignorenulls=True).over(s.over(F.col(s.tick).desc()).rowsBetween(Window.unboundedPreceding, 0))


def fill(s: Series, how: str, value=None, ticks: DataFrame | None = None) -> Series:
    """Fills the empty buckets of a grid, or the given ticks (by key and tick): previous, next, value or interpolate (linear in time)."""
    how = how.removeprefix("filler.")
    rows = scaffold(s) if ticks is None else s.df.join(ticks.select(*s.keys, s.tick).distinct(), [*s.keys, s.tick], "full")
    base = Series(rows, s.keys, s.tick, s.value, s.grid)
    filled = rows.withColumn("_v", _filled(base, how, value)).withColumn(s.value, F.col("_v")).drop("_v").where(F.col(s.value).isNotNull())
    return base.with_df(filled)


def _filled(s: Series, how: str, value=None) -> Column:
    """The value of each row, or what a filler puts where it is null."""
    v = F.col(s.value)
    if how == "value":
        return F.coalesce(v, F.lit(value))
    if how == "previous":
        return _before(s, v)
    if how == "next":
        return _after(s, v)
    if how in ("interpolate", "linear"):
        known = F.when(v.isNotNull(), F.col(s.tick))
        t0, t1 = _before(s, known), _after(s, known)
        v0, v1 = _before(s, v), _after(s, v)
        share = (F.col(s.tick) - t0) / F.when(t1 != t0, t1 - t0).cast("double")
        return F.when(v.isNotNull(), v.cast("double")).otherwise(v0 + (v1 - v0) * share)
    raise KeyError(f"no filler named {how!r}")


def crop(s: Series) -> Series:
    """Without the empty buckets at both ends: with points as rows this only moves the grid."""
    return s.with_df(s.df, grid=Grid(s.grid.span) if s.grid else None)


def cross_fill(a: Series, b: Series, by: Sequence[str], how: str = "previous", value=None) -> DataFrame:
    """Two sets of series at the union of their ticks, gaps filled from each one's own points: (by, tick, a, b)."""
    rows = aligned(a, b, by, "full").drop("_a", "_b")
    for c in ("a", "b"):
        rows = rows.withColumn(f"_{c}", _filled(Series(rows, tuple(by), "tick", c), how, value))
    return rows.select(*by, "tick", F.col("_a").alias("a"), F.col("_b").alias("b"))


def fill_ticks(s: Series, ticks: Sequence[int], value, lat: float | None = None, lon: float | None = None, elev: int | None = None) -> Series:
    """A point with the given value and place at each given tick at which a series has none."""
    wanted = s.df.select(*s.keys).distinct().select("*", F.explode(F.array(*[F.lit(t).cast("bigint") for t in ticks])).alias(s.tick))
    place = {c: v for c, v in (("lat", lat), ("lon", lon), ("elev", elev)) if c in s.df.columns}
    types = dict(s.df.dtypes)
    fresh = wanted.join(s.df.select(*s.keys, s.tick).distinct(), [*s.keys, s.tick], "left_anti")
    fresh = fresh.select("*", F.lit(value).cast(types[s.value]).alias(s.value), *[F.lit(v).cast(types[c]).alias(c) for c, v in place.items()])
    return s.with_df(s.df.unionByName(fresh, allowMissingColumns=True))


# --- pivot, partition -----------------------------------------------------------------------------


def pivot(s: Series, labelling: dict[str, Series], by: Sequence[str], all_needed: bool = False) -> Series:
    """Values of the labelling series at the same tick become labels of the points; a missing one leaves its label null, or drops the point."""
    rows = s.df
    for name, other in labelling.items():
        label = other.df.select(*by, F.col(other.tick).alias(s.tick), F.col(other.value).cast("string").alias(name))
        rows = rows.join(label, [*by, s.tick], "inner" if all_needed else "left")
    return Series(rows, (*s.keys, *labelling), s.tick, s.value)


def partition(s: Series, by: Sequence[str]) -> DataFrame:
    """How many series and points each class of labels holds."""
    return s.df.groupBy(*by).agg(F.count_distinct(F.struct(*s.keys)).alias("n_series"), F.count(F.lit(1)).alias("n_points"))


def strict_partition(s: Series, by: Sequence[str]) -> DataFrame:
    """The same, of series that have all the given labels only."""
    known = fold(lambda a, b: a & b, [F.col(k).isNotNull() for k in by], F.lit(True))
    return partition(s.with_df(s.df.where(known)), by)
