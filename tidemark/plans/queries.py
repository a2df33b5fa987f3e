"""Queries over the driver's tables, each with its SQL for DuckDB beside it.

Series come from ``events`` (class = event_type, label user_id, tick in microseconds, seq =
event_id) and from ``orders`` and ``lineitem``. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo, udfs
from tidemark.functions.scalars import SCALARS
from tidemark.model import Series, from_table, micros
from tidemark.operators import frameworks as fw
from tidemark.operators import series as ops
from tidemark.operators import mappers, meta, patterns, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DAY = 86_400_000_000
HOUR = 3_600_000_000
#: End of the last bucket of the fixed grids: 2024-02-01.
LAST = 1_706_745_600_000_000

EV = "(SELECT event_type AS class, user_id, epoch_us(ts) AS tick, value, event_id AS seq FROM events)"


#: Added before rounding on both sides, so that sums in another order don't fall on either side of a half.
NUDGE = 1e-7


def nudged(sql: str) -> str:
    """The SQL with NUDGE added to what each round() rounds."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += (sql[j] == "(") - (sql[j] == ")")
            if depth == 1 and sql[j] == ",":
                comma = j
            j += 1
        inner = nudged(sql[i + 6 : comma])
        out += sql[at:i] + f"round(({inner}) + {NUDGE}" + sql[comma:j]
        at = j
    return out + sql[at:]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = nudged(sql)
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, user: bool = False) -> Series:
    keys: dict = {"class": "event_type"} | ({"user_id": "user_id"} if user else {})
    return from_table(read(spark, d, "events"), keys, micros(F.col("ts")), "value", "event_id")


def spread_out(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, before slow work on each: a file of few row groups is read by as few tasks."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def r(c: Column | str, n: int = 4) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, n)


def out(s: Series, *keys: str, n: int | None = 4) -> DataFrame:
    value = F.col(s.value)
    return s.df.select(*[F.col(k) for k in (keys or s.keys)], F.col(s.tick).alias("tick"), (r(value, n) if n is not None else value).alias("value"))


# --- bucketize ------------------------------------------------------------------------------------

END = f"(tick + (({LAST} - tick) % {DAY} + {DAY}) % {DAY})"
_BUCKETS = {
    "mean": ("avg(value)", {}),
    "sum": ("sum(value)", {}),
    "min": ("min(value)", {}),
    "max": ("max(value)", {}),
    "count": ("count(value)", {}),
    "first": ("arg_min(value, (tick, seq))", {}),
    "last": ("arg_max(value, (tick, -seq))", {}),
    "median": ("quantile_cont(value, 0.5)", {}),
    "percentile": ("quantile_disc(value, 0.9)", {"q": 90}),
    "sd": ("coalesce(stddev_samp(value), 0.0)", {}),
    "var": ("coalesce(var_samp(value), 0.0)", {}),
    "rms": ("sqrt(avg(value * value))", {}),
    "range": ("max(value) - min(value)", {}),
    "mad": ("mad(value)", {}),
}


def _bucket_query(name: str, params: dict):
    def run(spark, d):
        return out(fw.bucketize(events(spark, d), name, span=DAY, last=LAST, **params))

    return run


for _name, (_sql, _params) in _BUCKETS.items():
    query(f"bucketize_{_name}", f"SELECT class, tick, round(value, 4) AS value FROM (SELECT class, {END} AS tick, {_sql} AS value FROM {EV} WHERE tick <= {LAST} GROUP BY ALL)")(_bucket_query(_name, _params))

query("bucketize_and", f"SELECT class, {END} AS tick, bool_and(value > 5) AS value FROM {EV} WHERE tick <= {LAST} GROUP BY ALL")(lambda spark, d: out(fw.bucketize(ops.map_value(events(spark, d), lambda v: v > 5), "and", span=DAY, last=LAST), n=None))
query("bucketize_or", f"SELECT class, {END} AS tick, bool_or(value > 90) AS value FROM {EV} WHERE tick <= {LAST} GROUP BY ALL")(lambda spark, d: out(fw.bucketize(ops.map_value(events(spark, d), lambda v: v > 90), "or", span=DAY, last=LAST), n=None))
query("bucketize_join", f"SELECT class, {END} AS tick, string_agg(user_id::VARCHAR, ',' ORDER BY tick, seq) AS value FROM {EV} WHERE tick <= {LAST} GROUP BY ALL")(
    lambda spark, d: out(fw.bucketize(from_table(read(spark, d, "events"), {"class": "event_type"}, micros(F.col("ts")), F.col("user_id").cast("string"), "event_id"), "join", span=DAY, last=LAST), n=None)
)
query("bucketize_circular", f"SELECT class, tick, round(CASE WHEN a < 0 THEN a + 24 ELSE a END, 4) AS value FROM (SELECT class, {END} AS tick, atan2(avg(sin(value * 2 * pi() / 24)), avg(cos(value * 2 * pi() / 24))) * 24 / (2 * pi()) AS a FROM {EV} WHERE tick <= {LAST} GROUP BY ALL)")(
    lambda spark, d: out(fw.bucketize(events(spark, d), "mean.circular", span=DAY, last=LAST, period=24.0))
)
query(
    "bucketize_auto_last",
    f"WITH e AS (SELECT class, tick, value, max(tick) OVER (PARTITION BY class) AS l FROM {EV}), g AS (SELECT *, l + (({HOUR} - l % {HOUR}) % {HOUR}) AS last FROM e) SELECT class, tick + ((last - tick) % {HOUR}) AS tick, round(sum(value), 4) AS value FROM g GROUP BY ALL",
)(lambda spark, d: out(fw.bucketize(events(spark, d), "sum", span=HOUR)))
query(
    "bucketize_auto_span",
    f"WITH e AS (SELECT class, tick, value, max(tick) OVER (PARTITION BY class) AS l, min(tick) OVER (PARTITION BY class) AS f FROM {EV}), g AS (SELECT *, (l - f + 1) // 10 + CASE WHEN (l - f + 1) % 10 > 0 THEN 1 ELSE 0 END AS span FROM e) SELECT class, tick + ((l - tick) % span) AS tick, round(avg(value), 4) AS value FROM g WHERE tick > l - span * 10 GROUP BY ALL",
)(lambda spark, d: out(fw.bucketize(events(spark, d), "mean", count=10)))
query("bucketize_calendar_month", "SELECT o_orderstatus AS class, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS tick, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")(
    lambda spark, d: out(fw.bucketize_calendar(from_table(read(spark, d, "orders"), {"class": "o_orderstatus"}, micros(F.col("o_orderdate")), "o_totalprice"), "sum", months=1), n=2)
)
query("unbucketize_calendar", "SELECT o_orderstatus AS class, epoch_us(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) - 1 AS tick, count(*) AS value FROM orders GROUP BY ALL")(
    lambda spark, d: out(fw.unbucketize_calendar(fw.bucketize_calendar(from_table(read(spark, d, "orders"), {"class": "o_orderstatus"}, micros(F.col("o_orderdate")), "o_totalprice"), "count", months=1), months=1), n=None)
)

# --- reduce ---------------------------------------------------------------------------------------

USER_DAY = f"(SELECT class, user_id, {END} AS tick, sum(value) AS value, count(*) AS n FROM {EV} WHERE tick <= {LAST} GROUP BY ALL)"


def user_days(spark, d, name: str = "sum") -> Series:
    return fw.bucketize(events(spark, d, user=True), name, span=DAY, last=LAST)


_REDUCERS = {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)", "median": "quantile_cont(value, 0.5)", "sd": "coalesce(stddev_samp(value), 0.0)", "rms": "sqrt(avg(value * value))", "percentile": "quantile_disc(value, 0.5)"}
for _name, _sql in _REDUCERS.items():
    query(f"reduce_{_name}", f"SELECT class, tick, round({_sql}, 4) AS value FROM {USER_DAY} GROUP BY ALL")((lambda n: lambda spark, d: out(fw.reduce_series(user_days(spark, d), ["class"], n)))(_name))

query("reduce_sum_forbid_nulls", f"WITH s AS (SELECT class, count(DISTINCT user_id) AS n FROM {USER_DAY} GROUP BY class) SELECT u.class, tick, round(sum(value), 4) AS value FROM {USER_DAY} u JOIN s USING (class) GROUP BY u.class, tick, s.n HAVING count(*) = s.n")(
    lambda spark, d: out(fw.reduce_series(user_days(spark, d), ["class"], "reducer.sum.forbid-nulls"))
)
query("reduce_count_include_nulls", f"WITH s AS (SELECT class, count(DISTINCT user_id) AS n FROM {USER_DAY} GROUP BY class) SELECT u.class, tick, max(s.n) AS value FROM {USER_DAY} u JOIN s USING (class) GROUP BY ALL")(
    lambda spark, d: out(fw.reduce_series(user_days(spark, d), ["class"], "reducer.count.include-nulls"), n=None)
)
query("reduce_argmax", f"SELECT class, tick, string_agg(user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS value FROM (SELECT *, rank() OVER (PARTITION BY class, tick ORDER BY n DESC) AS k FROM {USER_DAY}) WHERE k = 1 GROUP BY ALL")(
    lambda spark, d: out(fw.reduce_series(user_days(spark, d, "count"), ["class"], "reducer.argmax", label="user_id"), n=None)
)
query("reduce_entropy", f"SELECT class, tick, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(CASE WHEN count(*) > 1 THEN count(*) END) END, 4) AS value FROM {USER_DAY} GROUP BY ALL")(
    lambda spark, d: out(fw.reduce_series(user_days(spark, d, "count"), ["class"], "reducer.shannonentropy.0"))
)

# --- windows --------------------------------------------------------------------------------------

UEV = f"(SELECT class, user_id, tick, value FROM {EV})"
_W = "(PARTITION BY class, user_id ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"
_WT = f"(PARTITION BY class, user_id ORDER BY tick RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"
_MAPPERS = {"mean": "avg(value) OVER {w}", "sum": "sum(value) OVER {w}", "max": "max(value) OVER {w}", "min": "min(value) OVER {w}", "count": "count(value) OVER {w}", "sd": "coalesce(stddev_samp(value) OVER {w}, 0.0)", "rms": "sqrt(avg(value * value) OVER {w})", "delta": "last(value) OVER {w} - first(value) OVER {w}"}


def users(spark, d) -> Series:
    return ops.dedup(events(spark, d, user=True))


DEV = f"(SELECT class, user_id, tick, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY class, user_id, tick ORDER BY seq DESC) AS k FROM {EV}) WHERE k = 1)"
for _name, _sql in _MAPPERS.items():
    query(f"map_{_name}_points", f"SELECT class, user_id, tick, round({_sql.format(w=_W)}, 4) AS value FROM {DEV}")((lambda n: lambda spark, d: out(fw.window_map(users(spark, d), n, 2, 1)))(_name))
    query(f"map_{_name}_time", f"SELECT class, user_id, tick, round({_sql.format(w=_WT)}, 4) AS value FROM {DEV}")((lambda n: lambda spark, d: out(fw.window_map(users(spark, d), n, -DAY, 0)))(_name))
query("map_rate", f"SELECT class, user_id, tick, round(CASE WHEN tick = p THEN value - v ELSE (value - v) / ((tick - p) / 1e6) END, 6) AS value FROM (SELECT *, coalesce(lag(tick) OVER w, tick) AS p, coalesce(lag(value) OVER w, value) AS v FROM {DEV} WINDOW w AS (PARTITION BY class, user_id ORDER BY tick))")(
    lambda spark, d: out(fw.window_map(users(spark, d), "rate", 1, 0), n=6)
)
query("map_occurrences", f"SELECT class, user_id, tick, round(value, 4) AS value FROM (SELECT class, user_id, tick, sum(value) OVER {_W} AS value, row_number() OVER (PARTITION BY class, user_id ORDER BY tick DESC) AS k FROM {DEV}) WHERE k <= 3")(
    lambda spark, d: out(fw.window_map(users(spark, d), "sum", 2, 1, occurrences=-3))
)
query("map_step", f"SELECT class, user_id, tick, round(value, 4) AS value FROM (SELECT class, user_id, tick, sum(value) OVER {_W} AS value, row_number() OVER (PARTITION BY class, user_id ORDER BY tick) AS k FROM {DEV}) WHERE (k - 1) % 4 = 0")(
    lambda spark, d: out(fw.window_map(users(spark, d), "sum", 2, 1, step=4))
)
query("map_strict", f"SELECT class, user_id, tick, round(value, 4) AS value FROM (SELECT class, user_id, tick, avg(value) OVER {_W} AS value, count(value) OVER {_W} AS n FROM {DEV}) WHERE n BETWEEN 4 AND 4")(
    lambda spark, d: out(fw.strict(users(spark, d), "mean", 4, 4, 2, 1))
)
_SINGLE = {
    "abs": ("abs(value - 50)", {}, lambda v: v - 50),
    "sqrt": ("sqrt(value)", {}, None),
    "tanh": ("(exp(2 * value / 100) - 1) / (exp(2 * value / 100) + 1)", {}, lambda v: v / 100),
    "sigmoid": ("1 / (1 + exp(-value / 100))", {}, lambda v: v / 100),
    "gt": ("CASE WHEN value > 50 THEN value END", {"threshold": 50.0}, None),
    "mod": ("value % 7", {"modulus": 7}, None),
    "round": ("floor(value + 0.5)", {}, None),
    "npdf": ("exp(-(pow((value - 50) / 10, 2)) / 2) / (10 * sqrt(2 * pi()))", {"mu": 50, "sigma": 10}, None),
    "replace": ("1.0", {"value": 1.0}, None),
}
for _name, (_sql, _params, _first) in _SINGLE.items():
    query(f"mapper_{_name}", f"SELECT * FROM (SELECT class, user_id, tick, round({_sql}, 4) AS value FROM {EV}) WHERE value IS NOT NULL")(
        (lambda n, p, f: lambda spark, d: out(mappers.map_points(ops.map_value(events(spark, d, user=True), f) if f else events(spark, d, user=True), f"mapper.{n}", **p)))(_name, _params, _first)
    )

# --- apply, filter --------------------------------------------------------------------------------

DAYSUM = f"(SELECT class, {END} AS tick, sum(value) AS value FROM {EV} WHERE tick <= {LAST} GROUP BY ALL)"


def _two(spark, d) -> tuple[Series, Series]:
    """Daily sums of all users of the two first event types by name."""
    s = user_days(spark, d)
    types = s.df.select("class").distinct().orderBy("class").limit(2)
    first = types.orderBy("class").limit(1)
    second = types.join(first, "class", "left_anti")
    make = lambda t: Series(s.df.join(t, "class", "left_semi").select("user_id", "tick", "value"), ("user_id",), grid=s.grid)
    return make(first), make(second)


_TWO = f"WITH t AS (SELECT class, row_number() OVER (ORDER BY class) AS k FROM (SELECT DISTINCT class FROM {EV})), u AS {USER_DAY}, a AS (SELECT user_id, tick, value AS x FROM u JOIN t USING (class) WHERE k = 1), b AS (SELECT user_id, tick, value AS y FROM u JOIN t USING (class) WHERE k = 2) "
for _name, _sql, _how in (
    ("op.add", "x + y", "JOIN"),
    ("op.sub", "x - y", "JOIN"),
    ("op.mul", "x * y", "JOIN"),
    ("op.div", "x / nullif(y, 0)", "JOIN"),
    ("op.add.ignore-nulls", "coalesce(x, 0) + coalesce(y, 0)", "FULL JOIN"),
    ("op.lt", "coalesce(x < y, false)", "FULL JOIN"),
    ("op.ge", "coalesce(x >= y, false)", "FULL JOIN"),
    ("op.eq", "coalesce(x = y, false)", "FULL JOIN"),
    ("op.ne", "coalesce(x <> y, false)", "FULL JOIN"),
):
    _bool = "coalesce" in _sql and "nulls" not in _name
    _value = f"{_sql}" if _bool else f"round({_sql}, 4)"
    query("apply_" + _name[3:].replace(".", "_").replace("-", "_"), _TWO + f"SELECT * FROM (SELECT user_id, tick, {_value} AS value FROM a {_how} b USING (user_id, tick)) WHERE value IS NOT NULL")(
        (lambda n, b: lambda spark, d: out(fw.apply_op(*_two(spark, d), ["user_id"], n), n=None if b else 4))(_name, _bool)
    )
query("apply_mask", _TWO + "SELECT user_id, tick, round(y, 4) AS value FROM a JOIN b USING (user_id, tick) WHERE x > 60")(lambda spark, d: out(fw.apply_op(ops.map_value(_two(spark, d)[0], lambda v: v > 60), _two(spark, d)[1], ["user_id"], "op.mask")))
query("apply_negmask", _TWO + "SELECT user_id, tick, round(y, 4) AS value FROM b LEFT JOIN a USING (user_id, tick) WHERE NOT coalesce(x > 60, false)")(lambda spark, d: out(fw.apply_op(ops.map_value(_two(spark, d)[0], lambda v: v > 60), _two(spark, d)[1], ["user_id"], "op.negmask")))
query("common_ticks", f"WITH s AS (SELECT count(DISTINCT class) AS n FROM {EV}), g AS (SELECT tick FROM {DAYSUM}, s GROUP BY tick, s.n HAVING count(DISTINCT class) = s.n) SELECT class, tick, round(value, 4) AS value FROM {DAYSUM} WHERE tick IN (SELECT tick FROM g)")(
    lambda spark, d: out(fw.common_ticks(fw.bucketize(events(spark, d), "sum", span=DAY, last=LAST)))
)

_SER = f"SELECT class, user_id, tick, round(value, 4) AS value FROM {EV} e "
for _name, _arg, _sql in (
    ("filter.bysize", (20, 40), "count(*) BETWEEN 20 AND 40"),
    ("filter.any.gt", (95,), "bool_or(value > 95)"),
    ("filter.any.lt", (1,), "bool_or(value < 1)"),
    ("filter.all.lt", (99,), "bool_and(value < 99)"),
    ("filter.all.ge", (1,), "bool_and(value >= 1)"),
    ("filter.last.gt", (50.0,), "arg_max(value, (tick, -seq)) > 50"),
    ("filter.last.le", (20.0,), "arg_max(value, (tick, -seq)) <= 20"),
):
    query("filter_" + _name[7:].replace(".", "_"), _SER + f"WHERE (class, user_id) IN (SELECT (class, user_id) FROM {EV} GROUP BY class, user_id HAVING {_sql})")(
        (lambda n, a: lambda spark, d: out(fw.filter_series(events(spark, d, user=True), n, *a)))(_name, _arg)
    )
query("filter_byclass", _SER + "WHERE regexp_full_match(class, '[a-m].*')")(lambda spark, d: out(fw.filter_series(events(spark, d, user=True), "filter.byclass", "~[a-m].*")))
query("filter_bylabels", _SER + "WHERE regexp_full_match(user_id::VARCHAR, '1[0-4]?')")(lambda spark, d: out(fw.filter_series(events(spark, d, user=True), "filter.bylabels", {"user_id": "~1[0-4]?"})))

# --- series ---------------------------------------------------------------------------------------

_SW = "OVER (PARTITION BY class, user_id ORDER BY tick, seq)"
for _name, _f, _sql in (
    ("dedup", lambda s: ops.dedup(s), f"SELECT class, user_id, tick, value FROM {DEV}"),
    ("value_dedup", lambda s: ops.value_dedup(ops.map_value(s, F.floor)), f"SELECT class, user_id, tick, v AS value FROM (SELECT class, user_id, tick, floor(value) AS v, row_number() OVER (PARTITION BY class, user_id, floor(value) ORDER BY tick, seq) AS k FROM {EV}) WHERE k = 1"),
    ("shrink", lambda s: ops.shrink(s, 3), f"SELECT class, user_id, tick, value FROM (SELECT *, row_number() {_SW} AS k FROM {EV}) WHERE k <= 3"),
    ("shrink_last", lambda s: ops.shrink(s, -3), f"SELECT class, user_id, tick, value FROM (SELECT *, row_number() OVER (PARTITION BY class, user_id ORDER BY tick DESC, seq DESC) AS k FROM {EV}) WHERE k <= 3"),
    ("monotonic", lambda s: ops.monotonic(s), f"SELECT class, user_id, tick, max(value) OVER (PARTITION BY class, user_id ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS value FROM {EV}"),
    ("resets", lambda s: ops.resets(s), f"SELECT class, user_id, tick, value + sum(j) OVER (PARTITION BY class, user_id ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT *, CASE WHEN value < lag(value) {_SW} THEN lag(value) {_SW} ELSE 0 END AS j FROM {EV})"),
    ("integrate", lambda s: ops.map_value(ops.integrate(s), lambda v: v / 86400), f"SELECT class, user_id, tick, sum(j) OVER (PARTITION BY class, user_id ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) / 86400 AS value FROM (SELECT *, coalesce(lag(value) {_SW} * (tick - lag(tick) {_SW}) / 1e6, 0) AS j FROM {EV})"),
    ("tick_index", lambda s: ops.tick_index(s), f"SELECT class, user_id, row_number() {_SW} - 1 AS tick, value FROM {EV}"),
    ("compact", lambda s: ops.compact(ops.map_value(s, lambda v: F.floor(v / 25))), f"SELECT class, user_id, tick, v AS value FROM (SELECT *, floor(value / 25) AS v, lag(floor(value / 25)) {_SW} AS p, lead(tick) {_SW} AS x FROM {EV}) WHERE p IS NULL OR x IS NULL OR p <> v"),
    ("range_compact", lambda s: ops.range_compact(ops.map_value(s, lambda v: F.floor(v / 25))), f"SELECT class, user_id, tick, v AS value FROM (SELECT *, floor(value / 25) AS v, lag(floor(value / 25)) {_SW} AS p, lead(floor(value / 25)) {_SW} AS x FROM {EV}) WHERE p IS NULL OR x IS NULL OR p <> v OR x <> v"),
    ("time_clip", lambda s: ops.time_clip(s, LAST - 5 * DAY, span=7 * DAY), f"SELECT class, user_id, tick, value FROM {EV} WHERE tick BETWEEN {LAST - 12 * DAY + 1} AND {LAST - 5 * DAY}"),
    ("time_shift", lambda s: ops.time_shift(s, -HOUR), f"SELECT class, user_id, tick - {HOUR} AS tick, value FROM {EV}"),
    ("standardize", lambda s: ops.standardize(s), f"SELECT class, user_id, tick, CASE WHEN coalesce(stddev_samp(value) OVER w, 0) = 0 THEN 0 ELSE (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS value FROM {EV} WINDOW w AS (PARTITION BY class, user_id)"),
    ("normalize", lambda s: ops.normalize(s), f"SELECT class, user_id, tick, CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS value FROM {EV} WINDOW w AS (PARTITION BY class, user_id)"),
    ("iso_normalize", lambda s: ops.iso_normalize(s), f"SELECT class, user_id, tick, CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE (value - avg(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS value FROM {EV} WINDOW w AS (PARTITION BY class, user_id)"),
    ("quantize", lambda s: ops.quantize(s, [10.0, 40.0, 80.0]), f"SELECT class, user_id, tick, (CASE WHEN value > 10 THEN 1 ELSE 0 END + CASE WHEN value > 40 THEN 1 ELSE 0 END + CASE WHEN value > 80 THEN 1 ELSE 0 END) AS value FROM {EV}"),
    ("prob", lambda s: stats.prob(ops.map_value(s, lambda v: F.floor(v / 10))), f"SELECT class, user_id, tick, count(*) OVER (PARTITION BY class, user_id, floor(value / 10)) / count(*) OVER (PARTITION BY class, user_id) AS value FROM {EV}"),
):
    query(_name, f"SELECT class, user_id, tick, round(value, 4) AS value FROM ({_sql})")((lambda f: lambda spark, d: out(f(events(spark, d, user=True))))(_f))

query("time_split", f"WITH c AS (SELECT *, CASE WHEN tick - lag(tick) {_SW} >= {DAY} THEN 1 ELSE 0 END AS cut FROM {EV}), p AS (SELECT *, sum(cut) OVER (PARTITION BY class, user_id ORDER BY tick, seq ROWS UNBOUNDED PRECEDING) + 1 AS split FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY class, user_id, split) AS size FROM p) SELECT class, user_id, split::BIGINT AS split, tick, round(value, 4) AS value FROM n WHERE size >= 2")(
    lambda spark, d: out(ops.time_split(events(spark, d, user=True), DAY, 2))
)
query("chunk", f"SELECT class, user_id, tick + (({LAST} - tick) % {7 * DAY} + {7 * DAY}) % {7 * DAY} AS chunk, tick, round(value, 4) AS value FROM {EV}")(lambda spark, d: out(ops.chunk(events(spark, d, user=True), 7 * DAY, LAST)))
query("time_modulo", f"SELECT class, user_id, tick // {DAY} AS quotient, tick % {DAY} AS tick, round(value, 4) AS value FROM {EV}")(lambda spark, d: out(ops.time_modulo(events(spark, d, user=True), DAY)))
query("first_last_tick", f"SELECT class, user_id, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS size FROM {EV} GROUP BY ALL")(
    lambda spark, d: ops.first_tick(events(spark, d, user=True)).join(ops.last_tick(events(spark, d, user=True)), ["class", "user_id"]).join(ops.size(events(spark, d, user=True)), ["class", "user_id"])
)
query("at_index", f"SELECT class, user_id, tick, round(value, 4) AS value FROM (SELECT *, row_number() {_SW} AS k FROM {EV}) WHERE k = 3")(lambda spark, d: ops.at_index(events(spark, d, user=True), 2).select("class", "user_id", "tick", r("value").alias("value")))
query("partition", f"SELECT class, count(DISTINCT user_id) AS n_series, count(*) AS n_points FROM {EV} GROUP BY ALL")(lambda spark, d: fw.partition(events(spark, d, user=True), ["class"]))
query("merge_relabel", f"SELECT 'all' AS class, tick, round(value, 4) AS value FROM {EV}")(lambda spark, d: out(ops.rename(ops.merge(events(spark, d), keys=("class",)), "all")))

# --- grid -----------------------------------------------------------------------------------------

_GRID = f"WITH b AS (SELECT class, user_id, {END} AS tick, sum(value) AS value FROM {EV} WHERE tick <= {LAST} GROUP BY ALL), g AS (SELECT class, user_id, unnest(generate_series({LAST} - (({LAST} - min(tick)) // {DAY}) * {DAY}, {LAST}, {DAY})) AS tick FROM b GROUP BY class, user_id), f AS (SELECT g.class, g.user_id, g.tick, b.value FROM g LEFT JOIN b ON g.class = b.class AND g.user_id = b.user_id AND g.tick = b.tick), w AS (SELECT *, last(value IGNORE NULLS) OVER (PARTITION BY class, user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first(value IGNORE NULLS) OVER (PARTITION BY class, user_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q, max(CASE WHEN value IS NOT NULL THEN tick END) OVER (PARTITION BY class, user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, min(CASE WHEN value IS NOT NULL THEN tick END) OVER (PARTITION BY class, user_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tq FROM f) "
for _name, _sql in (("previous", "p"), ("next", "q"), ("value", "coalesce(value, -1)"), ("interpolate", "CASE WHEN value IS NOT NULL THEN value ELSE p + (q - p) * (tick - tp) / (tq - tp) END")):
    query(f"fill_{_name}", _GRID + f"SELECT class, user_id, tick, round(v, 4) AS value FROM (SELECT *, {_sql} AS v FROM w) WHERE v IS NOT NULL")((lambda n: lambda spark, d: out(fw.fill(user_days(spark, d), n, -1.0)))(_name))

# --- statistics -----------------------------------------------------------------------------------

query("musigma", f"SELECT class, user_id, round(avg(value), 4) AS mu, round(coalesce(stddev_samp(value), 0), 4) AS sigma FROM {EV} GROUP BY ALL")(lambda spark, d: stats.mu_sigma(events(spark, d, user=True)).select("class", "user_id", r("mu").alias("mu"), r("sigma").alias("sigma")))
query("nsumsumsq", f"SELECT class, count(*) AS n, round(sum(value), 2) AS s, round(sum(value * value), 2) AS q FROM {EV} GROUP BY ALL")(lambda spark, d: stats.n_sum_sumsq(events(spark, d)).select("class", "n", r("sum", 2).alias("s"), r("sumsq", 2).alias("q")))
for _name, _k in (("kurtosis", 4), ("skewness", 3)):
    query(_name, f"SELECT class, round(avg(pow(z, {_k})), 4) AS value FROM (SELECT class, (value - avg(value) OVER (PARTITION BY class)) / stddev_pop(value) OVER (PARTITION BY class) AS z FROM {EV}) GROUP BY ALL")((lambda n: lambda spark, d: getattr(stats, n)(events(spark, d)).select("class", r(n).alias("value")))(_name))
query("value_histogram", f"SELECT class, floor(value) AS value, count(*) AS n FROM {EV} GROUP BY ALL")(lambda spark, d: stats.histogram(ops.map_value(events(spark, d), lambda v: F.floor(v).cast("double"))))
query("mode", f"WITH h AS (SELECT class, floor(value) AS value, count(*) AS n FROM {EV} GROUP BY ALL) SELECT class, value, n FROM h WHERE (class, n) IN (SELECT (class, max(n)) FROM h GROUP BY class)")(lambda spark, d: stats.mode(ops.map_value(events(spark, d), lambda v: F.floor(v).cast("double"))))
query("threshold_test", f"SELECT class, tick FROM {EV} WHERE abs(value) >= 90")(lambda spark, d: stats.threshold_test(events(spark, d), 90))
query("zscore_test", f"SELECT class, tick FROM (SELECT class, tick, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM {EV} WINDOW w AS (PARTITION BY class)) WHERE abs(z) >= 1.5")(lambda spark, d: stats.zscore_test(events(spark, d), threshold=1.5))
query("zscore_test_mad", f"WITH m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY class) AS m FROM {EV}), n AS (SELECT *, quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY class) / 0.6745 AS d FROM m) SELECT class, tick FROM n WHERE d <> 0 AND abs((value - m) / d) >= 1.5")(
    lambda spark, d: stats.zscore_test(events(spark, d), mad=True, threshold=1.5)
)
query("linear_regression", f"SELECT class, round(regr_intercept(value, tick / 1e12), 3) AS alpha, round(regr_slope(value, tick / 1e12), 4) AS beta FROM {EV} GROUP BY ALL")(
    lambda spark, d: (lambda s: stats.linear_regression(s.with_df(s.df.withColumn("tick", F.col("tick") / 1e12))).select("class", r("alpha", 3).alias("alpha"), r("beta").alias("beta")))(events(spark, d))
)

# --- kernels (checked by tests, not by SQL) -------------------------------------------------------


def _daily(spark, d) -> Series:
    return fw.fill(fw.bucketize(events(spark, d), "mean", span=DAY, last=LAST), "previous")


for _name, _f in (
    ("grubbs_test", lambda s: stats.grubbs_test(s)),
    ("esd_test", lambda s: stats.esd_test(s, 3)),
    ("lowess", lambda s: stats.lowess(s, 7).df),
    ("rlowess", lambda s: stats.lowess(s, 7, rounds=2).df),
    ("stl", lambda s: stats.stl(s, 7)),
    ("stl_esd_test", lambda s: stats.stl_esd_test(s, 7, 3)),
    ("lttb", lambda s: stats.lttb(s, 10).df),
    ("lower_hull", lambda s: stats.hull(s).df),
    ("upper_hull", lambda s: stats.hull(s, upper=True).df),
    ("fft", lambda s: stats.fft(s)),
    ("patterns", lambda s: patterns.patterns(s, 8, 3, 6, standardise=True).df),
    ("discords", lambda s: patterns.discords(s, 4, 2).df),
    ("polyfit", lambda s: stats.polyfit(ops.tick_index(s), 2)),
):
    query(_name)((lambda f: lambda spark, d: f(_daily(spark, d)))(_f))

_DAILY = f"WITH RECURSIVE b AS (SELECT class, {END} AS tick, avg(value) AS value FROM {EV} WHERE tick <= {LAST} GROUP BY ALL), g AS (SELECT class, unnest(generate_series({LAST} - (({LAST} - min(tick)) // {DAY}) * {DAY}, {LAST}, {DAY})) AS tick FROM b GROUP BY class), f AS (SELECT class, tick, last(value IGNORE NULLS) OVER (PARTITION BY class ORDER BY tick ROWS UNBOUNDED PRECEDING) AS value FROM g LEFT JOIN b USING (class, tick)), n AS (SELECT class, tick, value, row_number() OVER (PARTITION BY class ORDER BY tick) AS i FROM f WHERE value IS NOT NULL)"
_KERNEL_SQL = {
    "uniform": "0.5",
    "triangular": "1 - u",
    "epanechnikov": "0.75 * (1 - u * u)",
    "quartic": "15.0 / 16 * pow(1 - u * u, 2)",
    "triweight": "35.0 / 32 * pow(1 - u * u, 3)",
    "tricube": "70.0 / 81 * pow(1 - u * u * u, 3)",
    "cosine": "pi() / 4 * cos(pi() / 2 * u)",
    "gaussian": "exp(-u * u / 2) / sqrt(2 * pi())",
    "logistic": "1 / (exp(u) + 2 + exp(-u))",
    "silverman": "exp(-u / sqrt(2)) / 2 * sin(pi() / 4 * u / sqrt(2))",
}
query(
    "kernels",
    _DAILY + ", w AS (SELECT n.class, n.tick, abs(n.i - m.i) / 3.0 AS u, m.value AS v FROM n JOIN n m ON n.class = m.class AND m.i BETWEEN n.i - 3 AND n.i + 3) "
    + " UNION ALL ".join(f"SELECT '{k}' AS kernel, class, tick, round(sum(({e}) * v) / sum({e}), 4) AS value FROM w GROUP BY class, tick HAVING sum({e}) <> 0" for k, e in _KERNEL_SQL.items()),
)(
    lambda spark, d: fold(
        lambda x, y: x.unionByName(y),
        [out(registry("mapper.kernel." + k)(_daily(spark, d), step=DAY, width=7, pre=3, post=3)).select(F.lit(k).alias("kernel"), "class", "tick", "value") for k in _KERNEL_SQL],
    )
)
query("single_exponential", _DAILY + ", e AS (SELECT class, tick, i, value AS s FROM n WHERE i = 1 UNION ALL SELECT n.class, n.tick, n.i, 0.3 * n.value + 0.7 * e.s FROM e JOIN n ON n.class = e.class AND n.i = e.i + 1) SELECT class, tick, round(s, 4) AS value FROM e")(
    lambda spark, d: out(stats.single_exponential(_daily(spark, d), 0.3))
)
query(
    "double_exponential",
    _DAILY + ", e AS (SELECT n.class, n.tick, n.i, n.value AS s, n.value - m.value AS t FROM n JOIN n m ON n.class = m.class AND m.i = 1 WHERE n.i = 2 UNION ALL SELECT n.class, n.tick, n.i, 0.3 * n.value + 0.7 * (e.s + e.t), 0.2 * (0.3 * n.value + 0.7 * (e.s + e.t) - e.s) + 0.8 * e.t FROM e JOIN n ON n.class = e.class AND n.i = e.i + 1) SELECT class, tick, round(s, 4) AS value, round(t, 4) AS trend FROM e",
)(lambda spark, d: stats.double_exponential(_daily(spark, d), 0.3, 0.2).select("class", "tick", r("value").alias("value"), r("trend").alias("trend")))


def registry(name: str):
    from tidemark.registry import find

    return find(name)


# --- scan, metadata -------------------------------------------------------------------------------

query("fetch_range", f"SELECT class, user_id, tick, round(value, 4) AS value FROM {EV} WHERE class = 'click' AND tick BETWEEN {LAST - 20 * DAY} AND {LAST - 10 * DAY}")(
    lambda spark, d: out(fetch(events(spark, d, user=True), "click{}", LAST - 20 * DAY, LAST - 10 * DAY))
)
query("fetch_count_skip_step", f"SELECT class, user_id, tick, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY class, user_id ORDER BY tick DESC, seq DESC) AS k FROM {EV}) WHERE k > 2 AND (k - 3) % 3 = 0 AND (k - 3) // 3 < 4")(
    lambda spark, d: out(fetch(events(spark, d, user=True), "~.*{}", None, None, count=4, skip=2, step=3))
)
query("find", f"SELECT DISTINCT class, user_id FROM {EV} WHERE regexp_full_match(class, '[a-m].*')")(lambda spark, d: meta.find(events(spark, d, user=True), "~[a-m].*{}"))
query("find_stats", f"SELECT count(DISTINCT (class, user_id)) AS series, count(DISTINCT class) AS classes, count(DISTINCT user_id) AS user_id FROM {EV}")(lambda spark, d: meta.find_stats(events(spark, d, user=True), "~.*{}"))
query("find_sets", f"SELECT DISTINCT 'class' AS key, class AS value FROM {EV} UNION SELECT DISTINCT 'user_id', user_id::VARCHAR FROM {EV}")(lambda spark, d: meta.find_sets(events(spark, d, user=True), "~.*{}"))
query("meta_set", f"SELECT class, user_id, tick, round(value, 4) AS value FROM {EV} WHERE class = 'click'")(lambda spark, d: out(meta.meta_set(events(spark, d, user=True), "click{}")))
query("tick_list", f"SELECT class, user_id, array_to_string(list(tick ORDER BY tick), ',') AS ticks FROM {EV} GROUP BY ALL")(lambda spark, d: meta.tick_list(events(spark, d, user=True)).select("class", "user_id", F.array_join(F.col("ticks").cast("array<string>"), ",").alias("ticks")))
query("last_bucket", f"SELECT class, max(tick) AS last_bucket FROM (SELECT class, {END} AS tick FROM {EV} WHERE tick <= {LAST}) GROUP BY ALL")(lambda spark, d: (lambda s: meta.last_bucket(Series(s.df, s.keys)))(fw.bucketize(events(spark, d), "sum", span=DAY, last=LAST)))
query("labels", f"SELECT DISTINCT class, user_id, user_id::VARCHAR AS label FROM {EV}")(lambda spark, d: meta.labels(events(spark, d, user=True)).select("class", "user_id", F.element_at("labels", F.lit("user_id")).alias("label")))
query("names", f"SELECT DISTINCT class FROM {EV}")(lambda spark, d: meta.name(events(spark, d, user=True)))
query("make_series", f"SELECT class, user_id, tick, round(value, 4) AS value FROM {EV}")(
    lambda spark, d: out(meta.make(ops.lists(events(spark, d, user=True)), ["class", "user_id"], "ticks", "values"))
)
query("set_value", f"SELECT class, user_id, tick, round(CASE WHEN tick = t THEN -1 ELSE value END, 4) AS value FROM (SELECT *, max(tick) OVER (PARTITION BY class, user_id) AS t, row_number() OVER (PARTITION BY class, user_id, tick ORDER BY seq) AS k FROM {EV}) WHERE tick <> t OR k = 1")(
    lambda spark, d: (lambda s: out(meta.add_value(s, ops.last_tick(s).select("class", "user_id", F.col("last_tick").alias("tick"), F.lit(-1.0).alias("value")), overwrite=True)))(events(spark, d, user=True))
)
query("multi_split", f"SELECT class, tick, user_id AS part, round(value, 4) AS value FROM (SELECT class, {LAST} AS tick, row_number() OVER (PARTITION BY class ORDER BY tick, seq) - 1 AS user_id, value FROM {EV})")(
    lambda spark, d: out(
        meta.multi_split(
            Series(events(spark, d).df.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("tick", "seq", "value"))), lambda x: F.struct(x["tick"].alias("tick"), x["value"].alias("value"))).alias("value")).withColumn("tick", F.lit(LAST).cast("bigint")), ("class",)),
            by_index=True,
        )
    )
)
query("probability", f"WITH h AS (SELECT class, floor(value / 10) AS value, count(*) AS n FROM {EV} GROUP BY ALL), t AS (SELECT class, sum(n) AS a FROM h GROUP BY class) SELECT class, value, n / a AS p FROM h JOIN t USING (class)")(
    lambda spark, d: (lambda s: meta.probability(s, stats.histogram(s)).select("class", "value", F.col("probability").alias("p")).distinct())(ops.map_value(events(spark, d), lambda v: F.floor(v / 10).cast("double")))
)
query("fill_ticks", f"WITH k AS (SELECT DISTINCT class, user_id FROM {EV}) SELECT class, user_id, tick, round(value, 4) AS value FROM {EV} UNION ALL SELECT class, user_id, {LAST + 400 * DAY} AS tick, -5.0 AS value FROM k")(
    lambda spark, d: out(fw.fill_ticks(events(spark, d, user=True), [LAST + 400 * DAY], -5.0))
)
query("strict_partition", f"SELECT class, count(DISTINCT user_id) AS n_series, count(*) AS n_points FROM {EV} WHERE class <> 'click' GROUP BY ALL")(
    lambda spark, d: fw.strict_partition((lambda s: s.with_df(s.df.withColumn("class", F.nullif("class", F.lit("click")))))(events(spark, d, user=True)), ["class"])
)
query("clip", f"SELECT class, l.start AS start, count(*) AS n, round(sum(value), 4) AS total FROM {EV} e JOIN (SELECT {LAST - 20 * DAY} AS start, {LAST - 15 * DAY} AS stop UNION ALL SELECT {LAST - 17 * DAY}, {LAST - 3 * DAY}) l ON e.tick BETWEEN l.start AND l.stop GROUP BY ALL")(
    lambda spark, d: ops.clip(events(spark, d), spark.createDataFrame([(LAST - 20 * DAY, LAST - 15 * DAY), (LAST - 17 * DAY, LAST - 3 * DAY)], "start bigint, end bigint")).groupBy("class", "start").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))
)
query("zscore", f"SELECT class, user_id, tick, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 4) AS value FROM {EV} WINDOW w AS (PARTITION BY class, user_id) QUALIFY value IS NOT NULL")(lambda spark, d: out(ops.zscore(events(spark, d, user=True), keep=True)))

def fetch(s: Series, selector: str, start, end, **options) -> Series:
    from tidemark.sources.selector import fetch as run

    return run(s, selector, start, end, **options)


# --- scalars --------------------------------------------------------------------------------------

_NUM = "l_quantity AS q, l_discount AS x, l_extendedprice AS p, l_orderkey AS k"
_MATH = {
    "ABS": ("abs(q - 25)", lambda c: SCALARS["ABS"](c.q - 25)),
    "SIGNUM": ("sign(q - 25)", lambda c: SCALARS["SIGNUM"](c.q - 25)),
    "FLOOR": ("floor(p)", lambda c: SCALARS["FLOOR"](c.p).cast("double")),
    "CEIL": ("ceil(p)", lambda c: SCALARS["CEIL"](c.p).cast("double")),
    "ROUND": ("floor(p + 0.5)", lambda c: SCALARS["ROUND"](c.p).cast("double")),
    "SQRT": ("sqrt(p)", lambda c: SCALARS["SQRT"](c.p)),
    "CBRT": ("cbrt(p)", lambda c: SCALARS["CBRT"](c.p)),
    "EXP": ("exp(x)", lambda c: SCALARS["EXP"](c.x)),
    "LOG": ("ln(p)", lambda c: SCALARS["LOG"](c.p)),
    "LOG10": ("log10(p)", lambda c: SCALARS["LOG10"](c.p)),
    "SIN": ("sin(x)", lambda c: SCALARS["SIN"](c.x)),
    "COS": ("cos(x)", lambda c: SCALARS["COS"](c.x)),
    "TAN": ("tan(x)", lambda c: SCALARS["TAN"](c.x)),
    "ATAN": ("atan(q)", lambda c: SCALARS["ATAN"](c.q)),
    "ATAN2": ("atan2(q, x + 1)", lambda c: SCALARS["ATAN2"](c.q, c.x + 1)),
    "HYPOT": ("sqrt(q * q + x * x)", lambda c: SCALARS["HYPOT"](c.q, c.x)),
    "POW": ("pow(x, 3)", lambda c: SCALARS["**"](c.x, F.lit(3.0))),
    "TORADIANS": ("radians(q)", lambda c: SCALARS["TORADIANS"](c.q)),
    "TODEGREES": ("degrees(x)", lambda c: SCALARS["TODEGREES"](c.x)),
    "MAX2": ("greatest(q, p)", lambda c: SCALARS["MAX"](c.q, c.p)),
    "MIN2": ("least(q, p)", lambda c: SCALARS["MIN"](c.q, c.p)),
    "DIV": ("k // 7", lambda c: SCALARS["DIV"](c.k, F.lit(7)).cast("double")),
    "MOD": ("k % 7", lambda c: SCALARS["%"](c.k, F.lit(7)).cast("double")),
    "BITAND": ("k & 12", lambda c: SCALARS["&"](c.k, F.lit(12)).cast("double")),
    "BITOR": ("k | 12", lambda c: SCALARS["|"](c.k, F.lit(12)).cast("double")),
    "BITXOR": ("xor(k, 12)", lambda c: SCALARS["^"](c.k, F.lit(12)).cast("double")),
    "SHL": ("k << 3", lambda c: SCALARS["<<"](c.k, F.lit(3)).cast("double")),
    "SHR": ("k >> 3", lambda c: SCALARS[">>"](c.k, F.lit(3)).cast("double")),
    "BITCOUNT": ("bit_count(k)", lambda c: SCALARS["BITCOUNT"](c.k).cast("double")),
}


def scalars(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """The keys and many numbers, as doubles to 6 places. Whole numbers are so already.

    Whole-stage code puts all expressions into one method, and beyond 8000 bytes the JVM only interprets it. With a
    higher-order function among them Spark makes a projection of small methods instead.
    """
    whole = {f.name for f in rows.select(*[c.alias(n) for n, c in columns.items()]).schema if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    first = F.transform(F.array(keys[0]), lambda x: x)[0].alias(keys[0])
    return rows.select(first, *keys[1:], *[(c.cast("double") if n in whole else r(c.cast("double"), 6)).alias(n) for n, c in columns.items()])


query("scalar_math", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({s})::DOUBLE, 6) AS f_{n.lower()}" for n, (s, _) in _MATH.items()) + f" FROM (SELECT l_orderkey, l_linenumber, {_NUM} FROM lineitem)")(
    lambda spark, d: (lambda c: scalars(c, ["l_orderkey", "l_linenumber"], {f"f_{n.lower()}": f(c) for n, (_, f) in _MATH.items()}))(
        read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"), F.col("l_extendedprice").alias("p"), F.col("l_orderkey").alias("k"))
    )
)
_TEXT = {
    "upper": ("upper(t)", lambda t: SCALARS["TOUPPER"](t)),
    "lower": ("lower(t)", lambda t: SCALARS["TOLOWER"](t)),
    "size": ("length(t)::VARCHAR", lambda t: SCALARS["SIZE"](t).cast("string")),
    "substring": ("substr(t, 3, 5)", lambda t: SCALARS["SUBSTRING"](t, F.lit(2), F.lit(5))),
    "md5": ("md5(t)", lambda t: SCALARS["MD5"](t)),
    "sha1": ("sha1(t)", lambda t: SCALARS["SHA1"](t)),
    "sha256": ("sha256(t)", lambda t: SCALARS["SHA256"](t)),
    "hex": ("lower(hex(encode(t)))", lambda t: SCALARS["->HEX"](t)),
    "b64": ("base64(encode(t))", lambda t: SCALARS["->B64"](F.encode(t, "utf-8"))),
    "match": ("regexp_full_match(t, '[A-Z].*#[0-9]+')::VARCHAR", lambda t: SCALARS["MATCH"](t, F.lit("[A-Z].*#[0-9]+")).cast("string")),
    "replaceall": ("regexp_replace(t, '[0-9]', 'x', 'g')", lambda t: SCALARS["REPLACEALL"](t, F.lit("[0-9]"), F.lit("x"))),
    "replace": ("regexp_replace(t, '[0-9]', 'x')", lambda t: SCALARS["REPLACE"](t, F.lit("[0-9]"), F.lit("x"))),
    "reverse": ("reverse(t)", lambda t: SCALARS["REVERSE"](t)),
    "indexof": ("(instr(t, '#') - 1)::VARCHAR", lambda t: SCALARS["INDEXOF"](t, F.lit("#")).cast("string")),
    "split": ("split_part(t, '#', 1)", lambda t: SCALARS["SPLIT"](t, F.lit("#"))[0]),
}
query("scalar_text", "SELECT c_custkey, " + ", ".join(f"{s} AS f_{n}" for n, (s, _) in _TEXT.items()) + " FROM (SELECT c_custkey, c_name AS t FROM customer)")(
    lambda spark, d: read(spark, d, "customer").select("c_custkey", *[f(F.col("c_name")).alias(f"f_{n}") for n, (_, f) in _TEXT.items()])
)
_MORE = {
    "expm1": ("exp(x) - 1", lambda c: SCALARS["EXPM1"](c.x)),
    "log1p": ("ln(1 + x)", lambda c: SCALARS["LOG1P"](c.x)),
    "asin": ("asin(x)", lambda c: SCALARS["ASIN"](c.x)),
    "acos": ("acos(x)", lambda c: SCALARS["ACOS"](c.x)),
    "sinh": ("(exp(x) - exp(-x)) / 2", lambda c: SCALARS["SINH"](c.x)),
    "cosh": ("(exp(x) + exp(-x)) / 2", lambda c: SCALARS["COSH"](c.x)),
    "tanh": ("(exp(2 * x) - 1) / (exp(2 * x) + 1)", lambda c: SCALARS["TANH"](c.x)),
    "sigmoid": ("1 / (1 + exp(-x))", lambda c: SCALARS["SIGMOID"](c.x)),
    "copysign": ("-abs(q)", lambda c: SCALARS["COPYSIGN"](c.q, F.lit(-1.0))),
    "rint": ("round_even(q / 4, 0)", lambda c: SCALARS["RINT"](c.q / 4)),
    "scalb": ("x * 8", lambda c: SCALARS["SCALB"](c.x, F.lit(3))),
    "npdf": ("exp(-pow(x - 0.05, 2) / 2) / sqrt(2 * pi())", lambda c: SCALARS["NPDF"](c.x, F.lit(0.05), F.lit(1.0))),
    "floordiv": ("floor((25 - k) / 7.0)", lambda c: SCALARS["FLOORDIV"](F.lit(25).cast("bigint") - c.k, F.lit(7))),
    "floormod": ("(25 - k) - 7 * floor((25 - k) / 7.0)", lambda c: SCALARS["FLOORMOD"](F.lit(25).cast("bigint") - c.k, F.lit(7))),
    "add": ("k + l", lambda c: SCALARS["+"](c.k, c.l)),
    "sub": ("l - k", lambda c: SCALARS["-"](c.l, c.k)),
    "mul": ("k * l", lambda c: SCALARS["*"](c.k, c.l)),
    "div": ("trunc((25 - k) / 7.0)", lambda c: SCALARS["/"](F.lit(25).cast("bigint") - c.k, F.lit(7).cast("bigint"))),
    "ratio": ("p / q", lambda c: SCALARS["/"](c.p, c.q)),
    "addexact": ("k + 3", lambda c: SCALARS["ADDEXACT"](c.k, F.lit(3))),
    "subtractexact": ("k - 3", lambda c: SCALARS["SUBTRACTEXACT"](c.k, F.lit(3))),
    "multiplyexact": ("k * 3", lambda c: SCALARS["MULTIPLYEXACT"](c.k, F.lit(3))),
    "incrementexact": ("k + 1", lambda c: SCALARS["INCREMENTEXACT"](c.k)),
    "decrementexact": ("k - 1", lambda c: SCALARS["DECREMENTEXACT"](c.k)),
    "negateexact": ("-k", lambda c: SCALARS["NEGATEEXACT"](c.k)),
    "tointexact": ("l", lambda c: SCALARS["TOINTEXACT"](c.l)),
    "eq": ("(l = 3)::INT", lambda c: SCALARS["=="](c.l, F.lit(3)).cast("int")),
    "ne": ("(l <> 3)::INT", lambda c: SCALARS["!="](c.l, F.lit(3)).cast("int")),
    "lt": ("(l < 3)::INT", lambda c: SCALARS["<"](c.l, F.lit(3)).cast("int")),
    "gt": ("(l > 3)::INT", lambda c: SCALARS[">"](c.l, F.lit(3)).cast("int")),
    "le": ("(l <= 3)::INT", lambda c: SCALARS["<="](c.l, F.lit(3)).cast("int")),
    "ge": ("(l >= 3)::INT", lambda c: SCALARS[">="](c.l, F.lit(3)).cast("int")),
    "near": ("(abs(x - 0.05) <= 0.015)::INT", lambda c: SCALARS["~="](c.x, F.lit(0.05), F.lit(0.015)).cast("int")),
    "both": ("(l > 2 AND q > 25)::INT", lambda c: SCALARS["&&"](c.l > 2, c.q > 25).cast("int")),
    "either": ("(l > 2 OR q > 25)::INT", lambda c: SCALARS["||"](c.l > 2, c.q > 25).cast("int")),
    "not": ("(NOT l > 2)::INT", lambda c: SCALARS["!"](c.l > 2).cast("int")),
    "bitnot": ("-k - 1", lambda c: SCALARS["~"](c.k)),
    "bitget": ("(k >> 2) & 1", lambda c: SCALARS["BITGET"](c.k, F.lit(2))),
    "shru": ("k >> 2", lambda c: SCALARS[">>>"](c.k, F.lit(2))),
    "isnan": ("0", lambda c: SCALARS["ISNaN"](c.x).cast("int")),
    "isnull": ("0", lambda c: SCALARS["ISNULL"](c.x).cast("int")),
    "pi": ("pi()", lambda c: SCALARS["PI"]()),
    "e": ("exp(1)", lambda c: SCALARS["E"]()),
    "todouble": ("k", lambda c: SCALARS["TODOUBLE"](c.k)),
    "tolong": ("trunc(p)", lambda c: SCALARS["TOLONG"](c.p)),
    "toboolean": ("(l <> 0)::INT", lambda c: SCALARS["TOBOOLEAN"](c.l).cast("int")),
    "ifte": ("CASE WHEN l > 2 THEN p ELSE q END", lambda c: SCALARS["IFTE"](c.l > 2, c.p, c.q)),
    "ift": ("CASE WHEN l > 2 THEN p END", lambda c: SCALARS["IFT"](c.l > 2, c.p)),
    "switch": ("CASE WHEN l = 1 THEN 10 WHEN l = 2 THEN 20 ELSE 0 END", lambda c: SCALARS["SWITCH"]([(c.l == 1, F.lit(10)), (c.l == 2, F.lit(20))], F.lit(0))),
    "days": ("l * 86400000000", lambda c: SCALARS["d"](c.l.cast("bigint"))),
    "weeks": ("l * 604800000000", lambda c: SCALARS["w"](c.l.cast("bigint"))),
    "hours": ("l * 3600000000", lambda c: SCALARS["h"](c.l.cast("bigint"))),
    "minutes": ("l * 60000000", lambda c: SCALARS["m"](c.l.cast("bigint"))),
    "seconds": ("l * 1000000", lambda c: SCALARS["s"](c.l.cast("bigint"))),
    "millis": ("l * 1000", lambda c: SCALARS["ms"](c.l.cast("bigint"))),
    "micros": ("l", lambda c: SCALARS["us"](c.l.cast("bigint"))),
    "nanos": ("l / 1000.0", lambda c: SCALARS["ns"](c.l)),
    "qmul": ("-(x * 2 + q * 3 + l * 4)", lambda c: SCALARS["QMULTIPLY"](SCALARS["->Q"](F.lit(0.0), c.x, c.q, c.l), SCALARS["->Q"](F.lit(0.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)))["w"]),
    "qconj": ("-q", lambda c: SCALARS["QCONJUGATE"](SCALARS["->Q"](c.x, c.p, c.q, c.x))["y"]),
    "qdiv": ("1.0", lambda c: SCALARS["QDIVIDE"](SCALARS["->Q"](c.q, c.p, c.q, c.x), SCALARS["->Q"](c.q, c.p, c.q, c.x))["w"]),
    "qrotate": ("q", lambda c: SCALARS["QROTATE"](SCALARS["ROTATIONQ"](F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(90.0)), c.q, F.lit(0.0), F.lit(0.0))["y"]),
    "qrotation": ("30.0", lambda c: SCALARS["QROTATION"](SCALARS["ROTATIONQ"](F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(30.0)))["angle"]),
}
query("scalar_more", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({s})::DOUBLE, 6) AS f_{n}" for n, (s, _) in _MORE.items()) + f" FROM (SELECT l_orderkey, l_linenumber, {_NUM}, l_linenumber AS l FROM lineitem)")(
    lambda spark, d: (lambda c: scalars(c, ["l_orderkey", "l_linenumber"], {f"f_{n}": f(c) for n, (_, f) in _MORE.items()}))(
        read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"), F.col("l_extendedprice").alias("p"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"))
    )
)
_STRINGS = {
    "trim": ("trim('  ' || t || ' ')", lambda t: SCALARS["TRIM"](F.concat(F.lit("  "), t, F.lit(" ")))),
    "concat": ("t || '!'", lambda t: SCALARS["CONCAT"](t, F.lit("!"))),
    "contains": ("contains(t, '#0')::VARCHAR", lambda t: SCALARS["CONTAINS"](t, F.lit("#0")).cast("string")),
    "urlencode": ("url_encode(t)", lambda t: SCALARS["URLENCODE"](t)),
    "urldecode": ("t", lambda t: SCALARS["URLDECODE"](SCALARS["URLENCODE"](t))),
    "unhex": ("t", lambda t: SCALARS["BYTES->"](SCALARS["HEX->"](SCALARS["->HEX"](t)))),
    "unb64": ("t", lambda t: SCALARS["BYTES->"](SCALARS["B64->"](SCALARS["->B64"](SCALARS["->BYTES"](t))))),
    "b64url": ("replace(replace(replace(base64(encode(t)), '=', ''), '+', '-'), '/', '_')", lambda t: SCALARS["->B64URL"](SCALARS["->BYTES"](t))),
    "unb64url": ("t", lambda t: SCALARS["BYTES->"](SCALARS["B64URL->"](SCALARS["->B64URL"](SCALARS["->BYTES"](t))))),
    "b64tohex": ("lower(hex(encode(t)))", lambda t: SCALARS["B64TOHEX"](SCALARS["->B64"](SCALARS["->BYTES"](t)))),
    "hextob64": ("base64(encode(t))", lambda t: SCALARS["HEXTOB64"](SCALARS["->HEX"](t))),
    "tohex": ("lpad(to_hex(length(t)), 16, '0')", lambda t: SCALARS["TOHEX"](F.length(t).cast("bigint"))),
    "fromhex": ("255::VARCHAR", lambda t: SCALARS["FROMHEX"](F.lit("ff")).cast("string")),
    "tobin": ("lpad(to_binary(length(t)), 64, '0')", lambda t: SCALARS["TOBIN"](F.length(t).cast("bigint"))),
    "frombin": ("length(t)::VARCHAR", lambda t: SCALARS["FROMBIN"](SCALARS["TOBIN"](F.length(t).cast("bigint"))).cast("string")),
    "hextobin": ("'10101011'", lambda t: SCALARS["HEXTOBIN"](F.lit("ab"))),
    "bintohex": ("'ab'", lambda t: SCALARS["BINTOHEX"](F.lit("10101011"))),
    "format": ("'<' || t || '>'", lambda t: SCALARS["STRINGFORMAT"](F.lit("<%s>"), t)),
    "template": ("'Dear ' || t", lambda t: SCALARS["TEMPLATE"](F.lit("Dear {{name}}"), F.create_map(F.lit("name"), t))),
    "b58": ("t", lambda t: SCALARS["BYTES->"](udfs.call("B58->", udfs.call("->B58", t)))),
    "b58c": ("t", lambda t: SCALARS["BYTES->"](udfs.call("B58C->", udfs.call("->B58C", t)))),
    "opb64": ("t", lambda t: SCALARS["BYTES->"](udfs.call("OPB64->", udfs.call("->OPB64", t)))),
    "opb64tohex": ("lower(hex(encode(t)))", lambda t: udfs.call("OPB64TOHEX", udfs.call("->OPB64", t))),
    "gzip": ("t", lambda t: SCALARS["BYTES->"](udfs.call("UNGZIP", udfs.call("GZIP", t)))),
    "deflate": ("t", lambda t: SCALARS["BYTES->"](udfs.call("INFLATE", udfs.call("DEFLATE", t)))),
    "tobits": ("t", lambda t: SCALARS["BYTES->"](udfs.call("BITSTOBYTES", udfs.call("BYTESTOBITS", SCALARS["->BYTES"](t))))),
    "frombits": ("t", lambda t: SCALARS["BYTES->"](udfs.call("BIN->", udfs.call("->BIN", t)))),
    "typeof": ("'string'", lambda t: SCALARS["TYPEOF"](t)),
    "lists": ("t || '-' || t", lambda t: SCALARS["JOIN"](SCALARS["->LIST"](t, t), F.lit("-"))),
    "lreverse": ("t || ',b'", lambda t: F.array_join(SCALARS["LREVERSE"](F.array(F.lit("b"), t)), ",")),
    "sublist": ("t", lambda t: F.array_join(SCALARS["SUBLIST"](F.array(F.lit("b"), t, F.lit("c")), F.lit(1), F.lit(1)), ",")),
    "set_at": ("'x,' || t", lambda t: F.array_join(SCALARS["SET"](F.array(F.lit("b"), t), F.lit("x"), F.lit(0)), ",")),
    "append": ("t || ',z'", lambda t: F.array_join(SCALARS["+!"](F.array(t), F.lit("z")), ",")),
    "difference": ("t", lambda t: F.array_join(SCALARS["DIFFERENCE"](F.array(t, F.lit("q")), F.array(F.lit("q"))), ",")),
    "union": ("t || ',q'", lambda t: F.array_join(SCALARS["UNION"](F.array(t, F.lit("q")), F.array(F.lit("q"))), ",")),
    "flatten": ("t || ',b'", lambda t: F.array_join(SCALARS["FLATTEN"](F.array(F.array(t), F.array(F.lit("b")))), ",")),
    "lmap": ("lower(t)", lambda t: F.array_join(SCALARS["LMAP"](F.array(t), F.lower), ",")),
    "lfilter": ("t", lambda t: F.array_join(SCALARS["LFILTER"](F.array(t, F.lit("q")), lambda x: F.length(x) > 1), ",")),
    "sortby": ("'q,' || t", lambda t: F.array_join(SCALARS["SORTBY"](F.array(t, F.lit("q")), F.length), ",")),
    "filterby": ("'q'", lambda t: F.array_join(SCALARS["FILTERBY"](F.array(t, F.lit("q")), F.length, F.lit(1)), ",")),
    "getkey": ("t", lambda t: SCALARS["GETKEY"](SCALARS["->MAP"](F.lit("a"), t), F.lit("a"))),
    "put": ("t", lambda t: SCALARS["GETKEY"](SCALARS["PUT"](SCALARS["->MAP"](F.lit("a"), F.lit("b")), F.lit("a"), t), F.lit("a"))),
    "keylist": ("'a'", lambda t: F.array_join(SCALARS["KEYLIST"](SCALARS["->MAP"](F.lit("a"), t)), ",")),
    "valuelist": ("t", lambda t: F.array_join(SCALARS["VALUELIST"](SCALARS["->MAP"](F.lit("a"), t)), ",")),
    "mmap": ("lower(t)", lambda t: SCALARS["GETKEY"](SCALARS["MMAP"](SCALARS["->MAP"](F.lit("a"), t), lambda k, v: F.lower(v)), F.lit("a"))),
    "bdadd": ("(length(t)::HUGEINT + 170141183460469231731687303715884105000)::VARCHAR", lambda t: udfs.call("BDADD", F.length(t).cast("string"), F.lit("170141183460469231731687303715884105000"))),
    "bdmul": ("(length(t)::HUGEINT * 12345678901234567890)::VARCHAR", lambda t: udfs.call("BDMUL", F.length(t).cast("string"), F.lit("12345678901234567890"))),
    "bdsub": ("(length(t) - 12345678901234567890::HUGEINT)::VARCHAR", lambda t: udfs.call("BDSUB", F.length(t).cast("string"), F.lit("12345678901234567890"))),
    "bddivint": ("(12345678901234567890::HUGEINT // length(t))::VARCHAR", lambda t: udfs.call("BDDIVINT", F.lit("12345678901234567890"), F.length(t).cast("string"))),
    "bdrem": ("(12345678901234567890::HUGEINT % length(t))::VARCHAR", lambda t: udfs.call("BDREM", F.lit("12345678901234567890"), F.length(t).cast("string"))),
    "bdpow": ("(length(t)::HUGEINT * length(t) * length(t))::VARCHAR", lambda t: udfs.call("BDPOW", F.length(t).cast("string"), F.lit("3"))),
    "bdgcd": ("gcd(length(t), 36)::VARCHAR", lambda t: udfs.call("BDGCD", F.length(t).cast("string"), F.lit("36"))),
    "bdcomp": ("sign(length(t) - 18)::INT::VARCHAR", lambda t: udfs.call("BDCOMP", F.length(t).cast("string"), F.lit("18"))),
    "bdmax": ("greatest(length(t), 20)::VARCHAR", lambda t: udfs.call("BDMAX", F.length(t).cast("string"), F.lit("20"))),
    "bdmin": ("least(length(t), 20)::VARCHAR", lambda t: udfs.call("BDMIN", F.length(t).cast("string"), F.lit("20"))),
    "bdneg": ("(-length(t))::VARCHAR", lambda t: udfs.call("BDNEG", F.length(t).cast("string"))),
    "bdand": ("(length(t) & 12)::VARCHAR", lambda t: udfs.call("BDAND", F.length(t).cast("string"), F.lit("12"))),
    "bdor": ("(length(t) | 12)::VARCHAR", lambda t: udfs.call("BDOR", F.length(t).cast("string"), F.lit("12"))),
    "bdxor": ("xor(length(t), 12)::VARCHAR", lambda t: udfs.call("BDXOR", F.length(t).cast("string"), F.lit("12"))),
    "bdshiftleft": ("(length(t) * 16)::VARCHAR", lambda t: udfs.call("BDSHIFTLEFT", F.length(t).cast("string"), F.lit("4"))),
    "bdfloor": ("length(t)::VARCHAR", lambda t: udfs.call("BDFLOOR", F.concat(F.length(t).cast("string"), F.lit(".75")))),
    "bdceil": ("(length(t) + 1)::VARCHAR", lambda t: udfs.call("BDCEIL", F.concat(F.length(t).cast("string"), F.lit(".75")))),
    "bdround": ("length(t)::VARCHAR || '.8'", lambda t: udfs.call("BDROUND", F.concat(F.length(t).cast("string"), F.lit(".75")), F.lit(1))),
    "bdmodpow": ("((length(t)::HUGEINT * length(t) * length(t)) % 1000)::VARCHAR", lambda t: udfs.call("BDMODPOW", F.length(t).cast("string"), F.lit("3"), F.lit("1000"))),
}
query("scalar_strings", "SELECT c_custkey, " + ", ".join(f"{s} AS f_{n}" for n, (s, _) in _STRINGS.items()) + " FROM (SELECT c_custkey, c_name AS t FROM customer)")(
    lambda spark, d: spread_out(read(spark, d, "customer").select("c_custkey", "c_name")).select("c_custkey", *[f(F.col("c_name")).alias(f"f_{n}") for n, (_, f) in _STRINGS.items()])
)
_TIME = {
    "year": ("year(ts)", "YEAR"),
    "month": ("month(ts)", "MONTH"),
    "day": ("day(ts)", "DAY"),
    "weekday": ("isodow(ts)", "WEEKDAY"),
    "hour": ("hour(ts)", "HOUR"),
    "minute": ("minute(ts)", "MINUTE"),
    "second": ("second(ts)", "SECOND"),
    "dayofyear": ("dayofyear(ts)", "DAYOFYEAR"),
    "isoweek": ("weekofyear(ts)", "ISOWEEK"),
    "adddays": ("epoch_us(ts + INTERVAL 3 DAY)", None),
    "addmonths": ("epoch_us(ts + INTERVAL 1 MONTH)", None),
    "addyears": ("epoch_us(ts + INTERVAL 1 YEAR)", None),
}
query("scalar_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, " + ", ".join(f"({s})::BIGINT AS f_{n}" for n, (s, _) in _TIME.items()) + " FROM events")(
    lambda spark, d: (lambda e: e.select("event_id", SCALARS["ISO8601"](F.col("t")).alias("iso"), *[(SCALARS[f](F.col("t")) if f else SCALARS[n.upper()](F.col("t"), F.lit({"adddays": 3}.get(n, 1)))).cast("bigint").alias(f"f_{n}") for n, (_, f) in _TIME.items()]))(read(spark, d, "events").select("event_id", micros(F.col("ts")).alias("t")))
)
query(
    "scalar_lists",
    "SELECT o_custkey, list_aggregate(list_sort(a), 'min') AS low, list_aggregate(a, 'max') AS high, len(list_distinct(a)) AS n_distinct, len(a) AS n, array_to_string(list_sort(list_distinct(a)), ',') AS joined, len(list_intersect(list_distinct(a), ['1-URGENT', '5-LOW'])) AS n_common, list_contains(a, '2-HIGH') AS has FROM (SELECT o_custkey, list(o_orderpriority) AS a FROM orders GROUP BY o_custkey)",
)(
    lambda spark, d: (lambda g: g.select("o_custkey", SCALARS["LMIN"](F.col("a")).alias("low"), SCALARS["LMAX"](F.col("a")).alias("high"), F.size(SCALARS["UNIQUE"](F.col("a"))).cast("bigint").alias("n_distinct"), F.size("a").cast("bigint").alias("n"), F.array_join(SCALARS["LSORT"](SCALARS["UNIQUE"](F.col("a"))), ",").alias("joined"), F.size(SCALARS["INTERSECTION"](F.col("a"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).cast("bigint").alias("n_common"), SCALARS["LCONTAINS"](F.col("a"), F.lit("2-HIGH")).alias("has")))(read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("a")))
)
query("scalar_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", SCALARS["JSONGET"](F.col("props"), F.lit("$.k")).alias("k")))
query("vector_dot", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 3) AS dot FROM embeddings")(lambda spark, d: read(spark, d, "embeddings").select("vec_id", r(SCALARS["DOT"](F.col("embedding"), F.col("embedding")), 3).alias("dot")))

# --- geo ------------------------------------------------------------------------------------------

_LL = "(SELECT event_id, user_id, event_type AS class, epoch_us(ts) AS tick, value, (user_id * 37 % 160 - 80)::DOUBLE + value / 100 AS lat, (user_id * 53 % 340 - 170)::DOUBLE + (event_id % 100) / 100 AS lon FROM events)"


def located(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("class"), micros(F.col("ts")).alias("tick"), "value", ((F.col("user_id") * 37 % 160 - 80).cast("double") + F.col("value") / 100).alias("lat"), ((F.col("user_id") * 53 % 340 - 170).cast("double") + (F.col("event_id") % 100) / 100).alias("lon"))


query("haversine", f"SELECT event_id, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(48.39 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.39)) * pow(sin(radians(-4.49 - lon) / 2), 2)))), 1) AS metres FROM {_LL}")(
    lambda spark, d: located(spark, d).select("event_id", r(geo.haversine(F.col("lat"), F.col("lon"), F.lit(48.39), F.lit(-4.49)), 1).alias("metres"))
)
query("bbox", f"SELECT class, round(min(lat), 6) AS south, round(min(lon), 6) AS west, round(max(lat), 6) AS north, round(max(lon), 6) AS east FROM {_LL} GROUP BY ALL")(
    lambda spark, d: geo.bbox(Series(located(spark, d), ("class",))).select("class", *[r(c, 6).alias(c) for c in ("south", "west", "north", "east")])
)
query("geo_within", f"SELECT user_id, bool_and(lat BETWEEN -60 AND 60 AND lon BETWEEN -120 AND 120) AS within, bool_or(lat BETWEEN -60 AND 60 AND lon BETWEEN -120 AND 120) AS intersects FROM {_LL} GROUP BY ALL")(
    lambda spark, d: geo.all_within(Series(located(spark, d), ("user_id",)), geo.within_box(F.col("lat"), F.col("lon"), -60, -120, 60, 120))
)
query("hhcode_round_trip", f"SELECT event_id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM {_LL}")(
    lambda spark, d: located(spark, d).select("event_id", geo.hhcode(F.col("lat"), F.col("lon")).alias("c")).select("event_id", r(geo.hhcode_lat(F.col("c")), 5).alias("lat"), r(geo.hhcode_lon(F.col("c")), 5).alias("lon"))
)
_HASH_X, _HASH_Y = "least(floor((lon + 180.0) / 360.0 * 8388608.0), 8388607)::BIGINT", "least(floor((lat + 90.0) / 180.0 * 4194304.0), 4194303)::BIGINT"
_LETTERS = " || ".join(
    "substr('0123456789bcdefghjkmnpqrstuvwxyz', (" + " + ".join(f"(({'x' if b % 2 == 0 else 'y'} >> {(22 if b % 2 == 0 else 21) - b // 2}) & 1) * {1 << (4 - j)}" for j, b in enumerate(range(5 * k, 5 * k + 5))) + ")::INTEGER + 1, 1)" for k in range(9)
)
query("geohash", f"SELECT event_id, {_LETTERS} AS geohash FROM (SELECT event_id, {_HASH_X} AS x, {_HASH_Y} AS y FROM {_LL})")(lambda spark, d: located(spark, d).select("event_id", geo.geohash(F.col("lat"), F.col("lon")).alias("geohash")))
query("geohash_round_trip", f"SELECT event_id, round(floor((lat + 90.0) / 180.0 * 4194304.0) / 4194304.0 * 180 - 90, 6) AS lat, round(floor((lon + 180.0) / 360.0 * 8388608.0) / 8388608.0 * 360 - 180, 6) AS lon FROM {_LL}")(
    lambda spark, d: located(spark, d).select("event_id", geo.from_geohash(geo.geohash(F.col("lat"), F.col("lon"))).alias("p")).select("event_id", r("p.lat", 6).alias("lat"), r("p.lon", 6).alias("lon"))
)
_RHUMB = "sqrt(pow(p2 - p1, 2) + pow(CASE WHEN abs(q) > 1e-12 THEN (p2 - p1) / q ELSE cos(p1) END * least(dl, 2 * pi() - dl), 2))"
query(
    "distance_travelled",
    f"WITH l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM {_LL} WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)), m AS (SELECT user_id, tick, event_id, radians(lat0) AS p1, radians(lat) AS p2, radians(abs(lon - lon0)) AS dl, ln(tan(pi() / 4 + radians(lat) / 2) / tan(pi() / 4 + radians(lat0) / 2)) AS q FROM l), s AS (SELECT user_id, tick, event_id, coalesce(6371000.0 * {_RHUMB}, 0) AS step FROM m) SELECT user_id, tick, round(sum(step) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) / 1000, 2) AS value FROM s",
)(lambda spark, d: out(ops.map_value(geo.distance(Series(located(spark, d).withColumnRenamed("event_id", "seq"), ("user_id",))), lambda v: v / 1000), n=2))

# --- mappers by name ------------------------------------------------------------------------------

_POINT = {"": ("value", 50.0), ".tick": ("tick", LAST - 20 * DAY), ".lat": ("lat", 10.0), ".lon": ("lon", 20.0), ".elev": ("elev", 500)}
_SIGNS = {"gt": ">", "ge": ">=", "eq": "=", "ne": "<>", "le": "<=", "lt": "<"}
_MAPPED: dict[str, tuple[dict, str]] = {f"mapper.{o}{part}": ({"threshold": t}, f"CASE WHEN {c} {sign} {t} THEN value END") for o, sign in _SIGNS.items() for part, (c, t) in _POINT.items()}
_MAPPED |= {
    "mapper.add": ({"value": 2.5}, "value + 2.5"),
    "mapper.mul": ({"value": 3.0}, "value * 3"),
    "mapper.pow": ({"power": 2}, "value * value"),
    "mapper.sqrt": ({}, "sqrt(value)"),
    "mapper.exp": ({"base": 1.02}, "pow(1.02, value)"),
    "mapper.log": ({"base": 2}, "CASE WHEN value > 0 THEN log2(value) END"),
    "mapper.min.x": ({"value": 30.0}, "least(value, 30)"),
    "mapper.max.x": ({"value": 30.0}, "greatest(value, 30)"),
    "mapper.tick": ({}, "tick / 1e9"),
    "mapper.lat": ({}, "lat"),
    "mapper.lon": ({}, "lon"),
    "mapper.elev": ({}, "elev"),
    "mapper.abs": ({}, "abs(value)"),
    "mapper.ceil": ({}, "ceil(value)"),
    "mapper.floor": ({}, "floor(value)"),
    "mapper.finite": ({}, "value"),
    "mapper.tolong": ({}, "trunc(value)"),
    "mapper.todouble": ({}, "value"),
    "mapper.toboolean": ({}, "(value <> 0)::INTEGER"),
    "mapper.geo.within": ({"shape": lambda la, lo: geo.within_box(la, lo, -60, -120, 60, 120)}, "CASE WHEN lat BETWEEN -60 AND 60 AND lon BETWEEN -120 AND 120 THEN value END"),
    "mapper.geo.outside": ({"shape": lambda la, lo: geo.within_box(la, lo, -60, -120, 60, 120)}, "CASE WHEN NOT (lat BETWEEN -60 AND 60 AND lon BETWEEN -120 AND 120) THEN value END"),
    "mapper.geo.fence": ({"shape": lambda la, lo: geo.within_box(la, lo, -60, -120, 60, 120)}, "(lat BETWEEN -60 AND 60 AND lon BETWEEN -120 AND 120)::INTEGER"),
    **{f"mapper.{n}": ({}, f"{f}(make_timestamp(tick))") for n, f in (("year", "year"), ("month", "month"), ("day", "day"), ("weekday", "isodow"), ("hour", "hour"), ("minute", "minute"), ("second", "second"))},
}


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """How many points each mapper leaves in each class, and their sum."""
    base = Series(located(spark, d).withColumn("elev", F.col("event_id") % 1000), ("class",))
    digest = lambda n, s: s.df.select("class", F.col("value").cast("double").alias("value")).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.lit(n).alias("mapper"), "class", "n", "total")
    made = [digest(n, registry(n)(base, **p)) for n, (p, _) in _MAPPED.items()]
    rows = fold(lambda x, y: x.unionByName(y), made)
    return rows.select("mapper", "class", "n", r(F.when(F.col("mapper") == "mapper.tick", F.col("total") / 1e9).otherwise(F.col("total")), 2).alias("total"))


query(
    "mappers",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS mapper, class, count(v) AS n, round(sum(v), 2) AS total FROM (SELECT class, ({e})::DOUBLE AS v FROM (SELECT *, event_id % 1000 AS elev FROM {_LL})) GROUP BY class" for n, (_, e) in _MAPPED.items()) + ") WHERE n > 0",
)(_mapped)

_WORDS = {
    "mapper.regexp.match": ({"pattern": "[a-m].*"}, "CASE WHEN regexp_full_match(v, '[a-m].*') THEN v END"),
    "mapper.regexp.replace": ({"pattern": "[aeiou]", "by": "_"}, "regexp_replace(v, '[aeiou]', '_', 'g')"),
    "mapper.tostring": ({}, "v"),
    "mapper.replace": ({"value": "x"}, "'x'"),
}
query("mappers_text", " UNION ALL ".join(f"SELECT '{n}' AS mapper, seq, {e} AS value FROM (SELECT event_id AS seq, event_type AS v FROM events) WHERE ({e}) IS NOT NULL" for n, (_, e) in _WORDS.items()))(
    lambda spark, d: fold(
        lambda x, y: x.unionByName(y),
        [registry(n)(from_table(read(spark, d, "events"), {"class": "event_type"}, micros(F.col("ts")), "event_type", "event_id"), **p).df.select(F.lit(n).alias("mapper"), "seq", "value") for n, (p, _) in _WORDS.items()],
    )
)

# --- more filters, ops and aggregators by name ----------------------------------------------------

_KEPT = {f"filter.{k}.{o}": (50.0, f"{f} {sign} 50" if k == "last" else f"{f}(value {sign} 50)") for k, f in (("last", "arg_max(value, (tick, -seq))"), ("any", "bool_or"), ("all", "bool_and")) for o, sign in _SIGNS.items()}
query("filters", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, class, user_id, count(*) AS n FROM {EV} GROUP BY class, user_id HAVING {e}" for n, (_, e) in _KEPT.items()) + ")")(
    lambda spark, d: fold(
        lambda x, y: x.unionByName(y),
        [fw.filter_series(events(spark, d, user=True), n, t).df.groupBy("class", "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("filter"), "class", "user_id", "n") for n, (t, _) in _KEPT.items()],
    )
)
_WINDOWED = {
    "mapper.median": ("quantile_cont(value, 0.5)", {}),
    "mapper.mad": ("mad(value)", {}),
    "mapper.percentile": ("quantile_disc(value, 0.9)", {"q": 90}),
    "mapper.range": ("max(value) - min(value)", {}),
    "mapper.var": ("coalesce(var_samp(value), 0.0)", {}),
    "mapper.first": ("arg_min(value, tick)", {}),
    "mapper.last": ("arg_max(value, tick)", {}),
    "mapper.highest": ("arg_max(value, (elev, tick))", {}),
    "mapper.lowest": ("arg_min(value, (elev, -tick))", {}),
    "mapper.vspeed": ("CASE WHEN max(tick) = min(tick) THEN 0.0 ELSE (arg_max(elev, tick) - arg_min(elev, tick)) / 1000.0 / ((max(tick) - min(tick)) / 1e6) END * 1000000", {}),
    "mapper.shannonentropy.1": ("CASE WHEN count(*) = 1 THEN 1.0 ELSE (ln(sum(value)) - sum(CASE WHEN value > 0 THEN value * ln(value) END) / sum(value)) / ln(CASE WHEN count(*) > 1 THEN count(*) END) END", {}),
}


def _lifted(spark: SparkSession, d: str) -> Series:
    e = read(spark, d, "events")
    rows = e.select("user_id", F.col("event_type").alias("class"), micros(F.col("ts")).alias("tick"), "value", ((F.col("event_id") * 7919) % 1000).alias("elev"), F.col("event_id").alias("seq"))
    return ops.dedup(Series(rows, ("class", "user_id")))


query(
    "mappers_windowed",
    f"WITH e AS (SELECT class, user_id, tick, value, (seq * 7919) % 1000 AS elev, row_number() OVER (PARTITION BY class, user_id ORDER BY tick) AS i FROM {DEV}), w AS (SELECT a.class, a.user_id, a.tick AS t, b.tick, b.value, b.elev FROM e a JOIN e b ON a.class = b.class AND a.user_id = b.user_id AND b.i BETWEEN a.i - 2 AND a.i + 1) "
    + " UNION ALL ".join(f"SELECT '{n}' AS mapper, class, user_id, t AS tick, round({e}, 4) AS value FROM w GROUP BY class, user_id, t" for n, (e, _) in _WINDOWED.items()),
)(
    lambda spark, d: fw.window_maps(_lifted(spark, d), {n: p for n, (_, p) in _WINDOWED.items()}, pre=2, post=1).df.select(
        "mapper", "class", "user_id", "tick", r(F.col("value") * F.when(F.col("mapper") == "mapper.vspeed", 1000000).otherwise(1)).alias("value")
    )
)

# --- streams --------------------------------------------------------------------------------------


def _source(spark: SparkSession, d: str) -> DataFrame:
    """A stream over a copy of events."""
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(d)


def _streamed(spark: SparkSession, d: str, make) -> DataFrame:
    """What a stream of aggregates gives once all of it has been read, from an in-memory sink: a row a group."""
    import uuid

    name = f"stream_{uuid.uuid4().hex}"
    running = make(_source(spark, d)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def _stream_bucketize(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming import bucketize as streaming

    make = lambda s: streaming.bucketize(s, ["event_type"], DAY, {"n": F.count(F.lit(1)), "value": F.sum("value")}, "0 seconds")
    found = _streamed(spark, d, make)
    return found.select("event_type", "tick", "n", r("value").alias("value"))


query("stream_bucketize", f"SELECT event_type, tick + (({LAST} - tick) % {DAY} + {DAY}) % {DAY} AS tick, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT event_type, epoch_us(ts) AS tick, value FROM events) GROUP BY ALL")(_stream_bucketize)


def _stream_subscribe(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming import bucketize as streaming

    found = streaming.subscribe(_source(spark, d).withColumnRenamed("event_type", "class"), ["click{user_id~1.*}", "=view{}"], ("class", "user_id"))
    return streaming.stored(spark, found.select("event_id", "class", "user_id"))


query("stream_subscribe", "SELECT event_id, event_type AS class, user_id FROM events WHERE (event_type = 'click' AND regexp_full_match(user_id::VARCHAR, '1.*')) OR event_type = 'view'")(_stream_subscribe)


# --- text formats ---------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources import ingest

    lines = ingest.render_lines(events(spark, d, user=True), ["user_id"])
    found = ingest.parse_lines(lines, "line")
    return found.select("tick", "class", F.element_at("labels", F.lit("user_id")).alias("user_id"), "type", r("double").alias("value"))


query("ingest_round_trip", f"SELECT tick, class, user_id::VARCHAR AS user_id, 'DOUBLE' AS type, round(value, 4) AS value FROM {EV}")(_lines)
