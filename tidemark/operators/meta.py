"""Series looked up and ordered by what names them; series made from and taken apart into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.model import Series
from tidemark.sources.selector import predicate


def find(s: Series, selector: str) -> DataFrame:
    """The keys of the selected series, one row each."""
    return s.df.where(predicate(selector, s.keys)).select(*s.keys).distinct()


def find_sets(s: Series, selector: str) -> DataFrame:
    """(key, value): the distinct values of the class and of each label of the selected series."""
    rows = find(s, selector)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in s.keys])).alias("_p")
    return rows.select(pairs).select("_p.key", "_p.value").distinct()


def find_stats(s: Series, selector: str, class_column: str = "class") -> DataFrame:
    """How many series are selected, and how many distinct values the class and each label have among them."""
    rows = find(s, selector)
    return rows.agg(F.count(F.lit(1)).alias("series"), *[F.count_distinct(k).alias("classes" if k == class_column else k) for k in s.keys])


def meta_set(s: Series, selector: str) -> Series:
    """The points of the series selected now: later points of other series don't join."""
    return s.with_df(s.df.join(find(s, selector), list(s.keys), "left_semi"))


def meta(known: DataFrame, new: DataFrame, keys: Sequence[str], diff: bool = False) -> DataFrame:
    """A table (keys, attributes map) after other attributes were set; diff: only those named change, and empty values remove one."""
    old, fresh = known.select(*keys, F.col("attributes").alias("_old")), new.select(*keys, F.col("attributes").alias("_new"))
    none = F.create_map().cast("map<string,string>")
    rows = old.join(fresh, list(keys), "full")
    if diff:
        kept = F.map_filter(F.coalesce("_old", none), lambda k, v: ~F.map_contains_key(F.coalesce("_new", none), k))
        merged = F.map_concat(kept, F.map_filter(F.coalesce("_new", none), lambda k, v: F.length(v) > 0))
    else:
        merged = F.coalesce("_new", "_old")
    return rows.select(*keys, merged.alias("attributes"))


def fetch_type(s: Series, selector: str, kind: str, *args, **options) -> Series:
    """As fetch, for values of one type only: those of a text column that read as LONG, DOUBLE or BOOLEAN, or the rest as STRING."""
    from tidemark.sources.ingest import value_type
    from tidemark.sources.selector import fetch

    found = fetch(s, selector, *args, **options)
    text = F.col(s.value).cast("string")
    target = {"LONG": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string"}[kind]
    own = dict(s.df.dtypes)[s.value]
    if own != "string":
        fits = {"bigint": "LONG", "int": "LONG", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOLEAN"}.get(own) == kind
        return found.with_df(found.df if fits else found.df.limit(0))
    on = ~value_type(text).isin("LONG", "DOUBLE", "BOOLEAN") if kind == "STRING" else value_type(text) == kind
    rows = found.df.where(on)
    return found.with_df(rows.withColumn(s.value, F.col(s.value).try_cast(target)))


# --- order ----------------------------------------------------------------------------------------


def sort(s: Series, reverse: bool = False) -> DataFrame:
    """Points of each series by tick, as a table in that order: for export."""
    return s.df.orderBy(*s.keys, *[F.col(c).desc() if reverse else F.col(c) for c in s.order()])


def value_sort(s: Series, reverse: bool = False) -> DataFrame:
    """Points of each series by value, then tick."""
    return s.df.orderBy(*s.keys, *[F.col(c).desc() if reverse else F.col(c) for c in (s.value, *s.order())])


def meta_sort(s: Series, fields: Sequence[str] = ()) -> DataFrame:
    """The series by the given keys, or all."""
    return s.df.select(*s.keys).distinct().orderBy(*(fields or s.keys))


def zipped(*sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The i-th series of each list side by side; a list of one goes with all. Lists are in order of ``by``."""
    number = lambda df, i: df.select(F.row_number().over(Window.orderBy(*by)).alias("_i"), F.struct(*[F.col(c) for c in df.columns]).alias(f"series_{i}"))
    numbered = [number(df, i) for i, df in enumerate(sets)]  # one row a series
    out, many = None, [df.limit(2).count() > 1 for df in sets]
    for n, more in zip(numbered, many, strict=True):
        if out is None:
            out = n
        elif more and "_i" in out.columns:
            out = out.join(n, "_i")
        else:
            out = out.crossJoin(n.drop("_i"))  # one row
    return out.orderBy("_i").drop("_i")


# --- parts ----------------------------------------------------------------------------------------


def make(spark_rows: DataFrame, keys: Sequence[str], ticks: str, values: str, lats: str | None = None, lons: str | None = None, elevs: str | None = None) -> Series:
    """Series from columns of arrays, one row a series; shorter arrays leave nulls, and points without a value go."""
    names = [n for n in (ticks, lats, lons, elevs, values) if n]
    alias = dict(zip((ticks, lats, lons, elevs, values), ("tick", "lat", "lon", "elev", "value"), strict=True))
    rows = spark_rows.select(*keys, F.explode(F.arrays_zip(*[F.col(n) for n in names])).alias("_p"))
    return Series(rows.select(*keys, *[F.col(f"_p.{n}").alias(alias[n]) for n in names]).where("value is not null"), tuple(keys))


def add_value(s: Series, points: DataFrame, overwrite: bool = False) -> Series:
    """More points; with overwrite they take the place of those at the same ticks."""
    rows = s.df.join(points.select(*s.keys, s.tick).distinct(), [*s.keys, s.tick], "left_anti") if overwrite else s.df
    return s.with_df(rows.unionByName(points, allowMissingColumns=True))


def clone_empty(s: Series) -> Series:
    """The same keys and columns without points."""
    return s.with_df(s.df.limit(0))


def set_attributes(df: DataFrame, attributes: dict[str, str | None], column: str = "attributes") -> DataFrame:
    """Attributes set on every row; empty or null values remove one, and a null key drops all others first."""
    own = F.coalesce(F.col(column), F.create_map().cast("map<string,string>")) if column in df.columns and None not in attributes else F.create_map().cast("map<string,string>")
    kept = F.map_filter(own, lambda k, v: ~k.isin(*[x for x in attributes if x is not None])) if any(x is not None for x in attributes) else own
    given = [F.lit(x) for k, v in attributes.items() if k is not None and v for x in (k, v)]
    return df.withColumn(column, F.map_concat(kept, F.create_map(*given)) if given else kept)


def bucket_span(s: Series) -> int:
    """0 without a grid."""
    return s.grid.span if s.grid else 0


def bucket_count(s: Series) -> DataFrame:
    """Buckets of each series' grid."""
    if s.grid and s.grid.count:
        return s.df.select(*s.keys).distinct().withColumn("bucket_count", F.lit(s.grid.count))
    last = F.lit(s.grid.last) if s.grid and s.grid.last else F.max(s.tick)
    span = bucket_span(s)
    count = F.floor((last - F.min(s.tick)) / span) + 1 if span else F.lit(0)
    return s.df.groupBy(*s.keys).agg(count.cast("bigint").alias("bucket_count"))


def last_bucket(s: Series) -> DataFrame:
    """End of each series' last bucket."""
    last = F.lit(s.grid.last) if s.grid and s.grid.last else F.max(s.tick)
    return s.df.groupBy(*s.keys).agg(last.cast("bigint").alias("last_bucket"))


def name(s: Series, class_column: str = "class") -> DataFrame:
    return s.df.select(class_column).distinct()


def labels(s: Series, class_column: str = "class") -> DataFrame:
    """The labels of each series as a map."""
    own = [k for k in s.keys if k != class_column]
    pairs = [x for k in own for x in (F.lit(k), F.col(k).cast("string"))]
    tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return s.df.select(*s.keys).distinct().withColumn("labels", tags)


def attributes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, "attributes").distinct()


def last_activity(s: Series, written: str) -> DataFrame:
    """When each series last got a point, from the column that holds the time of writing."""
    return s.df.groupBy(*s.keys).agg(F.max(written).alias("last_activity"))


def tick_list(s: Series) -> DataFrame:
    """Ticks of each series in order: for export, one row holds a whole series."""
    return s.df.groupBy(*s.keys).agg(F.sort_array(F.collect_list(s.tick)).alias("ticks"))


def loc_strings(s: Series) -> DataFrame:
    """The places of each series as cell codes, in order of tick: for export."""
    code = F.lower(F.lpad(F.hex(geo.hhcode(F.col("lat"), F.col("lon"))), 16, "0"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(s.tick).alias("t"), code.alias("c"))))
    return s.df.where("lat is not null and lon is not null").groupBy(*s.keys).agg(F.transform(rows, lambda r: r["c"]).alias("places"))


def multi(part: str):
    """The parts of values that hold points themselves: array<struct<tick,lat,lon,elev,value>> -> array of one field."""

    def extract(column: Column) -> Column:
        if part == "hhcode":
            return F.transform(column, lambda p: geo.hhcode(p["lat"], p["lon"]))
        if part == "location":
            return F.transform(column, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
        return F.transform(column, lambda p: p[part])

    return extract


def multi_split(s: Series, by_index: bool = False, label: str = "part") -> Series:
    """Points of multivalues as points of their own: of one series each index, or all under the tick that each has."""
    rows = s.df.select(*s.keys, F.col(s.tick).alias("_t"), F.posexplode(s.value).alias("_i", "_p"))
    if by_index:
        return Series(rows.select(*s.keys, F.col("_i").cast("bigint").alias(label), F.col("_t").alias(s.tick), F.col("_p.value").alias(s.value)), (*s.keys, label), s.tick, s.value)
    return Series(rows.select(*s.keys, F.coalesce("_p.tick", "_t").alias(s.tick), F.col("_p.value").alias(s.value)), s.keys, s.tick, s.value)


def probability(s: Series, histogram: DataFrame) -> DataFrame:
    """The share of each point's value in a histogram (keys, value, n) of its series; 0 for values it lacks."""
    total = histogram.groupBy(*s.keys).agg(F.sum("n").alias("_all"))
    rows = s.df.join(histogram.select(*s.keys, F.col(s.value), "n"), [*s.keys, s.value], "left").join(total, list(s.keys), "left")
    return rows.withColumn("probability", F.coalesce(F.col("n") / F.col("_all"), F.lit(0.0))).drop("n", "_all")


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
