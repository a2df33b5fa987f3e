"""Text formats of points: ingest lines, InfluxDB line protocol, and the JSON of series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import Series

#: TS/LAT:LON/ELEV class{labels}{attributes} value
_LINE = r"^(=?)(-?[0-9]*)/(?:(-?[0-9.eE+-]+):(-?[0-9.eE+-]+))?/(-?[0-9]*)\s+(?:([^{\s]+)\{([^}]*)\}(?:\{([^}]*)\})?\s+)?(.*)$"


def _decoded(text: Column) -> Column:
    return F.try_url_decode(text)


def _map(text: Column) -> Column:
    """``a=b,c=d``, percent-encoded, as a map."""
    pairs = F.filter(F.split(text, ","), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_arrays(
        F.transform(pairs, lambda x: _decoded(F.substring_index(x, "=", 1))),
        F.transform(pairs, lambda x: _decoded(F.substr(x, F.instr(x, "=") + 1))),
    )


def value_type(text: Column) -> Column:
    """LONG, DOUBLE, BOOLEAN or STRING, as the literal is written."""
    return (
        F.when(text.rlike("^'.*'$|^\".*\"$"), "STRING")
        .when(F.lower(text).isin("t", "f", "true", "false"), "BOOLEAN")
        .when(text.rlike("^[+-]?[0-9]+$"), "LONG")
        .when(text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$") | text.isin("NaN", "Infinity", "-Infinity"), "DOUBLE")
        .otherwise("INVALID")
    )


def parse_lines(lines: DataFrame, column: str = "value", max_past: int | None = None, max_future: int | None = None) -> DataFrame:
    """Points of ingest lines: tick, lat, lon, elev, class, labels, attributes, raw value, its type and typed columns.

    Lines that don't parse have a null class and type INVALID, so that they can be counted; a line
    that begins with ``=`` needs continued() first. Ticks further than max_past before now or
    max_future after it are left out; an empty tick is now.
    """
    part = lambda i: F.nullif(F.regexp_extract(column, _LINE, i), F.lit(""))
    now = F.unix_micros(F.current_timestamp())
    raw = F.trim(F.regexp_extract(column, _LINE, 9))
    text = F.when(raw.rlike("^'.*'$|^\".*\"$"), _decoded(F.substr(raw, F.lit(2), F.length(raw) - 2)))
    out = lines.select(
        F.coalesce(part(2).cast("bigint"), now).alias("tick"),
        part(3).cast("double").alias("lat"),
        part(4).cast("double").alias("lon"),
        part(5).cast("bigint").alias("elev"),
        _decoded(part(6)).alias("class"),
        _map(F.regexp_extract(column, _LINE, 7)).alias("labels"),
        _map(F.regexp_extract(column, _LINE, 8)).alias("attributes"),
        raw.alias("raw"),
        value_type(raw).alias("type"),
        F.when(value_type(raw) == "LONG", raw.cast("bigint")).alias("long"),
        F.when(value_type(raw).isin("DOUBLE", "LONG"), raw.cast("double")).alias("double"),
        F.when(value_type(raw) == "BOOLEAN", F.lower(raw).isin("t", "true")).alias("boolean"),
        text.alias("string"),
    )
    if max_past is not None:
        out = out.where(F.col("tick") >= now - max_past)
    if max_future is not None:
        out = out.where(F.col("tick") <= now + max_future)
    return out


def continued(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines in which ``=`` stands for the series of the line before, within one partition of the source, completed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = ""
        for f in frames:
            out = []
            for line in f[column]:
                if line and line.startswith("="):
                    place, _, value = line[1:].partition(" ")
                    line = f"{place} {last} {value.strip()}"
                elif line:
                    parts = line.split(None, 2)
                    last = parts[1] if len(parts) > 2 else last
                out.append(line)
            yield pd.DataFrame({column: out})

    return lines.select(column).mapInPandas(run, f"`{column}` string")


def render_lines(s: Series, labels: list[str], class_column: str = "class") -> DataFrame:
    """One ingest line a point."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in s.df.columns else F.lit("")
    place = F.when(F.col("lat").isNotNull(), F.concat(at("lat"), F.lit(":"), at("lon"))).otherwise("") if "lat" in s.df.columns else F.lit("")
    tags = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.url_encode(F.col(k).cast("string"))) for k in sorted(labels)])
    value = F.col(s.value).cast("string")
    if dict(s.df.dtypes)[s.value] == "string":
        value = F.concat(F.lit("'"), F.url_encode(value), F.lit("'"))
    elif dict(s.df.dtypes)[s.value] == "boolean":
        value = F.when(F.col(s.value), "T").otherwise("F")
    return s.df.select(F.concat(F.col(s.tick).cast("string"), F.lit("/"), place, F.lit("/"), at("elev"), F.lit(" "), F.url_encode(F.col(class_column)), F.lit("{"), tags, F.lit("} "), value).alias("line"))


_ILP = r"^((?:\\.|[^\s,])+)((?:,(?:\\.|[^\s,=])+=(?:\\.|[^\s,])+)*)\s+((?:\\.|\"(?:\\.|[^\"])*\"|[^\s\"])+)(?:\s+(-?[0-9]+))?$"


def parse_influx(lines: DataFrame, column: str = "value", per_micro: int = 1000) -> DataFrame:
    """Points of line protocol, one a field: class ``measurement.field``, labels, tick in microseconds, raw value and type."""
    part = lambda i: F.regexp_extract(column, _ILP, i)
    fields = F.regexp_extract_all(part(3), F.lit(r'((?:\\.|[^,=])+)=("(?:\\.|[^"])*"|[^,]+)'), F.lit(0))
    tags = F.substr(part(2), F.lit(2))
    rows = lines.where(F.col(column).rlike(_ILP)).select(
        part(1).alias("m"),
        _map(tags).alias("labels"),
        (F.floor(F.nullif(part(4), F.lit("")).cast("bigint") / per_micro)).cast("bigint").alias("t"),
        F.explode(fields).alias("f"),
    )
    raw = F.substr(F.col("f"), F.instr(F.col("f"), "=") + 1)
    plain = F.when(raw.rlike("^-?[0-9]+[iu]$"), F.substr(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    kind = F.when(raw.rlike("^-?[0-9]+[iu]$"), "LONG").when(raw.startswith('"'), "STRING").when(F.lower(raw).isin("t", "f", "true", "false"), "BOOLEAN").otherwise("DOUBLE")
    return rows.select(
        F.concat_ws(".", "m", F.substring_index("f", "=", 1)).alias("class"),
        "labels",
        F.coalesce("t", F.unix_micros(F.current_timestamp())).alias("tick"),
        F.when(kind == "STRING", F.substr(plain, F.lit(2), F.length(plain) - 2)).otherwise(plain).alias("raw"),
        kind.alias("type"),
    )


def to_json(s: Series, labels: list[str], class_column: str = "class") -> DataFrame:
    """A JSON object a series: c class, l labels, v rows of [tick, value] in order. For export: a row holds a whole series."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(s.tick).alias("t"), F.col(s.value).alias("v"))))
    tags = F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), F.array(*[F.col(k).cast("string") for k in labels]))
    out = s.df.groupBy(*s.keys).agg(rows.alias("_v"))
    values = F.transform("_v", lambda r: F.array(r["t"].cast("string"), r["v"].cast("string")))
    return out.select(F.to_json(F.struct(F.col(class_column).alias("c"), tags.alias("l"), values.alias("v"))).alias("json"))


def append(s: Series, path: str, by: str = "class") -> None:
    """Adds points to a Parquet store, one folder a class."""
    s.df.write.mode("append").partitionBy(by).parquet(path)


def without(points: DataFrame, keys: list[str], selected: DataFrame, tick: str, start: int, end: int) -> DataFrame:
    """The points left after deleting the selected series' ticks within start..end."""
    gone = points.where(F.col(tick).between(start, end)).join(selected.select(*keys).distinct(), keys, "left_semi")
    return points.join(gone.select(*keys, tick).distinct(), [*keys, tick], "left_anti")
