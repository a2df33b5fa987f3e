"""The unit of data: labelled time series as rows of one long DataFrame.

A Series wraps a DataFrame with one row per point. ``keys`` are the columns whose values identify
a series (its class and labels), ``tick`` is a BIGINT time in microseconds, ``value`` the value,
and lat, lon, elev and seq (insertion order) are there when the data has them. A bucketized Series
also knows its grid: span, and where they are fixed for all series, last bucket and count.
Everything stays lazy; operators return new Series or plain DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PLACE = ("lat", "lon", "elev")


@dataclass(frozen=True)
class Grid:
    """Right-closed buckets (end - span, end], the last of which ends at ``last``; None: each series' own."""

    span: int
    last: int | None = None
    count: int | None = None


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...]
    tick: str = "tick"
    value: str = "value"
    grid: Grid | None = None

    @property
    def place(self) -> tuple[str, ...]:
        return tuple(c for c in PLACE if c in self.df.columns)

    @property
    def seq(self) -> str | None:
        return "seq" if "seq" in self.df.columns else None

    def over(self, *order: Column | str) -> WindowSpec:
        """Rows of one series, in order of tick unless told otherwise."""
        w = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        return w.orderBy(*(order or self.order()))

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))

    def order(self) -> list[str]:
        return [self.tick, *([self.seq] if self.seq else [])]

    def with_df(self, df: DataFrame, **more) -> Series:
        return replace(self, df=df, **more)

    def points(self, *more: Column) -> list[Column]:
        """The columns of a point, for select()."""
        return [*[F.col(k) for k in self.keys], F.col(self.tick), *[F.col(c) for c in self.place], F.col(self.value), *([F.col(self.seq)] if self.seq else []), *more]

    def valued(self, value: Column) -> Series:
        """The same points with other values; points whose new value is null go."""
        df = self.df.withColumn(self.value, value)
        return self.with_df(df.where(F.col(self.value).isNotNull()))


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp"))


def from_table(df: DataFrame, keys: dict[str, Column | str], tick: Column, value: Column | str, seq: Column | str | None = None, **place: Column | str) -> Series:
    """A Series out of any table: key names and expressions, a tick in microseconds (or a timestamp expression given through micros())."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    columns = [as_col(c).alias(k) for k, c in keys.items()] + [tick.cast("bigint").alias("tick")]
    columns += [as_col(c).alias(k) for k, c in place.items() if c is not None]
    columns.append(as_col(value).alias("value"))
    if seq is not None:
        columns.append(as_col(seq).alias("seq"))
    return Series(df.select(*columns).where(F.col("value").isNotNull()), tuple(keys))
