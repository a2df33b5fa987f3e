"""Functions of the user as mappers, reducers, bucketizers, filters and fillers.

A point is (tick, value); a function gets the ticks and values of its window, bucket or tick as
numpy arrays and gives a value, or a dict of values, which become one series each under the label
``output``. One series, bucket or tick partition at a time is in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import Series
from tidemark.operators.frameworks import bucket_end, keep_series


def _types(s: Series) -> str:
    types = dict(s.df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in s.keys)


def _rows(made, tick: int):
    return [(tick, k, v) for k, v in made.items()] if isinstance(made, dict) else [(tick, None, made)]


def mapper(s: Series, f: Callable, pre: int = 0, post: int = 0, value_type: str = "double") -> Series:
    """f(ticks, values, index of the point) over the window of each point: counts if positive, time spans if negative."""
    keys, tick, value = s.keys, s.tick, s.value

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick)
        t, v = pdf[tick].to_numpy(), pdf[value].to_numpy()
        n = len(t)
        if pre < 0 or post < 0:
            lo, hi = np.searchsorted(t, t + pre, "left"), np.searchsorted(t, t - post, "right")
        else:
            lo, hi = np.maximum(0, np.arange(n) - pre), np.minimum(n, np.arange(n) + post + 1)
        out = [r for i in range(n) for r in _rows(f(t[lo[i] : hi[i]], v[lo[i] : hi[i]], i - lo[i]), t[i]) if r[2] is not None]
        frame = pd.DataFrame(out, columns=[tick, "output", value])
        for i, k in enumerate(keys):
            frame.insert(i, k, pdf[k].iloc[0])
        return frame

    out = s.df.select(*keys, tick, value).groupBy(*keys).applyInPandas(run, f"{_types(s)}`{tick}` bigint, output string, `{value}` {value_type}")
    return Series(out, (*keys, "output"), tick, value)


def bucketizer(s: Series, f: Callable, span: int, last: int, value_type: str = "double") -> Series:
    """f(ticks, values) of each right-closed bucket."""
    keys, tick, value = s.keys, s.tick, s.value
    rows = s.df.where(F.col(tick) <= last).withColumn("_end", bucket_end(F.col(tick), span, F.lit(last)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick)
        out = [r for r in _rows(f(pdf[tick].to_numpy(), pdf[value].to_numpy()), int(pdf["_end"].iloc[0])) if r[2] is not None]
        frame = pd.DataFrame(out, columns=[tick, "output", value])
        for i, k in enumerate(keys):
            frame.insert(i, k, pdf[k].iloc[0])
        return frame

    out = rows.select(*keys, tick, value, "_end").groupBy(*keys, "_end").applyInPandas(run, f"{_types(s)}`{tick}` bigint, output string, `{value}` {value_type}")
    return Series(out, (*keys, "output"), tick, value)


def reducer(s: Series, by: list[str], f: Callable, value_type: str = "double") -> Series:
    """f(values) of the partition's series at each tick."""
    tick, value = s.tick, s.value
    types = dict(s.df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = f(pdf[value].to_numpy())
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), pdf[tick].iloc[0], made]], columns=[*by, tick, value]).dropna(subset=[value])

    schema = "".join(f"`{k}` {types[k]}, " for k in by) + f"`{tick}` bigint, `{value}` {value_type}"
    return Series(s.df.select(*by, tick, value).groupBy(*by, tick).applyInPandas(run, schema), tuple(by), tick, value)


def series_filter(s: Series, f: Callable[[np.ndarray, np.ndarray], bool]) -> Series:
    """Series for which f(ticks, values) holds."""
    keys, tick, value = s.keys, s.tick, s.value

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick)
        return pdf[list(keys)].head(1) if f(pdf[tick].to_numpy(), pdf[value].to_numpy()) else pdf[list(keys)].head(0)

    return keep_series(s, s.df.select(*keys, tick, value).groupBy(*keys).applyInPandas(run, _types(s).rstrip(", ")))


def filler(s: Series, ticks: DataFrame, f: Callable, pre: int = 1, post: int = 1) -> Series:
    """f(tick, ticks before, values before, ticks after, values after) at each given tick (by key) without a value."""
    keys, tick, value = s.keys, s.tick, s.value
    rows = s.df.select(*keys, tick, value).join(ticks.select(*keys, tick).distinct(), [*keys, tick], "full")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick).reset_index(drop=True)
        known = pdf[value].notna().to_numpy()
        t, v = pdf[tick].to_numpy()[known], pdf[value].to_numpy(dtype=float)[known]
        for i in np.flatnonzero(~known).tolist():
            x = pdf.at[i, tick]
            at = int(np.searchsorted(t, x))
            pdf.at[i, value] = f(x, t[max(0, at - pre) : at], v[max(0, at - pre) : at], t[at : at + post], v[at : at + post])
        return pdf.dropna(subset=[value])[[*keys, tick, value]]

    return s.with_df(rows.groupBy(*keys).applyInPandas(run, f"{_types(s)}`{tick}` bigint, `{value}` double"))


def spline(x: float, t: np.ndarray, v: np.ndarray) -> float | None:
    """Natural cubic spline through the points, at x."""
    n = len(t)
    if n < 2:
        return None
    t = t.astype(float)
    h = np.diff(t)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    i = int(np.clip(np.searchsorted(t, x) - 1, 0, n - 2))
    l, r = x - t[i], t[i + 1] - x
    return float((m[i] * r**3 + m[i + 1] * l**3) / (6 * h[i]) + (v[i] / h[i] - m[i] * h[i] / 6) * r + (v[i + 1] / h[i] - m[i + 1] * h[i] / 6) * l)


def _second_derivatives(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of the natural cubic spline at its knots, by elimination along the three diagonals."""
    h, m = np.diff(t), np.zeros(len(t))
    rise = 6 * np.diff(np.diff(v) / h)
    upper, right = np.zeros(len(t)), np.zeros(len(t))
    for i in range(1, len(t) - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * upper[i - 1]
        upper[i], right[i] = h[i] / pivot, (rise[i - 1] - h[i - 1] * right[i - 1]) / pivot
    for i in range(len(t) - 2, 0, -1):
        m[i] = right[i] - upper[i] * m[i + 1]
    return m


def lowess_filler(s: Series, ticks: DataFrame, q: int, rounds: int = 0, invalid: float | None = None) -> Series:
    """At each given tick (by key) without a value, the natural spline through the series smoothed over its q nearest points.

    Two points are joined by a line. Beyond the series' ends, and where it has fewer points, ``invalid`` or nothing.
    A series must fit a task.
    """
    from tidemark.operators.stats import lowess_values

    if q < 2:
        raise ValueError("the bandwidth must be over 1")
    keys, tick, value = s.keys, s.tick, s.value
    rows = s.df.select(*keys, tick, F.col(value).cast("double").alias(value)).join(ticks.select(*keys, tick).distinct(), [*keys, tick], "full")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick).reset_index(drop=True)
        known = pdf[value].notna().to_numpy()
        t, v = pdf[tick].to_numpy(np.int64)[known].astype(float), pdf[value].to_numpy(dtype=float)[known]
        x = pdf[tick].to_numpy(np.int64)[~known].astype(float)
        made = np.full(len(x), np.nan if invalid is None else invalid)
        inside = (x >= t[0]) & (x <= t[-1]) if len(t) > 1 else np.zeros(len(x), bool)
        if inside.any():
            y = lowess_values(t, v, q, rounds) if len(t) > 2 else v
            m = _second_derivatives(t, y)
            i = np.searchsorted(t, x[inside]) - 1
            h, left, right = t[i + 1] - t[i], x[inside] - t[i], t[i + 1] - x[inside]
            made[inside] = (m[i] * right**3 + m[i + 1] * left**3) / (6 * h) + (y[i] / h - m[i] * h / 6) * right + (y[i + 1] / h - m[i + 1] * h / 6) * left
        pdf.loc[~known, value] = made
        return pdf.dropna(subset=[value])[[*keys, tick, value]]

    return s.with_df(rows.groupBy(*keys).applyInPandas(run, f"{_types(s)}`{tick}` bigint, `{value}` double"))


def akima(x: float, t: np.ndarray, v: np.ndarray) -> float | None:
    """Akima's piecewise cubic through at least five points, at x."""
    n = len(t)
    if n < 5:
        return None
    t = t.astype(float)
    d = np.diff(v) / np.diff(t)
    d = np.concatenate([[3 * d[0] - 2 * d[1], 2 * d[0] - d[1]], d, [2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]])
    w1, w2 = np.abs(d[3:] - d[2:-1]), np.abs(d[1:-2] - d[:-3])
    s = np.where(w1 + w2 > 0, (w1 * d[1:-2] + w2 * d[2:-1]) / np.where(w1 + w2 > 0, w1 + w2, 1), (d[1:-2] + d[2:-1]) / 2)
    i = int(np.clip(np.searchsorted(t, x) - 1, 0, n - 2))
    h, u = t[i + 1] - t[i], x - t[i]
    m = (v[i + 1] - v[i]) / h
    return float(v[i] + s[i] * u + (3 * m - 2 * s[i] - s[i + 1]) / h * u**2 + (s[i] + s[i + 1] - 2 * m) / h**2 * u**3)


def newton(x: float, t: np.ndarray, v: np.ndarray) -> float | None:
    """The polynomial through all points, by divided differences, at x."""
    if not len(t):
        return None
    t, c = t.astype(float), v.astype(float).copy()
    for j in range(1, len(t)):
        c[j:] = (c[j:] - c[j - 1 : -1]) / (t[j:] - t[: len(t) - j])
    out = c[-1]
    for k in range(len(t) - 2, -1, -1):
        out = out * (x - t[k]) + c[k]
    return float(out)


def by_curve(f: Callable[[float, np.ndarray, np.ndarray], float | None]) -> Callable:
    """A curve through points as a filler."""
    return lambda x, t0, v0, t1, v1: f(x, np.concatenate([t0, t1]), np.concatenate([v0, v1])) if len(t0) and len(t1) else None


def trend(x, t0, v0, t1, v1) -> float | None:
    """Mean of the two straight lines through the last two points before and the first two after, weighted by nearness."""
    if len(t0) < 2 or len(t1) < 2:
        return None
    a = v0[-1] + (v0[-1] - v0[-2]) / (t0[-1] - t0[-2]) * (x - t0[-1])
    b = v1[0] + (v1[1] - v1[0]) / (t1[1] - t1[0]) * (x - t1[0])
    share = (x - t0[-1]) / (t1[0] - t0[-1])
    return float(a * (1 - share) + b * share)
