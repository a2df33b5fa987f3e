"""Statistics of series: relational where the measure is a sum, grouped numpy kernels where it is sequential."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import Series
from tidemark.operators.frameworks import scaffold
from tidemark.operators.series import _valued, spread, with_measures

# --- sums -----------------------------------------------------------------------------------------


def mu_sigma(s: Series, bessel: bool = True) -> DataFrame:
    sd = F.stddev_samp(s.value) if bessel else F.stddev_pop(s.value)
    return s.df.groupBy(*s.keys).agg(F.avg(s.value).alias("mu"), F.coalesce(sd, F.lit(0.0)).alias("sigma"))


def n_sum_sumsq(s: Series) -> DataFrame:
    v = F.col(s.value)
    return s.df.groupBy(*s.keys).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"))


def _moment(s: Series, k: int, bessel: bool) -> DataFrame:
    """Mean of ((x - mean) / sd)**k; the flag only changes sd. Spark's own central moments add up within each task before
    the shuffle; they divide by the population's sd."""
    v = F.col(s.value).cast("double")
    own = F.skewness(v) if k == 3 else F.kurtosis(v) + 3
    n = F.count(v)
    scale = F.pow((n - 1) / n, F.lit(k / 2)) if bessel else F.lit(1.0)
    return s.df.groupBy(*s.keys).agg(F.when(F.stddev_pop(v) != 0, own * scale).alias("moment"))


def kurtosis(s: Series, bessel: bool = False) -> DataFrame:
    return _moment(s, 4, bessel).withColumnRenamed("moment", "kurtosis")


def skewness(s: Series, bessel: bool = False) -> DataFrame:
    return _moment(s, 3, bessel).withColumnRenamed("moment", "skewness")


def histogram(s: Series) -> DataFrame:
    """How often each value occurs in each series."""
    return s.df.groupBy(*s.keys, s.value).agg(F.count(F.lit(1)).alias("n"))


def mode(s: Series) -> DataFrame:
    """All most frequent values."""
    h = histogram(s)
    most = F.max("n").over(Window.partitionBy(*s.keys))
    return h.withColumn("_m", most).where("n = _m").drop("_m")


def prob(s: Series) -> Series:
    """Each point's value replaced by its share of all points of the series."""
    n = F.count(F.lit(1))
    same = n.over(Window.partitionBy(*s.keys, s.value))
    return _valued(s, same / n.over(s.whole()))


def cprob(s: Series, separator: str | None = None) -> Series:
    """P(value), or with a separator P(event | prefix), split at its last occurrence."""
    if separator is None:
        return prob(s)
    prefix = F.regexp_replace(s.value, f"(?s)\\Q{separator}\\E(?!.*\\Q{separator}\\E).*$", "")
    rows = s.df.withColumn("_prefix", prefix)
    n = F.count(F.lit(1))
    value = n.over(Window.partitionBy(*s.keys, s.value)) / n.over(Window.partitionBy(*s.keys, "_prefix"))
    return s.with_df(rows.withColumn("_v", value).withColumn(s.value, F.col("_v")).drop("_v", "_prefix"))


def linear_regression(s: Series) -> DataFrame:
    """alpha and beta of value = alpha + beta * tick."""
    x, y = F.col(s.tick).cast("double"), F.col(s.value).cast("double")
    return s.df.groupBy(*s.keys).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"))


def correlate(a: Series, b: Series, by: list[str], offsets: list[int]) -> DataFrame:
    """Correlation of a with b shifted by each offset, in ticks."""
    shifts = F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")
    left = a.df.select(*by, F.col(a.tick).alias("tick"), F.col(a.value).cast("double").alias("a"))
    right = b.df.select(*by, F.col(b.tick).alias("_t"), F.col(b.value).cast("double").alias("b"), shifts).withColumn("tick", F.col("_t") + F.col("offset")).drop("_t")
    return left.join(right, [*by, "tick"]).groupBy(*by, "offset").agg(F.corr("a", "b").alias("correlation"))


def nbounds(m: int, mu: float = 0.0, sigma: float = 1.0) -> list[float]:
    """Bounds of m intervals of equal probability under a normal distribution."""
    from statistics import NormalDist

    d = NormalDist(mu, sigma)
    return [d.inv_cdf(k / m) for k in range(1, m)]


def lbounds(a: float, b: float, m: int) -> list[float]:
    """Bounds of m equal intervals between a and b, with the two beyond."""
    return [a + (b - a) * k / m for k in range(m + 1)]


# --- outliers -------------------------------------------------------------------------------------


def threshold_test(s: Series, threshold: float) -> DataFrame:
    return s.df.where(F.abs(s.value) >= threshold).select(*s.keys, s.tick)


def zscore_test(s: Series, mad: bool = False, threshold: float = 3.5) -> DataFrame:
    """Ticks whose z-score (or modified z-score) reaches the threshold."""
    w, v = s.whole(), F.col(s.value)
    if mad:
        rows = s.df.withColumn("_m", F.percentile(v, F.lit(0.5)).over(w))
        rows = rows.withColumn("_d", F.percentile(F.abs(v - F.col("_m")), F.lit(0.5)).over(w) / 0.6745)
    else:
        rows = with_measures(s, _m=F.avg(v), _d=spread(v))
    return rows.where((F.col("_d") != 0) & (F.abs((v - F.col("_m")) / F.col("_d")) >= threshold)).select(*s.keys, s.tick)


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + step * d, 1e-300) if 1 + step * d != 0 else 1e300
        c = 1 + step / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) / a


def t_quantile(p: float, dof: float) -> float:
    """Student's t quantile by bisection."""
    def cdf(t: float) -> float:
        tail = _betainc(dof / 2, 0.5, dof / (dof + t * t)) / 2
        return 1 - tail if t > 0 else tail

    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def grubbs_limit(n: int, alpha: float = 0.05) -> float:
    if n < 3:
        return math.inf
    t2 = t_quantile(alpha / (2 * n), n - 2) ** 2
    return (n - 1) / math.sqrt(n) * math.sqrt(t2 / (n - 2 + t2))


def _scores(v: np.ndarray, mad: bool) -> np.ndarray:
    if mad:
        m = np.median(v)
        d = np.median(np.abs(v - m)) / 0.6745
    else:
        m, d = v.mean(), v.std(ddof=1) if len(v) > 1 else 0.0
    return np.abs(v - m) / d if d else np.zeros(len(v))


def esd_outliers(v: np.ndarray, most: int, alpha: float = 0.05, mad: bool = False) -> np.ndarray:
    """Indices of the outliers of the generalised ESD test, for at most ``most`` of them."""
    left, found, kept = np.arange(len(v)), [], 0
    n = len(v)
    for i in range(1, min(most, n - 2) + 1):
        z = _scores(v[left], mad)
        at = int(z.argmax())
        p = 1 - alpha / (2 * (n - i + 1))
        t = t_quantile(p, n - i - 1)
        limit = (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1))
        found.append(left[at])
        if z[at] > limit:
            kept = i
        left = np.delete(left, at)
    return np.array(found[:kept], dtype=int)


def _kernel(s: Series, f, value_type: str = "double", more: str = "") -> DataFrame:
    """f(pandas frame of one series, in order of tick) -> frame with the key columns. A series must fit a task."""
    types = dict(s.df.dtypes)
    keys = ", ".join(f"`{k}` {types[k]}" for k in s.keys)
    schema = f"{keys}, `{s.tick}` bigint, `{s.value}` {value_type}{more}" if keys else f"`{s.tick}` bigint, `{s.value}` {value_type}{more}"

    tick, value, names = s.tick, s.value, s.keys

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tick)
        out = f(pdf[tick].to_numpy(), pdf[value].to_numpy())
        frame = pd.DataFrame(out).rename(columns={"tick": tick, "value": value})
        for i, k in enumerate(names):
            frame.insert(i, k, pdf[k].iloc[0])
        return frame

    return s.df.select(*s.keys, s.tick, s.value).groupBy(*s.keys).applyInPandas(run, schema)


def grubbs_test(s: Series, mad: bool = False, alpha: float = 0.05) -> DataFrame:
    def f(t, v):
        z = _scores(v, mad)
        at = z.argmax() if len(z) else 0
        hit = [at] if len(z) and z[at] > grubbs_limit(len(v), alpha) else []
        return {"tick": t[hit], "value": v[hit].astype(float)}

    return _kernel(s, f)


def esd_test(s: Series, most: int, mad: bool = False, alpha: float = 0.05) -> DataFrame:
    def f(t, v):
        at = np.sort(esd_outliers(v.astype(float), most, alpha, mad))
        return {"tick": t[at], "value": v[at].astype(float)}

    return _kernel(s, f)


# --- smoothing ------------------------------------------------------------------------------------


def single_exponential(s: Series, alpha: float) -> Series:
    def f(t, v):
        return {"tick": t, "value": pd.Series(v.astype(float)).ewm(alpha=alpha, adjust=False).mean().to_numpy()}

    return s.with_df(_kernel(s, f))


def double_exponential(s: Series, alpha: float, beta: float) -> DataFrame:
    """Level (value) and trend of Holt's method, from the second point on, where they are its value and its rise."""

    def f(t, v):
        level, trend = np.zeros(len(v)), np.zeros(len(v))
        if len(v) > 1:
            level[1], trend[1] = v[1], v[1] - v[0]
        for i in range(2, len(v)):
            level[i] = alpha * v[i] + (1 - alpha) * (level[i - 1] + trend[i - 1])
            trend[i] = beta * (level[i] - level[i - 1]) + (1 - beta) * trend[i - 1]
        return {"tick": t[1:], "value": level[1:], "trend": trend[1:]}

    return _kernel(s, f, more=", trend double")


def lowess_values(x: np.ndarray, y: np.ndarray, q: int, rounds: int = 0, degree: int = 1) -> np.ndarray:
    """Local regression with tricube weights over the q nearest points; ``rounds`` of bisquare reweighting."""
    x, y = x.astype(float), y.astype(float)
    n = len(x)
    q = min(max(q, 2), n)
    robust, out = np.ones(n), y.copy()
    for _ in range(rounds + 1):
        lo = 0
        for i in range(n):
            while lo + q < n and x[lo + q] - x[i] < x[i] - x[lo]:
                lo += 1
            part = slice(lo, lo + q)
            d = np.abs(x[part] - x[i])
            h = d.max() or 1.0
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3 * robust[part]
            if w.sum() == 0:
                continue
            xc = x[part] - x[i]
            a = np.vander(xc, degree + 1)
            sw = np.sqrt(w)
            beta, *_ = np.linalg.lstsq(a * sw[:, None], y[part] * sw, rcond=None)
            out[i] = beta[-1]
        rest = np.abs(y - out)
        m = np.median(rest)
        if m == 0:
            break
        robust = np.clip(1 - (rest / (6 * m)) ** 2, 0, None) ** 2
    return out


def lowess(s: Series, q: int, rounds: int = 0, degree: int = 1) -> Series:
    return s.with_df(_kernel(s, lambda t, v: {"tick": t, "value": lowess_values(t, v, q, rounds, degree)}))


def stl(s: Series, period: int, rounds: int = 2, seasonal: int = 7, trend: int | None = None) -> DataFrame:
    """Seasonal, trend and remainder (value) by loess, for a gap-free grid."""

    def f(t, v):
        y = v.astype(float)
        x = np.arange(len(y))
        t_part, s_part = np.zeros(len(y)), np.zeros(len(y))
        width = trend or int(1.5 * period / (1 - 1.5 / seasonal)) | 1
        for _ in range(rounds):
            rest = y - t_part
            for k in range(period):
                on = np.arange(k, len(y), period)
                if len(on) > 1:
                    s_part[on] = lowess_values(np.arange(len(on)), rest[on], seasonal)
                elif len(on):
                    s_part[on] = rest[on]
            low = pd.Series(s_part).rolling(period, center=True, min_periods=1).mean().to_numpy()
            s_part = s_part - low
            t_part = lowess_values(x, y - s_part, width)
        return {"tick": t, "value": y - s_part - t_part, "seasonal": s_part, "trend": t_part}

    return _kernel(s, f, more=", seasonal double, trend double")


def stl_esd_test(s: Series, period: int, most: int, alpha: float = 0.05, mad: bool = True) -> DataFrame:
    rest = stl(s, period)
    return esd_test(Series(rest.select(*s.keys, s.tick, s.value), s.keys, s.tick, s.value), most, mad, alpha)


# --- shape ----------------------------------------------------------------------------------------


def lttb_indices(t: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """First and last, and of each of n - 2 buckets of size len / (n - 1) the point of the largest triangle.

    A triangle's corners are the first point of all, the candidate, and the centre of the next bucket,
    whose sums are divided by its size plus one. (The published method moves the first corner along.)
    """
    size = len(t)
    if size <= n - 2 or size < 3:
        return np.arange(size)
    cut = 1 + np.floor(np.arange(n + 1) * (size / (n - 1))).astype(int)
    out = [0]
    for i in range(n - 2):
        a, b = min(cut[i + 1], size - 1), min(cut[i + 2], size - 1)
        t_mean, v_mean = t[a:b].sum() / (b - a + 1), v[a:b].sum() / (b - a + 1)
        a, b = cut[i] if cut[i] < size - 1 else size - 2, min(cut[i + 1], size - 1)
        if b > a:
            area = np.abs((t[0] - t_mean) * (v[a:b] - v[0]) - (t[0] - t[a:b]) * (v_mean - v[0]))
            out.append(a + int(area.argmax()))
    return np.array([*out, size - 1])


def tlttb_indices(t: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """As lttb_indices, with n - 2 buckets of equal time between the ends; buckets without points choose nothing."""
    size = len(t)
    if size <= n - 2 or size < 3:
        return np.arange(size)
    if n < 3:
        raise ValueError("at least three points must be asked for")
    span = max(1, math.ceil((int(t[-1]) - int(t[0]) - 2) / (n - 2)))
    inner = (t[1:-1] - t[0] - 1) // span
    start = np.concatenate([[0], 1 + np.flatnonzero(np.diff(inner, prepend=inner[0] - 1)), [size - 1]])
    end = np.append(start[1:], size)
    tick, value = t.astype(float), v.astype(float)
    out = [0]
    for i in range(1, len(start) - 1):
        after = slice(start[i + 1], end[i + 1])
        n_after = end[i + 1] - start[i + 1] + 1
        t_mean, v_mean = tick[after].sum() / n_after, value[after].sum() / n_after
        own = slice(start[i], end[i])
        area = np.abs((tick[0] - t_mean) * (value[own] - value[0]) - (tick[0] - tick[own]) * (v_mean - value[0]))
        out.append(int(start[i] + area.argmax()))
    return np.array([*out, size - 1])


def lttb(s: Series, n: int, by_time: bool = False) -> Series:
    def f(t, v):
        at = tlttb_indices(t, v, n) if by_time else lttb_indices(t.astype(float), v.astype(float), n)
        return {"tick": t[at], "value": v[at].astype(float)}

    return s.with_df(_kernel(s, f))


def hull(s: Series, upper: bool = False) -> Series:
    """Lower or upper convex hull of the points."""

    def f(t, v):
        sign = -1.0 if upper else 1.0
        keep: list[int] = []
        for i in range(len(t)):
            while len(keep) > 1:
                a, b = keep[-2], keep[-1]
                if sign * ((float(t[b]) - t[a]) * (v[i] - v[a]) - (v[b] - v[a]) * (float(t[i]) - t[a])) > 0:
                    break
                keep.pop()
            keep.append(i)
        return {"tick": t[keep], "value": v[keep].astype(float)}

    return s.with_df(_kernel(s, f))


def fft(s: Series, polar: bool = False) -> DataFrame:
    """Spectrum of a gap-free series: real part (value) and imaginary part, or amplitude and phase."""

    def f(t, v):
        z = np.fft.fft(v.astype(float))
        a, b = (np.abs(z), np.angle(z)) if polar else (z.real, z.imag)
        return {"tick": np.arange(len(z)), "value": a, "second": b}

    return _kernel(s, f, more=", second double")


def ifft(real: np.ndarray, imaginary: np.ndarray) -> np.ndarray:
    return np.fft.ifft(np.asarray(real) + 1j * np.asarray(imaginary)).real


def haar(s: Series, inverse: bool = False) -> Series:
    """Discrete Haar wavelet transform of a series whose length is a power of two."""

    def f(t, v):
        out, n = v.astype(float).copy(), len(v)
        if inverse:
            size = 1
            while size < n:
                a, d = out[:size].copy(), out[size : 2 * size].copy()
                out[0 : 2 * size : 2], out[1 : 2 * size : 2] = (a + d) / math.sqrt(2), (a - d) / math.sqrt(2)
                size *= 2
        else:
            size = n
            while size > 1:
                a, b = out[0:size:2].copy(), out[1:size:2].copy()
                half = size // 2
                out[:half], out[half:size] = (a + b) / math.sqrt(2), (a - b) / math.sqrt(2)
                size = half
        return {"tick": t, "value": out}

    return s.with_df(_kernel(s, f))


def dtw_distance(a: np.ndarray, b: np.ndarray, scale: str | None = None) -> float:
    """Dynamic time warping with absolute differences, of the values as they are, over their range, or as z-scores.

    The z-scores of b are divided by its variance instead of its deviation: results must equal those of the
    convention that these names come from. Constant values have no range, which is an error.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    if scale == "range":
        if not np.ptp(a) or not np.ptp(b):
            raise ValueError("constant values can't be scaled to their range")
        a, b = ((x - x.min()) / np.ptp(x) for x in (a, b))
    elif scale == "z":
        a, b = (a - a.mean()) / a.std(ddof=int(len(a) > 1)), (b - b.mean()) / b.var()
    elif scale is not None:
        raise KeyError(f"no scale named {scale!r}")
    row = np.full(len(b) + 1, np.inf)
    row[0] = 0
    for x in a:
        cost = np.abs(x - b)
        new = np.full(len(b) + 1, np.inf)
        for j in range(1, len(b) + 1):
            new[j] = cost[j - 1] + min(row[j], new[j - 1], row[j - 1])
        row = new
    return float(row[-1])


def polyfit(s: Series, degree: int) -> DataFrame:
    """Coefficients, from the constant up: the tick column holds the power."""
    return _kernel(s, lambda t, v: {"tick": np.arange(degree + 1), "value": np.polyfit(t.astype(float), v.astype(float), degree)[::-1]})


def polynomial(s: Series, coefficients: list[float], by_bucket: bool = False) -> Series:
    """The polynomial (coefficients from the constant up) of each tick as its value; on a grid, of every bucket, or of
    its number from the oldest on, which then replaces the tick."""
    if by_bucket and s.grid is None:
        raise ValueError("the series has no grid")
    rows = scaffold(s) if s.grid else s.df
    if by_bucket:
        first = F.min(s.tick).over(Window.partitionBy(*s.keys))
        rows = rows.withColumn("_first", first).withColumn(s.tick, ((F.col(s.tick) - F.col("_first")) / s.grid.span).cast("bigint")).drop("_first")
    x, out = F.col(s.tick).cast("double"), F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    made = rows.withColumn("_v", out).withColumn(s.value, F.col("_v")).drop("_v")
    return s.with_df(made, grid=None) if by_bucket else s.with_df(made)


def random_from(histogram_: Column, seed: int | None = None) -> Column:
    """A value drawn by the weights of an array<struct<value, n>>."""
    total = F.aggregate(histogram_, F.lit(0.0), lambda a, x: a + x["n"])
    u = F.rand(seed) * total
    return F.aggregate(histogram_, F.struct(F.lit(0.0).alias("sum"), F.get(histogram_, F.lit(0))["value"].alias("v"), F.lit(False).alias("done")), lambda a, x: F.when(a["done"], a).otherwise(F.struct((a["sum"] + x["n"]).alias("sum"), x["value"].alias("v"), (a["sum"] + x["n"] >= u).alias("done"))), lambda a: a["v"])
