"""Splits and thinning by movement, and sequences compared: what needs one pass in order over a series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.geo import RADIUS
from tidemark.model import Series


def _great_circle(lat1, lon1, lat2, lon2) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, a)))


def _rhumb(lat1, lon1, lat2, lon2) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    d = abs(math.radians(lon2 - lon1))
    d = min(d, 2 * math.pi - d)
    stretch = math.log(math.tan(math.pi / 4 + p2 / 2) / math.tan(math.pi / 4 + p1 / 2))
    q = (p2 - p1) / stretch if abs(stretch) > 1e-12 else math.cos(p1)
    return RADIUS * math.hypot(p2 - p1, q * d)


def _grouped(s: Series, f, more: str = "") -> DataFrame:
    types = dict(s.df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in s.df.columns) + more
    tick = s.tick

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values(tick).reset_index(drop=True))

    return s.df.groupBy(*s.keys).applyInPandas(run, schema)


def location_offset(s: Series, metres: float) -> Series:
    """Points at least so far (along a rhumb line) from the last one kept; the first and the last stay, and so do points without a place."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, at = [], None
        for i, (lat, lon) in enumerate(zip(pdf["lat"], pdf["lon"], strict=True)):
            if lat is None or pd.isna(lat) or i == len(pdf) - 1:
                keep.append(i)
            elif at is None or _rhumb(*at, lat, lon) >= metres:
                keep.append(i)
                at = (lat, lon)
        return pdf.iloc[keep]

    return s.with_df(_grouped(s, f))


def motion_split(s: Series, seconds: float, metres: float, label: str = "split") -> Series:
    """Cuts where the place has stayed within ``metres`` of the piece's last move for ``seconds`` or more."""
    tick = s.tick

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, piece, at, since = [], 1, None, None
        for t, lat, lon in zip(pdf[tick], pdf["lat"], pdf["lon"], strict=True):
            if not pd.isna(lat):
                if at is None or _great_circle(*at, lat, lon) > metres:
                    if since is not None and (t - since) / 1e6 >= seconds:
                        piece += 1
                    at, since = (lat, lon), t
            pieces.append(piece)
        return pdf.assign(**{label: pieces})

    return Series(_grouped(s, f, f", `{label}` bigint"), (*s.keys, label), s.tick, s.value)


def best_dtw(query: np.ndarray, sequence: np.ndarray) -> list[tuple[int, float]]:
    """Starts of the subsequences of the query's length with the smallest warping distance, and that distance."""
    from tidemark.operators.stats import dtw_distance

    n = len(query)
    found = [(i, dtw_distance(query, sequence[i : i + n])) for i in range(len(sequence) - n + 1)]
    least = min((d for _, d in found), default=0.0)
    return [(i, d) for i, d in found if d == least]


def fft_window(name: str, n: int) -> np.ndarray:
    """Weights to put on a series before its spectrum is taken."""
    k = np.arange(n)
    x = 2 * np.pi * k / max(n - 1, 1)
    return {
        "rectangle": np.ones(n),
        "triangle": 1 - np.abs((k - (n - 1) / 2) / (n / 2)),
        "welch": 1 - ((k - (n - 1) / 2) / ((n - 1) / 2)) ** 2,
        "hann": 0.5 - 0.5 * np.cos(x),
        "hamming": 0.54 - 0.46 * np.cos(x),
        "blackman": 0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x),
        "nuttall": 0.355768 - 0.487396 * np.cos(x) + 0.144232 * np.cos(2 * x) - 0.012604 * np.cos(3 * x),
        "sine": np.sin(np.pi * k / max(n - 1, 1)),
    }[name]


def wavelet_step(values: np.ndarray, low: np.ndarray, inverse: bool = False) -> np.ndarray:
    """One level of an orthogonal wavelet transform with the given low-pass filter, periodic at the ends."""
    low = np.asarray(low, float)
    high = low[::-1] * np.where(np.arange(len(low)) % 2, -1, 1)
    n = len(values)
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(low))[None, :]) % n
    if not inverse:
        return np.concatenate([values[at] @ low, values[at] @ high])
    out = np.zeros(n)
    np.add.at(out, at, values[: n // 2, None] * low + values[n // 2 :, None] * high)
    return out


def wavelet(values: np.ndarray, low: np.ndarray, inverse: bool = False) -> np.ndarray:
    """All levels, for a length that is a power of two."""
    out = np.asarray(values, float).copy()
    sizes = []
    n = len(out)
    while n >= 2 and n >= len(low):
        sizes.append(n)
        n //= 2
    for n in sizes[::-1] if inverse else sizes:
        out[:n] = wavelet_step(out[:n], low, inverse)
    return out
