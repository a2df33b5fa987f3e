"""Symbolic patterns of series: words of piecewise means, their detection, and discords."""

from __future__ import annotations

import numpy as np

from tidemark.functions.udfs import morton, opb64
from tidemark.model import Series
from tidemark.operators.stats import _kernel, nbounds


def words(v: np.ndarray, alphabet: int, letters: int, window: int, standardise: bool = False) -> list[str]:
    """A word for the window that begins at each value: ``letters`` means, each as one of ``alphabet`` intervals of equal
    normal probability; the letters' bits in turn, highest first, in order-preserving base64."""
    levels = alphabet.bit_length() - 1
    if alphabet != 1 << levels or not 1 <= levels <= 16:
        raise ValueError("the alphabet's size must be a power of two from 2 to 65536")
    if window % letters:
        raise ValueError("the letters must divide the window")
    if len(v) < window:
        return []
    means = np.lib.stride_tricks.sliding_window_view(np.asarray(v, float), window).reshape(-1, letters, window // letters).mean(2)
    if standardise:
        mu = means.mean(1, keepdims=True)
        sd = means.std(1, ddof=1 if letters > 1 else 0, keepdims=True)
        means = (means - mu) / np.where(sd > 0, sd, 1)
    symbols = np.searchsorted(nbounds(alphabet), means)
    bits = levels * letters
    return [opb64((morton(row, levels) << -bits % 8).to_bytes(-(-bits // 8), "big")) for row in symbols.tolist()]


def patterns(s: Series, alphabet: int, letters: int, window: int, standardise: bool = False) -> Series:
    """The word of the window that begins at each tick, for a gap-free grid."""

    def f(t, v):
        found = words(v, alphabet, letters, window, standardise)
        return {"tick": t[: len(found)], "value": found}

    return s.with_df(_kernel(s, f, "string"))


def detect(s: Series, wanted: set[str], alphabet: int, letters: int, window: int, standardise: bool = False) -> Series:
    """The points of all windows whose word is wanted, each once."""

    def f(t, v):
        on = np.zeros(len(v), bool)
        for i, w in enumerate(words(v, alphabet, letters, window, standardise)):
            if w in wanted:
                on[i : i + window] = True
        return {"tick": t[on], "value": v[on].astype(float)}

    return s.with_df(_kernel(s, f))


def discords(s: Series, window: int, count: int, z: bool = False) -> Series:
    """Starts of the ``count`` windows that lie farthest from their nearest window that doesn't overlap them, and that distance; discords don't overlap either."""

    def f(t, v):
        n = len(v) - window + 1
        if n < 1:
            return {"tick": t[:0], "value": np.zeros(0)}
        w = np.lib.stride_tricks.sliding_window_view(v.astype(float), window).copy()
        if z:
            w = (w - w.mean(1, keepdims=True)) / np.where(w.std(1, keepdims=True) > 0, w.std(1, keepdims=True), 1)
        near = np.full(n, np.inf)
        for i in range(n):
            d = np.sqrt(((w - w[i]) ** 2).sum(1))
            d[max(0, i - window + 1) : i + window] = np.inf
            near[i] = d.min()
        out: list[int] = []
        for i in np.argsort(-np.where(np.isfinite(near), near, -1), kind="stable").tolist():
            if len(out) < count and np.isfinite(near[i]) and all(abs(i - j) >= window for j in out):
                out.append(i)
        out.sort()
        return {"tick": t[out], "value": near[out]}

    return s.with_df(_kernel(s, f))
