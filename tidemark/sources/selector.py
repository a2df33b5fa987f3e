"""Selectors ``class{label=exact,label~regex}{attribute=...}`` as predicates, and the scan they drive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import Series
from tidemark.operators.frameworks import text_match


def parse(selector: str) -> tuple[str, dict[str, str]]:
    """(class pattern, {label: pattern}); patterns begin with = or ~."""
    m = re.fullmatch(r"(?s)\s*([^{]*?)\s*\{(.*?)\}\s*(?:\{(.*)\})?\s*", selector)
    if not m:
        raise ValueError(f"not a selector: {selector!r}")
    name = m[1] if m[1][:1] in ("=", "~") else f"={m[1]}"
    labels = {}
    for part in filter(None, [*m[2].split(","), *(m[3] or "").split(",")]):
        key, sign, value = re.fullmatch(r"(?s)\s*([^=~]+?)\s*([=~])(.*)", part).groups()
        labels[key] = f"{sign}{value}"
    return name, labels


def render(name: str, labels: dict[str, str]) -> str:
    return f"{name}{{{','.join(f'{k}={v}' for k, v in sorted(labels.items()))}}}"


def predicate(selector: str, keys: tuple[str, ...], class_column: str = "class") -> Column:
    name, labels = parse(selector)
    cond = text_match(F.col(class_column), name)
    for k, pattern in labels.items():
        cond = cond & (text_match(F.col(k).cast("string"), pattern) if k in keys else F.lit(pattern in ("=", "~")))
    return cond


def fetch(s: Series, selector: str, start: int | None = None, end: int | None = None, count: int | None = None, skip: int = 0, step: int = 1, sample: float | None = None, boundary_pre: int = 0, boundary_post: int = 0) -> Series:
    """Points of the selected series within start..end, newest first for skip, step and count; boundaries add points outside the range."""
    base = s.with_df(s.df.where(predicate(selector, s.keys)))
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(s.tick) >= start)
    if end is not None:
        inside = inside & (F.col(s.tick) <= end)
    rows = base.df.where(inside)
    if count is not None or skip or step > 1:
        order = [F.col(c).desc() for c in s.order()]
        rows = rows.withColumn("_k", F.row_number().over(s.over(*order)) - 1 - skip).where((F.col("_k") >= 0) & (F.col("_k") % step == 0))
        if count is not None:
            rows = rows.where(F.col("_k") < count * step)
        rows = rows.drop("_k")
    if sample is not None:
        rows = rows.where(F.rand(0) < sample)
    for n, side, desc in ((boundary_pre, start, True), (boundary_post, end, False)):
        if n and side is not None:
            out = base.df.where(F.col(s.tick) < side if desc else F.col(s.tick) > side)
            order = F.col(s.tick).desc() if desc else F.col(s.tick)
            rows = rows.unionByName(out.withColumn("_k", F.row_number().over(s.over(order))).where(F.col("_k") <= n).drop("_k"))
    return s.with_df(rows)
