"""Gaussian mixture by expectation maximisation: a sweep is one projection and one grouped sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.messages import mixture_gate


def sweep(data: DataFrame, row: str, x: Column, components: list[tuple[float, float, float]], floor: float = 1e-6) -> list[tuple[float, float, float]]:
    """One step: responsibilities, then weights, means and variances; a row per component comes back."""
    r, v = F.col("responsibility"), F.col("x")
    gate = mixture_gate(data, row, x, components).groupBy("component").agg(F.sum(r).alias("n"), F.sum(r * v).alias("s"), F.sum(r * v * v).alias("q"))
    got = {g["component"]: g for g in gate.collect()}
    total = sum(g["n"] for g in got.values())
    out = []
    for k, old in enumerate(components):
        g = got.get(k)
        if g is None or g["n"] <= 0:
            out.append(old)
            continue
        mean = g["s"] / g["n"]
        out.append((g["n"] / total, mean, max(floor, g["q"] / g["n"] - mean * mean)))
    return out


def fit(data: DataFrame, row: str, x: Column, components: list[tuple[float, float, float]], sweeps: int = 10, tolerance: float = 1e-6) -> list[tuple[float, float, float]]:
    for _ in range(sweeps):
        new = sweep(data, row, x, components)
        moved = max(abs(a - b) for n, o in zip(new, components, strict=True) for a, b in zip(n, o, strict=True))
        components = new
        if moved < tolerance:
            break
    return components
