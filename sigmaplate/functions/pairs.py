"""Numbers of about twice a double's digits as column expressions: tuples of a double and the rest that it leaves.

Error-free sums and products after Knuth and Dekker. What is given to them is used several times: `held` computes it once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import bound, polynomial

Pair = tuple[Column, Column]


def held(p: Pair, use: Callable[[Pair], Column]) -> Column:
    """use(p), with the pair computed once however often it is used."""
    return bound(F.struct(p[0].alias("hi"), p[1].alias("lo")), lambda s: use((s["hi"], s["lo"])))


def add(a: Column, b: Column) -> Pair:
    """The sum of two doubles."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def multiply(a: Column, b: Column) -> Pair:
    """The product of two doubles."""
    (ah, al), (bh, bl), p = _halves(a), _halves(b), a * b
    return p, (ah * bh - p + ah * bl + al * bh) + al * bl


def _halves(a: Column) -> Pair:
    t = a * 134217729.0  # 2**27 + 1
    h = t - (t - a)
    return h, a - h


def plus(p: Pair, q: Pair) -> Pair:
    hi, lo = add(p[0], q[0])
    return hi, lo + p[1] + q[1]


def times(p: Pair, q: Pair) -> Pair:
    hi, lo = multiply(p[0], q[0])
    return hi, lo + (p[0] * q[1] + p[1] * q[0])


def over(p: Pair, d: float) -> Pair:
    q = p[0] / d
    hi, lo = multiply(q, F.lit(d))
    return q, (p[0] - hi - lo + p[1]) / d


def _constants() -> tuple[tuple[float, float], list[tuple[float, float]]]:
    """ln 2 / 64, whose first part has 36 bits so that its multiples are exact, and sqrt(2 pi) * 2**(j / 64)."""
    with localcontext() as context:
        context.prec = 50
        step = Decimal(2).ln() / 64
        first = math.floor(float(step) * 2.0**42) / 2.0**42
        root = Decimal("2.50662827463100050241576528481104525300698674060993831663")
        steps = [root * (step * j).exp() for j in range(64)]
        return (first, float(step - Decimal(first))), [(float(v), float(v - Decimal(float(v)))) for v in steps]


_STEP, _SCALES = _constants()


def inverse_normal_pdf(x: Column, use: Callable[[Pair, Column], Column]) -> Column:
    """use(m, k) for the pair m and the whole k of which m * 2**k is 1 / normal_pdf(x), for 1 < x < 40."""
    scales = F.array(*[F.struct(F.lit(hi).alias("hi"), F.lit(lo).alias("lo")) for hi, lo in _SCALES])

    def parts(t: Pair) -> Column:
        """x * x / 2 as n steps of ln 2 / 64 and the rest (hi, lo)."""
        n = F.rint(t[0] / (_STEP[0] * 2.0))
        hi, lo = add(t[0] / 2.0 - n * _STEP[0], t[1] / 2.0 - n * _STEP[1])
        return bound(F.struct(n.alias("n"), hi.alias("hi"), lo.alias("lo")), near)

    def near(r: Column) -> Column:
        """The power of 2 and of its 64th root, and e**rest - 1 as w and v."""
        h, rest, k = r["hi"], r["lo"], F.floor(r["n"] / 64.0)
        scale = F.element_at(scales, (r["n"] - k * 64 + 1).cast("int"))
        v = rest + rest * h + polynomial(h, (1 / 5040, 1 / 720, 1 / 120, 1 / 24, 1 / 6, 1 / 2)) * h * h
        return bound(F.struct(k.cast("double").alias("k"), scale.alias("s"), h.alias("w"), v.alias("v")), joined)

    def joined(g: Column) -> Column:
        s = (g["s"]["hi"], g["s"]["lo"])
        return held(times(s, (g["w"], g["v"])), lambda p: use(plus(s, p), g["k"]))

    return held(multiply(x, x), parts)


def scaled(p: Pair, k: Column) -> Column:
    """The double next to p * 2**k."""
    half = F.floor(k / 2.0)
    return (p[0] + p[1]) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), k - half)
