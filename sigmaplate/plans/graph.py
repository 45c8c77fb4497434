"""Declared factor graphs over plates, run as joins, projections and grouped sums.

A variable is a Gaussian over a plate: a table of keys with a prior.  A factor is a table of rows,
one factor node each, whose columns name the keys of the variables it touches; its kind is taken
from a registry, which users extend.  A sweep goes over the factors in order: rows join the
marginals of their variables, a row's own last messages are divided out, the kind's expressions give
the new messages, and marginals are the priors times the grouped product of messages.  A sweep's
messages are written tables, so that plans don't grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bound
from ..operators import factor_messages as fm
from ..session import materialized

#: What a kind of factor gets for an argument: tau and prec of all that the rest of the graph says.
Cavity = tuple[Column, Column]
Messages = Callable[[dict[str, Cavity]], dict[str, Cavity]]


@dataclass(frozen=True)
class Kind:
    """A kind of factor: its arguments, its messages to them, and its log evidence given the cavities, if it has one."""

    arguments: tuple[str, ...]
    messages: Messages
    log_evidence: Callable[[dict[str, Cavity]], Column] | None = None


KINDS: dict[str, Kind] = {}


def register(name: str, arguments: tuple[str, ...], log_evidence: Callable[[dict[str, Cavity]], Column] | None = None) -> Callable[[Messages], Messages]:
    """Add a kind of factor by its message function; rows' own columns are at hand as ``F.col``."""

    def add(messages: Messages) -> Messages:
        KINDS[name] = Kind(arguments, messages, log_evidence)
        return messages

    return add


def _moments(c: Cavity) -> tuple[Column, Column]:
    return c[0] / c[1], F.lit(1.0) / c[1]


def _ratio(mean: Column, variance: Column, c: Cavity) -> Cavity:
    return mean / variance - c[0], F.lit(1.0) / variance - c[1]


def _through(c: Cavity, noise: Column) -> Cavity:
    """A message through Gaussian noise; no information stays none."""
    shrink = F.lit(1.0) + noise * c[1]
    return c[0] / shrink, c[1] / shrink


@register("observed", ("mean",))
def _observed(c: dict[str, Cavity]) -> dict[str, Cavity]:
    """Rows' column y is the variable plus noise of variance ``noise``."""
    return {"mean": (F.col("y") / F.col("noise"), F.lit(1.0) / F.col("noise"))}


@register("gaussian", ("x", "mean"))
def _gaussian(c: dict[str, Cavity]) -> dict[str, Cavity]:
    """x is the mean plus noise of variance ``noise``."""
    return {"x": _through(c["mean"], F.col("noise")), "mean": _through(c["x"], F.col("noise"))}


@register("sum_observed", ("a", "b"))
def _sum_observed(c: dict[str, Cavity]) -> dict[str, Cavity]:
    """y is a + b plus noise."""
    (a, va), (b, vb) = _moments(c["a"]), _moments(c["b"])
    y, n = F.col("y"), F.col("noise")
    return {"a": ((y - b) / (vb + n), F.lit(1.0) / (vb + n)), "b": ((y - a) / (va + n), F.lit(1.0) / (va + n))}


def _compared(c: dict[str, Cavity], use: Callable[[Column], Column]) -> Column:
    """use(the posteriors of both sides with their noise), worked out once."""
    noise = F.col("noise")
    sides = [x for a in ("a", "b") for x in _moments(_through(c[a], noise))]
    named = F.struct(*[x.alias(n) for x, n in zip(sides, ("ma", "va", "mb", "vb"), strict=True)])
    return bound(named, lambda m: bound(F.struct(m.alias("m"), fm.greater_posteriors(m["ma"], m["va"], m["mb"], m["vb"]).alias("g")), use))


@register("greater", ("a", "b"), lambda c: _compared(c, lambda s: s["g"]["log_evidence"]))
def _greater(c: dict[str, Cavity]) -> dict[str, Cavity]:
    """a plus noise is more than b plus noise, each of variance ``noise``."""
    noise = F.col("noise")

    def back(s: Column) -> Column:
        out = []
        for x in ("a", "b"):
            m, v = s["m"][f"m{x}"], s["m"][f"v{x}"]
            tau, prec = _through(_ratio(s["g"][f"mean_{x}"], s["g"][f"variance_{x}"], (m / v, F.lit(1.0) / v)), noise)
            out += [tau.alias(f"tau_{x}"), prec.alias(f"prec_{x}")]
        return F.struct(*out)

    sent = _compared(c, back)
    return {x: (sent[f"tau_{x}"], sent[f"prec_{x}"]) for x in ("a", "b")}


@register("positive", ("x",), lambda c: fm.normal_cdf_ln(c["x"][0] / F.sqrt(c["x"][1])))
def _positive(c: dict[str, Cavity]) -> dict[str, Cavity]:
    m, v = _moments(c["x"])
    sent = bound(fm.positive_posterior(m, v), lambda p: F.struct(*[x.alias(n) for x, n in zip(_ratio(p["mean"], p["variance"], c["x"]), ("tau", "prec"), strict=True)]))
    return {"x": (sent["tau"], sent["prec"])}


@register("equal", ("a", "b"))
def _equal(c: dict[str, Cavity]) -> dict[str, Cavity]:
    return {"a": c["b"], "b": c["a"]}


@dataclass
class _Factor:
    kind: Kind
    rows: DataFrame
    row: str
    edges: dict[str, tuple[str, str]]  # argument -> (variable, the rows' column of its key)
    messages: DataFrame | None = None


@dataclass
class Graph:
    priors: dict[str, DataFrame] = field(default_factory=dict)
    factors: list[_Factor] = field(default_factory=list)
    #: Functions of the list of factors that rewrite it before a run, such as to merge or reorder factors.
    passes: list[Callable[[list[_Factor]], list[_Factor]]] = field(default_factory=list)

    def variable(self, name: str, keys: DataFrame, key: str, mean: Column | float = 0.0, variance: Column | float = 1.0) -> Graph:
        """A Gaussian for each row of keys; mean and variance may be columns of it."""
        m, v = (c if isinstance(c, Column) else F.lit(float(c)) for c in (mean, variance))
        self.priors[name] = keys.select(F.col(key).alias("key"), (m / v).alias("tau"), (F.lit(1.0) / v).alias("prec"))
        return self

    def factor(self, kind: str, rows: DataFrame, row: str, **edges: tuple[str, str]) -> Graph:
        """A factor node for each of ``rows``, told apart by the column ``row``; an edge is argument=(variable, column of its key)."""
        of = KINDS[kind]
        if set(edges) != set(of.arguments):
            raise ValueError(f"{kind} has the arguments {of.arguments}")
        self.factors.append(_Factor(of, rows, row, edges))
        return self

    def _marginals(self, name: str, without: _Factor | None = None) -> DataFrame:
        """(key, tau, prec) of a variable: its prior times all messages."""
        out = self.priors[name]
        for f in self.factors:
            if f.messages is None or f is without:
                continue
            for argument, (variable, _) in f.edges.items():
                if variable == name:
                    sent = f.messages.select(F.col(f"key_{argument}").alias("key"), F.col(f"tau_{argument}").alias("tau"), F.col(f"prec_{argument}").alias("prec"))
                    out = out.unionByName(sent)
        return out.groupBy("key").agg(F.sum("tau").alias("tau"), F.sum("prec").alias("prec"))

    def _with_cavities(self, f: _Factor) -> tuple[DataFrame, dict[str, Cavity]]:
        rows = f.rows if f.messages is None else f.rows.join(f.messages.drop(*[f"key_{a}" for a in f.edges]), f.row)
        for argument, (variable, column) in f.edges.items():
            m = self._marginals(variable).select(F.col("key").alias(f"key_{argument}"), F.col("tau").alias(f"all_tau_{argument}"), F.col("prec").alias(f"all_prec_{argument}"))
            rows = rows.join(m, F.col(column) == F.col(f"key_{argument}"))
        old = lambda p, a: F.lit(0.0) if f.messages is None else F.col(f"{p}_{a}")
        rows = rows.withColumns({f"cavity_{p}_{a}": F.col(f"all_{p}_{a}") - old(p, a) for a in f.edges for p in ("tau", "prec")})
        return rows, {a: (F.col(f"cavity_tau_{a}"), F.col(f"cavity_prec_{a}")) for a in f.edges}

    def run(self, sweeps: int, damping: float = 0.0, trace: str | None = None) -> dict[str, DataFrame]:
        """(key, mean, variance) of every variable after some sweeps.

        damping: the share of the old message that stays, in natural parameters.  trace: a folder
        that gets each sweep's messages as a table, sweep by sweep.
        """
        for rewrite in self.passes:
            self.factors = rewrite(self.factors)
        for sweep in range(sweeps):
            for k, f in enumerate(self.factors):
                rows, cavities = self._with_cavities(f)
                new = f.kind.messages(cavities)
                mix = lambda fresh, name: fresh if not damping or f.messages is None else fresh * (1.0 - damping) + F.col(name) * damping  # noqa: B023, E731
                sent = [F.col(f"key_{a}") for a in f.edges]
                sent += [mix(v, f"{p}_{a}").alias(f"{p}_{a}") for a, pair in new.items() for p, v in zip(("tau", "prec"), pair, strict=True)]
                f.messages = materialized(rows.select(f.row, *sent))
                if trace:
                    f.messages.withColumn("sweep", F.lit(sweep)).write.mode("overwrite").parquet(f"{trace}/factor={k}/sweep={sweep}")
        out = {}
        for name in self.priors:
            m = self._marginals(name)
            out[name] = m.select("key", (F.col("tau") / F.col("prec")).alias("mean"), (F.lit(1.0) / F.col("prec")).alias("variance"))
        return out

    def change(self, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> float:
        """The largest move of a mean between two results: a test of convergence."""
        moves = [before[n].alias("a").join(after[n].alias("b"), "key").agg(F.max(F.abs(F.col("a.mean") - F.col("b.mean")))).first()[0] or 0.0 for n in before]
        return max(moves, default=0.0)
