"""Logistic model with random effects, fitted by variational updates on Spark.

The rows are collapsed to binomial cells once.  The posterior is Gaussian in the fixed
effects, in every random effect and in the log SD of every random factor.  An update joins the
tables of levels to the cells and sums per level; from these sums a factor's precision
takes a second-order step along the bound with its effects optimised out, and the
effects follow in closed form.  The driver holds the fixed effects and two numbers
per factor.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.links import normal_quantile
from ..session import scratch_path
from ..sources.sinks import materialize, remove_table
from .scan import running_weight
from .stats import value_weights

FIXED_PRIOR_VARIANCE = 100.0
LOG_SD_PRIOR_VARIANCE = 100.0
# The longest table of levels that is broadcast; longer ones are joined by a shuffle in every update.
BROADCAST_LEVELS = 1_000_000
# Steps of a log precision that are tried besides the second-order one.
STEPS = [0.0, *(sign * size for size in (0.02, 0.1, 0.4, 1.0, 2.0) for sign in (-1, 1))]


@dataclass
class MixedFit:
    names: list[str]
    means: np.ndarray
    covariance: np.ndarray
    sigmas: dict[str, float]
    log_sds: dict[str, tuple[float, float]]
    effects: dict[str, DataFrame]
    sweeps: int
    change: float
    bounds: list[float]
    frame: DataFrame

    def coefficients(self) -> DataFrame:
        """One row with the posterior mean of each fixed effect."""
        ddl = ", ".join(f"`{n}` double" for n in self.names)
        return self.frame.sparkSession.createDataFrame([tuple(map(float, self.means))], ddl)

    def summary(self) -> DataFrame:
        """Fixed effects with posterior SD; each random factor's SD with the SD of its logarithm; the fit."""
        sds = np.sqrt(np.diag(self.covariance))
        rows = [("fixed", n, float(m), float(s)) for n, m, s in zip(self.names, self.means, sds)]
        rows += [("random", n, self.sigmas[n], s) for n, (_, s) in self.log_sds.items()]
        rows += [("fit", "converged", 1.0, None), ("fit", "sweeps", float(self.sweeps), None)]
        rows += [("fit", "bound", self.bounds[-1], None)]
        return self.frame.sparkSession.createDataFrame(rows, "kind string, name string, value double, sd double")


@dataclass
class Factor:
    """Posterior of a random factor: its log SD is Gaussian, ``log_precision`` is log E[1 / SD^2]."""

    name: str
    key: str
    log_precision: float = 0.0
    spread: float = 0.1  # variance of the log SD
    shift: float = 0.0  # part of the effects that went to a fixed effect
    levels: float = 0.0
    sums: dict[str, float] = field(default_factory=dict)

    @property
    def precision(self) -> float:
        return math.exp(self.log_precision)

    @property
    def log_sd(self) -> float:
        return self.spread - self.log_precision / 2

    def settle_spread(self) -> None:
        """The variance of the log SD that is best at this precision."""
        for _ in range(50):
            self.spread = 1 / (2 * self.levels + (1 + 2 * self.spread - self.log_precision) / LOG_SD_PRIOR_VARIANCE)

    def prior(self, step: float = 0.0) -> float:
        """Terms of the bound in the precision alone, after a step."""
        log_precision = self.log_precision + step
        return self.levels * log_precision / 2 - (self.spread - log_precision / 2) ** 2 / (2 * LOG_SD_PRIOR_VARIANCE)

    def bound(self) -> float:
        """Prior and entropy of the effects and of the log SD."""
        s = self.sums
        log_sd = self.log_sd
        effects = -self.levels * log_sd - self.precision * (s["m2"] + s["v"]) / 2 + s["log_v"] / 2 + self.levels / 2
        prior = -(log_sd**2 + self.spread) / (2 * LOG_SD_PRIOR_VARIANCE) - math.log(LOG_SD_PRIOR_VARIANCE) / 2
        return effects + prior + math.log(self.spread) / 2 + 0.5


def one_row(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    """Numbers as a table of one row: as literals they would make Spark compile every update anew."""
    numbers = ", ".join(f"{float(v)!r}D" for v in values.values())
    return F.broadcast(spark.sql(f"select * from values ({numbers}) as t({', '.join(values)})"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def best_step(factor: Factor, gains: Sequence[float], slope: float, curvature: float) -> float:
    """The second-order step if it lies beside the best step tried, else that."""
    order = sorted(STEPS)
    best = max(zip(STEPS, gains), key=lambda x: (x[1], -abs(x[0])))[0]
    at = order.index(best)
    if curvature < 0:
        newton = -slope / curvature
        if order[max(0, at - 1)] <= newton <= order[min(len(order) - 1, at + 1)]:
            return newton
    return best


def fit_mixed_model(
    df: DataFrame,
    outcome: str,
    fixed: dict[str, Column],
    random: dict[str, tuple[str, Column]],
    max_sweeps: int = 500,
    tolerance: float = 1e-4,
) -> MixedFit:
    """``logit P(outcome) = sum fixed + sum random[level] * covariate``.

    ``fixed`` maps names to design columns (``lit(1)`` is the intercept);
    ``random`` maps names to (grouping column, covariate).  Mean-field updates
    with the Jaakkola-Jordan bound; log SDs have a normal prior.  The fit ends when a
    sweep raises the evidence bound by less than ``tolerance``, and raises RuntimeError
    if ``max_sweeps`` do not get there.
    """
    spark = df.sparkSession
    keys = list(dict.fromkeys(k for k, _ in random.values()))
    of_key = {k: [name for name, (own, _) in random.items() if own == k] for k in keys}
    f_cols = [f"f{i}" for i in range(len(fixed))]
    z_cols = {name: f"z{i}" for i, name in enumerate(random)}
    design = df.dropna(subset=[*keys, outcome]).select(
        *keys,
        F.col(outcome).cast("double").alias("_y"),
        *[c.cast("double").alias(f) for f, c in zip(f_cols, fixed.values())],
        *[c.cast("double").alias(z_cols[name]) for name, (_, c) in random.items()],
    )
    first_path = scratch_path(spark, "mixed-cells")
    cells = materialize(
        design.groupBy(*keys, *f_cols, *z_cols.values()).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("k")
        ),
        first_path,
    )
    p = len(f_cols)
    beta, cov = np.zeros(p), np.eye(p)
    factors = {name: Factor(name, key) for name, (key, _) in random.items()}
    tables: dict[str, tuple[DataFrame, str]] = {}
    lengths: dict[str, int] = {}
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    # Random effects on the design of a fixed effect share their mean with it.
    gaps = [(name, i) for name in random for i in range(p)]
    row = cells.agg(
        *[F.max(F.abs(F.col(z_cols[n]) - F.col(f_cols[i]))).alias(f"g{j}") for j, (n, i) in enumerate(gaps)],
        *[F.approx_count_distinct(k).alias(f"levels{j}") for j, k in enumerate(keys)],
    ).first()
    # Cells of a level of the longest table lie together, so the sums of an update are made where they lie.
    # (Adaptive execution splits a level that is too large for a partition.)
    longest = max(range(len(keys)), key=lambda j: row[f"levels{j}"])
    cells = materialize(cells.hint("rebalance", keys[longest]), scratch_path(spark, "mixed-cells"))
    remove_table(spark, first_path)
    partner = {n: i for j, (n, i) in enumerate(gaps) if row[f"g{j}"] == 0}

    def numbers() -> DataFrame:
        values = {f"b_{i}": beta[i] for i in range(p)}
        values |= {f"c_{i}_{j}": cov[i, j] * (1 if i == j else 2) for i, j in pairs}
        for name, z in z_cols.items():
            values |= {f"t_{z}": factors[name].precision, f"s_{z}": factors[name].shift}
        return one_row(spark, values)

    # The updates are SQL texts: hundreds of columns built one by one cost more than the jobs.
    def solved(rows: DataFrame, names: list[str]) -> DataFrame:
        """Adds pull, mean and variance of the effects from the sums of their key's table, one after the other."""
        for at, name in enumerate(names):
            z = z_cols[name]
            # The residuals still hold the old effects; those already solved have moved since.
            moved = "".join(f" - w_{y}_{z} * (m_{y} - old_{y})" for y in (z_cols[n] for n in names[:at]))
            rows = rows.selectExpr("*", f"r_{z}{moved} + w_{z}_{z} * old_{z} as pull_{z}")
            rows = rows.selectExpr("*", f"pull_{z} / (w_{z}_{z} + t_{z}) as m_{z}", f"1 / (w_{z}_{z} + t_{z}) as v_{z}")
        return rows

    def effects_of(key: str) -> DataFrame:
        """``key`` with the posterior mean and variance of its factors' effects."""
        zs = [z_cols[n] for n in of_key[key]]
        rows = solved(tables[key][0].crossJoin(numbers()), of_key[key])
        columns = [c for z in zs for c in (f"m_{z} - s_{z} as m_{z}", f"v_{z}", f"has_{z}")]
        return rows.selectExpr(quoted(key), *columns)

    def state() -> DataFrame:
        """Cells with the linear predictor's mean, the bound's weight and the residual."""
        rows = cells
        for key in keys:
            if key in tables:
                effects = effects_of(key).drop(*[f"has_{z_cols[n]}" for n in of_key[key]])
                rows = rows.join(F.broadcast(effects) if lengths[key] <= BROADCAST_LEVELS else effects, key, "left")
        rows = rows.crossJoin(numbers())
        fresh = [x for n, (key, _) in random.items() if key not in tables for x in (f"0D as m_{z_cols[n]}", f"1 / t_{z_cols[n]} as v_{z_cols[n]}")]
        rows = rows.selectExpr("*", *fresh) if fresh else rows
        zs = list(z_cols.values())
        mean = " + ".join([f"{f} * b_{i}" for i, f in enumerate(f_cols)] + [f"{z} * m_{z}" for z in zs])
        var = " + ".join([f"{f_cols[i]} * {f_cols[j]} * c_{i}_{j}" for i, j in pairs] + [f"{z} * {z} * v_{z}" for z in zs])
        rows = rows.selectExpr("*", f"{mean} as _mean", f"{var} as _var").selectExpr("*", "sqrt(_mean * _mean + _var) as _xi")
        rows = rows.selectExpr("*", "n * if(_xi < 1e-6, 0.25D, tanh(_xi / 2) / (_xi * 2)) as _w")
        return rows.selectExpr("*", "k - n / 2 - _w * _mean as _gap")

    def update_fixed() -> float:
        """New fixed effects; returns the bound's terms in the data and the old fixed effects."""
        nonlocal beta, cov
        # The log of the logistic function at xi, minus xi / 2, and the linear term.
        fit = "sum(n * (-log1p(exp(-_xi)) - _xi / 2) + (k - n / 2) * _mean) as fit"
        sums = [f"sum(_w * {f_cols[i]} * {f_cols[j]}) as p{i}_{j}" for i, j in pairs]
        sums += [f"sum(_gap * {f}) as r{i}" for i, f in enumerate(f_cols)]
        row = state().selectExpr(fit, *sums).first()
        if row["fit"] is None:
            return 0.0
        bound = row["fit"] - (beta @ beta + np.trace(cov)) / (2 * FIXED_PRIOR_VARIANCE) + np.linalg.slogdet(cov)[1] / 2
        bound += p / 2 - p * math.log(FIXED_PRIOR_VARIANCE) / 2
        weight = np.zeros((p, p))
        for i, j in pairs:
            weight[i, j] = weight[j, i] = row[f"p{i}_{j}"]
        cov = np.linalg.inv(weight + np.eye(p) / FIXED_PRIOR_VARIANCE)
        beta = cov @ (np.array([row[f"r{i}"] for i in range(p)]) + weight @ beta)
        return bound

    def update_levels(key: str) -> None:
        """New precisions and effects of the factors of one grouping column."""
        names = of_key[key]
        zs = [z_cols[n] for n in names]
        cross = [(a, b) for i, a in enumerate(zs) for b in zs[i:]]
        aggregates = [f"sum(_w * {a} * {b}) as w_{a}_{b}" for a, b in cross]
        aggregates += [x for z in zs for x in (f"sum(_gap * {z}) as r_{z}", f"first(m_{z}) as old_{z}", f"first(v_{z}) as was_{z}")]
        sums = state().groupBy(key).agg(*map(F.expr, aggregates))
        sums = sums.selectExpr("*", *[f"w_{z}_{z} > 0 as has_{z}" for z in zs])
        seen = Observation()
        only = lambda z, c: f"coalesce(sum(if(has_{z}, {c}, null)), 0D)"
        kinds = {"n": "1D", "m2": "old_{z} * old_{z}", "v": "was_{z}", "log_v": "ln(was_{z})"}
        watched = sums.observe(seen, *[F.expr(f"{only(z, c.format(z=z))} as {kind}_{z}") for z in zs for kind, c in kinds.items()], F.count(F.lit(1)).alias("rows"))
        path = scratch_path(spark, "mixed-levels")
        written = materialize(watched, path)
        old, tables[key] = tables.get(key), (written, path)
        lengths[key] = seen.get["rows"]
        for name in names:
            factor, z = factors[name], z_cols[name]
            factor.levels = seen.get[f"n_{z}"]
            factor.sums = {c: seen.get[f"{c}_{z}"] for c in ("m2", "v", "log_v")}
            # The sums are those of the old effects, before this update.
            bounds.append(factor.bound())
            factor.shift = 0.0
        for name in names:
            step_precision(key, name)
        if old is not None:
            remove_table(spark, old[1])

    def step_precision(key: str, name: str) -> None:
        """Second-order step of a factor's precision, its effects optimised out, from one pass over the levels."""
        names, factor, z = of_key[key], factors[name], z_cols[name]
        if not factor.levels:
            return
        factor.settle_spread()
        rows = solved(tables[key][0].crossJoin(numbers()), names[: names.index(name) + 1]).filter(f"has_{z}")
        at = [f"(w_{z}_{z} + t_{z} * {math.exp(step)!r}D)" for step in STEPS]
        found = rows.selectExpr(
            *[f"sum((pull_{z} * pull_{z} / {x} - ln({x})) / 2) as gain_{i}" for i, x in enumerate(at)],
            *[f"sum(pull_{z} / {x}) as common_{i}" for i, x in enumerate(at)],
            f"sum(t_{z} * (m_{z} * m_{z} + v_{z})) as held",
            f"sum(t_{z} * t_{z} * v_{z} * (2 * m_{z} * m_{z} + v_{z})) as bent",
        ).first()
        gains = [found[f"gain_{i}"] + factor.prior(s) for i, s in enumerate(STEPS)]
        # First and second derivative of that bound in the log precision.
        slope = (factor.levels - found["held"]) / 2 + factor.log_sd / (2 * LOG_SD_PRIOR_VARIANCE)
        curvature = (found["bent"] - found["held"]) / 2 - 1 / (4 * LOG_SD_PRIOR_VARIANCE)
        step = best_step(factor, gains, slope, curvature)
        factor.log_precision += step
        factor.settle_spread()
        if name in partner:
            # The part that is common to all effects is better held by the fixed effect.
            i = partner[name]
            common = float(np.interp(step, *zip(*sorted((s, found[f"common_{i}"]) for i, s in enumerate(STEPS)))))
            pulls = factor.precision * common - beta[i] / FIXED_PRIOR_VARIANCE
            factor.shift = pulls / (factor.precision * factor.levels + 1 / FIXED_PRIOR_VARIANCE)
            beta[i] += factor.shift

    evidence: list[float] = []
    for sweep in range(1, max_sweeps + 1):
        bounds = [update_fixed()]
        for key in keys:
            update_levels(key)
        evidence.append(float(sum(bounds)))
        change = evidence[-1] - evidence[-2] if sweep > 1 else math.inf
        if change < tolerance:
            break
    else:
        raise RuntimeError(f"no convergence in {max_sweeps} sweeps; the last one raised the bound by {change:.2g}")
    return MixedFit(
        names=list(fixed),
        means=beta,
        covariance=cov,
        sigmas={n: math.exp(f.log_sd) for n, f in factors.items()},
        log_sds={n: (f.log_sd, math.sqrt(f.spread)) for n, f in factors.items()},
        effects={
            n: effects_of(key).filter(f"has_{z_cols[n]}").selectExpr(quoted(key), f"m_{z_cols[n]} as mean", f"sqrt(v_{z_cols[n]}) as sd")
            for n, (key, _) in random.items()
        },
        sweeps=sweep,
        change=change,
        bounds=evidence,
        frame=cells,
    )


def random_effect_qq(effects: DataFrame, sigma: float, by: Sequence[str] = ()) -> DataFrame:
    """Standardised posterior means against normal quantiles at rank / (n + 1)."""
    keys = list(by)
    scaled = effects.select(*keys, (F.col("mean") / F.lit(sigma)).alias("sample"))
    ranked = running_weight(value_weights(scaled, keys, "sample"), keys, "sample", "n")
    rank = F.col("running") - F.col("n") + (F.col("n") + 1) / 2
    return ranked.select(
        *keys, "sample", "n", normal_quantile(rank / (F.col("total") + 1)).alias("theoretical")
    )
