"""Link functions and the normal distribution as column expressions."""

import math
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, bind

# Rational approximation of the normal CDF (Hart 1968, as given by
# West 2005), highest power first.
CDF_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
CDF_SWITCH = 7.07106781186547

# Rational approximation of the normal quantile (Acklam), highest
# power first; the trailing 1 of each denominator is written out.
QUANTILE_TAIL = 0.02425
QUANTILE_MID_TOP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
QUANTILE_MID_BOTTOM = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
QUANTILE_TAIL_TOP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
QUANTILE_TAIL_BOTTOM = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)


def _polynomial(x: Column, coefficients) -> Column:
    terms = F.array(*[F.lit(c) for c in coefficients])
    return F.aggregate(terms, F.lit(0.0), lambda acc, c: acc * x + c)


def clip(c, eps: float = 1e-12) -> Column:
    """Keep a probability inside ``[eps, 1 - eps]``."""
    return F.greatest(F.least(as_column(c), F.lit(1.0 - eps)), F.lit(eps))


def logit(c) -> Column:
    p = as_column(c)
    return F.log(p / (1 - p))


def expit(c) -> Column:
    """Inverse logit, also called the sigmoid."""
    return 1 / (1 + F.exp(-as_column(c)))


def log1p(c) -> Column:
    return F.log1p(as_column(c))


def normal_pdf(c) -> Column:
    x = as_column(c)
    return F.exp(x * x * -0.5) / math.sqrt(2 * math.pi)


def normal_cdf(c) -> Column:
    """Standard normal CDF, absolute error about 1e-15."""

    def tail(size: Column) -> Column:
        bell = F.exp(size * size * -0.5)
        near = bell * _polynomial(size, CDF_TOP) / _polynomial(size, CDF_BOTTOM)
        chain = size + F.lit(0.65)
        for step in (4.0, 3.0, 2.0, 1.0):
            chain = size + F.lit(step) / chain
        far = bell / chain / math.sqrt(2 * math.pi)
        return F.when(size < CDF_SWITCH, near).otherwise(far)

    x = as_column(c)
    return bind(x, lambda v: bind(tail(F.abs(v)), lambda t: F.when(v > 0, 1 - t).otherwise(t)))


def normal_quantile(c) -> Column:
    """Inverse normal CDF: a rational start and one Halley step."""

    def start(p: Column) -> Column:
        low = F.least(p, 1 - p)
        q = p - 0.5
        r = q * q
        middle = _polynomial(r, QUANTILE_MID_TOP) * q / _polynomial(r, QUANTILE_MID_BOTTOM)
        outer = bind(
            F.sqrt(F.log(low) * -2),
            lambda t: _polynomial(t, QUANTILE_TAIL_TOP) / _polynomial(t, QUANTILE_TAIL_BOTTOM),
        )
        return F.when(low >= QUANTILE_TAIL, middle).otherwise(F.when(p < 0.5, outer).otherwise(-outer))

    def refine(p: Column, x: Column) -> Column:
        return bind((normal_cdf(x) - p) / normal_pdf(x), lambda e: x - e / (1 + x * e / 2))

    p = as_column(c)
    found = bind(p, lambda v: bind(start(v), lambda x: refine(v, x)))
    return F.when((p > 0) & (p < 1), found)


# Series of log(gamma(z + 1/2) / gamma(z)) - log(z) / 2 in 1/z, 1/z^3, ...
HALF_STEP = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)
HALF_STEP_FROM = 12


def _log_half_step(z: Column) -> Column:
    """log(gamma(z + 1/2) / gamma(z)) for z > 0, moved up to where the series is exact."""
    far = z + HALF_STEP_FROM
    below = F.lit(0.0)
    for i in range(HALF_STEP_FROM):
        below = below + F.log1p(0.5 / (z + i))
    series = F.lit(0.0)
    for coefficient in reversed(HALF_STEP):
        series = series / (far * far) + coefficient
    return 0.5 * F.log(far) + series / far - below


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, with as many terms as its size asks for."""
    nonzero = lambda c: F.when(c == 0, 1e-300).otherwise(c)

    def turn(state, term):
        d = 1 / nonzero(1 + term * state["d"])
        c = nonzero(1 + term / state["c"])
        return F.struct((state["total"] * d * c).alias("total"), c.alias("c"), d.alias("d"))

    def step(state, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return bind(turn(state, even), lambda s: turn(s, odd))

    first = 1 / nonzero(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("total"), F.lit(1.0).alias("c"), first.alias("d"))
    steps = F.sequence(F.lit(1), (60 + F.ceil(5 * F.sqrt(F.greatest(a, b)))).cast("int"))
    return F.aggregate(steps, start, step, lambda s: s["total"])


def student_p(t, freedom) -> Column:
    """Two-sided p value of Student's t, P(|T| >= |t|); null for no degrees of freedom.

    The work per row grows with the square root of the degrees of freedom, so
    over the groups of a table it stays below one step per row of the table.
    """
    named = F.struct(
        as_column(t).cast("double").alias("t"), as_column(freedom).cast("double").alias("f")
    )

    def tail(v):
        share = F.struct((v["f"] / (v["f"] + v["t"] * v["t"])).alias("x"), (v["f"] / 2).alias("a"))

        def inside(w):
            a, x = w["a"], w["x"]
            rest = v["t"] * v["t"] / (v["f"] + v["t"] * v["t"])
            front = F.exp(_log_half_step(a) - 0.5 * math.log(math.pi) - a * F.log1p(v["t"] * v["t"] / v["f"]) + 0.5 * F.log(rest))
            # The fraction settles fast on one side of the peak only.
            swap = x > (a + 1) / (a + 2.5)
            half = F.lit(0.5)
            args = F.struct(
                F.when(swap, half).otherwise(a).alias("a"),
                F.when(swap, a).otherwise(half).alias("b"),
                F.when(swap, rest).otherwise(x).alias("x"),
            )
            value = front * bind(args, lambda g: _beta_fraction(g["a"], g["b"], g["x"]) / g["a"])
            return F.when(swap, 1 - value).otherwise(value)

        return F.when(v["t"] == 0, 1.0).when(v["f"] > 0, bind(share, inside))

    return F.when(named["f"] > 0, bind(named, tail))
