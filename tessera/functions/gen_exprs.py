"""Column recipes of the generator as Spark SQL expression text.

Every generated value is a pure function of (seed, table, column, purpose, row id): a 52-bit
uniform taken from the md5 of those parts. This keeps a row's value independent of
partitioning, task retries and executor loss (unlike ``rand(seed)``).

A normal value takes one uniform through the inverse distribution function. Excluded values are cut out
of the uniform's range beforehand, so one draw always gives an allowed value: nothing is drawn again.
"""

from __future__ import annotations

import math

TWO52 = 4503599627370496  # 2**52: 13 hex digits of md5 are exact in a double

# The published rational approximation of the standard normal quantile (central part,
# |p - 1/2| <= 0.47575, relative error below 1.15e-9). Values are clipped at 1.5 standard deviations,
# so the tails are never asked for.
QUANTILE_NUM = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
                -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_DEN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
                -1.328068155288572e+01, 1.0)

SCALE = 1_000_000  # floats are rounded to millionths


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def uniform(parts: list[str], id_sql: str) -> str:
    """Uniform in [0, 1) from md5 of the parts and the row id."""
    key = "concat_ws(':', " + ", ".join(quote(p) for p in parts) + f", CAST({id_sql} AS STRING))"
    return f"(CAST(CAST(conv(substr(md5({key}), 1, 13), 16, 10) AS BIGINT) AS DOUBLE) / CAST({TWO52} AS DOUBLE))"


def phi(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


LOW = phi(-1.5)  # share of draws clipped to 0, and as many to the range


def _horner(coefficients, x: str) -> str:
    out = dbl(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {dbl(c)})"
    return out


def quantile(p: str) -> str:
    """Standard normal quantile of ``p`` (a column name or a short expression) in the central part."""
    q = f"({p} - CAST(0.5 AS DOUBLE))"
    r = f"({q} * {q})"
    return f"({_horner(QUANTILE_NUM, r)} * {q} / {_horner(QUANTILE_DEN, r)})"


def normal(p: str, rng: float) -> str:
    """Value at probability ``p`` of a Gaussian (mean rng/2, sd rng/3) clipped to [0, rng]."""
    x = f"(CAST(0.5 AS DOUBLE) + {quantile(p)} / CAST(3 AS DOUBLE)) * {dbl(float(rng))}"
    return (f"(CASE WHEN {p} < {dbl(LOW)} THEN CAST(0 AS DOUBLE) WHEN {p} >= {dbl(1 - LOW)} THEN {dbl(float(rng))} "
            f"ELSE least(greatest({x}, CAST(0 AS DOUBLE)), {dbl(float(rng))}) END)")


def skip(p: str, cuts: list[tuple[float, float]]) -> str:
    """A uniform spread over [0, 1) without the intervals ``cuts`` (sorted, apart)."""
    left = 1.0 - sum(hi - lo for lo, hi in cuts)
    out = f"({p} * {dbl(left)})"
    if not cuts:
        return p
    arr = ", ".join(f"named_struct('lo', {dbl(lo)}, 'd', {dbl(hi - lo)})" for lo, hi in cuts)
    return f"aggregate(array({arr}), {out}, (t, e) -> IF(t >= e.lo, t + e.d, t))"


def int_cuts(excluded: set[int], rng: float) -> list[tuple[float, float]]:
    """Probability intervals of the excluded integers; neighbours join into one."""
    top = math.floor(rng)
    cdf = lambda v: phi((v - rng / 2) / (rng / 3))
    out: list[tuple[float, float]] = []
    for v in sorted(x for x in excluded if 0 <= x <= top):
        lo = 0.0 if v == 0 else cdf(v)
        hi = 1.0 if v == top else cdf(v + 1)
        if v == top and float(top) == rng:
            lo = 1 - LOW  # the range itself is an integer: only the clipped draws reach it
        elif v == top - 1 and float(top) == rng:
            hi = 1 - LOW
        if out and out[-1][1] >= lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def next_allowed(value: str, excluded: list[int], top: int) -> str:
    """``value`` (an integer expression), or the next integer not excluded, down from the top if need be."""
    if not excluded:
        return value
    up = ", ".join(f"{v}L" for v in sorted(excluded))
    down = ", ".join(f"{v}L" for v in sorted(excluded, reverse=True))
    climb = f"aggregate(array({up}), CAST({value} AS BIGINT), (t, e) -> IF(e = t, t + 1, t))"
    sink = f"aggregate(array({down}), {top}L, (t, e) -> IF(e = t, t - 1, t))"
    return f"least({climb}, {sink})"


def idiv(a: str, b: int) -> str:
    return f"({a} div {b})"


def skip_ticks(ticks: list[int], k: str) -> str:
    """The k-th tick that is not in the sorted ``ticks``."""
    if not ticks:
        return k
    arr = ", ".join(f"{v}L" for v in ticks)
    return f"aggregate(array({arr}), CAST({k} AS BIGINT), (t, e) -> IF(e <= t, t + 1, t))"


def seconds_to_ts(secs: str) -> str:
    return f"CAST(timestamp_seconds({secs}) AS TIMESTAMP_NTZ)"
