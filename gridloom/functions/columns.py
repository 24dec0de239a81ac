"""Column expressions with exact floating-point rules, and 3-vectors as structs (x, y, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Distance from 1 to the next double.
EPSILON = 2.0**-52


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < INF)


def ieee_divide(n: Column, d: Column) -> Column:
    """n / d by IEEE 754: signed infinities and NaN where Spark would raise."""
    sign = F.signum(n) * F.when(d.cast("string").startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    by_zero = F.when(F.isnan(n) | (n == 0), F.lit(NAN)).otherwise(sign * F.lit(INF))
    return F.when(d == 0, by_zero).otherwise(n / F.nullif(d, F.lit(0.0)))


def clamp(v: Column, low: float, high: float) -> Column:
    """v within [low, high]; NaN stays NaN."""
    if low > high:
        raise ValueError("the lower bound is above the upper one")
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def scalar_divide(v: Column, by: float) -> Column:
    if by == 0:
        raise ZeroDivisionError("division by zero")
    return v / F.lit(float(by))


def huber(squared: Column, delta: float) -> tuple[Column, Column]:
    """(cost, weight) of a squared residual norm under the Huber loss; delta 0 turns it off."""
    if not 0 <= delta < math.inf:
        raise ValueError("delta must be finite and not negative")
    bad = F.raise_error(F.lit("a squared norm must be finite and not negative")).cast("double")
    checked = F.when(~finite(squared) | (squared < 0), bad).otherwise(squared)
    if delta == 0:
        return checked / 2, F.lit(1.0)
    root, d = F.sqrt(checked), F.lit(float(delta))
    inside = root <= d
    return F.when(inside, checked / 2).otherwise(d * root - d * d / 2), F.when(inside, F.lit(1.0)).otherwise(d / root)


# --- 3-vectors ---------------------------------------------------------------------------

AXES = ("x", "y", "z")


def vec(x, y, z) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(float(c)) if isinstance(c, (int, float)) else F.col(c)
    return F.struct(*[as_column(c).alias(a) for c, a in zip((x, y, z), AXES)])


def vec_of_array(values: Column) -> Column:
    return vec(*[F.get(values, F.lit(i)) for i in range(3)])


def vec_to_array(a: Column) -> Column:
    return F.array(*[a[k] for k in AXES])


def vec_add(a: Column, b: Column) -> Column:
    return vec(*[a[k] + b[k] for k in AXES])


def vec_sub(a: Column, b: Column) -> Column:
    return vec(*[a[k] - b[k] for k in AXES])


def vec_scale(a: Column, s: Column) -> Column:
    return vec(*[a[k] * s for k in AXES])


def vec_divide(a: Column, s: Column) -> Column:
    return vec(*[ieee_divide(a[k], s) for k in AXES])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def normalized(a: Column, eps: float = EPSILON) -> Column:
    """a at unit length; unchanged if its length is eps or less."""
    n = norm(a)
    safe = F.when(n <= eps, F.lit(1.0)).otherwise(n)
    return vec(*[a[k] / safe for k in AXES])


def vec_finite(a: Column) -> Column:
    return finite(a["x"]) & finite(a["y"]) & finite(a["z"])


# --- Ordered folds -----------------------------------------------------------------------


def ordered_sum(order: Column, v: Column) -> Column:
    """Aggregate: the sum of v in the order of `order`, starting from the first value."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v")))), lambda e: e["v"])
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, F.lit(0)), lambda a, x: a + x)


def compensated_sum(order: Column, v: Column) -> Column:
    """Aggregate: struct (s, c) of the compensated sum of v in the order of `order`; the sum is s + c."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v")))), lambda e: e["v"])

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step)
