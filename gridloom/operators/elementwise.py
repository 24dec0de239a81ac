"""Element-wise operators: projections of one source; matrices from two sources are joined by element, or by row where both are in rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from ..matrix import CELLS, Matrix, dealt


def _pairwise(a: Matrix, b: Matrix, combine: Callable[[Column, Column], Column]) -> Matrix:
    """combine(0, 0) must be 0, as elements that two sparse matrices lack stay absent."""
    a.same_shape(b)
    x, y = (m.element or (lambda v: v) for m in (a, b))
    if a.source is b.source and a.layout == b.layout and a.sparse == b.sparse:
        return replace(a, element=lambda v: combine(x(v), y(v)))
    if a.layout == b.layout != CELLS:
        both = a.source.select("row", "values").join(b.source.select("row", F.col("values").alias("others")), "row")
        return replace(a, source=both.select("row", F.zip_with("values", "others", lambda v, w: combine(x(v), y(w))).alias("values")), element=None)
    many = max(m.stored if m.sparse else m.size for m in (a, b))
    left, right = (dealt(m.df.select("row", "col", F.col("v").alias(c)), many, "row", "col") for m, c in ((a, "v"), (b, "w")))
    if a.sparse or b.sparse:  # an element that one side lacks is zero there
        both = left.join(right, ["row", "col"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in "vw"})
    else:
        both = left.join(right, ["row", "col"])
    stored = a.stored + b.stored if a.stored and b.stored else 0
    return Matrix(both.select("row", "col", combine(F.col("v"), F.col("w")).alias("v")), *a.shape, a.sparse and b.sparse, stored=stored)


def add(a: Matrix, b: Matrix) -> Matrix:
    return _pairwise(a, b, lambda v, w: v + w)


def sub(a: Matrix, b: Matrix) -> Matrix:
    return _pairwise(a, b, lambda v, w: v - w)


def hadamard_multiply(a: Matrix, b: Matrix) -> Matrix:
    return _pairwise(a, b, lambda v, w: v * w)


def hadamard_divide(a: Matrix, b: Matrix) -> Matrix:
    """IEEE division: by zero gives infinities or NaN, as do elements that a sparse divisor lacks; so it is completed."""
    a.same_shape(b)
    if b.sparse and a.source is b.source:
        every = replace(a, element=None).dense()
        a, b = replace(every, element=a.element), replace(every, element=b.element)
    elif b.sparse:
        b = b.dense()
    return _pairwise(a, b, C.ieee_divide)


def scalar_multiply(a: Matrix, s: float) -> Matrix:
    return a.map(lambda v: v * F.lit(float(s)), keeps_zero=math.isfinite(s))


def scalar_add(a: Matrix, s: float) -> Matrix:
    return a.map(lambda v: v + F.lit(float(s)), keeps_zero=s == 0)


def scalar_divide(a: Matrix, s: float) -> Matrix:
    """Raises ZeroDivisionError for either zero."""
    C.scalar_divide(F.lit(0.0), s)
    return a.map(lambda v: C.scalar_divide(v, s), keeps_zero=not math.isnan(s))


def absolute(a: Matrix) -> Matrix:
    return a.map(F.abs)


def sqrt(a: Matrix) -> Matrix:
    """NaN for negative elements."""
    return a.map(F.sqrt)


def clamp(a: Matrix, low: float, high: float) -> Matrix:
    """NaN stays; bounds in the wrong order raise ValueError."""
    C.clamp(F.lit(0.0), low, high)
    return a.map(lambda v: C.clamp(v, low, high), keeps_zero=low <= 0 <= high)
