"""Rotations and rigid transforms of 3-D points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def rotation_matrix(axis: tuple[float, float, float], angle: float) -> np.ndarray:
    """Rotation about an axis by the right-hand rule: cos I + sin [u]x + (1 - cos) u uT."""
    length = math.sqrt(sum(a * a for a in axis))
    if length < 1e-12:
        raise ValueError("the axis has no direction")
    u = np.array(axis, float) / length
    skew = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return math.cos(angle) * np.eye(3) + math.sin(angle) * skew + (1 - math.cos(angle)) * np.outer(u, u)


def rotation_columns(axis: Column, angle: Column) -> list[list[Column]]:
    """The same as nine expressions, where axis (a 3-vector struct) and angle are columns."""
    length = C.norm(axis)
    checked = F.when(length < 1e-12, F.raise_error(F.lit("the axis has no direction")).cast("double")).otherwise(length)
    u = [axis[k] / checked for k in C.AXES]
    cos, sin = F.cos(angle), F.sin(angle)
    zero = F.lit(0.0)
    skew = [[zero, -u[2], u[1]], [u[2], zero, -u[0]], [-u[1], u[0], zero]]
    return [[(cos if i == j else zero) + sin * skew[i][j] + (1 - cos) * u[i] * u[j] for j in range(3)] for i in range(3)]


def rigid_transform(rotation: np.ndarray, translation: tuple[float, float, float]) -> np.ndarray:
    """4 x 4: the rotation, the translation in the last column, and a bottom row of 0 0 0 1."""
    r = np.asarray(rotation, float)
    if r.shape != (3, 3):
        raise ValueError("a rotation is 3 x 3")
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = r, translation
    return t


def transform_points(points: DataFrame, transform: np.ndarray, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """R p + t for every row, as a projection with the matrix as constants; the bottom row is not used."""
    m = np.asarray(transform, float)
    if m.shape != (4, 4):
        raise ValueError("a transform is 4 x 4")
    p = [F.col(c) for c in (x, y, z)]
    new = [sum((F.lit(float(m[i, j])) * p[j] for j in range(1, 3)), F.lit(float(m[i, 0])) * p[0]) + F.lit(float(m[i, 3])) for i in range(3)]
    return points.withColumns(dict(zip((x, y, z), new)))
