"""The registered queries over the driver's tables, each with the same result in DuckDB SQL.

Floating results are rounded on both sides. Where an operator has no closed form in SQL, its
query returns what must hold of the result: a product that gives the input back, or the
solution of a system whose right side was made from a known solution.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..matrix import Matrix, dealt
from ..operators import dense, elementwise, geometry, iterative, leastsquares, products, reduce, rows, small, sparse
from ..scratch import materialise, scratch_dir
from ..sources import matrix_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def register(function):
        QUERIES[name], ORACLES[name] = function, oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 decimals, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# --- Matrices from the tables -----------------------------------------------------------------


def embeddings(spark: SparkSession, sf_dir: str) -> Matrix:
    """One row for each vector, in the order of vec_id, which counts from 0."""
    df = table(spark, sf_dir, "embeddings")
    return Matrix.from_arrays(df, "vec_id", "embedding", df.count(), 64)


EMB = "emb AS (SELECT vec_id AS row, CAST(unnest(range(64)) AS BIGINT) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def rounded(m: Matrix) -> DataFrame:
    return m.df.select("row", "col", r6("v").alias("v"))


def on_embeddings(name: str, build: Callable[[Matrix], Matrix], value: str, where: str = "emb") -> None:
    oracle = f"WITH {EMB} SELECT row, col, round({value}, 6) + 0.0 AS v FROM {where}"
    query(name, oracle)(lambda spark, sf_dir: rounded(build(embeddings(spark, sf_dir))))


# --- Constructors and element access ----------------------------------------------------------

query("matrix_zeros", f"WITH {EMB} SELECT row, col, CAST(0 AS DOUBLE) AS v FROM emb")(
    lambda spark, sf_dir: Matrix.zeros(spark, *embeddings(spark, sf_dir).shape).df
)
on_embeddings("matrix_fill", lambda a: a.fill(2.5), "CAST(2.5 AS DOUBLE)")
on_embeddings("matrix_set_element", lambda a: a.set(3, 4, -1.25), "CASE WHEN row = 3 AND col = 4 THEN -1.25 ELSE v END")


@query("matrix_get_element", f"WITH {EMB} SELECT row, col, v FROM emb WHERE row = 3 AND col = 4")
def matrix_get_element(spark, sf_dir):
    value = embeddings(spark, sf_dir).get(3, 4)
    return spark.range(1).select(F.lit(3).cast("long").alias("row"), F.lit(4).cast("long").alias("col"), F.lit(value).alias("v"))


@query("matrix_file_roundtrip", f"WITH {EMB} SELECT row, col, v FROM emb")
def matrix_file_roundtrip(spark, sf_dir):
    path = f"{scratch_dir(spark)}/matrix-{uuid.uuid4().hex}.bin"
    matrix_file.write_matrix(embeddings(spark, sf_dir), path)
    return matrix_file.read_matrix(spark, path).df


@query("vector_file_roundtrip", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, CAST(o_totalprice AS DOUBLE) AS v FROM orders")
def vector_file_roundtrip(spark, sf_dir):
    """The prices of all orders, by number."""
    path = f"{scratch_dir(spark)}/vector-{uuid.uuid4().hex}.bin"
    items = rows.compact(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), "o_orderkey", F.lit(True), "row")
    matrix_file.write_vector(items, items.count(), path)
    return matrix_file.read_vector(spark, path)


# --- Element-wise -----------------------------------------------------------------------------

other = lambda a: elementwise.scalar_add(elementwise.absolute(a), 1.0)
on_embeddings("ew_add", lambda a: elementwise.add(a, other(a)), "v + (abs(v) + 1.0)")
on_embeddings("ew_sub", lambda a: elementwise.sub(a, other(a)), "v - (abs(v) + 1.0)")
on_embeddings("ew_scalar_multiply", lambda a: elementwise.scalar_multiply(a, 1.5), "v * 1.5::DOUBLE")
on_embeddings("ew_scalar_add", lambda a: elementwise.scalar_add(a, 0.25), "v + 0.25::DOUBLE")
on_embeddings("ew_scalar_divide", lambda a: elementwise.scalar_divide(a, 3.0), "v / 3.0::DOUBLE")
on_embeddings("ew_alpha_times", lambda a: 1.5 * a, "1.5::DOUBLE * v")
on_embeddings("ew_alpha_plus", lambda a: 0.25 + a, "0.25::DOUBLE + v")
on_embeddings("ew_hadamard_multiply", lambda a: elementwise.hadamard_multiply(a, other(a)), "v * (abs(v) + 1.0)")
on_embeddings("ew_hadamard_divide", lambda a: elementwise.hadamard_divide(a, other(a)), "v / (abs(v) + 1.0)")
on_embeddings("ew_abs", elementwise.absolute, "abs(v)")
on_embeddings("ew_sqrt", lambda a: elementwise.sqrt(elementwise.absolute(a)), "sqrt(abs(v))")
on_embeddings("ew_clamp", lambda a: elementwise.clamp(a, -0.1, 0.1), "least(greatest(v, -0.1::DOUBLE), 0.1::DOUBLE)")
query("transpose", f"WITH {EMB} SELECT col AS row, row AS col, round(v, 6) + 0.0 AS v FROM emb")(
    lambda spark, sf_dir: rounded(embeddings(spark, sf_dir).transpose())
)


@query("ew_ieee_divide", "SELECT event_id, value / ((event_id % 3 - 1) * (-1.0::DOUBLE)) AS v FROM events")
def ew_ieee_divide(spark, sf_dir):
    d = (F.col("event_id") % 3 - 1) * F.lit(-1.0)
    return table(spark, sf_dir, "events").select("event_id", C.ieee_divide(F.col("value"), d).alias("v"))


@query(
    "ew_clamp_nan",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
SELECT event_id, CASE WHEN isnan(v) THEN v ELSE least(greatest(v, 10.0::DOUBLE), 50.0::DOUBLE) END AS v FROM e""",
)
def ew_clamp_nan(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, C.NAN).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", C.clamp(F.col("v"), 10.0, 50.0).alias("v"))


@query("finite_flags", "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS finite FROM events")
def finite_flags(spark, sf_dir):
    x = F.when(F.col("event_id") % 5 == 0, C.NAN).otherwise(F.col("value"))
    y = F.when(F.col("event_id") % 7 == 0, -C.INF).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", C.vec_finite(C.vec(x, y, 1.0)).alias("finite"))


# --- Reductions -------------------------------------------------------------------------------

_LANES = {
    "all": "(SELECT CAST(0 AS BIGINT) AS lane, row + col * (SELECT count(*) FROM embeddings) AS place, v FROM emb)",
    "rows": "(SELECT row AS lane, col AS place, v FROM emb)",
    "columns": "(SELECT col AS lane, row AS place, v FROM emb)",
}
for _axis, _lanes in _LANES.items():
    for _name, _op, _sql in (
        ("sum", reduce.total, "sum(v)"),
        ("mean", reduce.mean, "avg(v)"),
        ("strict_mean", reduce.strict_mean, "avg(v)"),
        ("min", reduce.minimum, "min(v)"),
        ("max", reduce.maximum, "max(v)"),
    ):
        query(f"reduce_{_axis}_{_name}", f"WITH {EMB} SELECT lane, round({_sql}, 6) + 0.0 AS v FROM {_lanes} GROUP BY lane")(
            lambda spark, sf_dir, op=_op, axis=_axis: op(embeddings(spark, sf_dir), axis).select("lane", r6("v").alias("v"))
        )
    for _name, _op, _sql in (("argmin", reduce.arg_min, "arg_min(place, row(v, place))"), ("argmax", reduce.arg_max, "arg_max(place, row(v, -place))")):
        query(f"reduce_{_axis}_{_name}", f"WITH {EMB} SELECT lane, {_sql} AS idx FROM {_lanes} GROUP BY lane")(
            lambda spark, sf_dir, op=_op, axis=_axis: op(embeddings(spark, sf_dir), axis).select("lane", "idx")
        )


@query(
    "reduce_with_nan",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
SELECT user_id, CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE min(v) END AS low, max(v) AS high,
       coalesce(min(event_id) FILTER (WHERE isnan(v)), arg_min(event_id, row(v, event_id))) AS low_at,
       coalesce(min(event_id) FILTER (WHERE isnan(v)), arg_max(event_id, row(v, -event_id))) AS high_at
FROM e GROUP BY user_id""",
)
def reduce_with_nan(spark, sf_dir):
    v = F.when(F.col("event_id") % 97 == 0, C.NAN).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", v.alias("v"))
    at = F.col("event_id")
    return e.groupBy("user_id").agg(
        reduce.smallest(F.col("v")).alias("low"),
        F.max("v").alias("high"),
        reduce.index_of(F.col("v"), at, False).alias("low_at"),
        reduce.index_of(F.col("v"), at, True).alias("high_at"),
    )


@query(
    "finite_median",
    """WITH e AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS v FROM events)
SELECT event_type, round(median(v) FILTER (WHERE isfinite(v)), 6) AS v FROM e GROUP BY event_type""",
)
def finite_median(spark, sf_dir):
    v = F.when(F.col("event_id") % 11 == 0, C.NAN).when(F.col("event_id") % 13 == 0, C.INF).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").select("event_type", v.alias("v"))
    return e.groupBy("event_type").agg(r6(reduce.finite_median(F.col("v"))).alias("v"))


@query("finite_medians", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice * (1 - l_discount)), 6) AS v FROM lineitem GROUP BY ALL")
def finite_medians(spark, sf_dir):
    """Groups of more than 500 rows are narrowed down first."""
    v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    found = reduce.finite_medians(table(spark, sf_dir, "lineitem"), v, ["l_returnflag", "l_linestatus"], most=500)
    return found.withColumn("v", r6("v"))


# --- Point clouds -----------------------------------------------------------------------------


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points: quantity, price in thousands, ten times the discount."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 10).alias("z")
    )


CLOUD = "cloud AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 10 AS z FROM lineitem)"
_TURN = geometry.rotation_matrix((0.0, 0.0, 1.0), math.pi / 4)
MOVE = geometry.rigid_transform(_TURN, (10.0, 5.0, 3.0))
MOVED = f"""{CLOUD}, moved AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag,
  cos(pi() / 4) * x - sin(pi() / 4) * y + 10 AS x, sin(pi() / 4) * x + cos(pi() / 4) * y + 5 AS y, z + 3 AS z FROM cloud)"""
_COV = "covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(x, z) AS cxz, covar_pop(y, y) AS cyy, covar_pop(y, z) AS cyz, covar_pop(z, z) AS czz"
_NAMES = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
_ROUND = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in _NAMES)


@query("rigid_points", f"WITH {MOVED} SELECT l_returnflag, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(max(x), 6) AS top FROM moved GROUP BY l_returnflag")
def rigid_points(spark, sf_dir):
    moved = geometry.transform_points(cloud(spark, sf_dir), MOVE)
    means = [r6(F.avg(c)).alias(c) for c in "xyz"]
    return moved.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *means, r6(F.max("x")).alias("top"))


@query("covariance_by_flag", f"WITH {CLOUD}, c AS (SELECT l_returnflag, count(*) AS n, {_COV} FROM cloud GROUP BY l_returnflag) SELECT l_returnflag, n, {_ROUND} FROM c")
def covariance_by_flag(spark, sf_dir):
    found = reduce.covariance(cloud(spark, sf_dir), by=["l_returnflag"])
    return found.select("l_returnflag", "n", *[r6(n).alias(n) for n in _NAMES])


@query(
    "covariance_matrix",
    f"""WITH {EMB}, p AS (SELECT row, max(v) FILTER (WHERE col = 0) AS x, max(v) FILTER (WHERE col = 1) AS y, max(v) FILTER (WHERE col = 2) AS z FROM emb GROUP BY row), c AS (SELECT {_COV} FROM p)
SELECT row, col, round(v, 6) + 0.0 AS v FROM (SELECT CAST(unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS BIGINT) AS row, CAST(unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS BIGINT) AS col, unnest([cxx, cxy, cxz, cxy, cyy, cyz, cxz, cyz, czz]) AS v FROM c)""",
)
def covariance_matrix(spark, sf_dir):
    """Of the first three columns of the embeddings."""
    a = embeddings(spark, sf_dir)
    return rounded(reduce.covariance_matrix(Matrix(a.df.where("col < 3"), a.rows, 3)))


@query(
    "cloud_principal_axes",
    f"""WITH {MOVED}, c AS (SELECT l_returnflag, count(*) AS n, {_COV} FROM moved GROUP BY l_returnflag)
SELECT l_returnflag, n, {_ROUND}, round(cxx + cyy + czz, 5) AS trace,
       round(cxx * (cyy * czz - cyz * cyz) - cxy * (cxy * czz - cyz * cxz) + cxz * (cxy * cyz - cyy * cxz), 3) AS determinant FROM c""",
)
def cloud_principal_axes(spark, sf_dir):
    """Covariances of the rigidly moved cloud, and the sum and product of their eigenvalues."""
    found = reduce.covariance(geometry.transform_points(cloud(spark, sf_dir), MOVE), by=["l_returnflag"])
    axes = small.symmetric_eigh3(found.withColumn("c", F.array(*_NAMES)), "c")
    w = [F.get("eigenvalues", F.lit(i)) for i in range(3)]
    return axes.select(
        "l_returnflag", "n", *[r6(n).alias(n) for n in _NAMES], F.round(w[0] + w[1] + w[2], 5).alias("trace"), F.round(w[0] * w[1] * w[2], 3).alias("determinant")
    )


_VEC = "SELECT l_orderkey, l_partkey, l_suppkey, x, y, z, x - 10 AS a, z + 1 AS b, y / 2 AS c FROM cloud"


@query(
    "vec3_ops",
    f"""WITH {CLOUD}, v AS ({_VEC}), k AS (SELECT *, x * a + y * b + z * c AS d, y * c - z * b AS kx, z * a - x * c AS ky, x * b - y * a AS kz, sqrt(x * x + y * y + z * z) AS len FROM v)
SELECT l_suppkey, round(sum(d) / 1007, 4) AS dot, round(sum(kx) / 1007, 4) AS cross_x, round(sum(ky) / 1007, 4) AS cross_y, round(sum(kz) / 1007, 4) AS cross_z,
  round(sum(x + a) / 1007, 4) AS add_x, round(sum(y - b) / 1007, 4) AS sub_y, round(sum(z * 2.5) / 1007, 4) AS scaled_z, round(sum(x / 8) / 1007, 4) AS divided_x,
  round(sum(x * x + y * y + z * z) / 1007, 4) AS squared, round(sum(len) / 1007, 4) AS norm, round(sum(y / len) / 1007, 6) AS unit_y FROM k GROUP BY l_suppkey""",
)
def vec3_ops(spark, sf_dir):
    p = cloud(spark, sf_dir).select("l_suppkey", C.vec("x", "y", "z").alias("p"), C.vec(F.col("x") - 10, F.col("z") + 1, F.col("y") / 2).alias("q"))
    p_, q_ = F.col("p"), F.col("q")
    made = p.select(
        "l_suppkey", C.dot(p_, q_).alias("dot"), C.cross(p_, q_).alias("cross"), C.vec_add(p_, q_).alias("add"), C.vec_sub(p_, C.vec(q_["x"], q_["y"], q_["z"])).alias("sub"),
        C.vec_scale(p_, F.lit(2.5)).alias("scaled"), C.vec_divide(p_, F.lit(8.0)).alias("divided"), C.squared_norm(p_).alias("squared"), C.norm(p_).alias("norm"), C.normalized(p_).alias("unit"),
    )
    total = lambda c, name, digits=4: F.round(F.sum(c) / 1007, digits).alias(name)
    return made.groupBy("l_suppkey").agg(
        total("dot", "dot"), total("cross.x", "cross_x"), total("cross.y", "cross_y"), total("cross.z", "cross_z"), total("add.x", "add_x"), total("sub.y", "sub_y"),
        total("scaled.z", "scaled_z"), total("divided.x", "divided_x"), total("squared", "squared"), total("norm", "norm"), total("unit.y", "unit_y", 6),
    )


@query(
    "rotation_by_row",
    """SELECT event_id, round(cos(value / 10), 6) + 0.0 AS r00, round(-sin(value / 10), 6) + 0.0 AS r01, round(sin(value / 10), 6) + 0.0 AS r10, 1.0::DOUBLE AS r22 FROM events""",
)
def rotation_by_row(spark, sf_dir):
    r = geometry.rotation_columns(C.vec(0.0, 0.0, 2.0), F.col("value") / 10)
    return table(spark, sf_dir, "events").select("event_id", r6(r[0][0]).alias("r00"), r6(r[0][1]).alias("r01"), r6(r[1][0]).alias("r10"), r6(r[2][2]).alias("r22"))


@query(
    "huber_loss",
    """SELECT event_id, round(CASE WHEN sqrt(abs(value)) <= 3 THEN abs(value) / 2 ELSE 3 * sqrt(abs(value)) - 4.5 END, 6) AS cost,
       round(CASE WHEN sqrt(abs(value)) <= 3 THEN 1.0::DOUBLE ELSE 3 / sqrt(abs(value)) END, 6) AS weight FROM events""",
)
def huber_loss(spark, sf_dir):
    cost, weight = C.huber(F.abs("value"), 3.0)
    return table(spark, sf_dir, "events").select("event_id", r6(cost).alias("cost"), r6(weight).alias("weight"))


# --- Small kernels, by supplier ---------------------------------------------------------------

_ROUND4 = _ROUND.replace(", 6)", ", 4)")
_BY_SUPPLIER = f"{CLOUD}, c AS (SELECT l_suppkey, {_COV} FROM cloud GROUP BY l_suppkey HAVING count(*) >= 2)"


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduce.covariance(cloud(spark, sf_dir), by=["l_suppkey"]).where("n >= 2")
    return found.select("l_suppkey", *_NAMES)


def _pick(array: str, i: int) -> Column:
    return F.get(array, F.lit(i))


@query("eigh3_reconstructs", f"WITH {_BY_SUPPLIER} SELECT l_suppkey, {_ROUND4} FROM c")
def eigh3_reconstructs(spark, sf_dir):
    """V diag(w) VT of each supplier's covariance."""
    made = small.symmetric_eigh3(by_supplier(spark, sf_dir).withColumn("c", F.array(*_NAMES)), "c", "l_suppkey")
    cell = lambda i, j: sum((_pick("eigenvalues", k) * _pick("eigenvectors", 3 * k + i) * _pick("eigenvectors", 3 * k + j) for k in range(1, 3)), _pick("eigenvalues", 0) * _pick("eigenvectors", i) * _pick("eigenvectors", j))
    places = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    return made.select("l_suppkey", *[(F.round(cell(i, j), 4) + 0.0).alias(n) for n, (i, j) in zip(_NAMES, places)])


@query("svd3_reconstructs", f"WITH {_BY_SUPPLIER} SELECT l_suppkey, {_ROUND4} FROM c")
def svd3_reconstructs(spark, sf_dir):
    full = F.array("cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz")
    made = small.svd3(by_supplier(spark, sf_dir).withColumn("m", full), "m")
    cell = lambda i, j: sum((_pick("u", 3 * i + k) * _pick("s", k) * _pick("vt", 3 * k + j) for k in range(1, 3)), _pick("u", 3 * i) * _pick("s", 0) * _pick("vt", j))
    places = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    return made.select("l_suppkey", *[(F.round(cell(i, j), 4) + 0.0).alias(n) for n, (i, j) in zip(_NAMES, places)])


@query("solve_small", f"WITH {_BY_SUPPLIER} SELECT l_suppkey, 1.0::DOUBLE AS x0, CAST(-2 AS DOUBLE) AS x1, CAST(3 AS DOUBLE) AS x2 FROM c")
def solve_small(spark, sf_dir):
    """The system (C + I) x = (C + I) (1, -2, 3) of each supplier."""
    c = by_supplier(spark, sf_dir).withColumns({n: F.col(n) + 1 for n in ("cxx", "cyy", "czz")})
    lines = [("cxx", "cxy", "cxz"), ("cxy", "cyy", "cyz"), ("cxz", "cyz", "czz")]
    right = F.array(*[F.col(a) - 2 * F.col(b) + 3 * F.col(d) for a, b, d in lines])
    made = small.solve_small(c.withColumns({"a": F.array(*[n for line in lines for n in line]), "b": right}), "a", "b", 3)
    return made.select("l_suppkey", *[r6(_pick("x", i)).alias(f"x{i}") for i in range(3)])


@query("spd_inverse", f"WITH {_BY_SUPPLIER} SELECT l_suppkey, 1.0::DOUBLE AS i00, 0.0::DOUBLE AS i01, 1.0::DOUBLE AS i11, 1.0::DOUBLE AS i22 FROM c")
def spd_inverse(spark, sf_dir):
    """Elements of (C + I)⁻¹ (C + I)."""
    c = by_supplier(spark, sf_dir).withColumns({n: F.col(n) + 1 for n in ("cxx", "cyy", "czz")})
    lines = [("cxx", "cxy", "cxz"), ("cxy", "cyy", "cyz"), ("cxz", "cyz", "czz")]
    made = small.spd_inverse(c.withColumn("a", F.array(*[n for line in lines for n in line])), "a", 3)
    cell = lambda i, j: sum((_pick("inverse", 3 * i + k) * F.col(lines[k][j]) for k in range(1, 3)), _pick("inverse", 3 * i) * F.col(lines[0][j]))
    return made.select("l_suppkey", *[r6(cell(i, j)).alias(f"i{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1), (2, 2))])


# --- Scans and rows ---------------------------------------------------------------------------


@query(
    "exclusive_scan",
    """WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
k AS (SELECT c_custkey - min(c_custkey) OVER () AS row, n FROM c)
SELECT row, CAST(0 AS BIGINT) AS col, CAST(sum(n) OVER (ORDER BY row) - n AS BIGINT) AS v FROM k""",
)
def exclusive_scan(spark, sf_dir):
    """Where the orders of each customer start if they are laid in a row."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    first, n = customers.agg(F.min("c_custkey"), F.count(F.lit(1))).first()
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    cells = customers.join(counts, "c_custkey", "left").select((F.col("c_custkey") - first).alias("row"), F.lit(0).cast("long").alias("col"), F.coalesce("n", F.lit(0)).alias("v"))
    return rows.exclusive_scan(Matrix(cells, n, 1)).df


_N = "(SELECT count(*) FROM embeddings)"


def _index(spark: SparkSession, n: int, into: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("ord"), (F.col("id") * 7 % into).alias("idx"))


@query("gather_rows", f"WITH {EMB} SELECT i.range AS row, col, round(v, 6) + 0.0 AS v FROM range({_N}) i JOIN emb ON emb.row = i.range * 7 % {_N}")
def gather_rows(spark, sf_dir):
    a = embeddings(spark, sf_dir)
    return rounded(rows.gather_rows(a, _index(spark, a.rows, a.rows), a.rows))


@query(
    "scatter_rows",
    f"""WITH {EMB}, o AS (SELECT range * 7 % ({_N} // 2) AS target, min(range) AS source FROM range({_N}) GROUP BY 1)
SELECT e.row, e.col, round(coalesce(-s.v, e.v), 6) + 0.0 AS v FROM emb e LEFT JOIN o ON o.target = e.row LEFT JOIN emb s ON s.row = o.source AND s.col = e.col""",
)
def scatter_rows(spark, sf_dir):
    a = embeddings(spark, sf_dir)
    return rounded(rows.scatter_rows(elementwise.scalar_multiply(a, -1.0), _index(spark, a.rows, a.rows // 2), a))


@query(
    "compact_rows",
    f"""WITH {EMB}, k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings WHERE label % 3 <> 0)
SELECT k.row, col, vec_id AS source_row, round(v, 6) + 0.0 AS v FROM k JOIN emb ON emb.row = k.vec_id""",
)
def compact_rows(spark, sf_dir):
    mask = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), (F.col("label") % 3).alias("keep"))
    kept, source = rows.compact_rows(embeddings(spark, sf_dir), mask)
    return rounded(kept).join(source, "row").select("row", "col", "source_row", "v")


# --- Sparse -----------------------------------------------------------------------------------


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parts and suppliers of line items."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return dealt(items, items.count(), "l_partkey", "l_suppkey").distinct()


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_partkey"), F.max("l_suppkey")).first()
    return top[0] + 1, top[1] + 1


def lines(spark: SparkSession, sf_dir: str) -> sparse.Triplets:
    """Line items as triplets (part, supplier, quantity); quantities are whole, so any order sums alike."""
    df = table(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("ord"), F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("v")
    )
    return sparse.Triplets(df, *_sizes(spark, sf_dir))


COO = "coo AS (SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
query("coo_combine", f"WITH {COO} SELECT row, col, v FROM coo")(lambda spark, sf_dir: sparse.combine(lines(spark, sf_dir)).df)
query("coo_to_csr", f"WITH {COO} SELECT row_number() OVER (ORDER BY row, col) - 1 AS pos, row, col, v FROM coo")(
    lambda spark, sf_dir: sparse.compress(lines(spark, sf_dir)).elements
)
query("coo_nnz", "SELECT count(*) AS nnz FROM lineitem")(lambda spark, sf_dir: spark.range(1).select(F.lit(lines(spark, sf_dir).nnz()).cast("long").alias("nnz")))


@query("csr_offsets", f"WITH {COO}, c AS (SELECT row, count(*) AS n FROM coo GROUP BY row), r AS (SELECT range AS row FROM range((SELECT max(l_partkey) + 2 FROM lineitem))) SELECT r.row, CAST(coalesce(sum(n) OVER (ORDER BY r.row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM r LEFT JOIN c ON c.row = r.row")
def csr_offsets(spark, sf_dir):
    return sparse.row_offsets(sparse.combine(lines(spark, sf_dir)))


@query("csr_validate", "SELECT true AS starts_at_zero, true AS ends_at_nnz, true AS never_falls, true AS columns_in_range, true AS values_finite")
def csr_validate(spark, sf_dir):
    found = sparse.validate(sparse.compress(lines(spark, sf_dir)))
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in found.items()])


@query(
    "spmv",
    f"""WITH {COO}, y AS (SELECT row, sum(v * (col % 7 + 0.5)) AS v FROM coo GROUP BY row)
SELECT r.range AS row, round(coalesce(y.v, 0.0), 6) + 0.0 AS v FROM range((SELECT max(l_partkey) + 1 FROM lineitem)) r LEFT JOIN y ON y.row = r.range""",
)
def spmv(spark, sf_dir):
    a = sparse.combine(lines(spark, sf_dir), ordered=False)
    x = spark.range(a.cols).select(F.col("id").alias("row"), (F.col("id") % 7 + 0.5).cast("double").alias("v"))
    return products.spmv(a, x).select("row", r6("v").alias("v"))


@query(
    "spmm",
    f"""WITH {COO}, b AS (SELECT s.range AS k, c.range AS col, s.range % 5 - c.range + 0.5 AS v FROM range((SELECT max(l_suppkey) + 1 FROM lineitem)) s, range(3) c),
y AS (SELECT coo.row, b.col, sum(coo.v * b.v) AS v FROM coo JOIN b ON b.k = coo.col GROUP BY ALL)
SELECT r.range AS row, c.range AS col, round(CAST(coalesce(y.v, 0) AS DOUBLE), 6) + 0.0 AS v FROM range((SELECT max(l_partkey) + 1 FROM lineitem)) r CROSS JOIN range(3) c
LEFT JOIN y ON y.row = r.range AND y.col = c.range""",
)
def spmm(spark, sf_dir):
    a = sparse.combine(lines(spark, sf_dir), ordered=False)
    b = Matrix.zeros(spark, a.cols, 3)
    b = b.with_values((F.col("row") % 5 - F.col("col") + 0.5).cast("double"))
    return rounded(products.spmm(a, b))


# --- Sparse matrices, whose absent elements count as zeros -------------------------------------


def balance(spark: SparkSession, sf_dir: str) -> Matrix:
    """Quantity above 25 by part and supplier, summed over line items: of both signs, some stored as 0."""
    m = sparse.combine(lines(spark, sf_dir), ordered=False)
    return m.with_values(F.col("v") - 25)


BALANCE = f"""{COO}, bal AS (SELECT row, col, v - 25 AS v FROM coo), grid AS (SELECT r.range AS row, c.range AS col FROM range((SELECT max(l_partkey) + 1 FROM lineitem)) r, range((SELECT max(l_suppkey) + 1 FROM lineitem)) c),
filled AS (SELECT row, col, CAST(coalesce(v, 0) AS DOUBLE) AS v FROM grid LEFT JOIN bal USING (row, col))"""
_FILLED_LANES = {
    "all": "(SELECT CAST(0 AS BIGINT) AS lane, row + col * (SELECT max(row) + 1 FROM grid) AS place, v FROM filled)",
    "rows": "(SELECT row AS lane, col AS place, v FROM filled)",
    "columns": "(SELECT col AS lane, row AS place, v FROM filled)",
}
for _axis, _lanes in _FILLED_LANES.items():
    for _name, _op, _sql in (
        ("sum", reduce.total, "sum(v)"),
        ("mean", reduce.mean, "avg(v)"),
        ("strict_mean", reduce.strict_mean, "avg(v)"),
        ("min", reduce.minimum, "min(v)"),
        ("max", reduce.maximum, "max(v)"),
    ):
        query(f"sparse_reduce_{_axis}_{_name}", f"WITH {BALANCE} SELECT lane, round({_sql}, 6) + 0.0 AS v FROM {_lanes} GROUP BY lane")(
            lambda spark, sf_dir, op=_op, axis=_axis: op(balance(spark, sf_dir), axis).select("lane", r6("v").alias("v"))
        )
    for _name, _op, _sql in (("argmin", reduce.arg_min, "arg_min(place, row(v, place))"), ("argmax", reduce.arg_max, "arg_max(place, row(v, -place))")):
        query(f"sparse_reduce_{_axis}_{_name}", f"WITH {BALANCE} SELECT lane, {_sql} AS idx FROM {_lanes} GROUP BY lane")(
            lambda spark, sf_dir, op=_op, axis=_axis: op(balance(spark, sf_dir), axis).select("lane", "idx")
        )

query("sparse_gram", f"WITH {BALANCE} SELECT a.col AS row, b.col, CAST(sum(a.v * b.v) AS DOUBLE) + 0.0 AS v FROM bal a JOIN bal b ON a.row = b.row GROUP BY ALL")(
    lambda spark, sf_dir: rounded(products.gram(balance(spark, sf_dir)))
)


def nations(spark: SparkSession, sf_dir: str, suppliers: int) -> Matrix:
    """1 for each supplier and its nation."""
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").alias("col"), F.lit(1.0).alias("v"))
    return Matrix(df.where(F.col("row") < suppliers), suppliers, 25, sparse=True)


_BY_NATION = "SELECT row, s_nationkey AS col, sum(v) AS v FROM bal JOIN supplier ON s_suppkey = col GROUP BY ALL"


@query("sparse_gemm", f"WITH {BALANCE} SELECT row, col, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM ({_BY_NATION})")
def sparse_gemm(spark, sf_dir):
    """Balance by part and nation of the supplier."""
    a = balance(spark, sf_dir)
    return rounded(a @ nations(spark, sf_dir, a.cols))


@query("sparse_gemm_mean", f"WITH {BALANCE}, n AS ({_BY_NATION}) SELECT CAST(range AS BIGINT) AS lane, round(coalesce(sum(v), 0) / (SELECT max(row) + 1 FROM grid), 6) + 0.0 AS v FROM range(25) LEFT JOIN n ON n.col = range GROUP BY range")
def sparse_gemm_mean(spark, sf_dir):
    """Means of the columns of that product, over all parts."""
    a = balance(spark, sf_dir)
    return reduce.mean(a @ nations(spark, sf_dir, a.cols), reduce.COLUMNS).select("lane", r6("v").alias("v"))


for _name, _op, _sql in (
    ("ew_scalar_add", lambda a: elementwise.scalar_add(a, 0.5), "v + 0.5"),
    ("ew_clamp", lambda a: elementwise.clamp(a, 1.0, 20.0), "least(greatest(v, 1.0::DOUBLE), 20.0::DOUBLE)"),
    ("fill", lambda a: a.fill(2.5), "CAST(2.5 AS DOUBLE)"),
    ("ew_hadamard_divide", lambda a: elementwise.hadamard_divide(elementwise.scalar_multiply(a, 3.0), a), "CASE WHEN v = 0 THEN 'NaN'::DOUBLE ELSE 3.0::DOUBLE END"),
):
    query(f"sparse_{_name}", f"WITH {BALANCE} SELECT row, col, {_sql} AS v FROM filled")(
        lambda spark, sf_dir, op=_op: op(balance(spark, sf_dir)).df
    )


@query("sparse_ew_sub", f"WITH {BALANCE}, far AS (SELECT l_partkey AS row, l_suppkey AS col, count(*) AS v FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL) SELECT row, col, CAST(coalesce(bal.v, 0) - 2 * coalesce(far.v, 0) AS DOUBLE) + 0.0 AS v FROM bal FULL JOIN far USING (row, col)")
def sparse_ew_sub(spark, sf_dir):
    """Two sparse matrices that store different elements."""
    a = balance(spark, sf_dir)
    last = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"))
    far = dealt(last, a.stored, "row", "col").groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return rounded(elementwise.sub(a, elementwise.scalar_multiply(Matrix(far, *a.shape, sparse=True, stored=a.stored), 2.0)))


@query("sparse_exclusive_scan", f"WITH {BALANCE}, k AS (SELECT row, col, CAST(v AS BIGINT) AS v FROM filled) SELECT row, col, CAST(coalesce(sum(v) OVER (ORDER BY col, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM k")
def sparse_exclusive_scan(spark, sf_dir):
    a = balance(spark, sf_dir)
    return rows.exclusive_scan(a.with_values(F.col("v").cast("long"))).df


@query(
    "sparse_scatter_rows",
    f"""WITH {BALANCE}, size AS (SELECT max(row) + 1 AS n FROM grid), o AS (SELECT range * 7 % (n // 2) AS target, min(range) AS source FROM size, range((SELECT n FROM size)) GROUP BY 1)
SELECT target AS row, bal.col, CAST(-bal.v AS DOUBLE) + 0.0 AS v FROM o JOIN bal ON bal.row = o.source
UNION ALL SELECT row, col, CAST(v AS DOUBLE) + 0.0 FROM bal WHERE row NOT IN (SELECT target FROM o)""",
)
def sparse_scatter_rows(spark, sf_dir):
    """Moved rows replace what the rows at their targets stored."""
    a = balance(spark, sf_dir)
    moved = rows.scatter_rows(elementwise.scalar_multiply(a, -1.0), _index(spark, a.rows, a.rows // 2), a)
    return rounded(moved)


# --- Dense products and decompositions --------------------------------------------------------

_GRAM = f"WITH {EMB} SELECT a.col AS row, b.col, round(sum(a.v * b.v), 6) + 0.0 AS v FROM emb a JOIN emb b ON a.row = b.row GROUP BY ALL"
query("gemm", _GRAM)(lambda spark, sf_dir: (lambda a: rounded(products.gemm(a.transpose(), a)))(embeddings(spark, sf_dir)))
query("gemm_blocks", _GRAM)(lambda spark, sf_dir: (lambda a: rounded(products.block_gemm(a.transpose(), a)))(embeddings(spark, sf_dir)))
query("gram", _GRAM)(lambda spark, sf_dir: rounded(products.gram(embeddings(spark, sf_dir))))
_SAME = f"WITH {EMB} SELECT row, col, round(v, 5) + 0.0 AS v FROM emb"


def r5(m: Matrix) -> DataFrame:
    return m.df.select("row", "col", (F.round("v", 5) + 0.0).alias("v"))


def _scaled_rows(m: Matrix, values: np.ndarray) -> Matrix:
    """diag(values) m, of as many rows as there are values."""
    s = F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("row").cast("int"))
    return Matrix(m.df.where(F.col("row") < len(values)).select("row", "col", (s * F.col("v")).alias("v")), len(values), m.cols)


def _rebuilt(f: dense.Factors) -> Matrix:
    """U diag(s) Vt of the first columns and rows of the factors."""
    k = len(f.values)
    left = f.left if f.left.cols == k else Matrix(f.left.df.where(F.col("col") < k), f.left.rows, k)
    right = f.right if f.right.rows == k else Matrix(f.right.df.where(F.col("row") < k), k, f.right.cols)
    if right.cols <= left.rows:
        return products.gemm(left, _scaled_rows(right, f.values))
    turned = left.transpose()
    return products.gemm(_scaled_rows(turned, f.values).transpose(), right)


def wide(spark: SparkSession, sf_dir: str) -> Matrix:
    """The embeddings as columns."""
    return embeddings(spark, sf_dir).transpose()


def dependent(spark: SparkSession, sf_dir: str) -> Matrix:
    """The embeddings with every odd column equal to the one before it."""
    a = embeddings(spark, sf_dir)
    pairs = F.transform("values", lambda v, i: F.get("values", i - i % 2))
    return Matrix(a.source.select("row", pairs.alias("values")), *a.shape, layout=a.layout)


_SAME_WIDE = f"WITH {EMB} SELECT col AS row, row AS col, round(v, 5) + 0.0 AS v FROM emb"
_SAME_DEPENDENT = f"WITH {EMB} SELECT e.row, e.col, round(o.v, 5) + 0.0 AS v FROM emb e JOIN emb o ON o.row = e.row AND o.col = e.col - e.col % 2"
query("svd_reconstructs", _SAME)(lambda spark, sf_dir: r5(_rebuilt(dense.svd(embeddings(spark, sf_dir), full=False))))
query("svd_tall_reconstructs", _SAME)(lambda spark, sf_dir: r5(_rebuilt(dense.svd(embeddings(spark, sf_dir), driver_elements=0, full=False))))
query("svd_wide_reconstructs", _SAME_WIDE)(lambda spark, sf_dir: r5(_rebuilt(dense.svd(wide(spark, sf_dir), driver_elements=0, full=False))))
query("svd_dependent_reconstructs", _SAME_DEPENDENT)(lambda spark, sf_dir: r5(_rebuilt(dense.svd(dependent(spark, sf_dir), driver_elements=0, full=False))))


def head(spark: SparkSession, sf_dir: str, n: int = 150) -> Matrix:
    """The sums of the embeddings by vec_id modulo n, a row each; their square factors have n x n elements."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % n).alias("row"), F.posexplode("embedding").alias("at", "v"))
    sums = e.groupBy("row", F.col("at").cast("long").alias("col")).agg(F.sum(F.col("v").cast("double")).alias("v"))
    return Matrix(sums, n, 64)


_HEAD = f"WITH {EMB} SELECT row % 150 AS row, col, round(sum(v), 5) + 0.0 AS v FROM emb GROUP BY row % 150, col"
_EYE_HEAD = "SELECT i.range AS row, j.range AS col, CASE WHEN i.range = j.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(150) i, range(150) j"
query("svd_full_reconstructs", _HEAD)(lambda spark, sf_dir: r5(_rebuilt(dense.svd(head(spark, sf_dir), driver_elements=0))))
query("svd_full_orthonormal", _EYE_HEAD)(lambda spark, sf_dir: _orthonormal(dense.svd(head(spark, sf_dir), driver_elements=0).left))
query("qr_full_reconstructs", _HEAD)(lambda spark, sf_dir: r5(products.gemm(*dense.qr(head(spark, sf_dir), driver_elements=0))))
query("qr_full_orthonormal", _EYE_HEAD)(lambda spark, sf_dir: _orthonormal(dense.qr(head(spark, sf_dir), driver_elements=0)[0]))


_EYE = "SELECT i.range AS row, j.range AS col, CASE WHEN i.range = j.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) i, range(64) j"


def _orthonormal(m: Matrix) -> DataFrame:
    return products.gram(m).df.select("row", "col", (F.round("v", 9) + 0.0).alias("v"))


@query("svd_tall_orthonormal", _EYE)
def svd_tall_orthonormal(spark, sf_dir):
    """UᵀU of the thin left factor."""
    return _orthonormal(dense.svd(embeddings(spark, sf_dir), driver_elements=0, full=False).left)


query("svd_dependent_orthonormal", _EYE)(lambda spark, sf_dir: _orthonormal(dense.svd(dependent(spark, sf_dir), driver_elements=0, full=False).left))
query("qr_dependent_orthonormal", _EYE)(lambda spark, sf_dir: _orthonormal(dense.qr(dependent(spark, sf_dir), driver_elements=0, full=False)[0]))


@query("qr_tall_orthonormal", _EYE)
def qr_tall_orthonormal(spark, sf_dir):
    return _orthonormal(dense.qr(embeddings(spark, sf_dir), driver_elements=0, full=False)[0])


@query(
    "svd_tall_values",
    f"WITH {EMB}, g AS (SELECT a.col AS i, b.col AS j, sum(a.v * b.v) AS v FROM emb a JOIN emb b ON a.row = b.row GROUP BY ALL) SELECT CAST(64 AS BIGINT) AS n, true AS falls, round(sum(v) FILTER (WHERE i = j), 4) AS squares, round(sum(v * v) / 1000, 4) AS fourth_powers FROM g",
)
def svd_tall_values(spark, sf_dir):
    """Singular values fall; their squares sum to the trace of AᵀA, their fourth powers to its squared norm."""
    s = dense.svd(embeddings(spark, sf_dir), driver_elements=0, full=False).values
    row = (len(s), bool((np.diff(s) <= 0).all()), float(round((s**2).sum(), 4)), float(round((s**4).sum() / 1000, 4)))
    return spark.createDataFrame([row], "n long, falls boolean, squares double, fourth_powers double")


query("qr_reconstructs", _SAME)(lambda spark, sf_dir: r5(products.gemm(*dense.qr(embeddings(spark, sf_dir), full=False))))
query("qr_tall_reconstructs", _SAME)(lambda spark, sf_dir: r5(products.gemm(*dense.qr(embeddings(spark, sf_dir), driver_elements=0, full=False))))
query("qr_wide_reconstructs", _SAME_WIDE)(lambda spark, sf_dir: r5(products.gemm(*dense.qr(wide(spark, sf_dir), driver_elements=0))))
query("qr_dependent_reconstructs", _SAME_DEPENDENT)(lambda spark, sf_dir: r5(products.gemm(*dense.qr(dependent(spark, sf_dir), driver_elements=0, full=False))))


@query("qr_upper_triangle", "SELECT 'tall' AS kind, true AS upper UNION ALL SELECT 'wide', true UNION ALL SELECT 'dependent', true")
def qr_upper_triangle(spark, sf_dir):
    """Whether no element below the diagonal of R differs from 0."""
    found = None
    for kind, a in (("tall", embeddings), ("wide", wide), ("dependent", dependent)):
        r = dense.qr(a(spark, sf_dir), driver_elements=0, full=False)[1].df
        one = r.agg((F.count_if((F.col("row") > F.col("col")) & (F.col("v") != 0)) == 0).alias("upper")).select(F.lit(kind).alias("kind"), "upper")
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "eigh_ring",
    """WITH ring AS (SELECT count(*) AS n FROM supplier)
       SELECT CAST(row_number() OVER (ORDER BY v DESC) - 1 AS BIGINT) AS idx, round(v, 6) + 0.0::DOUBLE AS v
       FROM (SELECT 2 * cos(2 * pi() * k / n) + 2 * cos(14 * pi() * k / n) AS v FROM ring, LATERAL (SELECT unnest(range(n)) AS k))""",
)
def eigh_ring(spark, sf_dir):
    """Suppliers in a ring, each linked to the next and to the seventh next: all eigenvalues, of which 16 columns at a time reach the driver."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey")
    low, n = own.agg(F.min("s_suppkey"), F.count(F.lit(1))).first()
    row = F.col("s_suppkey") - low
    steps = F.explode(F.array(*map(F.lit, (1, -1, 7, -7)))).alias("step")
    cells = own.select(row.cast("long").alias("row"), steps).select("row", F.pmod(F.col("row") + F.col("step"), F.lit(n)).cast("long").alias("col"))
    a = Matrix(cells.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("v")), n, n, sparse=True)
    found = dense.eigh(a, driver_elements=16 * n)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "idx bigint, v double").select("idx", (r6("v") + 0.0).alias("v"))


@query(
    "eigh_gram",
    f"WITH {EMB}, g AS (SELECT a.col AS i, b.col AS j, sum(a.v * b.v) AS v FROM emb a JOIN emb b ON a.row = b.row GROUP BY ALL) SELECT CAST(64 AS BIGINT) AS n, round(sum(v) FILTER (WHERE i = j), 4) AS trace, round(sum(v * v) / 1000, 4) AS squares FROM g",
)
def eigh_gram(spark, sf_dir):
    """The sum of the eigenvalues of AᵀA is its trace, that of their squares its squared norm."""
    w = dense.eigh(products.gram(embeddings(spark, sf_dir)))
    return spark.range(1).select(F.lit(len(w)).cast("long").alias("n"), F.round(F.lit(float(w.sum())), 4).alias("trace"), F.round(F.lit(float((w * w).sum() / 1000)), 4).alias("squares"))


@query("solve_ridge", "SELECT range AS row, CAST(0 AS BIGINT) AS col, CAST(range % 5 - 2 AS DOUBLE) AS v FROM range(64)")
def solve_ridge(spark, sf_dir):
    """(AᵀA + I) x = (AᵀA + I) x0 for a known x0."""
    g = products.gram(embeddings(spark, sf_dir))
    m = g.with_values(F.col("v") + F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0))
    known = Matrix.zeros(spark, 64, 1).with_values((F.col("row") % 5 - 2).cast("double"))
    return rounded(dense.solve(m, products.gemm(m, known)))


@query(
    "vector_products",
    "SELECT round(sum(value * (event_id % 7)) / count(*), 6) AS inner_product, round(sqrt(sum(value * value) / count(*)), 6) AS norm FROM events",
)
def vector_products(spark, sf_dir):
    """Inner product and norm, by the root of the number of rows."""
    events = table(spark, sf_dir, "events")
    x = events.select(F.col("event_id").alias("row"), F.col("value").cast("double").alias("v"))
    y = events.select(F.col("event_id").alias("row"), (F.col("event_id") % 7).cast("double").alias("v"))
    n = events.count()
    row = (round(reduce.dot(x, y) / n, 6), round(reduce.vector_norm(x) / math.sqrt(n), 6))
    return spark.createDataFrame([row], "inner_product double, norm double")


# --- Iterative solvers ------------------------------------------------------------------------


def coupling(spark: SparkSession, sf_dir: str, normalised: bool) -> Matrix:
    """The Laplacian of the graph that links parts and suppliers of line items, plus the identity; symmetric positive definite."""
    parts, suppliers = _sizes(spark, sf_dir)
    n = parts + suppliers
    links = supplied(spark, sf_dir).select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + parts).alias("b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = materialise(both.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("d")), "degree")
    every = spark.range(n).select(F.col("id").alias("a")).join(degree, "a", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    if normalised:
        far = degree.select(F.col("a").alias("b"), F.col("d").alias("e"))
        cells = both.join(degree, "a").join(far, "b").select(F.col("a").alias("row"), F.col("b").alias("col"), (-1 / F.sqrt(F.col("d") * F.col("e"))).alias("v"))
        own = every.select(F.col("a").alias("row"), F.col("a").alias("col"), F.when(F.col("d") > 0, 2.0).otherwise(1.0).alias("v"))
    else:
        cells = both.select(F.col("a").alias("row"), F.col("b").alias("col"), F.lit(-1.0).alias("v"))
        own = every.select(F.col("a").alias("row"), F.col("a").alias("col"), (F.col("d") + 1).alias("v"))
    return Matrix(materialise(cells.unionByName(own), "coupling"), n, n)


_KNOWN = "SELECT range AS row, CAST(range % 9 - 4 AS DOUBLE) AS v FROM range((SELECT max(l_partkey) + max(l_suppkey) + 2 FROM lineitem))"
_TIGHT = iterative.SolverOptions(200, 1e-11)


def _known(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), (F.col("id") % 9 - 4).cast("double").alias("v"))


def _solved(x: DataFrame) -> DataFrame:
    return x.select("row", r6("v").alias("v"))


@query("cg", _KNOWN)
def cg(spark, sf_dir):
    a = coupling(spark, sf_dir, True)
    return _solved(iterative.cg(a, products.spmv(a, _known(spark, a.rows)), options=_TIGHT)[0])


@query("pcg", _KNOWN)
def pcg(spark, sf_dir):
    a = coupling(spark, sf_dir, False)
    return _solved(iterative.pcg(a, products.spmv(a, _known(spark, a.rows)), options=_TIGHT)[0])


@query("pcg_tables", _KNOWN)
def pcg_tables(spark, sf_dir):
    """Matrix and vectors as tables that are bucketed alike."""
    a = coupling(spark, sf_dir, False)
    return _solved(iterative.pcg(a, products.spmv(a, _known(spark, a.rows)), options=_TIGHT, driver_rows=0)[0])


@query("block_pcg", _KNOWN)
def block_pcg(spark, sf_dir):
    """Preconditioned by the inverses of the diagonal 1 x 1 blocks, given as a table of blocks."""
    a = coupling(spark, sf_dir, False)
    blocks = a.df.where("row = col").select(F.col("row").alias("block"), F.array(1 / F.col("v")).alias("values"))
    return _solved(iterative.block_pcg(a, products.spmv(a, _known(spark, a.rows)), blocks, options=_TIGHT)[0])


@query("block_pcg_of_blocks", "SELECT range AS row, CAST(range % 9 - 4 AS DOUBLE) AS v FROM range(3 * (SELECT max(l_suppkey) + 51 FROM lineitem))")
def block_pcg_of_blocks(spark, sf_dir):
    """The equations of suppliers and groups alone, in blocks of three, preconditioned by the inverses of the diagonal ones."""
    residuals, primaries, parts = block_model(spark, sf_dir)
    eq = leastsquares.NormalEquations.of(residuals, primaries, parts, 3, 2)
    n = 3 * primaries
    own = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(5.0).alias("v"))
    cells = eq.matrix("pp").df.unionByName(own).groupBy("row", "col").agg(F.sum("v").alias("v"))
    a = Matrix(materialise(cells, "blocks"), n, n, sparse=True)
    diagonal = a.df.where("row div 3 = col div 3").groupBy(F.expr("row div 3").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("row") % 3 * 3 + F.col("col") % 3).cast("int"), "v"))).alias("cells"))
    full = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.coalesce(F.col("cells")[i], F.lit(0.0)))
    blocks = small.spd_inverse(diagonal.select("block", full.alias("a")), "a", 3).select("block", F.col("inverse").alias("values"))
    return _solved(iterative.block_pcg(a, products.spmv(a, _known(spark, n)), blocks, options=iterative.SolverOptions(500, 1e-12))[0])


@query("coo_append", "SELECT row, col, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT l_partkey AS row, l_suppkey AS col, l_quantity AS v FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, -1 FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL")
def coo_append(spark, sf_dir):
    """Line items, and behind them a correction for the first of each order."""
    more = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(
        F.monotonically_increasing_id().alias("ord"), F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.lit(-1.0).alias("v")
    )
    return sparse.combine(lines(spark, sf_dir).add(more)).df


@query("pcg_fixed_steps", _KNOWN)
def pcg_fixed_steps(spark, sf_dir):
    a = coupling(spark, sf_dir, True)
    return _solved(iterative.cg_fixed(a, products.spmv(a, _known(spark, a.rows)), 22, preconditioned=True)[0])


@query("solve_coupling", _KNOWN)
def solve_coupling(spark, sf_dir):
    """The system of all parts and suppliers: the parts are eliminated at once, as none shares an element with another, then what suppliers are left with."""
    a = coupling(spark, sf_dir, False)
    a = Matrix(a.df, *a.shape, sparse=True)
    b = products.spmv(a, _known(spark, a.rows)).select("row", F.lit(0).cast("long").alias("col"), "v")
    return _solved(dense.solve(a, Matrix(b, a.rows, 1)).df)


@query("solver_report", "SELECT true AS converged, true AS few_steps, true AS small_residual")
def solver_report(spark, sf_dir):
    a = coupling(spark, sf_dir, True)
    report = iterative.cg(a, products.spmv(a, _known(spark, a.rows)), options=_TIGHT)[1].as_frame(spark)
    return report.select("converged", (F.col("iterations") < 60).alias("few_steps"), (F.col("final_residual_norm") <= F.col("initial_residual_norm") * 1e-11).alias("small_residual"))


# --- Block least squares ----------------------------------------------------------------------


def additive_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Residual rows of v = effect of supplier + effect of part, for known effects, with priors at the suppliers' effects.

    A supplier's effect is its key mod 5, a part's its key mod 7, so the step from zero is known.
    """
    parts, suppliers = _sizes(spark, sf_dir)
    number = lambda c: F.array((c).cast("double"))
    one = F.array(F.lit(1.0))
    links = supplied(spark, sf_dir)
    seen = links.select(
        (F.col("l_partkey") * suppliers + F.col("l_suppkey")).alias("res"), F.array("l_suppkey").alias("primary"), F.col("l_partkey").alias("eliminated"),
        F.array(one).alias("jp"), one.alias("je"), number(-(F.col("l_suppkey") % 5) - F.col("l_partkey") % 7).alias("r"), F.lit(1.0).alias("weight"),
    )
    prior = spark.range(suppliers).select(
        (-F.col("id") - 1).alias("res"), F.array("id").alias("primary"), F.lit(None).cast("long").alias("eliminated"),
        F.array(one).alias("jp"), F.lit(None).cast("array<double>").alias("je"), number(-(F.col("id") % 5)).alias("r"), F.lit(2.0).alias("weight"),
    )
    anchor = spark.range(parts).select(
        (-F.col("id") - 1 - suppliers).alias("res"), F.array().cast("array<bigint>").alias("primary"), F.col("id").alias("eliminated"),
        F.array().cast("array<array<double>>").alias("jp"), one.alias("je"), number(-(F.col("id") % 7)).alias("r"), F.lit(0.5).alias("weight"),
    )
    return seen.unionByName(prior).unionByName(anchor), suppliers, parts


_EFFECTS = """SELECT 'supplier' AS side, range AS row, CAST(range % 5 AS DOUBLE) AS v FROM range((SELECT max(l_suppkey) + 1 FROM lineitem))
UNION ALL SELECT 'part', range, CAST(range % 7 AS DOUBLE) FROM range((SELECT max(l_partkey) + 1 FROM lineitem))"""


def _schur(backend: str):
    def run(spark, sf_dir):
        residuals, suppliers, parts = additive_model(spark, sf_dir)
        eq = leastsquares.NormalEquations.of(residuals, suppliers, parts, 1, 1)
        report, p, e = leastsquares.solve_damped(eq, 0.0, leastsquares.SchurOptions(backend, 100, 1e-12, 1e-12))
        if not report.converged:
            raise RuntimeError(report.message)
        side = lambda df, name: df.select(F.lit(name).alias("side"), "row", r6("v").alias("v"))
        return side(p, "supplier").unionByName(side(e, "part"))

    return run


for _backend in ("implicit", "dense", "assembled"):
    query(f"schur_step_{_backend}", _EFFECTS)(_schur(_backend))


@query(
    "normal_equations",
    """WITH l AS (SELECT DISTINCT l_partkey AS e, l_suppkey AS p FROM lineitem), s AS (SELECT range AS i FROM range((SELECT max(l_suppkey) + 1 FROM lineitem))), t AS (SELECT range AS i FROM range((SELECT max(l_partkey) + 1 FROM lineitem)))
SELECT 'pp' AS part, s.i, s.i AS j, CAST(2 + count(l.e) AS DOUBLE) AS v FROM s LEFT JOIN l ON l.p = s.i GROUP BY s.i
UNION ALL SELECT 'gp', s.i, CAST(0 AS BIGINT), CAST(-2 * (s.i % 5) - count(l.e) * (s.i % 5) - coalesce(sum(l.e % 7), 0) AS DOUBLE) FROM s LEFT JOIN l ON l.p = s.i GROUP BY s.i
UNION ALL SELECT 'ee', t.i, t.i, CAST(0.5 + count(l.p) AS DOUBLE) FROM t LEFT JOIN l ON l.e = t.i GROUP BY t.i
UNION ALL SELECT 'ge', t.i, CAST(0 AS BIGINT), CAST(-0.5 * (t.i % 7) - count(l.p) * (t.i % 7) - coalesce(sum(l.p % 5), 0) AS DOUBLE) FROM t LEFT JOIN l ON l.e = t.i GROUP BY t.i
UNION ALL SELECT 'pe', p, e, 1.0::DOUBLE FROM l""",
)
def normal_equations(spark, sf_dir):
    residuals, suppliers, parts = additive_model(spark, sf_dir)
    even, odd = residuals.where("pmod(res, 2) = 0"), residuals.where("pmod(res, 2) = 1")
    make = lambda df: leastsquares.NormalEquations.of(df, suppliers, parts, 1, 1)
    return make(even).merge(make(odd)).sums.select("part", "i", "j", r6("v").alias("v"))


def block_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Two residuals a line item: blocks of three for its supplier and its order's group, one of two for its part.

    The first line of an order has no part. Numbers are small integers, so sums are exact.
    """
    parts, suppliers = _sizes(spark, sf_dir)
    number = lambda f, m, width: F.transform(F.sequence(F.lit(0), F.lit(m * width - 1)), f)
    res = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    first = F.col("l_linenumber") == 1
    primary = lambda slot: number(lambda at: (F.pmod(F.col("res") + 2 * slot + 5 * at, F.lit(7)) - 3).cast("double"), 2, 3)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", res.cast("long").alias("res")).select(
        "res", F.array(F.col("l_suppkey").cast("long"), (F.pmod("l_orderkey", F.lit(50)) + suppliers).cast("long")).alias("primary"),
        F.when(~first, F.col("l_partkey")).cast("long").alias("eliminated"), F.array(primary(0), primary(1)).alias("jp"),
        F.when(~first, number(lambda at: (F.pmod(2 * F.col("res") + 3 * at, F.lit(5)) - 2).cast("double"), 2, 2)).alias("je"),
        number(lambda at: (F.pmod("res", F.lit(11)) - 5 + at).cast("double"), 2, 1).alias("r"), (1 + F.pmod("res", F.lit(3))).cast("double").alias("weight"),
    )
    return rows, suppliers + 50, parts


_BLOCKS = """WITH n AS (SELECT max(l_suppkey) + 1 AS suppliers FROM lineitem),
l AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey * 8 + l_linenumber AS res, l_suppkey, l_orderkey % 50 + n.suppliers AS grp, CASE WHEN l_linenumber <> 1 THEN l_partkey END AS e, (l_orderkey * 8 + l_linenumber) % 3 + 1 AS w FROM lineitem, n),
k AS (SELECT CAST(range AS BIGINT) AS m FROM range(2)), c3 AS (SELECT range AS c FROM range(3)), c2 AS (SELECT range AS c FROM range(2)),
p AS (SELECT id, w, CASE s WHEN 0 THEN l_suppkey ELSE grp END AS b, m, c, (res + 2 * s + 5 * (m * 3 + c)) % 7 - 3 AS v FROM l, k, c3, (SELECT range AS s FROM range(2))),
q AS (SELECT id, w, e AS b, m, c, (2 * res + 3 * (m * 2 + c)) % 5 - 2 AS v FROM l, k, c2 WHERE e IS NOT NULL),
g AS (SELECT id, m, res % 11 - 5 + m AS v FROM l, k),
sums AS (
SELECT 'pp' AS part, a.b AS i, b.b AS j, a.c * 3 + b.c AS place, sum(a.w * a.v * b.v) AS v FROM p a JOIN p b ON a.id = b.id AND a.m = b.m GROUP BY ALL
UNION ALL SELECT 'pe', a.b, b.b, a.c * 2 + b.c, sum(a.w * a.v * b.v) FROM p a JOIN q b ON a.id = b.id AND a.m = b.m GROUP BY ALL
UNION ALL SELECT 'ee', a.b, b.b, a.c * 2 + b.c, sum(a.w * a.v * b.v) FROM q a JOIN q b ON a.id = b.id AND a.m = b.m GROUP BY ALL
UNION ALL SELECT 'gp', a.b, 0, a.c, sum(a.w * a.v * g.v) FROM p a JOIN g ON a.id = g.id AND a.m = g.m GROUP BY ALL
UNION ALL SELECT 'ge', a.b, 0, a.c, sum(a.w * a.v * g.v) FROM q a JOIN g ON a.id = g.id AND a.m = g.m GROUP BY ALL)
SELECT part, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(place AS INTEGER) AS place, CAST(v AS DOUBLE) + 0.0 AS v FROM sums"""


@query("normal_equations_blocks", _BLOCKS)
def normal_equations_blocks(spark, sf_dir):
    """Blocks of 3 and 2 numbers, two primaries in each row, rows without an eliminated block."""
    residuals, primaries, parts = block_model(spark, sf_dir)
    eq = leastsquares.NormalEquations.of(residuals, primaries, parts, 3, 2)
    return eq.sums.select("part", "i", "j", F.col("at").alias("place"), (F.col("v") + F.lit(0.0)).alias("v"))


def _damped_step(backend: str):
    """(H + damping) x = -g has the known solution x once g is made from x."""

    def run(spark, sf_dir):
        residuals, primaries, parts = block_model(spark, sf_dir)
        eq = leastsquares.NormalEquations.of(residuals, primaries, parts, 3, 2)
        sums = materialise(eq.sums, "equations").where("part not in ('gp', 'ge')")
        eq = leastsquares.NormalEquations(sums, primaries, parts, 3, 2)
        known = lambda n, m: spark.range(n).select(F.col("id").alias("row"), (F.col("id") % m - 2).cast("double").alias("v"))
        p, e = known(3 * primaries, 5), known(2 * parts, 4)
        damped = {}
        for part in ("pp", "ee"):  # diagonal elements grow by half, those below 1e-3 by 5e-4
            cells, n = eq.matrix(part).df, eq.matrix(part).rows
            own = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(0.0).alias("v"))
            cells = cells.unionByName(own).groupBy("row", "col").agg(F.sum("v").alias("v"))
            grown = F.when(F.col("row") == F.col("col"), F.col("v") + 0.5 * F.greatest("v", F.lit(1e-3))).otherwise(F.col("v"))
            damped[part] = Matrix(cells.select("row", "col", grown.alias("v")), n, n)
        cross = eq.matrix("pe")
        zero = F.lit(0).cast("long").alias("j")
        for name, size, terms in (
            ("gp", 3, [products.spmv(damped["pp"], p), products.spmv(cross, e)]),
            ("ge", 2, [products.spmv(cross.transpose(), p), products.spmv(damped["ee"], e)]),
        ):
            g = terms[0].unionByName(terms[1]).groupBy("row").agg((-F.sum("v")).alias("v"))
            i = F.floor(F.col("row") / size).alias("i")
            sums = sums.unionByName(g.select(F.lit(name).alias("part"), i, zero, (F.col("row") % size).cast("int").alias("at"), "v"))
        eq = leastsquares.NormalEquations(sums, primaries, parts, 3, 2)
        report, dp, de = leastsquares.solve_damped(eq, 0.5, leastsquares.SchurOptions(backend, 300, 1e-13, 1e-13, 1e-3))
        if not report.converged:
            raise RuntimeError(report.message)
        side = lambda df, name: df.select(F.lit(name).alias("side"), "row", (F.round("v", 4) + F.lit(0.0)).alias("v"))
        return side(dp, "primary").unionByName(side(de, "eliminated"))

    return run


_KNOWN_STEP = """SELECT 'primary' AS side, range AS row, CAST(range % 5 - 2 AS DOUBLE) AS v FROM range(3 * (SELECT max(l_suppkey) + 51 FROM lineitem))
UNION ALL SELECT 'eliminated', range, CAST(range % 4 - 2 AS DOUBLE) FROM range(2 * (SELECT max(l_partkey) + 1 FROM lineitem))"""

for _backend in ("implicit", "dense", "assembled"):
    query(f"damped_step_blocks_{_backend}", _KNOWN_STEP)(_damped_step(_backend))


@query("lm_fit", _EFFECTS)
def lm_fit(spark, sf_dir):
    """Damped steps from zero until the step is small; the model is linear, so each is accepted."""
    residuals, suppliers, parts = additive_model(spark, sf_dir)
    control = leastsquares.DampingControl(initial=1e-9, decrease=0.1)
    eq = leastsquares.NormalEquations.of(residuals, suppliers, parts, 1, 1)
    eq = leastsquares.NormalEquations(materialise(eq.table, "equations"), suppliers, parts, 1, 1)
    xp, xe = np.zeros(suppliers), np.zeros(parts)
    ps, es = iterative.DriverVectors(spark, suppliers), iterative.DriverVectors(spark, parts)
    pp, pe, ee = eq.matrix("pp"), eq.matrix("pe"), eq.matrix("ee")
    gp, ge = ps.load(eq.gradient("gp")), es.load(eq.gradient("ge"))
    for _ in range(5):
        # the gradient at x of a linear model is g + H x
        now_p = gp + ps.apply(pp, xp) + ps.load(products.spmv(pe, es.frame(xe)))
        now_e = ge + es.apply(ee, xe) + es.load(products.spmv(pe.transpose(), ps.frame(xp)))
        blocks = eq.table.where("part not in ('gp', 'ge')")  # stay whole, so that they are not put together for each step
        for part, space, g in (("gp", ps, now_p), ("ge", es, now_e)):
            zero = F.lit(0).cast("long")
            blocks = blocks.unionByName(space.frame(g).select(F.lit(part).alias("part"), F.col("row").alias("i"), zero.alias("j"), F.array("v").alias("values")))
        at = leastsquares.NormalEquations(blocks, suppliers, parts, 1, 1)
        report, dp, de = leastsquares.solve_damped(at, control.damping, leastsquares.SchurOptions("dense", 100, 1e-12, 1e-12))
        if not report.converged:
            raise RuntimeError(report.message)
        dp, de = ps.load(dp), es.load(de)
        xp, xe = xp + dp, xe + de
        control.accept()
        if max(np.abs(dp).max(), np.abs(de).max()) < 1e-9:
            break
    side = lambda df, name: df.select(F.lit(name).alias("side"), "row", r6("v").alias("v"))
    return side(ps.frame(xp), "supplier").unionByName(side(es.frame(xe), "part"))
