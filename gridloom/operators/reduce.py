"""Reductions over all elements, rows or columns, with defined results for NaN, ties, empty lanes and absent elements."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..matrix import BROADCAST_ROWS, BY_ROWS, CELLS, Matrix
from ..scratch import materialise

ALL, ROWS, COLUMNS = "all", "rows", "columns"
#: Elements that strict_mean() folds at once.
CHUNK = 4096
#: Offsets that are numbered in one task where the first absent element is looked for.
BUCKET = 100_000


def _laid_out(a: Matrix, axis: str) -> tuple[DataFrame, int, int]:
    """(lane, at, v) of the stored elements, the number of lanes and the length of each; `at` is the offset in the lane."""
    row, col = F.col("row"), F.col("col")
    if axis == ALL:
        return a.df.select(F.lit(0).cast("long").alias("lane"), (row + col * a.rows).alias("at"), "v"), 1, a.size
    if axis == ROWS:
        return a.df.select(row.alias("lane"), col.alias("at"), "v"), a.rows, a.cols
    if axis == COLUMNS:
        return a.df.select(col.alias("lane"), row.alias("at"), "v"), a.cols, a.rows
    raise ValueError(f"unknown axis {axis!r}")


def _not_empty(lanes: int, length: int) -> None:
    if lanes and not length:
        raise ValueError("a lane without elements has a sum only")


def _by_lane(a: Matrix, axis: str) -> DataFrame | None:
    """(lane, values) if each lane is one row of the source, so that nothing needs a shuffle."""
    if a.layout == CELLS or axis == ALL or (axis == ROWS) != (a.layout == BY_ROWS):
        return None
    values = F.transform("values", a.element) if a.element else F.col("values")
    return a.source.select(F.col("row").alias("lane"), values.alias("values"))


def _every_lane(a: Matrix, found: DataFrame, lanes: int) -> DataFrame:
    """found, with a row for the lanes of a sparse matrix that store nothing."""
    if not a.sparse:
        return found
    return a.spark.range(lanes).select(F.col("id").alias("lane")).join(found, "lane", "left")


def total(a: Matrix, axis: str = ALL) -> DataFrame:
    """(lane, v): sums in double; a lane without elements sums to 0."""
    cells, lanes, length = _laid_out(a, axis)
    if not length:
        return a.spark.range(lanes).select(F.col("id").alias("lane"), F.lit(0.0).alias("v"))
    if (arrays := _by_lane(a, axis)) is not None:
        return arrays.select("lane", F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("v"))
    sums = cells.groupBy("lane").agg(F.sum(F.col("v").cast("double")).alias("v"))
    return _every_lane(a, sums, lanes).select("lane", F.coalesce("v", F.lit(0.0)).alias("v"))


def mean(a: Matrix, axis: str = ALL) -> DataFrame:
    """(lane, v): plain averages, for data whose sums neither overflow nor cancel; see strict_mean()."""
    _, lanes, length = _laid_out(a, axis)
    _not_empty(lanes, length)
    return total(a, axis).select("lane", (F.col("v") / max(length, 1)).alias("v"))


def strict_mean(a: Matrix, axis: str = ALL) -> DataFrame:
    """(lane, v): means that never overflow for finite elements and lose nothing to cancellation.

    Elements are scaled by a power of two near the lane's largest, folded with compensation in
    chunks of CHUNK offsets, and the chunks' sums are folded again. NaN gives NaN, as infinities
    of both signs do; one infinity is the mean.
    """
    cells, lanes, length = _laid_out(a, axis)
    _not_empty(lanes, length)
    v = F.col("v").cast("double")
    facts = cells.groupBy("lane").agg(
        F.bool_or(F.isnan(v)).alias("nan"),
        F.bool_or(v == C.INF).alias("up"),
        F.bool_or(v == -C.INF).alias("down"),
        F.max(F.when(C.finite(v), F.abs(v))).alias("top"),
    )
    power = F.when(F.col("top") > 0, F.pow(F.lit(2.0), F.greatest(F.least(F.ceil(F.log2("top")), F.lit(1023)), F.lit(-1000)))).otherwise(F.lit(1.0))
    facts = _every_lane(a, facts, lanes).withColumn("scale", power).withColumn("n", F.lit(float(length)))
    scaled = cells.join(facts.select("lane", "scale"), "lane").where(C.finite(v)).withColumn("x", v / F.col("scale"))
    level, size = scaled.select("lane", "at", "x"), length
    while True:  # each level folds CHUNK numbers into two, a sum and what it lost
        chunk = F.floor(F.col("at") / CHUNK).alias("chunk")
        sums = level.groupBy("lane", chunk).agg(C.compensated_sum(F.col("at"), F.col("x")).alias("f"))
        if size <= CHUNK:
            break
        pair = F.array(F.struct((2 * F.col("chunk")).alias("at"), F.col("f.s").alias("x")), F.struct((2 * F.col("chunk") + 1).alias("at"), F.col("f.c").alias("x")))
        level, size = sums.select("lane", F.inline(pair)), 2 * (-(-size // CHUNK))
    folded = F.col("f.s") + F.col("f.c")
    whole = folded * F.col("scale")  # overflows only where the sum does
    ordinary = F.when(C.finite(whole), whole / F.col("n")).otherwise(folded / F.col("n") * F.col("scale"))
    special = F.when(F.col("nan") | (F.col("up") & F.col("down")), C.NAN).when(F.col("up"), C.INF).when(F.col("down"), -C.INF)
    return facts.join(sums.select("lane", "f"), "lane", "left").select("lane", F.coalesce(special, ordinary, F.when(F.col("top").isNull(), F.lit(0.0))).alias("v"))


def smallest(v: Column) -> Column:
    """Aggregate: the minimum, NaN if there is any."""
    return F.when(F.bool_or(F.isnan(v)), F.lit(C.NAN)).otherwise(F.min(v))


def index_of(v: Column, at: Column, largest: bool) -> Column:
    """Aggregate: the lowest offset of a NaN, else of the extreme value."""
    first_nan = F.min(F.when(F.isnan(v), at))
    if largest:
        return F.coalesce(first_nan, -F.max(F.struct(v.alias("v"), (-at).alias("i")))["i"])
    return F.coalesce(first_nan, F.min(F.struct(v.alias("v"), at.alias("i")))["i"])


def _first_absent(cells: DataFrame, length: int) -> DataFrame:
    """(lane, free): the first offset that a lane with stored elements lacks, if it lacks any.

    Offsets are numbered within buckets, and buckets within lanes: as long as offset and number
    agree, none is absent.
    """
    rank = F.row_number().over(Window.partitionBy("lane", "bucket").orderBy("at")) - 1 + F.col("bucket") * BUCKET
    held = cells.select("lane", "at", F.floor(F.col("at") / BUCKET).alias("bucket")).withColumn("filled", F.col("at") == rank)
    buckets = held.groupBy("lane", "bucket").agg(F.count_if("filled").alias("filled"))
    place = F.row_number().over(Window.partitionBy("lane").orderBy("bucket")) - 1
    end = F.least((F.col("bucket") + 1) * BUCKET, F.lit(length))
    free = F.col("bucket") * BUCKET + F.col("filled")
    found = buckets.withColumn("there", F.col("bucket") == place).groupBy("lane").agg(
        F.min(F.when(free < end, free)).alias("inside"), (F.count_if("there") * BUCKET).alias("behind")
    )
    behind = F.when(F.col("behind") < length, F.col("behind"))
    return found.select("lane", F.least("inside", behind).alias("free"))


def _extreme(a: Matrix, axis: str, largest: bool, with_index: bool) -> DataFrame:
    cells, lanes, length = _laid_out(a, axis)
    _not_empty(lanes, length)
    v = F.col("v")
    if (arrays := _by_lane(a, axis)) is not None:
        values = F.col("values")
        odd = F.exists(values, F.isnan)
        top = F.array_max(values) if largest else F.when(odd, F.lit(C.NAN)).otherwise(F.array_min(values))
        found = arrays.select("lane", top.alias("v"), "values")
        if not with_index:
            return found.drop("values")
        return found.select("lane", "v", (F.array_position("values", F.col("v")) - 1).alias("idx"))
    found = [(F.max(v) if largest else smallest(v)).alias("v")]  # Spark orders NaN last, so its max is NaN already
    if with_index:
        found.append(index_of(v, F.col("at"), largest).alias("idx"))
    if not a.sparse:
        return cells.groupBy("lane").agg(*found)
    stored = _every_lane(a, cells.groupBy("lane").agg(*found, F.count(F.lit(1)).alias("n")), lanes).withColumn("n", F.coalesce("n", F.lit(0)))
    zero = F.lit(0.0)
    lacks = F.col("n") < length
    beaten = F.coalesce(~F.isnan(v) & ((v < zero) if largest else (v > zero)), F.lit(True))  # by an absent element
    value = F.when(lacks & beaten, zero).otherwise(v)
    if not with_index:
        return stored.select("lane", value.alias("v"))
    free = stored.join(_first_absent(cells, length), "lane", "left").withColumn("free", F.coalesce("free", F.when(F.col("n") == 0, F.lit(0).cast("long"))))
    at = F.when(lacks & beaten, F.col("free")).when(lacks & (v == zero), F.least("idx", "free")).otherwise(F.col("idx"))
    return free.select("lane", value.alias("v"), at.alias("idx"))


def minimum(a: Matrix, axis: str = ALL) -> DataFrame:
    return _extreme(a, axis, False, False)


def maximum(a: Matrix, axis: str = ALL) -> DataFrame:
    return _extreme(a, axis, True, False)


def arg_min(a: Matrix, axis: str = ALL) -> DataFrame:
    """(lane, v, idx): offset in the lane, column-major over all elements; the first NaN wins, then the lowest offset."""
    return _extreme(a, axis, False, True)


def arg_max(a: Matrix, axis: str = ALL) -> DataFrame:
    return _extreme(a, axis, True, True)


def dot(x: DataFrame, y: DataFrame) -> float:
    """The inner product of two vectors (row, v); absent rows count as 0."""
    pairs = x.select("row", "v").join(y.select("row", F.col("v").alias("w")), "row")
    return float(pairs.agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0)


def vector_norm(x: DataFrame) -> float:
    return float(x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0)


def finite_median(v: Column) -> Column:
    """Aggregate: the median of the finite values; null if there are none. Values far apart do not overflow."""
    kept = F.when(C.finite(v), v)
    return F.percentile(kept / 2, F.lit(0.5)) * 2


def finite_medians(df: DataFrame, v: Column, by: list[str], most: int = 100_000) -> DataFrame:
    """(*by, v): the median of the finite values of each group, null if there are none; exact, in bounded memory at any size.

    As long as a group has more than `most` candidates for its middle, approximate quantiles on
    either side of it narrow them down, and the values left out are counted; no sorted list or
    table of a group's values is ever held. Of the last candidates equal ones are counted and a
    window over those finds the middle. Values stay where they are: what is known of groups is sent
    to them, up to BROADCAST_ROWS groups, so that no task gets the values of a whole group.
    """
    names = [f"k{i}" for i in range(len(by))]
    groups = df.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)]).agg(F.count(F.when(C.finite(v), 1)).alias("n"))
    groups = materialise(groups.withColumns({"low": F.lit(-C.INF), "high": F.lit(C.INF), "below": F.lit(0).cast("long"), "left": F.col("n")}), "medians")
    values = df.select(*[F.col(b).alias(n) for b, n in zip(by, names)], v.cast("double").alias("x")).where(C.finite(F.col("x")))
    inside = F.col("x").between(F.col("low"), F.col("high"))
    near = F.broadcast if groups.count() <= BROADCAST_ROWS else lambda known: known
    while groups.where((F.col("left") > most) & (F.col("low") < F.col("high"))).limit(1).count():
        g = groups.where((F.col("left") > most) & (F.col("low") < F.col("high"))).withColumnsRenamed({n: f"g{n}" for n in names})
        both = values.join(near(g), reduce_and([F.col(n).eqNullSafe(F.col(f"g{n}")) for n in names])).where(inside)
        # how far the middle is into the candidates, and a margin of twice the error on either side
        middle = (F.first("n") / 2 - F.first("below")) / F.first("left")
        cuts = both.groupBy(*names).agg(F.percentile_approx("x", [i / 64 for i in range(65)], 10_000).alias("cuts"), middle.alias("middle"))
        at = F.floor(F.col("middle") * 64)
        cut = lambda i: F.get("cuts", F.greatest(F.least(i, F.lit(64)), F.lit(0)).cast("int"))
        cuts = cuts.select(*[F.col(n).alias(f"c{n}") for n in names], cut(at - 1).alias("from"), cut(at + 2).alias("to"))
        cut_ = both.join(near(cuts), reduce_and([F.col(n).eqNullSafe(F.col(f"c{n}")) for n in names]))
        counts = cut_.groupBy(*names).agg(
            F.first("from").alias("from"), F.first("to").alias("to"), F.count_if(F.col("x") < F.col("from")).alias("under"), F.count_if(F.col("x") <= F.col("to")).alias("upto")
        ).withColumnsRenamed({n: f"c{n}" for n in names})
        next_ = groups.join(near(counts), reduce_and([F.col(n).eqNullSafe(F.col(f"c{n}")) for n in names]), "left")
        # a bound that the middle is beyond, though quantiles are near enough not to give one, is not taken
        low_ok = F.coalesce(F.col("below") + F.col("under") <= F.floor((F.col("n") - 1) / 2), F.lit(False))
        high_ok = F.coalesce(F.col("below") + F.col("upto") > F.floor(F.col("n") / 2), F.lit(False))
        under, upto = F.when(low_ok, F.col("under")).otherwise(0), F.when(high_ok, F.col("upto")).otherwise(F.col("left"))
        smaller = next_.select(
            *names, "n", F.when(low_ok, F.col("from")).otherwise(F.col("low")).alias("low"), F.when(high_ok, F.col("to")).otherwise(F.col("high")).alias("high"),
            (F.col("below") + under).alias("below"), (upto - under).alias("left"),
        )
        before = groups.agg(F.sum("left")).first()[0]
        groups = materialise(smaller, "medians")
        if groups.agg(F.sum("left")).first()[0] == before:  # few values, each many times: counting them is all that is left
            break
    g = groups.withColumnsRenamed({n: f"g{n}" for n in names})
    both = values.join(near(g), reduce_and([F.col(n).eqNullSafe(F.col(f"g{n}")) for n in names])).where(inside)
    counted = both.groupBy(*names, "n", "below", "x").agg(F.count(F.lit(1)).alias("times"))
    upto = F.col("below") + F.sum("times").over(Window.partitionBy(*names).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto)
    one, two = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    found = ranked.groupBy(*names).agg(F.min(F.when(F.col("upto") > one, F.col("x"))).alias("a"), F.min(F.when(F.col("upto") > two, F.col("x"))).alias("b"))
    found = found.select(*[F.col(n).alias(f"f{n}") for n in names], (F.col("a") / 2 + F.col("b") / 2).alias("v"))
    made = groups.join(near(found), reduce_and([F.col(n).eqNullSafe(F.col(f"f{n}")) for n in names]), "left")
    return made.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "v")


def reduce_and(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def covariance(points: DataFrame, x: str = "x", y: str = "y", z: str = "z", by: list[str] | None = None) -> DataFrame:
    """Population covariance of 3-D points, as n, cxx, cxy, cxz, cyy, cyz, czz, for each group of `by`.

    One aggregation, partial before the shuffle. Groups of fewer than two points have null.
    """
    pairs = {"cxx": (x, x), "cxy": (x, y), "cxz": (x, z), "cyy": (y, y), "cyz": (y, z), "czz": (z, z)}
    enough = F.count(F.lit(1)) >= 2
    found = [F.when(enough, F.covar_pop(a, b)).alias(name) for name, (a, b) in pairs.items()]
    return points.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *found)


def covariance_matrix(points: Matrix) -> Matrix:
    """3 x 3 population covariance of an N x 3 matrix of points, N at least 2."""
    if points.rows < 2:
        raise ValueError("a covariance needs two points at least")
    if points.cols != 3:
        raise ValueError("points have three columns")
    wide = points.row_arrays().select(*[F.get("values", F.lit(i)).alias(n) for i, n in enumerate("xyz")])
    c = covariance(wide).first()
    return Matrix.of(points.spark, [[c["cxx"], c["cxy"], c["cxz"]], [c["cxy"], c["cyy"], c["cyz"]], [c["cxz"], c["cyz"], c["czz"]]])
