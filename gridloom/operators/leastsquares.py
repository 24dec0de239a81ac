"""Block least squares: normal equations from residual rows, damped Schur complements, damping control."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..matrix import DRIVER_ELEMENTS, TASK_ROWS, Matrix, dealt
from ..scratch import materialise
from . import small
from .definite import solve_definite
from .dense import Singular, solve
from .iterative import Breakdown, DriverVectors, SolverOptions, conjugate_gradients, vectors_for

RESIDUALS = (
    "res bigint, primary array<bigint>, eliminated bigint, jp array<array<double>>, je array<double>, r array<double>, weight double"
)


#: Numbers of products that a task holds at once, about, and of their sums.
PIECE, HOLD = 1 << 20, 1 << 23


def _blocks_batch(columns: dict[str, np.ndarray], values: np.ndarray) -> pa.RecordBatch:
    """Columns of whole numbers, and an array of numbers for each row."""
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), lists], [*columns, "values"])


def _residual_products(residuals: DataFrame, dp: int, de: int) -> DataFrame:
    """(part, i, j, values): the products of each residual row's own Jacobians; part counts the names of _sizes().

    Rows of a batch that are alike in size are multiplied together, PIECE numbers at a time.
    """

    def products(primary, eliminated, jp, je, r, w):
        """Of rows with equally many primaries and residuals: jp (row, primary, m, dp), je (row, m, de) or None."""
        n, many = primary.shape
        zero = np.zeros(n, np.int64)
        if many:
            weighed = jp * w[:, None, None, None]
            left = weighed.transpose(0, 1, 3, 2)
            pp = left[:, :, None] @ jp[:, None]
            yield 0, np.repeat(primary, many), np.tile(primary, many).ravel(), pp.reshape(-1, dp * dp)
            yield 3, primary.ravel(), np.repeat(zero, many), (left @ r[:, None, :, None]).reshape(-1, dp)
        if je is not None:
            own = (je * w[:, None, None]).transpose(0, 2, 1)
            if many:
                yield 1, primary.ravel(), np.repeat(eliminated, many), (left @ je[:, None]).reshape(-1, dp * de)
            yield 2, eliminated, eliminated, (own @ je).reshape(-1, de * de)
            yield 4, eliminated, zero, (own @ r[:, :, None]).reshape(-1, de)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = {c: batch.column(c) for c in ("primary", "r")}
            many, m = (pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists.values())
            has = batch.column("eliminated").is_valid().to_numpy(zero_copy_only=False)
            kinds, of = np.unique(np.stack([many, m, has], 1), axis=0, return_inverse=True)
            for kind, (p, size, e) in enumerate(kinds.tolist()):
                rows = np.flatnonzero(of.ravel() == kind)
                for at in np.array_split(rows, -(-len(rows) * max(p * p, 1) * max(dp, de) ** 2 // PIECE)):
                    some = batch.take(pa.array(at))
                    flat = lambda c, *shape: some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(at), *shape)  # noqa: B023, E731
                    primary = flat("primary", p) if p else np.zeros((len(at), 0), np.int64)
                    jp = some.column("jp").flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(at), p, size, dp) if p else None
                    je = flat("je", size, de) if e else None
                    eliminated = some.column("eliminated").to_numpy(zero_copy_only=False) if e else None
                    w = pc.fill_null(some.column("weight"), 1.0).to_numpy(zero_copy_only=False)
                    for part, i, j, values in products(primary, eliminated, jp, je, flat("r", size), w):
                        yield _blocks_batch({"part": np.full(len(i), part, np.int32), "i": i, "j": j}, values)

    return residuals.select("primary", "eliminated", "jp", "je", "r", "weight").mapInArrow(run, "part int, i long, j long, values array<double>")


@dataclass(frozen=True)
class NormalEquations:
    """Sums by block: part is pp, pe, ee (blocks i, j, row-major) or gp, ge (gradients of i).

    `table` holds whole blocks (part, i, j, values) or their numbers (part, i, j, at, v); `most`, if
    known, is the most blocks it has, by which merge() deals them out.
    """

    table: DataFrame
    primaries: int
    eliminated: int
    primary_size: int
    eliminated_size: int
    most: int = 0

    @staticmethod
    def of(residuals: DataFrame, primaries: int, eliminated: int, primary_size: int, eliminated_size: int, check: bool = True) -> NormalEquations:
        """From rows of RESIDUALS: each has primary blocks, an eliminated block, or both; one row is one residual block.

        Every row gives the products of its own Jacobians; they are summed by block, partially
        before the shuffle as long as they are few enough for the session's tasks, else in as many
        tasks as keep each small. Rows are checked, and products counted, first, in one aggregate.
        """
        dp, de = primary_size, eliminated_size
        if min(primaries, eliminated) < 0 or min(dp, de) < 1:
            raise ValueError("block counts must not be negative and block sizes must be positive")
        most = check_residuals(residuals, primaries, eliminated, dp, de) if check else 0
        # whole blocks are summed, place by place, so that a residual gives one row for each of its blocks
        parts = F.array(*map(F.lit, _sizes(dp, de)))
        blocks = _residual_products(residuals, dp, de).withColumn("part", F.get(parts, F.col("part")))
        blocks = _summed(dealt(blocks, most, "part", "i", "j"), ["part", "i", "j"], max(dp, de) ** 2)
        size = F.coalesce(*[F.when(F.col("part") == name, n) for name, n in _sizes(dp, de).items()])
        return NormalEquations(blocks.select("part", "i", "j", F.slice("values", 1, size).alias("values")), primaries, eliminated, dp, de, most)

    @property
    def sums(self) -> DataFrame:
        """(part, i, j, at, v)."""
        if "v" in self.table.columns:
            return self.table
        return self.table.select("part", "i", "j", F.posexplode("values").alias("at", "v"))

    def blocks(self, part: str) -> DataFrame:
        """(i, j, values) of one part."""
        found = self.table.where(F.col("part") == part)
        if "v" not in self.table.columns:
            return found.select("i", "j", "values")
        size = _sizes(self.primary_size, self.eliminated_size)[part]
        cells = found.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("int"), "v"))).alias("cells"))
        values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda at: F.coalesce(F.col("cells")[at], F.lit(0.0)))
        return cells.select("i", "j", values.alias("values"))

    def by_blocks(self) -> DataFrame:
        """(part, i, j, values) of whole blocks."""
        if "v" not in self.table.columns:
            return self.table
        sizes = _sizes(self.primary_size, self.eliminated_size)
        cells = self.table.groupBy("part", "i", "j").agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("int"), "v"))).alias("cells"))
        size = F.coalesce(*[F.when(F.col("part") == name, F.lit(n)) for name, n in sizes.items()])
        values = F.transform(F.sequence(F.lit(0), size - 1), lambda at: F.coalesce(F.col("cells")[at], F.lit(0.0)))
        return cells.select("part", "i", "j", values.alias("values"))

    def merge(self, other: NormalEquations) -> NormalEquations:
        """The sums of both sets of residuals; the layouts must agree."""
        mine = (self.primaries, self.eliminated, self.primary_size, self.eliminated_size)
        if mine != (other.primaries, other.eliminated, other.primary_size, other.eliminated_size):
            raise ValueError("the layouts differ")
        most = self.most + other.most
        if "v" in self.table.columns or "v" in other.table.columns:
            both = dealt(self.sums.unionByName(other.sums), most, "part", "i", "j")
            return NormalEquations(both.groupBy("part", "i", "j", "at").agg(F.sum("v").alias("v")), *mine, most)
        widest = max(self.primary_size, self.eliminated_size) ** 2
        both = _summed(dealt(self.table.unionByName(other.table), most, "part", "i", "j"), ["part", "i", "j"], widest)
        return NormalEquations(both.select("part", "i", "j", F.filter("values", F.isnotnull).alias("values")), *mine, most)

    def matrix(self, part: str) -> Matrix:
        """pp, pe or ee in scalar coordinates."""
        width = self.primary_size if part == "pp" else self.eliminated_size
        height = self.eliminated_size if part == "ee" else self.primary_size
        at = F.col("at")
        cells = self.sums.where(F.col("part") == part)
        row = F.col("i") * height + F.floor(at / width)
        sizes = {"p": self.primaries * self.primary_size, "e": self.eliminated * self.eliminated_size}
        return Matrix(cells.select(row.alias("row"), (F.col("j") * width + at % width).alias("col"), "v"), sizes[part[0]], sizes[part[1]])

    def gradient(self, part: str) -> DataFrame:
        width = self.primary_size if part == "gp" else self.eliminated_size
        return self.sums.where(F.col("part") == part).select((F.col("i") * width + F.col("at")).alias("row"), "v")


def _sizes(dp: int, de: int) -> dict[str, int]:
    return {"pp": dp * dp, "pe": dp * de, "ee": de * de, "gp": dp, "ge": de}


def _summed(blocks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Blocks summed place by place; places that no block has are null."""
    return blocks.groupBy(*keys).agg(F.array(*[F.sum(F.get("values", F.lit(k))) for k in range(width)]).alias("values"))


def check_residuals(residuals: DataFrame, primaries: int, eliminated: int, dp: int, de: int) -> int:
    """How many products the rows have; the first bad row raises IndexError for a block that is not there, ValueError for all else. One aggregate."""
    m = F.size("r")
    ps = F.coalesce("primary", F.array().cast("array<bigint>"))
    odd = lambda values: F.exists(values, lambda v: ~C.finite(v) | v.isNull())
    w = F.coalesce("weight", F.lit(1.0))
    outside = F.exists(ps, lambda i: (i < 0) | (i >= primaries)) | F.coalesce((F.col("eliminated") < 0) | (F.col("eliminated") >= eliminated), F.lit(False))
    wrong = (
        F.coalesce(m < 1, F.lit(True))
        | ((F.size(ps) == 0) & F.col("eliminated").isNull())
        | (F.size(F.array_distinct(ps)) != F.size(ps))
        | (F.size(ps) != F.coalesce(F.size("jp"), F.lit(0)))
        | F.exists(F.coalesce("jp", F.array().cast("array<array<double>>")), lambda j: (F.size(j) != m * dp) | odd(j))
        | F.when(F.col("eliminated").isNotNull(), F.coalesce((F.size("je") != m * de) | odd(F.col("je")), F.lit(True))).otherwise(False)
        | odd(F.col("r"))
        | ~(C.finite(w) & (w >= 0))
    )
    many = F.size(ps).cast("long")
    terms = many * (many + F.when(F.col("eliminated").isNull(), 1).otherwise(2)) + F.when(F.col("eliminated").isNull(), 0).otherwise(2)
    found = residuals.agg(
        F.min(F.when(outside, F.col("res"))).alias("outside"), F.min(F.when(wrong, F.col("res"))).alias("wrong"), F.sum(terms).alias("terms")
    ).first()
    if found["outside"] is not None:
        raise IndexError(f"residual {found['outside']} names a block that is not there")
    if found["wrong"] is not None:
        raise ValueError(f"residual {found['wrong']} does not fit the layout or is not finite")
    return found["terms"] or 0


@dataclass(frozen=True)
class SchurOptions:
    """backend: `implicit` (products only), `dense` (assembled, Cholesky at the driver or elimination in panels) or `assembled` (assembled, block-Jacobi)."""

    backend: str = "implicit"
    max_iterations: int = 100
    relative_tolerance: float = 1e-8
    absolute_tolerance: float = 1e-12
    minimum_diagonal: float = 1e-12


@dataclass(frozen=True)
class SchurReport:
    backend: str
    converged: bool
    iterations: int
    initial_residual_norm: float
    final_residual_norm: float
    pattern_reused: bool = False
    message: str = ""


INDEFINITE = "the Schur complement is not positive definite"

#: Blocks of one eliminated id that a task multiplies with each other at once, about.
TILE = 64


class SchurWorkspace:
    """Keeps how the blocks of eliminated ids are tiled, for as long as the same blocks are there.

    Of each id with more than TILE blocks it is how many tiles they are dealt to. The next step
    with the same blocks neither counts them nor asks whether any id is popular.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._signature, self._popular, self.pattern_builds = None, None, 0

    def tiles_of(self, links: DataFrame) -> tuple[DataFrame | None, bool]:
        """(k, tiles) of the popular ids of links (i, k), None if there are none, and whether that was kept."""
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("i", "k").cast("decimal(38,0)"))).first())
        if now == self._signature:
            return self._popular, True
        self._popular, self._signature = _popular(links), now
        self.pattern_builds += 1
        return self._popular, False


def _popular(links: DataFrame) -> DataFrame | None:
    counts = links.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    found = materialise(counts.select("k", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "schur-tiles")
    return found if found.limit(1).count() else None


def _damped_blocks(blocks: DataFrame, count: int, size: int, damping: float, least: float) -> DataFrame:
    """(i, values) of the diagonal blocks 0 to count - 1, absent ones included: diagonal elements d grow by damping * max(|d|, least)."""
    own = blocks.where("i = j").select("i", "values")
    every = blocks.sparkSession.range(count).select(F.col("id").alias("i")).join(own, "i", "left")
    zero = F.array_repeat(F.lit(0.0), size * size)
    grown = lambda v, at: F.when(at % (size + 1) == 0, v + F.lit(damping) * F.greatest(F.abs(v), F.lit(least))).otherwise(v)
    return every.select("i", F.transform(F.coalesce("values", zero), grown).alias("values"))


def _cells(blocks: DataFrame, height: int, width: int, rows: int, cols: int) -> Matrix:
    """Blocks (i, j, values) in scalar coordinates, a projection."""
    cells = blocks.select("i", "j", F.posexplode("values").alias("at", "v"))
    row, col = F.col("i") * height + F.expr(f"at div {width}"), F.col("j") * width + F.col("at") % width
    return Matrix(cells.select(row.alias("row"), col.alias("col"), "v"), rows, cols)


def _inverses(blocks: DataFrame, size: int) -> tuple[DataFrame, bool]:
    """(i, inverse) of diagonal blocks, written, and whether every block is positive definite."""
    found = materialise(small.spd_inverse(blocks.select("i", F.col("values").alias("a")), "a", size).select("i", "inverse"), "inverse-blocks")
    return found, found.where("inverse is null").limit(1).count() == 0


def _added(batches, width: int):
    """Batches (i, j, values) of _products() without blocks above the diagonal, and blocks of one place added up as far as HOLD numbers hold."""
    keys, sums = np.zeros(0, np.int64), np.zeros((0, width))
    waiting, held = [], 0

    def merge():
        nonlocal keys, sums, waiting, held
        i, j, values = (np.concatenate(x) for x in zip(*waiting))
        waiting, held = [], 0
        key = i << 32 | (j + 1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, values = key[first], np.add.reduceat(values[order], first, axis=0)
        at = np.searchsorted(keys, key)
        known = at < len(keys)
        known[known] = keys[at[known]] == key[known]
        sums[at[known]] += values[known]
        if not known.all():
            keys, sums = np.insert(keys, at[~known], key[~known]), np.insert(sums, at[~known], values[~known], axis=0)

    def pieces():
        for at in range(0, len(keys), max(1, PIECE // width)):
            some = keys[at : at + max(1, PIECE // width)]
            yield _blocks_batch({"i": some >> 32, "j": (some & 0xFFFFFFFF) - 1}, sums[at : at + len(some)])

    for batch in batches:
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        values = batch.column("values").flatten().to_numpy().reshape(-1, width)
        low = i >= j
        if not low.all():
            i, j, values = i[low], j[low], values[low]
        waiting.append((i, j, values))
        held += values.size
        if held > 2 * PIECE:
            merge()
            if sums.size > HOLD:
                yield from pieces()
                keys, sums = keys[:0], sums[:0]
    if waiting:
        merge()
    yield from pieces()


def _products(pairs: DataFrame, dp: int, de: int, added: bool = False) -> DataFrame:
    """(i, j, values) from rows (x, y, inverse, g): -X V⁻¹ Yᵀ for the blocks of two tiles of one id, and with j = -1 X V⁻¹ g.

    y is null where a tile meets itself; two different tiles give both triangles. Products leave a
    task in pieces of PIECE numbers, however many blocks come together in a batch. With `added`
    only places with i >= j are given, and the task adds them up, see _added().
    """

    def numbers(tile, width: int) -> tuple[np.ndarray, np.ndarray]:
        return tile.field("i").to_numpy(), tile.field("values").flatten().to_numpy().reshape(-1, width, de)

    def piece(i, j, values) -> pa.RecordBatch:
        return _blocks_batch({"i": np.concatenate(i), "j": np.concatenate(j)}, np.concatenate(values))

    def run(batches):
        for batch in batches:
            i, j, values, held = [], [], [], 0
            for x, y, inverse, g in zip(*(batch.column(c) for c in ("x", "y", "inverse", "g"))):
                if held > PIECE:
                    yield piece(i, j, values)
                    i, j, values, held = [], [], [], 0
                ids, w = numbers(x.values, dp)
                v = inverse.values.to_numpy().reshape(de, de)
                left = w @ v
                others, u = numbers(y.values, dp) if y.is_valid else (ids, w)
                c = -np.einsum("abk,ckd->acbd", left, u.transpose(0, 2, 1), optimize=True).reshape(len(ids), len(others), dp, dp)
                i.append(np.repeat(ids, len(others)))
                j.append(np.tile(others, len(ids)))
                values.append(c.reshape(-1, dp * dp))
                held += 2 * c.size
                if y.is_valid:
                    i.append(j[-1])
                    j.append(i[-2])
                    values.append(c.transpose(0, 1, 3, 2).reshape(-1, dp * dp))
                elif g.is_valid:
                    right = np.zeros((len(ids), dp * dp))
                    right[:, :dp] = left @ g.values.to_numpy()
                    i.append(ids)
                    j.append(np.full(len(ids), -1))
                    values.append(right)
            if i:
                yield piece(i, j, values)

    every = (lambda batches: _added(run(batches), dp * dp)) if added else run
    return pairs.select("x", "y", "inverse", "g").mapInArrow(every, "i long, j long, values array<double>")


def schur_complement(
    eq: NormalEquations, damping: float, minimum_diagonal: float, inverses: DataFrame, workspace: SchurWorkspace | None = None
) -> tuple[DataFrame, DataFrame, bool]:
    """(S, right, reused): blocks (i, j, values), i >= j, of S = Hpp - Hpe V⁻¹ Hepᵀ, damped, and blocks (i, values) of -gp + Hpe V⁻¹ ge.

    The blocks of an eliminated id come together as arrays and are multiplied as such; those of an
    id with more than TILE of them are dealt to tiles first, and pairs of tiles are dealt out, so
    no id gathers in one task. Ids are dealt out by ranges, as those near each other often meet the
    same primaries: each task adds up its products before they are shuffled.
    """
    dp, de = eq.primary_size, eq.eliminated_size
    spark = eq.table.sparkSession
    cross = eq.blocks("pe").select("i", F.col("j").alias("k"), "values")
    links = cross.select("i", "k")
    popular, reused = workspace.tiles_of(links) if workspace is not None else (_popular(links), False)
    facts = inverses.withColumnRenamed("i", "k").join(eq.blocks("ge").select(F.col("i").alias("k"), F.col("values").alias("g")), "k", "left")
    cell = F.collect_list(F.struct("i", "values"))
    few = cross if popular is None else cross.join(popular, "k", "left_anti")
    nothing = F.lit(None).cast("array<struct<i:bigint,values:array<double>>>").alias("y")
    # an id's facts travel with its blocks, so that they are not joined by hash
    nulls = lambda *names: [F.lit(None).cast(kind).alias(name) for name, kind in names]
    told = facts.select("k", *nulls(("i", "bigint"), ("values", "array<double>")), "inverse", "g")
    both = few.select("k", "i", "values", *nulls(("inverse", "array<double>"), ("g", "array<double>"))).unionByName(told)
    packed = eq.primaries < 1 << 31  # two indices in one number
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // TASK_ROWS))
    own = F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "values")))
    pairs = both.repartitionByRange(tasks, "k").groupBy("k").agg(own.alias("x"), F.max("inverse").alias("inverse"), F.max("g").alias("g"))
    parts = _products(pairs.where("size(x) > 0 AND inverse IS NOT NULL").withColumn("y", nothing), dp, de, packed)
    if popular is not None:
        dealt = cross.join(popular, "k").withColumn("t", F.pmod(F.xxhash64("i"), "tiles").cast("int"))
        tiles = materialise(dealt.groupBy("k", "tiles", "t").agg(cell.alias("x")), "schur-tiled")
        own = tiles.select("k", "x", nothing)
        first = tiles.where("t + 1 < tiles").select("k", "t", "x", F.explode(F.sequence(F.col("t") + 1, F.col("tiles") - 1)).alias("u"))
        second = tiles.where("t > 0").select("k", F.col("t").alias("u"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("t"))
        mixed = first.join(second, ["k", "t", "u"]).select("k", "x", "y")
        parts = parts.unionByName(_products(own.unionByName(mixed).join(facts, "k"), dp, de, packed))
    diagonal = _damped_blocks(eq.blocks("pp"), eq.primaries, dp, damping, minimum_diagonal).select("i", F.col("i").alias("j"), "values")
    gradient = eq.blocks("gp").select("i", F.lit(-1).cast("long").alias("j"), F.transform("values", lambda v: -v).alias("values"))
    parts = parts if packed else parts.where("i >= j")
    every = parts.unionByName(eq.blocks("pp").where("i > j")).unionByName(diagonal).unionByName(gradient)
    found = materialise(_summed(every, ["i", "j"], dp * dp), "schur")
    right = found.where("j = -1").select("i", F.slice("values", 1, dp).alias("values"))
    return found.where("j >= 0"), right, reused


def _both_triangles(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks (i, j, values) with i >= j of a symmetric matrix, and those above the diagonal."""
    turned = F.array(*[F.get("values", F.lit(c * size + r)) for r in range(size) for c in range(size)])
    return blocks.unionByName(blocks.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), turned.alias("values")))


def solve_damped(
    eq: NormalEquations, damping: float, options: SchurOptions = SchurOptions(), guess: DataFrame | None = None, workspace: SchurWorkspace | None = None
) -> tuple[SchurReport, DataFrame, DataFrame]:
    """(report, primary step, eliminated step) of the damped normal equations; steps are (row, v).

    Failure to converge, and blocks that are not positive definite, are told by the report;
    steps are then empty. Bad options raise ValueError.
    """
    if options.backend not in ("implicit", "dense", "assembled"):
        raise ValueError(f"unknown backend {options.backend!r}")
    if not (math.isfinite(damping) and damping >= 0) or not (options.minimum_diagonal > 0) or options.max_iterations < 1:
        raise ValueError("bad damping or options")
    spark = eq.table.sparkSession
    dp, de = eq.primary_size, eq.eliminated_size
    eq = NormalEquations(materialise(eq.by_blocks(), "normal-equations"), eq.primaries, eq.eliminated, dp, de)
    n, ne = eq.primaries * eq.primary_size, eq.eliminated * eq.eliminated_size
    empty = spark.createDataFrame([], "row bigint, v double")
    space = vectors_for(spark, max(n, 1))
    outer = vectors_for(spark, max(ne, 1))
    inverses, ok = _inverses(_damped_blocks(eq.blocks("ee"), eq.eliminated, de, damping, options.minimum_diagonal), de)
    if not ok:
        return SchurReport(options.backend, False, 0, 0.0, 0.0, message="an eliminated block is not positive definite"), empty, empty
    v_inverse = _cells(inverses.select("i", F.col("i").alias("j"), F.col("inverse").alias("values")), de, de, ne, ne)
    pe = _cells(eq.blocks("pe"), dp, de, n, ne)
    ep = pe.transpose()
    ge = outer.load(_vector(eq.blocks("ge"), de))
    zero = space.load(None)
    limits = SolverOptions(options.max_iterations, options.relative_tolerance, options.absolute_tolerance)
    reused = False
    if not n:
        x, report = zero, SchurReport(options.backend, True, 0, 0.0, 0.0)
    else:
        if options.backend != "implicit":
            found, right, reused = schur_complement(eq, damping, options.minimum_diagonal, inverses, workspace)
            s, rhs = _cells(_both_triangles(found, dp), dp, dp, n, n), space.load(_vector(right, dp))
        else:
            s = None
            own = _damped_blocks(eq.blocks("pp"), eq.primaries, dp, damping, options.minimum_diagonal).select("i", F.col("i").alias("j"), "values")
            primary = materialise(own.unionByName(eq.blocks("pp").where("i <> j")), "damped-primary")
            pp = _cells(primary, dp, dp, n, n)
            # -gp + Hpe V⁻¹ ge
            rhs = space.axpy(-1.0, space.load(_vector(eq.blocks("gp"), dp)), space.load(_frame_product(pe, outer.frame(outer.apply(v_inverse, ge)))))
        if options.backend == "dense":
            x, report = _dense(s, space, rhs, options, found, dp)
            report = replace(report, pattern_reused=reused)
        else:
            implicit = _Implicit(eq, inverses, primary) if s is None and isinstance(space, DriverVectors) else None
            held = s and Matrix(space.held(s.df) if isinstance(space, DriverVectors) else s.df, n, n)
            apply = (lambda p: space.apply(held, p)) if s is not None else implicit.apply if implicit else (
                lambda p: space.axpy(
                    -1.0, space.load(_frame_product(pe, outer.frame(outer.apply(v_inverse, outer.load(_frame_product(ep, space.frame(p))))))), space.apply(pp, p)
                )
            )
            diagonal = found.where("i = j").select("i", "values") if s is not None else _schur_diagonal(eq, primary, inverses)
            blocks, good = _inverses(diagonal, dp)
            blocks = _cells(blocks.select("i", F.col("i").alias("j"), F.col("inverse").alias("values")), dp, dp, n, n)
            if not good:
                return SchurReport(options.backend, False, 0, 0.0, 0.0, message="a Schur block is not positive definite"), empty, empty
            start = space.load(guess) if guess is not None else zero
            try:
                x, found = conjugate_gradients(
                    space, apply, rhs, start, lambda r: space.apply(blocks, r), limits, sum_of_tolerances=options.backend == "implicit"
                )
            except Breakdown as e:
                return SchurReport(options.backend, False, 0, 0.0, 0.0, reused, str(e)), empty, empty
            finally:
                if implicit:
                    implicit.release()
                if held:
                    held.df.unpersist()
            report = SchurReport(options.backend, found.converged, found.iterations, found.initial_residual_norm, found.final_residual_norm, reused)
    if not report.converged:
        return SchurReport(**{**report.__dict__, "message": report.message or "no convergence"}), empty, empty
    # V⁻¹ (-ge - Hepᵀ x)
    right = ge if not n else outer.axpy(1.0, ge, outer.load(_frame_product(ep, space.frame(x))))
    e = outer.axpy(-1.0, outer.apply(v_inverse, right), outer.load(None))
    first = lambda df, k: df.where(F.col("row") < k)
    return report, first(space.frame(x), n), first(outer.frame(e), ne)


class _Implicit:
    """Products with S = Hpp - Hpe V⁻¹ Hepᵀ for a vector at the driver, one job each.

    The blocks of an eliminated id lie together in one partition, in order; there are at most as
    many as primaries. A task adds up what its ids give to each row, so that one row for each
    row and task is shuffled.
    """

    def __init__(self, eq: NormalEquations, inverses: DataFrame, primary: DataFrame):
        self.dp, self.de, self.n = eq.primary_size, eq.eliminated_size, eq.primaries * eq.primary_size
        cross = eq.blocks("pe").select("i", F.col("j").alias("k"), "values").join(inverses.withColumnRenamed("i", "k"), "k")
        # ids that lie near each other often meet the same primaries, so ranges of ids touch fewer rows than hashes do
        tasks = int(eq.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.cross = cross.select("k", "i", "values", "inverse").repartitionByRange(tasks, "k").sortWithinPartitions("k").persist(StorageLevel.MEMORY_AND_DISK)
        self.primary = primary.select("i", "j", "values").repartition("i").persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.cross.unpersist()
        self.primary.unpersist()

    def apply(self, p: np.ndarray) -> np.ndarray:
        dp, de, n = self.dp, self.de, self.n
        spark = self.cross.sparkSession
        sent = spark.sparkContext.broadcast(p.reshape(-1, dp))
        rows = np.arange(dp)

        def given(total: np.ndarray):
            touched = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(touched), pa.array(total[touched])], ["row", "v"])

        def eliminated(batches):
            total, open_ = np.zeros(n), None

            def close(k, i, x, v):
                at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                t = np.add.reduceat(np.einsum("mab,ma->mb", x, sent.value[i]), at)
                y = np.repeat(np.einsum("gbc,gc->gb", v[at], t), np.diff(np.append(at, len(k))), axis=0)
                np.subtract(total, np.bincount((i[:, None] * dp + rows).ravel(), np.einsum("mab,mb->ma", x, y).ravel(), n), out=total)

            for batch in batches:
                if not batch.num_rows:
                    continue
                now = [batch.column("k").to_numpy(), batch.column("i").to_numpy()]
                now += [batch.column(c).flatten().to_numpy().reshape(-1, w, de) for c, w in (("values", dp), ("inverse", de))]
                if open_:
                    now = [np.concatenate(pair) for pair in zip(open_, now)]
                cut = int(np.searchsorted(now[0], now[0][-1]))  # the last id may go on in the next batch
                if cut:
                    close(*(c[:cut] for c in now))
                open_ = [c[cut:] for c in now]
            if open_:
                close(*open_)
            yield given(total)

        def own(batches):
            total = np.zeros(n)
            for batch in batches:
                if batch.num_rows:
                    i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
                    y = np.einsum("mab,mb->ma", batch.column("values").flatten().to_numpy().reshape(-1, dp, dp), sent.value[j])
                    total += np.bincount((i[:, None] * dp + rows).ravel(), y.ravel(), n)
            yield given(total)

        parts = self.cross.mapInArrow(eliminated, "row long, v double").unionByName(self.primary.mapInArrow(own, "row long, v double"))
        got = parts.groupBy("row").agg(F.sum("v").alias("v")).toArrow()
        sent.destroy()
        out = np.zeros(n)
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out


def _frame_product(a: Matrix, x: DataFrame) -> DataFrame:
    right = x.select(F.col("row").alias("col"), F.col("v").alias("w"))
    return a.df.join(right, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def _vector(blocks: DataFrame, size: int) -> DataFrame:
    cells = blocks.select("i", F.posexplode("values").alias("at", "v"))
    return cells.select((F.col("i") * size + F.col("at")).alias("row"), "v")


def _schur_diagonal(eq: NormalEquations, primary: DataFrame, inverses: DataFrame) -> DataFrame:
    """(i, values): the diagonal blocks of S only, of the products of each block with itself."""
    dp, de = eq.primary_size, eq.eliminated_size

    def own(batches):
        for batch in batches:
            if batch.num_rows:
                x, v = (batch.column(c).flatten().to_numpy().reshape(-1, w, de) for c, w in (("values", dp), ("inverse", de)))
                yield _blocks_batch({"i": batch.column("i").to_numpy()}, -(x @ v @ x.transpose(0, 2, 1)).reshape(-1, dp * dp))

    cross = eq.blocks("pe").select("i", F.col("j").alias("k"), "values").join(inverses.select(F.col("i").alias("k"), "inverse"), "k")
    every = cross.select("i", "values", "inverse").mapInArrow(own, "i long, values array<double>")
    return _summed(every.unionByName(primary.where("i = j").select("i", "values")), ["i"], dp * dp)


def _dense(s: Matrix, space, rhs, options: SchurOptions, blocks: DataFrame | None = None, size: int = 1) -> tuple[np.ndarray, SchurReport]:
    """`blocks`, if given, are those of s, of size x size numbers."""
    b = space.load(rhs) if isinstance(rhs, np.ndarray) else None
    if b is None or s.size > DRIVER_ELEMENTS:
        return _dense_apart(s, space, rhs, options, blocks, size)
    a = s.to_numpy(DRIVER_ELEMENTS)
    try:
        low = np.linalg.cholesky((a + a.T) / 2)
    except np.linalg.LinAlgError:
        return b, SchurReport("dense", False, 0, 0.0, 0.0, message=INDEFINITE)
    x = np.linalg.solve(low.T, np.linalg.solve(low, b))
    return x, _report(float(np.linalg.norm(b)), float(np.linalg.norm(b - a @ x)), options)


def _report(first: float, last: float, options: SchurOptions) -> SchurReport:
    limit = max(options.absolute_tolerance + options.relative_tolerance * first, 100 * C.EPSILON * max(1.0, first))
    return SchurReport("dense", last <= limit, 1, first, last, message="" if last <= limit else "the residual exceeds the tolerance")


def _dense_apart(s: Matrix, space, rhs, options: SchurOptions, blocks: DataFrame | None = None, size: int = 1):
    """The same by distributed Cholesky factors of components, or elimination in panels.

    An s that is not positive definite is told by the report; a system that is too large raises ValueError.
    """
    first = math.sqrt(space.dot(rhs, rhs))
    try:
        x = solve_definite(blocks.where("i >= j"), s.rows // size, size, rhs) if blocks is not None and isinstance(rhs, np.ndarray) else None
        if x is None:
            right = space.frame(rhs).select("row", F.lit(0).cast("long").alias("col"), "v")
            x = space.load(solve(Matrix(s.df, *s.shape, sparse=True), Matrix(right, s.rows, 1), definite=True).df.select("row", "v"))
    except Singular:
        return rhs, SchurReport("dense", False, 0, 0.0, 0.0, message=INDEFINITE)
    left = space.axpy(-1.0, space.apply(s, x), rhs)
    return x, _report(first, math.sqrt(space.dot(left, left)), options)


@dataclass
class DampingControl:
    """Levenberg-Marquardt damping: falls after accepted steps, grows after rejected ones, within bounds."""

    initial: float = 1e-3
    lowest: float = 1e-12
    highest: float = 1e12
    decrease: float = 0.3
    increase: float = 10.0

    def __post_init__(self):
        values = (self.initial, self.lowest, self.highest, self.decrease, self.increase)
        if not (all(map(math.isfinite, values)) and 0 < self.lowest <= self.initial <= self.highest and 0 < self.decrease < 1 < self.increase):
            raise ValueError("bad damping options")
        self.damping, self.accepted, self.rejected = self.initial, 0, 0

    def accept(self) -> None:
        self.damping = max(self.lowest, self.damping * self.decrease)
        self.accepted += 1

    def reject(self) -> None:
        self.damping = min(self.highest, self.damping * self.increase)
        self.rejected += 1


def residual_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESIDUALS)


def merged(parts: list[NormalEquations]) -> NormalEquations:
    return reduce(NormalEquations.merge, parts)
