"""Binary matrix files: two little-endian int64 (rows, columns), then float64 in column order. A vector has one int64.

A file is written and read by ranges of elements, in parallel. On a mounted file system it is one
file, whose ranges tasks write in place; on any other store it is a folder of parts, each named by
the number of its first element, beside a file with the shape. Both are read alike.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..matrix import Matrix
from ..shipping import send_package

#: Elements that one partition reads or writes.
PARTITION_ELEMENTS = 1 << 22
SHAPE = "shape"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def _is_mounted(system: pafs.FileSystem) -> bool:
    return isinstance(system, pafs.LocalFileSystem)


def _pieces(uri: str, dimensions: int) -> tuple[tuple[int, ...], list[tuple[str, int, int, int]]]:
    """The shape, and (path, first byte, first element, elements) of each stored piece."""
    system, path = _opened(uri)
    info, head = system.get_file_info(path), 8 * dimensions
    parts = info.type == pafs.FileType.Directory
    with system.open_input_file(f"{path}/{SHAPE}" if parts else path) as file:
        shape = tuple(np.frombuffer(file.read(head), "<i8").tolist())
        held = file.size() - head
    n = int(np.prod(shape, dtype=object)) if len(shape) == dimensions and min(shape) >= 0 else -1
    if not parts:
        found = [(path, head, 0, held // 8)]
    else:
        files = [x for x in system.get_file_info(pafs.FileSelector(path)) if x.base_name.startswith("part-")]
        found = sorted(((x.path, 0, int(x.base_name.removeprefix("part-")), x.size // 8) for x in files), key=lambda x: x[2])
        held = 8 * sum(x[3] for x in found)
    if n < 0 or held != 8 * n or any(a[2] + a[3] != b[2] for a, b in zip(found, found[1:])):
        raise ValueError(f"{uri} is not a {'matrix' if dimensions == 2 else 'vector'} file")
    return shape, found


def shape_of(uri: str) -> tuple[int, int]:
    return _pieces(uri, 2)[0]


class _Part(InputPartition):
    def __init__(self, path: str, offset: int, first: int, count: int, rows: int):
        super().__init__(first)
        self.path, self.offset, self.first, self.count, self.rows = path, offset, first, count, rows


class _Reader(DataSourceReader):
    def __init__(self, options, dimensions: int):
        self.uri, self.dimensions = options["path"], dimensions
        self.step = int(options.get("partitionelements", PARTITION_ELEMENTS))

    def partitions(self):
        shape, pieces = _pieces(self.uri, self.dimensions)
        parts = [
            _Part(path, offset + 8 * at, first + at, min(self.step, count - at), max(shape[0], 1))
            for path, offset, first, count in pieces
            for at in range(0, count, self.step)
        ]
        return parts or [_Part("", 0, 0, 0, 1)]

    def read(self, part):
        if not part.count:
            return
        system, _ = _opened(self.uri)
        with system.open_input_file(part.path) as file:
            file.seek(part.offset)
            for at in range(part.first, part.first + part.count, 1 << 16):
                n = min(1 << 16, part.first + part.count - at)
                v = pa.array(np.frombuffer(file.read(8 * n), "<f8"))
                lin = np.arange(at, at + n)
                if self.dimensions == 1:
                    yield pa.RecordBatch.from_arrays([pa.array(lin), v], ["row", "v"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(lin % part.rows), pa.array(lin // part.rows), v], ["row", "col", "v"])


@dataclass
class _Written(WriterCommitMessage):
    """Elements that a task wrote, and the parts, as (temporary name, first element)."""

    count: int
    parts: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    """Rows (lin, v), each task's in order: first all ranges are written under a temporary name, then the name is changed.

    A range that a repeated task writes again is the same range, so retries do no harm.
    """

    def __init__(self, options):
        self.uri, self.shape, self.stage = options["path"], [int(x) for x in options["shape"].split(",")], options["stage"]
        self.n = int(np.prod(self.shape, dtype=object))

    def write(self, iterator):
        system, path = _opened(self.uri)
        place = f"{path}.{self.stage}"
        count, parts, out, ahead = 0, [], None, None
        try:
            for batch in iterator:
                lin, v = batch.column("lin").to_numpy(), batch.column("v").to_numpy(zero_copy_only=False).astype("<f8")
                if not len(lin):
                    continue
                steps = np.flatnonzero(np.diff(lin) != 1) + 1  # ranges of neighbours
                for a, b in zip([0, *steps], [*steps, len(lin)]):
                    if out is None or lin[a] != ahead:
                        if out is not None:
                            out.close()
                        if _is_mounted(system):
                            out = open(place, "r+b")
                            out.seek(8 * len(self.shape) + 8 * int(lin[a]))
                        else:
                            name = f"{place}/{uuid.uuid4().hex}"
                            parts.append((name, int(lin[a])))
                            out = system.open_output_stream(name)
                    out.write(v[a:b].tobytes())
                    ahead = lin[b - 1] + 1
                count += len(lin)
        finally:
            if out is not None:
                out.close()
        return _Written(count, parts)

    def commit(self, messages):
        system, path = _opened(self.uri)
        place = f"{path}.{self.stage}"
        if sum(m.count for m in messages if m) != self.n:
            self.abort(messages)
            raise ValueError(f"{self.uri}: {sum(m.count for m in messages if m)} elements came for a shape of {self.shape}")
        if not _is_mounted(system):
            for name, first in (part for m in messages if m for part in m.parts):
                system.move(name, f"{place}/part-{first}")
        system.move(place, path)

    def abort(self, messages):
        system, path = _opened(self.uri)
        place = f"{path}.{self.stage}"
        if _is_mounted(system):
            if os.path.exists(place):
                os.remove(place)
        else:
            system.delete_dir(place)


class MatrixFileSource(DataSource):
    """format("matrixfile")."""

    dimensions = 2

    @classmethod
    def name(cls):
        return "matrixfile"

    def schema(self):
        return "row long, col long, v double"

    def reader(self, schema):
        return _Reader(dict(self.options), self.dimensions)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


class VectorFileSource(MatrixFileSource):
    """format("vectorfile")."""

    dimensions = 1

    @classmethod
    def name(cls):
        return "vectorfile"

    def schema(self):
        return "row long, v double"


def _registered(spark: SparkSession) -> SparkSession:
    send_package(spark)
    spark.dataSource.register(MatrixFileSource)
    spark.dataSource.register(VectorFileSource)
    return spark


def read_matrix(spark: SparkSession, uri: str) -> Matrix:
    return Matrix(_registered(spark).read.format("matrixfile").option("path", uri).load(), *shape_of(uri))


def read_vector(spark: SparkSession, uri: str) -> DataFrame:
    """(row, v) of a vector file."""
    return _registered(spark).read.format("vectorfile").option("path", uri).load()


def _write(elements: DataFrame, shape: tuple[int, ...], uri: str, step: int) -> None:
    """elements are (lin, v); they are shuffled once, to ranges of `step` neighbours."""
    spark = _registered(elements.sparkSession)
    system, path = _opened(uri)
    stage, n = f"{uuid.uuid4().hex}.tmp", int(np.prod(shape, dtype=object))
    head = np.array(shape, "<i8").tobytes()
    system.create_dir(os.path.dirname(path) if _is_mounted(system) else f"{path}.{stage}", recursive=True)
    with system.open_output_stream(f"{path}.{stage}" if _is_mounted(system) else f"{path}.{stage}/{SHAPE}") as out:
        out.write(head)
    if _is_mounted(system):
        os.truncate(f"{path}.{stage}", len(head) + 8 * n)
    parts = max(1, -(-n // step))
    dealt = elements.repartitionById(parts, F.expr(f"cast(lin div {step} as int)")).sortWithinPartitions("lin")
    writer = dealt.write.format("matrixfile").mode("append").option("path", uri).option("shape", ",".join(map(str, shape))).option("stage", stage)
    writer.save()


def write_matrix(a: Matrix, uri: str, step: int = PARTITION_ELEMENTS) -> None:
    """Write a matrix of any size; a task writes `step` elements, and the name appears when all are there."""
    lin = (F.col("row") + F.col("col") * a.rows).alias("lin")
    _write(a.dense().df.select(lin, F.col("v").cast("double").alias("v")), a.shape, uri, step)


def write_vector(vector: DataFrame, n: int, uri: str, step: int = PARTITION_ELEMENTS) -> None:
    """Write (row, v) with rows 0 to n - 1, as write_matrix() does; ValueError if rows are missing or too many."""
    _write(vector.select(F.col("row").cast("long").alias("lin"), F.col("v").cast("double").alias("v")), (n,), uri, step)
