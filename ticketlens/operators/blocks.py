"""Products of a large sparse matrix with narrow dense ones.

The sparse matrix is cut into blocks of ``ROWS`` by ``COLS`` cells, stored as coordinates; a dense one
of a few hundred columns into strips of as many rows. A block meets its strip by a join on the block
number, the product is NumPy inside the task, and the partial results of one strip are added up
where the strip lives. Nothing but matrices of strip width squared reaches the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.operators.scale import number_by_digest
from ticketlens.session import materialise

ROWS, COLS = 1024, 2048
#: numbers that one step of a product may hold at once
STEP = 1 << 22
#: partial strips that a task holds before it passes them on
HELD = 16
BATCH_BYTES = 48 << 20

_STRIP = "block long, data binary"
_STRIP_ARROW = pa.schema([("block", pa.int64()), ("data", pa.binary())])


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Blocks and strips are long rows, so what goes to Python at once is bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def numbered(rows: DataFrame, name: str, size: int) -> DataFrame:
    """``rows`` (one per ``name``) with ``block`` and ``at``: gapless numbers in the order of a digest,
    ``size`` to a block."""
    digest = F.md5(F.coalesce(F.col(name).cast("string"), F.lit("")))
    placed = number_by_digest(rows.withColumn("_digest", digest), [], "_digest", "_number")
    at = F.col("_number") - 1
    return placed.select(*rows.columns, F.floor(at / size).alias("block"), (at % size).alias("at"))


@dataclass(frozen=True)
class Strips:
    """A dense matrix of ``width`` columns: rows (block, data) of ``height`` rows each, 8-byte floats
    row by row. Places without a row, and blocks that are missing, are zero."""

    frame: DataFrame
    height: int
    width: int

    def written(self, label: str) -> Strips:
        return Strips(materialise(self.frame, label), self.height, self.width)

    def mapped(self, change: Callable[[np.ndarray], np.ndarray], width: int) -> Strips:
        """Every strip changed on its own."""
        shape = (self.height, self.width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield _strip(block, change(_dense(data, shape)))

        return Strips(self.frame.mapInArrow(run, _STRIP), self.height, width)

    def times(self, small: np.ndarray) -> Strips:
        """The product with a small matrix from the right."""
        return self.mapped(lambda x: x @ small, small.shape[1])


def _dense(data: pa.Scalar, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(shape)


def _strip(block: int, values: np.ndarray) -> pa.RecordBatch:
    data = np.ascontiguousarray(values, dtype=np.float64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary())],
                                      schema=_STRIP_ARROW)


def added(frames: Sequence[DataFrame], height: int, width: int) -> Strips:
    """The sum of all strips of the same block."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != block:
                    if total is not None:
                        yield _strip(block, total)
                    block, total = number, np.zeros((height, width))
                total += _dense(data, (height, width))
        if total is not None:
            yield _strip(block, total)

    ordered = rows.repartition("block").sortWithinPartitions("block")
    return Strips(ordered.mapInArrow(run, _STRIP), height, width)


def packed_rows(rows: DataFrame, height: int, width: int) -> Strips:
    """Strips from rows (block, at, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, values = None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            places = batch.column(1).to_numpy()
            vectors = batch.column(2).flatten().to_numpy().reshape(-1, width)
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for first, last in zip(np.append(0, cuts), np.append(cuts, len(numbers))):
                if first == last:
                    continue
                if numbers[first] != block:
                    if values is not None:
                        yield _strip(block, values)
                    block, values = int(numbers[first]), np.zeros((height, width))
                values[places[first:last]] = vectors[first:last]
        if values is not None:
            yield _strip(block, values)

    ordered = rows.select("block", "at", "vec").repartition("block").sortWithinPartitions("block")
    return Strips(ordered.mapInArrow(run, _STRIP), height, width)


def unpacked_rows(strips: Strips, names: DataFrame, columns: str,
                  change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """``columns`` of ``names`` (which also has ``block`` and ``at``) and ``vec``, the row of that place;
    zero where there is no strip. ``change`` is applied to the rows of a block."""
    kept = [c for c in names.columns if c not in ("block", "at")]
    inside = names.groupBy("block").agg(F.collect_list(F.struct("at", *kept)).alias("names"))
    joined = inside.join(strips.frame, "block", "left").select("names", "data")
    shape = (strips.height, strips.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data in zip(batch.column(0), batch.column(1)):
                fields = names.values
                places = fields.field("at").to_numpy()
                dense = _dense(data, shape) if data.is_valid else np.zeros(shape)
                vectors = np.ascontiguousarray(change(dense[places]))
                offsets = np.arange(len(places) + 1, dtype=np.int32) * vectors.shape[1]
                vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*[fields.field(c) for c in kept], vec],
                                                 names=[*kept, "vec"])

    return joined.mapInArrow(run, f"{columns}, vec array<double>")


def triangle(strips: Strips) -> np.ndarray:
    """The triangular factor of a QR decomposition, by a tree: every task reduces its strips to one
    small matrix, fewer and fewer tasks those, and the driver the last few."""
    width = strips.width

    def reduced(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((0, width))
        for matrix in matrices:
            top = np.linalg.qr(np.vstack([top, matrix]), mode="r")
        if len(top):
            yield _strip(0, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(_dense(data, (-1, width)) for batch in batches for data in batch.column(1))

    parts, tasks = strips.frame.mapInArrow(run, _STRIP), strips.frame.rdd.getNumPartitions()
    while tasks > 8:
        tasks = max(8, tasks // 8)
        parts = parts.repartition(tasks).mapInArrow(run, _STRIP)
    last = [np.frombuffer(row["data"]).reshape(-1, width) for row in parts.collect()]
    return np.linalg.qr(np.vstack([np.zeros((1, width)), *last]), mode="r")


def whitening(upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix with the triangular factor ``upper``: the singular values, largest first, and the
    small matrix that turns its columns into orthonormal ones in that order. Directions that are
    numerically absent become zero."""
    _, values, vectors = np.linalg.svd(upper, full_matrices=False)
    kept = values > values.max(initial=0.0) * 1e-12
    return values, vectors.T * np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0)


@dataclass(frozen=True)
class Sparse:
    """Blocks (rb, cb, r, c, v) of a matrix: 4-byte places inside the block and 8-byte values."""

    blocks: DataFrame

    def times(self, right: Strips, more: Sequence[DataFrame] = ()) -> Strips:
        """The product with strips of ``COLS`` rows: strips of ``ROWS`` rows, to which strips of
        ``more`` are added."""
        return self._product(right, "cb", "rb", ROWS, more)

    def transposed_times(self, left: Strips) -> Strips:
        """The transposed matrix times strips of ``ROWS`` rows: strips of ``COLS`` rows."""
        return self._product(left, "rb", "cb", COLS)

    def _product(self, dense: Strips, meet: str, by: str, height: int,
                 more: Sequence[DataFrame] = ()) -> Strips:
        joined = self.blocks.join(dense.frame.withColumnRenamed("block", meet), meet)
        out, given = ("r", "c") if by == "rb" else ("c", "r")
        width, shape = dense.width, (dense.height, dense.width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, to, at, value, data in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                    if block not in held:
                        if len(held) >= HELD:
                            yield from (_strip(b, total) for b, total in held.items())
                            held = {}
                        held[block] = np.zeros((height, width))
                    _add_product(held[block], _array(to, np.int32), _array(at, np.int32),
                                 _array(value, np.float64), _dense(data, shape))
            yield from (_strip(b, total) for b, total in held.items())

        partial = joined.select(by, out, given, "v", "data").mapInArrow(run, _STRIP)
        return added([partial, *more], height, width)


def _array(data: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), dtype=kind)


def _add_product(total: np.ndarray, to: np.ndarray, at: np.ndarray, value: np.ndarray,
                 dense: np.ndarray) -> None:
    """total[to] += value * dense[at], for entries in any order."""
    order = np.argsort(to, kind="stable")
    step = max(1, STEP // dense.shape[1])
    for first in range(0, len(order), step):
        some = order[first:first + step]
        rows = to[some]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        total[rows[starts]] += np.add.reduceat(value[some, None] * dense[at[some]], starts, axis=0)


def sparse(entries: DataFrame, label: str) -> Sparse:
    """Written blocks of the entries (rb, ra, cb, ca, value): block and place of row and column."""
    schema = pa.schema([("rb", pa.int64()), ("cb", pa.int64()), ("r", pa.binary()), ("c", pa.binary()),
                        ("v", pa.binary())])

    def block(key: tuple[int, int], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        values = [np.concatenate(column) for column in zip(*parts)]
        data = [x.astype(k).tobytes() for x, k in zip(values, (np.int32, np.int32, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *data)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            rb, cb, *rest = (column.to_numpy() for column in batch.columns)
            cuts = np.flatnonzero((np.diff(rb) != 0) | (np.diff(cb) != 0)) + 1
            for first, last in zip(np.append(0, cuts), np.append(cuts, len(rb))):
                if first == last:
                    continue
                if key != (rb[first], cb[first]):
                    if parts:
                        yield block(key, parts)
                    key, parts = (int(rb[first]), int(cb[first])), []
                parts.append([column[first:last] for column in rest])
        if parts:
            yield block(key, parts)

    ordered = entries.select("rb", "cb", "ra", "ca", "value").repartition("rb", "cb")
    ordered = ordered.sortWithinPartitions("rb", "cb")
    return Sparse(materialise(
        ordered.mapInArrow(pack, "rb long, cb long, r binary, c binary, v binary"), label))
