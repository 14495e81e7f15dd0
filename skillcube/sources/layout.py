"""How cubes lie in files: stores cut into other chunks, and Parquet files along a space-filling curve.

A store is rechunked as arrays, not as rows. A task reads a box of whole source chunks, cuts it where the new chunks meet, and sends the pieces; what
belongs to one new chunk meets again in order and is put together, one chunk at a time. Neither side holds more than the memory limit.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcube.functions.weights import AXIS_LABELS
from skillcube.sources.zarr import Cube, Store, register

#: Bytes that a task of a rechunking holds at most, of one array.
MAX_BYTES = 1 << 28
_PIECE = "array string, chunk long, at array<int>, data binary"


@dataclass(frozen=True)
class Plan:
    """Boxes to read (whole source chunks), chunks to write, and the pieces between them."""

    shape: tuple[int, ...]
    read: tuple[int, ...]
    write: tuple[int, ...]

    def boxes(self) -> Iterator[tuple[tuple[int, int], ...]]:
        yield from itertools.product(*([(a, min(n, a + c)) for a in range(0, n, c)] for n, c in zip(self.shape, self.read, strict=True)))

    def pieces(self, box: Sequence[tuple[int, int]]) -> Iterator[tuple[int, tuple[tuple[int, int], ...], tuple[int, ...]]]:
        """(number of the chunk, the piece's box, its corner within the chunk) of every piece of a box."""
        grid = [-(-n // c) for n, c in zip(self.shape, self.write, strict=True)]
        for at in itertools.product(*(range(a // c, -(-b // c)) for (a, b), c in zip(box, self.write, strict=True))):
            part = tuple((max(a, k * c), min(b, (k + 1) * c)) for (a, b), k, c in zip(box, at, self.write, strict=True))
            number = 0
            for k, g in zip(at, grid, strict=True):
                number = number * g + k
            yield number, part, tuple(a - k * c for (a, _), k, c in zip(part, at, self.write, strict=True))

    def count(self) -> int:
        """Pieces in all."""
        return math.prod(len({*range(0, n, r), *range(0, n, w)}) for n, r, w in zip(self.shape, self.read, self.write, strict=True))


def plan(shape: Sequence[int], source: Sequence[int], target: Sequence[int], item: int, most: int = MAX_BYTES) -> Plan:
    """Boxes that make few pieces and fit into memory: source chunks are put together first along the dimensions in which the new chunks are longest for them."""
    write = tuple(min(c, n) for c, n in zip(target, shape, strict=True))
    read = [min(c, n) for c, n in zip(source, shape, strict=True)]
    size = lambda chunk: math.prod(chunk) * item
    for what, chunk in (("a source chunk", read), ("a new chunk", write)):
        if size(chunk) > most:
            raise ValueError(f"{what} of {size(chunk)} bytes is beyond the memory limit of {most}")
    for d in sorted(range(len(read)), key=lambda d: -write[d] / read[d]):
        room = most // size(read)
        want = -(-write[d] // read[d])
        read[d] = min(shape[d], read[d] * max(1, min(room, want)))
    return Plan(tuple(shape), tuple(read), write)


def rechunk(spark: SparkSession, source: str, target: str, chunks: dict[str, int], variables: Sequence[str] | None = None, compressor: str | None = "zlib", most: int = MAX_BYTES) -> None:
    """Write a store's variables with other chunks (labels a chunk spans by dimension; all, where one is not named). Items and attributes stay as they are.

    Raises where a chunk is beyond the memory limit, or where something is stored at the target already.
    """
    register(spark)
    cube, store = Cube(source), Store(target)
    if store.get(".zmetadata") is not None or store.get(".zgroup") is not None:
        raise FileExistsError(target)
    chosen = list(variables) if variables else cube.variables()
    dims = cube.dims(chosen)
    packed = {"id": compressor, "level": 1} if compressor else None
    about: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": {}}
    plans: dict[str, Plan] = {}
    for name in [*chosen, *(d for d in dims if d in cube.arrays)]:
        a = cube.arrays[name]
        size = [min(chunks.get(d, n), n) for d, n in zip(a.dims, a.shape, strict=True)] if name in chosen else a.shape
        about[f"{name}/.zarray"] = {"zarr_format": 2, "shape": a.shape, "chunks": size, "dtype": a.dtype, "compressor": packed, "fill_value": a.fill, "order": "C", "filters": None}
        about[f"{name}/.zattrs"] = a.attrs | {"_ARRAY_DIMENSIONS": a.dims}
        plans[name] = plan(a.shape, a.chunks, size, int(a.dtype[2:]), most)
    store.put(".zpending", json.dumps({"zarr_consolidated_format": 1, "metadata": about}).encode())
    boxes = [(name, [x for ends in box for x in ends]) for name, p in plans.items() for box in p.boxes()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, at = Cube(source).arrays, Store(source)
        for batch in batches:
            for name, flat in zip(batch.column("array").to_pylist(), batch.column("box").to_pylist(), strict=True):
                box = list(zip(flat[::2], flat[1::2], strict=True))
                items = arrays[name].read(at, box)
                for number, part, corner in plans[name].pieces(box):
                    piece = items[tuple(slice(a - o, b - o) for (a, b), (o, _) in zip(part, box, strict=True))]
                    where = [x for c, (a, b) in zip(corner, part, strict=True) for x in (c, b - a)]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number]), pa.array([where], pa.list_(pa.int32())), pa.array([piece.tobytes()], pa.binary())], ["array", "chunk", "at", "data"])

    # a task for each box; boxes are as many as the source has chunks at most
    tasks = spark.sparkContext.defaultParallelism * 4
    work = spark.createDataFrame(boxes, "array string, box array<int>").repartition(min(len(boxes), max(tasks, len(boxes) // 16)))
    pieces = work.mapInArrow(cut, _PIECE).repartition("array", "chunk").sortWithinPartitions("array", "chunk")
    pieces.write.format("zarr").option("pieces", "true").option("variables", ",".join(plans)).mode("append").save(target)


# ---- Parquet


def curve_key(sizes: dict[str, int]) -> Column:
    """A cell's place on a Z-shaped curve through dimensions of these sizes: the bits of its positions __at_DIM in turn, the highest first."""
    bits = {d: max(1, (n - 1).bit_length()) for d, n in sizes.items()}
    order = [(d, b - 1 - level) for level in range(max(bits.values())) for d, b in bits.items() if level < b]
    if len(order) > 63:
        raise ValueError("the axes have too many labels for one key")
    key = F.lit(0).cast("long")
    for d, bit in order:
        key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(F.col(f"__at_{d}"), bit).bitwiseAND(F.lit(1).cast("long")))
    return key


def along_curve(df: DataFrame, dims: Sequence[str], files: int) -> DataFrame:
    """df in `files` partitions along a space-filling curve, so that a box in these dimensions lies in few of them. The labels of each axis reach the driver."""
    spark, rows, sizes = df.sparkSession, df, {}
    for d in dims:
        labels = sorted(r[0] for r in df.select(d).distinct().limit(AXIS_LABELS + 1).collect())
        if len(labels) > AXIS_LABELS:
            raise ValueError(f"{d} is no axis: it has more than {AXIS_LABELS} labels")
        sizes[d] = len(labels)
        at = spark.createDataFrame([(x, k) for k, x in enumerate(labels)], T.StructType([df.schema[d], T.StructField(f"__at_{d}", T.LongType())]))
        rows = rows.join(F.broadcast(at), d)  # at most AXIS_LABELS rows
    rows = rows.withColumn("__key", curve_key(sizes))
    return rows.repartitionByRange(files, "__key").sortWithinPartitions("__key").select(*df.columns)
