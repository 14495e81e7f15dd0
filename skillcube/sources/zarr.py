"""Cubes in Zarr stores (format 2): a data source that opens the chunks a query needs and no others, and a sink of whole chunks.

    register(spark)
    spark.read.format("zarr").option("variables", "temperature").load("gs://bucket/era5.zarr").where("level = 500 AND time >= TIMESTAMP_NTZ'2020-01-01'")

A row is a cell: a column per dimension, holding its label, and one per variable. The schema comes from the store's metadata. Comparisons of
dimensions with constants are answered from the labels, so chunks without a wanted label are never opened. A task reads one chunk, or as many
small neighbours as make up CELLS. A variable that lacks some of the dimensions is repeated along them. A chunk that is not stored holds the fill
value. Times ("hours since ...") are timestamps without zone, time spans are whole hours, _FillValue and missing_value are nulls, scale_factor and
add_offset are applied. Files are reached through pyarrow: local folders, s3://, gs://, hdfs:// and what else it opens.
"""

from __future__ import annotations

import base64
import bz2
import contextlib
import gzip
import itertools
import json
import lzma
import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from skillcube.functions.weights import AXIS_LABELS

#: Cells that a task reads at least, if there are as many; cells of a record batch.
CELLS, BATCH = 1 << 22, 1 << 17
#: Fixed names of units and their microseconds.
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
STAGING = ".staging"


class Store:
    """Keys below a folder. A missing key is None."""

    def __init__(self, path: str):
        path = path.replace("file:///", "/", 1) if path.startswith("file:///") else path.replace("file:/", "/", 1) if path.startswith("file:/") else path
        self.fs, self.root = (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)
        self.root = self.root.rstrip("/")

    def get(self, key: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{key}", compression=None) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, key: str, data: bytes) -> None:
        full = f"{self.root}/{key}"
        self.fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(full, compression=None) as f:
            f.write(data)

    def move(self, key: str, to: str) -> None:
        self.fs.create_dir(f"{self.root}/{to}".rsplit("/", 1)[0], recursive=True)
        self.fs.move(f"{self.root}/{key}", f"{self.root}/{to}")

    def remove(self, key: str = "") -> None:
        with contextlib.suppress(FileNotFoundError):
            self.fs.delete_dir(f"{self.root}/{key}".rstrip("/"))

    def folders(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory)


# ---- compression


def _blosc(raw: bytes) -> bytes:
    """A Blosc 1 frame of LZ4, zlib or Zstandard blocks, with or without byte shuffle."""
    _, _, flags, size, total, block, _ = struct.unpack_from("<BBBBIII", raw)
    if flags & 2:  # stored as it is
        return raw[16 : 16 + total]
    if flags & 4:
        raise ValueError("bit-shuffled Blosc chunks are not read")
    unpack = {1: pa.Codec("lz4_raw").decompress, 3: lambda b, n: zlib.decompress(b), 4: lambda b, n: _zstd(b)}.get(flags >> 5)
    if unpack is None:
        raise ValueError(f"Blosc codec {flags >> 5} is not read")
    out = bytearray()
    for k in range(-(-total // block) if block else 0):
        length = min(block, total - k * block)
        (at,) = struct.unpack_from("<i", raw, 16 + 4 * k)
        # a whole block is split into one stream for each byte of an item, unless flag 16 says otherwise
        streams = size if not flags & 16 and 1 < size <= 16 and length == block and block // size >= 128 else 1
        part = bytearray()
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", raw, at)
            data = raw[at + 4 : at + 4 + n]
            part += data if n == length // streams else bytes(unpack(data, length // streams))
            at += 4 + n
        if flags & 1 and size > 1:
            whole = length - length % size
            items = np.frombuffer(bytes(part[:whole]), np.uint8).reshape(size, -1)
            part = items.T.tobytes() + bytes(part[whole:])
        out += part
    return bytes(out)


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _zstd_pack(raw: bytes, level: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


UNPACK = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": _zstd, "blosc": _blosc}
PACK = {"zlib": zlib.compress, "gzip": gzip.compress, "zstd": _zstd_pack}


# ---- metadata


@dataclass(frozen=True)
class Array:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: object = None
    order: str = "C"
    compressor: dict | None = None
    separator: str = "."
    attrs: dict = field(default_factory=dict)

    def decode(self, raw: bytes | None) -> np.ndarray:
        """A chunk's items; edge chunks are stored whole."""
        if raw is None:
            return np.full(self.chunks, self.fill_value(), self.dtype)
        if self.compressor:
            raw = UNPACK[self.compressor["id"]](raw)
        return np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.order)

    def pack(self, items: np.ndarray) -> bytes:
        data = items.tobytes(self.order)
        return PACK[self.compressor["id"]](data, self.compressor.get("level", 1)) if self.compressor else data

    def fill_value(self):
        if isinstance(self.fill, str) and self.dtype[1] == "f":
            return float(self.fill.replace("Infinity", "inf"))
        if isinstance(self.fill, str) and self.dtype[1] == "S":
            return base64.b64decode(self.fill)
        return 0 if self.fill is None else self.fill

    def read(self, store: Store, box: Sequence[tuple[int, int]]) -> np.ndarray:
        """The items of a box (start and stop along each dimension), from the chunks that it touches."""
        out = np.empty([b - a for a, b in box], self.dtype)
        for at in itertools.product(*(range(a // c, -(-b // c)) for (a, b), c in zip(box, self.chunks, strict=True))):
            chunk = self.decode(store.get(f"{self.name}/{self.separator.join(map(str, at)) or '0'}"))
            have = [(max(a, k * c), min(b, (k + 1) * c)) for (a, b), k, c in zip(box, at, self.chunks, strict=True)]
            to = tuple(slice(a - o, b - o) for (a, b), (o, _) in zip(have, box, strict=True))
            out[to] = chunk[tuple(slice(a - k * c, b - k * c) for (a, b), k, c in zip(have, at, self.chunks, strict=True))]
        return out


def _array(name: str, about: dict, attrs: dict) -> Array:
    if about["zarr_format"] != 2 or about.get("filters"):
        raise ValueError(f"{name}: only arrays of Zarr format 2 without filters are read")
    if not isinstance(about["dtype"], str) or about["dtype"][1] == "O":
        raise ValueError(f"{name}: items of type {about['dtype']} are not read")
    if about["compressor"] and about["compressor"]["id"] not in UNPACK:
        raise ValueError(f"{name}: compressor {about['compressor']['id']} is not read")
    dims = tuple(attrs.get("_ARRAY_DIMENSIONS", ()))
    if len(dims) != len(about["shape"]):
        raise ValueError(f"{name}: its dimensions have no names")
    return Array(name, dims, tuple(about["shape"]), tuple(about["chunks"]), about["dtype"], about["fill_value"], about["order"], about["compressor"], about.get("dimension_separator", "."), attrs)


class Cube:
    """The arrays of a store and the labels of its dimensions."""

    def __init__(self, path: str):
        self.store, self.path = Store(path), path
        whole = self.store.get(".zmetadata")
        if whole is not None:
            about = json.loads(whole)["metadata"]
        elif self.store.get(".zgroup") is not None:
            keys = [f"{n}/{k}" for n in self.store.folders() for k in (".zarray", ".zattrs")]
            about = {k: json.loads(raw) for k in keys if (raw := self.store.get(k)) is not None}
        else:
            raise FileNotFoundError(f"{path} is no Zarr store")
        self.arrays: dict[str, Array] = {}
        self.unread: dict[str, str] = {}
        for key in about:
            if key.endswith("/.zarray"):
                name = key.removesuffix("/.zarray")
                try:
                    self.arrays[name] = _array(name, about[key], about.get(f"{name}/.zattrs", {}))
                except ValueError as e:  # another array's matter until it is asked for
                    self.unread[name] = str(e)
        self._labels: dict[str, np.ndarray] = {}

    def variables(self) -> list[str]:
        """Arrays that are no labels of a dimension."""
        return [n for n, a in self.arrays.items() if a.dims != (n,) and a.dims]

    def dims(self, variables: Sequence[str]) -> dict[str, int]:
        """Dimensions of the variables together and their sizes, those of the largest variable first."""
        for v in variables:
            if v not in self.arrays:
                raise KeyError(self.unread.get(v, f"{v} is not in {self.path}"))
        by_size = sorted((self.arrays[v] for v in variables), key=lambda a: -len(a.dims))
        return {d: n for a in by_size for d, n in zip(a.dims, a.shape, strict=True)}

    def labels(self, dim: str) -> np.ndarray:
        """datetime64[us], int64, float64 or text; positions where the store has no labels."""
        if dim not in self._labels:
            a = self.arrays.get(dim)
            if a is None or a.dims != (dim,):
                if dim in self.unread:
                    raise ValueError(self.unread[dim])
                n = next(s for b in self.arrays.values() for d, s in zip(b.dims, b.shape, strict=True) if d == dim)
                self._labels[dim] = np.arange(n)
            else:
                self._labels[dim] = _decoded_labels(a, a.read(self.store, [(0, a.shape[0])]))
        return self._labels[dim]

    def schema(self, variables: Sequence[str]) -> T.StructType:
        fields = [T.StructField(d, _label_type(self.labels(d)), False) for d in self.dims(variables)]
        return T.StructType(fields + [T.StructField(v, _item_type(self.arrays[v]), True, {"dims": list(self.arrays[v].dims)}) for v in variables])


def _decoded_labels(a: Array, raw: np.ndarray) -> np.ndarray:
    units = a.attrs.get("units", "")
    kind = a.dtype[1]
    if kind == "M":
        return raw.astype("datetime64[us]")
    if kind == "m":
        return _hours(raw.astype("timedelta64[us]").astype(np.int64), a.name)
    unit, _, since = units.partition(" since ")
    step = UNITS.get(unit.strip().rstrip("s"))
    if step and since:
        start = datetime.fromisoformat(since.strip().removesuffix(" UTC"))
        start = start.astimezone(UTC).replace(tzinfo=None) if start.tzinfo else start
        past = np.round(raw.astype(np.float64) * step) if kind == "f" else raw.astype(np.int64) * step
        return np.datetime64(start, "us") + past.astype("timedelta64[us]")
    if step:
        return _hours(np.round(raw.astype(np.float64) * step).astype(np.int64), a.name)
    if kind == "f":
        return raw.astype(np.float64)
    if kind in "iu":
        return raw.astype(np.int64)
    return np.char.decode(raw, "utf-8") if kind == "S" else raw


def _hours(us: np.ndarray, name: str) -> np.ndarray:
    if (us % UNITS["hour"]).any():
        raise ValueError(f"{name} holds parts of hours")
    return us // UNITS["hour"]


def _label_type(labels: np.ndarray) -> T.DataType:
    return {"M": T.TimestampNTZType(), "i": T.LongType(), "f": T.DoubleType(), "U": T.StringType(), "b": T.BooleanType()}[labels.dtype.kind]


def _item_type(a: Array) -> T.DataType:
    if "scale_factor" in a.attrs or "add_offset" in a.attrs:
        return T.DoubleType()
    kind, size = a.dtype[1], int(a.dtype[2:])
    if kind == "f":
        return T.FloatType() if size <= 4 else T.DoubleType()
    if kind in "iub":
        return T.BooleanType() if kind == "b" else T.LongType() if size == 8 or (kind, size) == ("u", 4) else T.IntegerType()
    raise ValueError(f"{a.name}: items of type {a.dtype} are not read")


# ---- reading


@dataclass
class Boxes(InputPartition):
    boxes: list[tuple[tuple[int, int], ...]]


class CubeReader(DataSourceReader):
    """Reads the arrays of a cube, whatever they are stored in, by boxes of their chunks."""

    def __init__(self, cube: Cube, schema: T.StructType):
        self.cube, self.schema = cube, schema
        self.variables = [f.name for f in schema.fields if f.name in self.cube.arrays and self.cube.arrays[f.name].dims != (f.name,)]
        self.dims = list(self.cube.dims(self.variables))
        self.kept = {d: np.ones(len(self.cube.labels(d)), bool) for d in self.dims}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        compare = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
        for f in filters:
            dim = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if dim in self.kept and type(f) in compare:
                self.kept[dim] &= compare[type(f)](self.cube.labels(dim), _constant(f.value))
            elif dim in self.kept and isinstance(f, In):
                self.kept[dim] &= np.logical_or.reduce([self.cube.labels(dim) == _constant(v) for v in f.value if v is not None] or [np.zeros(len(self.kept[dim]), bool)])
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Chunks of the largest variable with a label that is wanted, small neighbours together."""
        main = self.cube.arrays[max(self.variables, key=lambda v: len(self.cube.arrays[v].dims))]
        size = dict(zip(main.dims, main.chunks, strict=True))
        along = []
        for d in self.dims:
            n, c = len(self.kept[d]), size.get(d, len(self.kept[d]) or 1)
            along.append([(a, min(n, a + c)) for a in range(0, n, c) if self.kept[d][a : a + c].any()])
        out: list[Boxes] = []
        cells = CELLS
        for box in itertools.product(*along):
            if cells >= CELLS:
                out.append(Boxes([]))
                cells = 0
            out[-1].boxes.append(box)
            cells += math.prod(b - a for a, b in box)
        return out or [Boxes([])]

    def read(self, partition: Boxes) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        for box in partition.boxes:
            inside = [np.flatnonzero(self.kept[d][a:b]) for d, (a, b) in zip(self.dims, box, strict=True)]
            shape = [len(x) for x in inside]
            labels = {d: self.cube.labels(d)[a:b][x] for d, (a, b), x in zip(self.dims, box, inside, strict=True)}
            values = {v: self._items(v, box, inside) for v in self.variables if v in names}
            for start in range(0, math.prod(shape), BATCH):
                at = dict(zip(self.dims, np.unravel_index(np.arange(start, min(start + BATCH, math.prod(shape))), shape), strict=True))
                columns = {d: pa.array(labels[d][at[d]]) for d in self.dims if d in names}
                for v, (items, missing) in values.items():
                    here = tuple(at[d] for d in self.cube.arrays[v].dims)
                    columns[v] = pa.array(items[here], mask=missing[here] if missing is not None else None)
                yield pa.RecordBatch.from_arrays([columns[n].cast(_arrow(f.dataType)) for n, f in zip(names, self.schema.fields, strict=True)], names)

    def _items(self, name: str, box: Sequence[tuple[int, int]], inside: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        a = self.cube.arrays[name]
        at = [self.dims.index(d) for d in a.dims]
        items = a.read(self.cube.store, [box[k] for k in at])[np.ix_(*(inside[k] for k in at))]
        marks = [a.attrs[k] for k in ("_FillValue", "missing_value") if isinstance(a.attrs.get(k), (int, float))]
        missing = np.logical_or.reduce([items == m for m in marks]) if marks else None
        if "scale_factor" in a.attrs or "add_offset" in a.attrs:
            items = items * float(a.attrs.get("scale_factor", 1)) + float(a.attrs.get("add_offset", 0))
        return items.astype(items.dtype.newbyteorder("="), copy=False), missing


def _constant(value):
    return np.datetime64(value.replace(tzinfo=None), "us") if isinstance(value, datetime) else float(value) if hasattr(value, "as_tuple") else value


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.TimestampNTZType(): pa.timestamp("us"), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.FloatType(): pa.float32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[kind]


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """Rows arrive by whole chunks, in order of their number, and leave as files: first below a folder of the attempt, and in their place once all of a task's are there.

    A task that is run again writes the same bytes to the same places. Metadata come last, so a job that fails leaves no store.
    """

    def __init__(self, path: str, arrays: list[Array]):
        self.path, self.arrays = path, arrays

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, attempt = Store(self.path), uuid.uuid4().hex
        made: list[str] = []
        held: list[pa.RecordBatch] = []
        now = None
        for batch in iterator:
            number = batch.column("__chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if held and number[a] != now:
                    made += self._chunk(store, attempt, int(now), held)
                    held = []
                now = number[a]
                held.append(batch.slice(a, b - a))
        if held:
            made += self._chunk(store, attempt, int(now), held)
        for key in made:
            store.move(f"{STAGING}/{attempt}/{key}", key)
        store.remove(f"{STAGING}/{attempt}")
        return Written(len(made))

    def _chunk(self, store: Store, attempt: str, number: int, batches: list[pa.RecordBatch]) -> list[str]:
        rows = pa.Table.from_batches(batches)
        cell = rows.column("__cell").to_numpy()
        if len(np.unique(cell)) != len(cell):
            raise ValueError("two rows have the labels of one cell")
        keys = []
        for a in self.arrays:
            grid = [-(-n // c) for n, c in zip(a.shape, a.chunks, strict=True)]
            items = np.full(math.prod(a.chunks), np.nan, a.dtype)
            items[cell] = rows.column(a.name).to_numpy().astype(a.dtype)
            key = f"{a.name}/{a.separator.join(str(k) for k in np.unravel_index(number, grid))}"
            store.put(f"{STAGING}/{attempt}/{key}", a.pack(items))
            keys.append(key)
        return keys

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store = Store(self.path)
        store.remove(STAGING)
        about = json.loads(store.get(".zpending"))
        for key, text in about["metadata"].items():
            store.put(key, json.dumps(text).encode())
        store.put(".zmetadata", json.dumps(about).encode())
        store.fs.delete_file(f"{store.root}/.zpending")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Store(self.path).remove()


class Zarr(DataSource):
    """Options: path; variables (comma-separated; all that are no labels, if unset)."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> T.StructType:
        cube = Cube(self.options["path"])
        chosen = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()] or cube.variables()
        return cube.schema(chosen)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CubeReader(Cube(self.options["path"]), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        about = json.loads(Store(self.options["path"]).get(".zpending"))["metadata"]
        pieces = self.options.get("pieces") == "true"
        names = self.options["variables"].split(",") if pieces else [f.name for f in schema.fields if not f.name.startswith("__")]
        return (PieceWriter if pieces else ZarrWriter)(self.options["path"], [_array(n, about[f"{n}/.zarray"], about[f"{n}/.zattrs"]) for n in names])


def register(spark: SparkSession) -> None:
    """Make format("zarr") known to a session and let filters reach it."""
    spark.dataSource.register(Zarr)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_zarr(spark: SparkSession, path: str, variables: Sequence[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("zarr")
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


class PieceWriter(ZarrWriter):
    """As ZarrWriter, of pieces of chunks (see rechunk): a chunk is put together from its pieces."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, attempt = Store(self.path), uuid.uuid4().hex
        by_name = {a.name: a for a in self.arrays}
        made: list[str] = []
        now, items = None, np.empty(0)
        for batch in iterator:
            for name, number, at, data in zip(*(batch.column(c) for c in ("array", "chunk", "at", "data")), strict=True):
                key, a = (name.as_py(), number.as_py()), by_name[name.as_py()]
                if key != now:
                    made += self._put(store, attempt, by_name, now, items)
                    now, items = key, np.full(a.chunks, a.fill_value(), a.dtype)
                corner, size = (tuple(at.as_py()[k :: 2]) for k in (0, 1))
                items[tuple(slice(c, c + n) for c, n in zip(corner, size, strict=True))] = np.frombuffer(data.as_buffer(), a.dtype).reshape(size)
        made += self._put(store, attempt, by_name, now, items)
        for key in made:
            store.move(f"{STAGING}/{attempt}/{key}", key)
        store.remove(f"{STAGING}/{attempt}")
        return Written(len(made))

    def _put(self, store: Store, attempt: str, arrays: dict[str, Array], which: tuple[str, int] | None, items: np.ndarray) -> list[str]:
        if which is None:
            return []
        a = arrays[which[0]]
        grid = [-(-n // c) for n, c in zip(a.shape, a.chunks, strict=True)]
        key = f"{a.name}/{a.separator.join(str(k) for k in np.unravel_index(which[1], grid))}"
        store.put(f"{STAGING}/{attempt}/{key}", a.pack(items))
        return [key]


def encoded(dim: str, labels: list) -> tuple[np.ndarray, dict]:
    """Labels as they are stored, and their attributes."""
    if isinstance(labels[0], datetime):
        hours = [(x - labels[0]).total_seconds() / 3600 for x in labels]
        whole = all(h == int(h) for h in hours)
        unit, items = ("hours", hours) if whole else ("microseconds", [(x - labels[0]) / (datetime.resolution) for x in labels])
        return np.array(items, "<i8"), {"units": f"{unit} since {labels[0].isoformat(' ')}", "calendar": "proleptic_gregorian"}
    a = np.asarray(labels)
    if dim in ("lead_hours", "prediction_timedelta"):
        return a.astype("<i8"), {"units": "hours"}
    return a.astype({"i": "<i8", "f": "<f8"}.get(a.dtype.kind, f"<U{max(a.dtype.itemsize // 4, 1)}")), {}


def write_zarr(df: DataFrame, path: str, dims: Sequence[str], chunks: dict[str, int] | None = None, compressor: str | None = "zlib", attrs: dict | None = None) -> None:
    """Write a cube: a row per cell, the dimensions in this order, every other column a variable of doubles.

    chunks: labels of a dimension that a chunk spans (all, where it is not named). A row that is missing is NaN; labels are sorted. Two rows for one
    cell raise, as does a path where something is stored already. The labels of each axis reach the driver; cells are shuffled once, by chunk.
    """
    spark = df.sparkSession
    register(spark)
    store = Store(path)
    if store.get(".zmetadata") is not None or store.get(".zgroup") is not None:
        raise FileExistsError(path)
    variables = [c for c in df.columns if c not in dims]
    axes = {d: sorted(r[0] for r in df.select(d).distinct().limit(AXIS_LABELS + 1).collect()) for d in dims}
    for d, labels in axes.items():
        if len(labels) > AXIS_LABELS or not labels or labels[0] is None:
            raise ValueError(f"{d} is no axis: it has no labels, a null among them or more than {AXIS_LABELS}")
    shape = [len(axes[d]) for d in dims]
    size = [min((chunks or {}).get(d, n), n) for d, n in zip(dims, shape, strict=True)]
    grid = [-(-n // c) for n, c in zip(shape, size, strict=True)]
    packed = {"id": compressor, "level": 1} if compressor else None
    about: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": attrs or {}}

    def describe(name: str, dtype: str, shape: list[int], chunks: list[int], dims: list[str], fill, more: dict) -> None:
        about[f"{name}/.zarray"] = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": packed, "fill_value": fill, "order": "C", "filters": None}
        about[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims} | more

    for d, labels in axes.items():
        items, more = encoded(d, labels)
        describe(d, items.dtype.str, [len(labels)], [len(labels)], [d], None, more)
        store.put(f"{d}/0", PACK[compressor](items.tobytes(), 1) if compressor else items.tobytes())
    for v in variables:
        describe(v, "<f8", shape, size, list(dims), "NaN", {})
    store.put(".zpending", json.dumps({"zarr_consolidated_format": 1, "metadata": about}).encode())
    rows, number, cell = df, F.lit(0).cast("long"), F.lit(0).cast("long")
    for d, c, g in zip(dims, size, grid, strict=True):
        at = spark.createDataFrame([(x, k) for k, x in enumerate(axes[d])], T.StructType([df.schema[d], T.StructField(f"__at_{d}", T.LongType())]))
        rows = rows.join(F.broadcast(at), d)  # at most AXIS_LABELS rows
        number, cell = number * g + F.expr(f"`__at_{d}` div {c}"), cell * c + F.col(f"__at_{d}") % c
    rows = rows.select(number.alias("__chunk"), cell.alias("__cell"), *(F.col(v).cast("double").alias(v) for v in variables))
    rows.repartition("__chunk").sortWithinPartitions("__chunk").write.format("zarr").mode("append").save(path)
