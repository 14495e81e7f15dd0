"""netCDF files of the classic formats (CDF-1, CDF-2 with long offsets, CDF-5), read and written without a library.

    register(spark)
    spark.read.format("netcdf").option("variables", "t2m").load("era5.nc").where("latitude > 0")

Rows, labels, times, missing values and filters are those of sources.zarr. A task reads a range of a variable's first dimension (of its records, if that
dimension is unlimited) by its bytes; ranges without a wanted label are not read. Files of the newer format, which is HDF5, raise.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from skillcube.sources.zarr import CELLS, Array, Cube, CubeReader, Store, encoded

#: Fixed values of the format: types of items by their number, and the tags of the header's lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Cells of a result that is written as one file.
MOST_CELLS = 1 << 24


@dataclass(frozen=True)
class Ranges(Array):
    """A variable: begin is its first byte; step the bytes from one record to the next, 0 without records."""

    begin: int = 0
    step: int = 0

    def read(self, store: Store, box: Sequence[tuple[int, int]]) -> np.ndarray:
        if not self.shape:
            return np.frombuffer(_bytes(store, self.begin, np.dtype(self.dtype).itemsize), self.dtype)[0]
        (a, b), inner = box[0], self.shape[1:]
        row = math.prod(inner) * np.dtype(self.dtype).itemsize
        if not self.step or self.step == row:
            items = np.frombuffer(_bytes(store, self.begin + a * row, (b - a) * row), self.dtype)
        else:
            items = np.concatenate([np.frombuffer(_bytes(store, self.begin + k * self.step, row), self.dtype) for k in range(a, b)] or [np.zeros(0, self.dtype)])
        return items.reshape(b - a, *inner)[(slice(None), *(slice(x, y) for x, y in box[1:]))]


def _bytes(store: Store, at: int, n: int) -> bytes:
    with store.fs.open_input_file(store.root) as f:
        f.seek(at)
        found = f.read(n)
    if len(found) != n:
        raise ValueError(f"{store.root} ends before its data do")
    return found


class _Header:
    """Reads the header's parts in turn, more bytes of the file as they are needed."""

    def __init__(self, store: Store):
        self.store, self.at, self.held = store, 0, b""
        self.size = store.fs.get_file_info(store.root).size or 0
        magic = self.take(4)
        if magic[:4] == b"\x89HDF":
            raise ValueError(f"{store.root} is of the newer netCDF format (HDF5), which is not read")
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{store.root} is no netCDF file of a classic format")
        self.wide, self.far = magic[3] == 5, magic[3] != 1

    def take(self, n: int) -> bytes:
        while len(self.held) < self.at + n:
            more = min(self.size - len(self.held), max(1 << 16, n))
            if more <= 0:
                raise ValueError(f"{self.store.root} ends within its header")
            self.held += _bytes(self.store, len(self.held), more)
        self.at += n
        return self.held[self.at - n : self.at]

    def whole(self, wide: bool | None = None) -> int:
        return struct.unpack(">q" if (self.wide if wide is None else wide) else ">I", self.take(8 if (self.wide if wide is None else wide) else 4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        return self.padded(self.whole()).decode()

    def count(self, tag: int) -> int:
        found, n = self.whole(False), self.whole()
        if found not in (0, tag):
            raise ValueError(f"{self.store.root} has no list {tag} where one belongs")
        return n if found else 0

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.count(ATTRIBUTE)):
            name, kind, n = self.name(), self.whole(False), self.whole()
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            items = np.frombuffer(raw, TYPES[kind])
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else items[0].item() if n == 1 else items.tolist()
        return out


class File(Cube):
    """A file's variables and the labels of its dimensions."""

    def __init__(self, path: str):
        self.store, self.path, self._labels, self.unread = Store(path), path, {}, {}
        h = _Header(self.store)
        records = h.whole()
        dims = [(h.name(), h.whole()) for _ in range(h.count(DIMENSION))]
        self.attrs = h.attributes()
        found = []
        for _ in range(h.count(VARIABLE)):
            name = h.name()
            at = [h.whole() for _ in range(h.whole())]
            attrs, kind = h.attributes(), h.whole(False)
            h.whole()  # its size, which may be cut short and follows from the dimensions
            found.append((name, at, attrs, kind, h.whole(h.far)))
        in_records = [f for f in found if f[1] and dims[f[1][0]][1] == 0]
        of_records = {f[0] for f in in_records}
        size = lambda f: math.prod(dims[d][1] or 1 for d in f[1]) * np.dtype(TYPES[f[3]]).itemsize  # noqa: E731  of one record, or of all
        step = sum(-(-size(f) // 4) * 4 for f in in_records) if len(in_records) > 1 else sum(map(size, in_records))  # a single one is not padded
        if in_records and records == (1 << 64) - 1 >> (0 if h.wide else 32) or records == -1:  # written as a stream: the file's length tells
            records = (h.size - min(f[4] for f in in_records)) // step
        self.arrays = {}
        for f in found:
            name, at, attrs, kind, begin = f
            shape = tuple(records if dims[d][1] == 0 else dims[d][1] for d in at)
            names = tuple(dims[d][0] for d in at)
            if TYPES[kind] == "S1" and shape:  # texts: the last dimension counts characters
                self.unread[name] = f"{name}: texts are not read"
                continue
            rows = max(1, min(shape[0], CELLS // max(1, math.prod(shape[1:])))) if shape else 1
            self.arrays[name] = Ranges(name, names, shape, (rows, *shape[1:]) if shape else (), TYPES[kind], attrs.get("_FillValue"), attrs=attrs, begin=begin, step=step if name in of_records else 0)


class NetCDF(DataSource):
    """Options: path; variables (comma-separated; all that are no labels, if unset)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> T.StructType:
        file = File(self.options["path"])
        return file.schema([v.strip() for v in self.options.get("variables", "").split(",") if v.strip()] or file.variables())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CubeReader(File(self.options["path"]), schema)


def register(spark: SparkSession) -> None:
    """Make format("netcdf") known to a session and let filters reach it."""
    spark.dataSource.register(NetCDF)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_netcdf(spark: SparkSession, path: str, variables: Sequence[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("netcdf")
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


def _text(x: str) -> bytes:
    raw = x.encode()
    return struct.pack(">I", len(raw)) + raw + bytes(-len(raw) % 4)


def _attributes(attrs: dict) -> bytes:
    out = struct.pack(">II", ATTRIBUTE if attrs else 0, len(attrs))
    for k, v in attrs.items():
        raw = v.encode() if isinstance(v, str) else struct.pack(">d", v)
        out += _text(k) + struct.pack(">II", 2 if isinstance(v, str) else 6, len(raw) if isinstance(v, str) else 1) + raw + bytes(-len(raw) % 4)
    return out


def write_netcdf(df: DataFrame, path: str, dims: Sequence[str], attrs: dict | None = None, most: int = MOST_CELLS) -> None:
    """Write a result cube as one CDF-2 file of doubles; the first dimension is the unlimited one.

    A file has one writer, the driver, so more than `most` cells raise: larger cubes are stores (sources.zarr). Labels are sorted; texts are numbered and
    spelled out in the attribute `labels` (one to a line). A missing row or value is NaN. Two rows for one cell raise.
    """
    store = Store(path)
    values = [c for c in df.columns if c not in dims]
    axes = {d: sorted(r[0] for r in df.select(d).distinct().limit(most + 1).collect()) for d in dims}
    shape = [len(axes[d]) for d in dims]
    if math.prod(shape) * len(values) > most:
        raise ValueError(f"{math.prod(shape)} cells of {len(values)} variables are beyond one file; write a store")
    if any(x is None for labels in axes.values() for x in labels) or not all(shape):
        raise ValueError("a dimension has no labels or a null among them")
    rows = df.select(*dims, *(F.col(v).cast("double") for v in values)).toPandas()
    at = tuple(np.searchsorted(np.array(axes[d]), rows[d].to_numpy(dtype=np.array(axes[d]).dtype)) for d in dims)
    flat = np.ravel_multi_index(at, shape)
    if len(np.unique(flat)) != len(flat):
        raise ValueError("two rows have the labels of one cell")
    arrays: list[tuple[str, list[int], np.ndarray, dict]] = []
    for k, d in enumerate(dims):
        items, more = encoded(d, axes[d])
        if items.dtype.kind == "U":
            items, more = np.arange(len(items)), {"labels": "\n".join(axes[d])}
        arrays.append((d, [k], items.astype(">f8"), more))
    for v in values:
        box = np.full(math.prod(shape), np.nan)
        box[flat] = rows[v].to_numpy(dtype=float)
        arrays.append((v, list(range(len(dims))), box.reshape(shape).astype(">f8"), {"_FillValue": float("nan")}))
    listed = b"".join(_text(d) + struct.pack(">I", 0 if k == 0 else n) for k, (d, n) in enumerate(zip(dims, shape, strict=True)))
    head = b"CDF\x02" + struct.pack(">I", shape[0]) + struct.pack(">II", DIMENSION, len(dims)) + listed + _attributes(attrs or {}) + struct.pack(">II", VARIABLE, len(arrays))
    about = [(_text(name) + struct.pack(">I", len(ds)) + struct.pack(f">{len(ds)}I", *ds) + _attributes(more), ds, items) for name, ds, items, more in arrays]
    start = len(head) + sum(len(a) + 16 for a, _, _ in about)  # type, size and begin follow each
    fixed, in_records = [x for x in about if x[1][0] != 0], [x for x in about if x[1][0] == 0]
    first = {id(x) for x in fixed}
    begins, offset = {}, start
    for x in fixed:
        begins[id(x)] = offset
        offset += x[2].nbytes
    for x in in_records:
        begins[id(x)] = offset
        offset += x[2][0].nbytes
    for x in about:
        head += x[0] + struct.pack(">II", 6, min((x[2] if id(x) in first else x[2][0]).nbytes, (1 << 32) - 4)) + struct.pack(">q", begins[id(x)])
    body = b"".join(x[2].tobytes() for x in fixed) + b"".join(x[2][k : k + 1].tobytes() for k in range(shape[0]) for x in in_records)
    folder, _, name = store.root.rpartition("/")
    Store(folder or "/").put(name, head + body)
