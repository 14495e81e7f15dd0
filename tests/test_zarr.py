"""Zarr stores: what is written is read, only chunks with wanted labels are opened, and failures leave no store."""

import json
import struct
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillcube.sources import zarr

DIMS = ["time", "level", "latitude", "longitude"]
SIZES = {"time": 6, "level": 3, "latitude": 4, "longitude": 5}


@pytest.fixture
def cube(spark):
    """6 times, 3 levels, 4 x 5 cells; t counts cells, u is its half with a missing row."""
    rows = []
    for i, at in enumerate(np.ndindex(*SIZES.values())):
        rows.append((datetime(2020, 1, 1) + timedelta(hours=6 * at[0]), [500, 700, 850][at[1]], -30.0 + 20 * at[2], 72.0 * at[3], float(i), i / 2 if i != 17 else None))
    return spark.createDataFrame(rows, "time timestamp_ntz, level long, latitude double, longitude double, t double, u double")


def rows(df):
    return sorted(tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in df.select(*DIMS, "t", "u").collect())


def spoil(path, keep):
    """Make every chunk of t unreadable but those kept."""
    for f in Path(path, "t").iterdir():
        if not f.name.startswith(".") and f.name not in keep:
            f.write_bytes(b"spoilt")


@pytest.mark.parametrize("compressor", ["zlib", "zstd", None])
def test_what_is_written_is_read(spark, cube, tmp_path, compressor):
    path = f"{tmp_path}/a.zarr"
    zarr.write_zarr(cube, path, DIMS, {"time": 4, "level": 1, "longitude": 3}, compressor)
    out = zarr.read_zarr(spark, path)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["timestamp_ntz", "bigint", "double", "double", "double", "double"]
    assert rows(out) == rows(cube)
    assert not Path(path, zarr.STAGING).exists() and not Path(path, ".zpending").exists()
    assert json.loads(Path(path, "t/.zarray").read_text())["chunks"] == [4, 1, 4, 3]


def test_only_chunks_with_wanted_labels_are_opened(spark, cube, tmp_path):
    path = f"file://{tmp_path}/a.zarr"
    zarr.write_zarr(cube, path, DIMS, {"time": 2, "level": 1})
    where = "time >= TIMESTAMP_NTZ'2020-01-01 12:00:00' AND time < TIMESTAMP_NTZ'2020-01-02 00:00:00' AND level IN (500, 850) AND latitude > -20 AND longitude = 144.0"
    want = [tuple(r) for r in cube.where(where).select(*DIMS, "t").orderBy(*DIMS).collect()]
    spoil(f"{tmp_path}/a.zarr", {"1.0.0.0", "1.2.0.0"})
    got = zarr.read_zarr(spark, path, ["t"]).where(where)
    assert [tuple(r) for r in got.orderBy(*DIMS).collect()] == want and len(want) == 2 * 2 * 3
    with pytest.raises(Exception, match="incorrect header check"):
        zarr.read_zarr(spark, path, ["t"]).count()


def test_partitions_are_chunks(spark, cube, tmp_path, monkeypatch):
    path = f"{tmp_path}/a.zarr"
    zarr.write_zarr(cube, path, DIMS, {"time": 2, "level": 1})
    monkeypatch.setattr(zarr, "CELLS", 1)
    schema = zarr.Cube(path).schema(["t"])
    reader = zarr.CubeReader(zarr.Cube(path), schema)
    assert len(reader.partitions()) == 9
    left = list(reader.pushFilters([zarr.EqualTo(("level",), 700), zarr.GreaterThan(("time",), datetime(2020, 1, 1, 18)), zarr.LessThan(("t",), 5.0)]))
    assert left == [zarr.LessThan(("t",), 5.0)] and [p.boxes for p in reader.partitions()] == [[((4, 6), (1, 2), (0, 4), (0, 5))]]
    monkeypatch.setattr(zarr, "CELLS", 100)
    assert len(zarr.CubeReader(zarr.Cube(path), schema).partitions()) == 3
    assert list(zarr.CubeReader(zarr.Cube(path), schema).pushFilters([zarr.In(("level",), (1,))])) == []


def test_nothing_wanted(spark, cube, tmp_path):
    path = f"{tmp_path}/a.zarr"
    zarr.write_zarr(cube, path, DIMS)
    assert zarr.read_zarr(spark, path).where("level = 1").collect() == []


def store(path, arrays):
    """A store as other programs write them. arrays: name -> (items, dims, chunks, compressor, pack, more of .zarray, attributes)."""
    for name, (items, dims, chunks, compressor, pack, more, attrs) in arrays.items():
        folder = Path(path, name)
        folder.mkdir(parents=True)
        about = {"zarr_format": 2, "shape": items.shape, "chunks": chunks, "dtype": items.dtype.str, "compressor": compressor, "fill_value": None, "order": "C", "filters": None} | more
        (folder / ".zarray").write_text(json.dumps(about))
        (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims} | attrs))
        for at in np.ndindex(*(-(-n // c) for n, c in zip(items.shape, chunks, strict=True))):
            whole = np.zeros(chunks, items.dtype)
            part = items[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks, strict=True))]
            whole[tuple(slice(0, n) for n in part.shape)] = part
            file = folder / more.get("dimension_separator", ".").join(map(str, at))
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(pack(whole.tobytes(more.get("order", "C"))))
    Path(path, ".zgroup").write_text('{"zarr_format": 2}')


def blosc(raw, size=4, block=2048, codec=1):
    """A Blosc frame: shuffled, split blocks of LZ4 or zlib streams."""
    pack = {1: lambda b: bytes(pa.Codec("lz4_raw").compress(b)), 3: zlib.compress}[codec]
    starts, body = [], b""
    n = -(-len(raw) // block)
    for k in range(n):
        part = np.frombuffer(raw[k * block : (k + 1) * block], np.uint8).reshape(-1, size).T.tobytes()
        streams = size if len(part) == block else 1
        starts.append(16 + 4 * n + len(body))
        for s in range(streams):
            one = part[s * len(part) // streams : (s + 1) * len(part) // streams]
            packed = pack(one)
            packed = one if len(packed) >= len(one) else packed
            body += struct.pack("<i", len(packed)) + packed
    return struct.pack("<BBBBIII", 2, 1, 1 | codec << 5, size, len(raw), block, 16 + 4 * n + len(body)) + struct.pack(f"<{n}i", *starts) + body


@pytest.mark.parametrize("codec", [1, 3])
def test_stores_of_other_programs(spark, tmp_path, codec):
    r = np.random.default_rng(1)
    t = np.round(r.normal(size=(5, 30, 40)), 1).astype("<f4")
    packed = r.integers(0, 100, (5, 30), dtype="<i2")
    plain = lambda b: b
    store(tmp_path / "s", {
        "t": (t, ["time", "lat", "lon"], (2, 30, 40), {"id": "blosc"}, lambda b: blosc(b, codec=codec), {"dimension_separator": "/"}, {}),
        "p": (packed, ["time", "lat"], (3, 7), None, plain, {"order": "F"}, {"scale_factor": 0.5, "add_offset": 1, "_FillValue": 7}),
        "time": (np.arange(5, dtype="<i4"), ["time"], (5,), None, plain, {}, {"units": "days since 2020-02-27", "calendar": "proleptic_gregorian"}),
        "lat": (np.linspace(-90, 90, 30), ["lat"], (30,), None, plain, {}, {}),
        "prediction_timedelta": (np.array([0, 6], "<i8"), ["prediction_timedelta"], (2,), None, plain, {}, {"units": "hours"}),
        "words": (np.array([1], "|i1"), ["x"], (1,), {"id": "odd"}, plain, {}, {}),
    })
    cube = zarr.Cube(str(tmp_path / "s"))
    assert list(cube.labels("prediction_timedelta")) == [0, 6] and cube.labels("time")[-1] == np.datetime64("2020-03-02", "us")
    out = zarr.read_zarr(spark, str(tmp_path / "s"), ["t", "p"]).toPandas().sort_values(["time", "lat", "lon"])
    assert (out.t.to_numpy().reshape(5, 30, 40) == t).all() and list(out.lon[:3]) == [0, 1, 2]
    p = out.p.to_numpy().reshape(5, 30, 40)
    assert np.array_equal(p, np.repeat(np.where(packed == 7, np.nan, packed * 0.5 + 1)[:, :, None], 40, 2), equal_nan=True)
    with pytest.raises(Exception, match="odd"):
        zarr.read_zarr(spark, str(tmp_path / "s"), ["words"]).collect()
    with pytest.raises(Exception, match="no Zarr store"):
        zarr.read_zarr(spark, str(tmp_path)).collect()


def test_a_chunk_that_is_not_stored_is_filled(spark, cube, tmp_path):
    path = f"{tmp_path}/a.zarr"
    zarr.write_zarr(cube.where("level <> 700 OR time > TIMESTAMP_NTZ'2020-01-01 06:00:00'"), path, DIMS, {"time": 2, "level": 1})
    assert not Path(path, "t/0.1.0.0").exists()
    got = zarr.read_zarr(spark, path, ["t"])
    assert got.count() == 360 and got.where(F.isnan("t")).count() == 40


def test_a_killed_task_leaves_no_chunk(spark, cube, tmp_path):
    path = f"{tmp_path}/a.zarr"
    twice = cube.unionByName(cube.where("t = 359"))
    with pytest.raises(Exception, match="two rows have the labels of one cell"):
        zarr.write_zarr(twice, path, DIMS, {"time": 2, "level": 1})
    assert not Path(path).exists()
    zarr.write_zarr(cube, path, DIMS)
    with pytest.raises(FileExistsError):
        zarr.write_zarr(cube, path, DIMS)
    with pytest.raises(ValueError, match="no axis"):
        zarr.write_zarr(cube.limit(0), f"{tmp_path}/b.zarr", DIMS)
