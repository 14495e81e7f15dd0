"""Classic netCDF files: round trips, files of other programs, and what is refused."""

import struct
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillcube.sources import netcdf

DIMS = ["time", "level", "latitude"]


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(datetime(2020, 1, 1) + timedelta(hours=6 * t), lv, 20.0 - 10.0 * a, float(t * 100 + lv + a), None if a == 1 else float(a)) for t in range(7) for lv in (500, 850) for a in range(3)]
    return spark.createDataFrame(rows, "time timestamp_ntz, level long, latitude double, x double, y double")


def test_round_trip(spark, cube, tmp_path):
    path = f"{tmp_path}/r.nc"
    netcdf.write_netcdf(cube, path, DIMS, {"title": "é"})
    out = netcdf.read_netcdf(spark, path)
    assert out.columns == [*DIMS, "x", "y"] and netcdf.File(path).attrs == {"title": "é"}
    number = lambda r: tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
    assert sorted(map(number, out.collect()), key=str) == sorted((number((r[0], float(r[1]), *r[2:])) for r in cube.collect()), key=str)
    some = out.where("level = 850 AND time > TIMESTAMP_NTZ'2020-01-02' AND latitude IN (0, 20)").select("x")
    assert sorted(r.x for r in some.collect()) == sorted(r.x for r in cube.where("level = 850 AND time > TIMESTAMP_NTZ'2020-01-02' AND latitude <> 10").collect())


def test_texts_are_numbered(spark, tmp_path):
    path = f"{tmp_path}/r.nc"
    netcdf.write_netcdf(spark.createDataFrame([("mse", 1.0), ("acc", 2.0)], "metric string, x double"), path, ["metric"])
    assert netcdf.File(path).arrays["metric"].attrs["labels"] == "acc\nmse"
    assert sorted(map(tuple, netcdf.read_netcdf(spark, path).collect())) == [(0.0, 2.0), (1.0, 1.0)]


def other(version, records, padded=True, stream=False):
    """A file as other programs write it: a record variable of shorts, one of floats, a fixed grid, a scalar and a text."""
    wide, far = version == 5, version != 1
    n = lambda k: struct.pack(">q" if wide else ">I", k)
    text = lambda s: n(len(s)) + s.encode() + bytes(-len(s) % 4)
    dims = struct.pack(">I", 10) + n(3) + text("time") + n(0) + text("lat") + n(3) + text("len") + n(4)
    att = struct.pack(">I", 12) + n(2) + text("scale_factor") + struct.pack(">I", 6) + n(1) + struct.pack(">d", 0.5) + text("_FillValue") + struct.pack(">I", 3) + n(1) + struct.pack(">hxx", -1)
    units = struct.pack(">I", 12) + n(1) + text("units") + struct.pack(">I", 2) + n(21) + b"days since 2000-02-28" + bytes(3)
    none = struct.pack(">I", 0) + n(0)
    short = [("t", [0, 1], att, 3, 6)] if padded else []
    variables = [("lat", [1], none, 5, 12), ("time", [0], units, 4, 4), *short, ("flag", [], none, 4, 4), ("word", [2], none, 2, 4)] if padded else [("t", [0, 1], att, 3, 6)]
    head = b"CDF" + bytes([version]) + (b"\xff" * (8 if wide else 4) if stream else n(records)) + dims + none + struct.pack(">I", 11) + n(len(variables))
    size = len(head) + sum(len(text(v[0])) + len(n(0)) * (1 + len(v[1])) + len(v[2]) + 4 + len(n(0)) + (8 if far else 4) for v in variables)
    fixed = [v for v in variables if 0 not in v[1]]
    begin, at = {}, size
    for v in fixed:
        begin[v[0]], at = at, at + v[4]
    for v in variables:
        if 0 in v[1]:
            begin[v[0]], at = at, at + (-(-v[4] // 4) * 4 if padded else v[4])
    for v in variables:
        head += text(v[0]) + n(len(v[1])) + b"".join(n(d) for d in v[1]) + v[2] + struct.pack(">I", v[3]) + n(v[4]) + struct.pack(">q" if far else ">I", begin[v[0]])
    body = b"".join({"lat": struct.pack(">3f", -1, 0, 1), "flag": struct.pack(">i", 9), "word": b"abcd"}[v[0]] for v in fixed)
    for r in range(records):
        for v in variables:
            if v[0] == "time":
                body += struct.pack(">i", r)
            elif v[0] == "t":
                body += struct.pack(">3h", 10 * r, -1 if r == 1 else 1, 2) + (b"\0\0" if padded else b"")
    return head + body


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("stream", [False, True])
def test_files_of_other_programs(spark, tmp_path, version, stream):
    Path(tmp_path, "a.nc").write_bytes(other(version, 4, stream=stream))
    got = netcdf.read_netcdf(spark, f"file://{tmp_path}/a.nc", ["t"])
    want = [(datetime(2000, 2, 28) + timedelta(days=r), lat, None if r == 1 and lat == 0 else v) for r in range(4) for lat, v in ((-1.0, 5.0 * r), (0.0, 0.5), (1.0, 1.0))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.where("lat > 0 AND time = TIMESTAMP_NTZ'2000-03-01'").select("t").collect() == [(1.0,)]
    with pytest.raises(Exception, match="texts are not read"):
        netcdf.read_netcdf(spark, f"{tmp_path}/a.nc", ["word"]).collect()


def test_a_single_record_variable_is_not_padded(spark, tmp_path):
    Path(tmp_path, "a.nc").write_bytes(other(1, 3, padded=False))
    got = netcdf.read_netcdf(spark, f"{tmp_path}/a.nc").orderBy("time", "lat").select("t").collect()
    assert [r.t for r in got] == [0.0, 0.5, 1.0, 5.0, None, 1.0, 10.0, 0.5, 1.0]


def test_what_is_refused(spark, cube, tmp_path):
    for raw, why in ((b"\x89HDF\r\n\x1a\n" + bytes(50), "newer"), (b"GRIB" + bytes(50), "no netCDF"), (other(2, 4)[:60], "ends within"), (other(2, 4)[:-20], "ends before")):
        Path(tmp_path, "b.nc").write_bytes(raw)
        with pytest.raises(Exception, match=why):
            netcdf.read_netcdf(spark, f"{tmp_path}/b.nc", ["t"]).collect()
    with pytest.raises(ValueError, match="beyond one file"):
        netcdf.write_netcdf(cube, f"{tmp_path}/c.nc", DIMS, most=10)
    with pytest.raises(ValueError, match="two rows"):
        netcdf.write_netcdf(cube.unionByName(cube.limit(1)), f"{tmp_path}/c.nc", DIMS)
    assert not Path(tmp_path, "c.nc").exists()


def test_records_are_read_by_ranges(spark, cube, tmp_path, monkeypatch):
    netcdf.write_netcdf(cube, f"{tmp_path}/r.nc", DIMS)
    monkeypatch.setattr(netcdf, "CELLS", 6)
    file = netcdf.File(f"{tmp_path}/r.nc")
    assert file.arrays["x"].chunks == (1, 2, 3)
    x = file.arrays["x"].read(file.store, [(2, 5), (1, 2), (0, 3)])
    assert x.tolist() == [[[100.0 * t + 850 + a for a in (2, 1, 0)]] for t in range(2, 5)]
    assert cube.agg(F.sum("x")).first()[0] == file.arrays["x"].read(file.store, [(0, 7), (0, 2), (0, 3)]).sum()
