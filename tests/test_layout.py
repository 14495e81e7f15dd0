"""Chunks of other shapes, and files along a curve."""

import itertools
import math
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skillcube.sources import layout, zarr

DIMS = ["time", "level", "latitude", "longitude"]


@pytest.fixture(scope="module")
def cube(spark):
    """32 times, 4 levels, 8 x 16 cells."""
    cells = itertools.product(range(32), range(4), range(8), range(16))
    rows = [(datetime(2020, 1, 1) + timedelta(hours=6 * t), 100 * (k + 1), 20.0 * a - 70, 22.5 * b, t + k / 10 + a / 100 + b / 1e4) for t, k, a, b in cells]
    return spark.createDataFrame(rows, "time timestamp_ntz, level long, latitude double, longitude double, t double")


@pytest.mark.parametrize(("source", "target"), [((3, 2, 8, 16), (32, 1, 4, 4)), ((32, 1, 3, 5), (1, 4, 8, 16)), ((5, 4, 8, 7), (7, 3, 2, 16)), ((1, 1, 1, 1), (32, 4, 8, 16))])
@pytest.mark.parametrize("most", [1 << 28, 4096 * 8 * 4])
def test_pieces_make_up_every_chunk(source, target, most):
    shape = (32, 4, 8, 16)
    p = layout.plan(shape, source, target, 8, most)
    assert math.prod(p.read) * 8 <= most and all(r % s == 0 or r == n for r, s, n in zip(p.read, source, shape, strict=True))
    seen, count = np.zeros(shape, int), 0
    for box in p.boxes():
        for number, part, corner in p.pieces(box):
            seen[tuple(slice(a, b) for a, b in part)] += 1
            grid = [-(-n // c) for n, c in zip(shape, p.write, strict=True)]
            at = np.unravel_index(number, grid)
            assert all(k * c + o == a and b <= (k + 1) * c for k, c, o, (a, b) in zip(at, p.write, corner, part, strict=True))
            count += 1
    assert (seen == 1).all() and count <= p.count()


def test_more_memory_makes_fewer_pieces():
    pieces = [layout.plan((1000, 10, 100, 100), (1, 10, 100, 100), (1000, 1, 10, 10), 4, most).count() for most in (400_000, 4_000_000, 400_000_000)]
    assert pieces[0] > 5 * pieces[1] > 25 * pieces[2]
    with pytest.raises(ValueError, match="a new chunk"):
        layout.plan((1000, 10, 100, 100), (1, 10, 10, 100), (1000, 10, 100, 100), 4, 400_000)


def test_rechunked_stores_hold_the_same(spark, cube, tmp_path):
    a, b = f"{tmp_path}/a.zarr", f"{tmp_path}/b.zarr"
    zarr.write_zarr(cube.where("time <> TIMESTAMP_NTZ'2020-01-01 06:00:00' OR level > 200"), a, DIMS, {"time": 1})
    layout.rechunk(spark, a, b, {"level": 1, "latitude": 3, "longitude": 5}, compressor="zstd", most=1 << 20)
    assert zarr.Cube(b).arrays["t"].chunks == (32, 1, 3, 5) and len([f for f in Path(b, "t").iterdir() if f.name[0] != "."]) == 4 * 3 * 4
    rows = lambda path: sorted(map(str, zarr.read_zarr(spark, path).collect()))
    assert rows(a) == rows(b) and not Path(b, zarr.STAGING).exists()
    with pytest.raises(FileExistsError):
        layout.rechunk(spark, a, b, {})


def test_a_rechunking_that_fails_leaves_no_store(spark, cube, tmp_path):
    a, b = f"{tmp_path}/a.zarr", f"{tmp_path}/b.zarr"
    zarr.write_zarr(cube, a, DIMS, {"time": 8})
    Path(a, "t/2.0.0.0").write_bytes(b"spoilt")
    with pytest.raises(Exception, match="incorrect header check"):
        layout.rechunk(spark, a, b, {"level": 1})
    assert not Path(b, ".zmetadata").exists() and not Path(b, ".zgroup").exists()


def files_that_may_hold(path, low, high):
    """Files whose statistics do not rule a box out."""
    found = 0
    files = list(Path(path).glob("*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k).statistics for k in range(meta.num_columns)}
            if all(stats[d].min <= high[d] and stats[d].max >= low[d] for d in low):
                found += 1
                break
    return found / len(files)


def test_a_box_lies_in_few_files(spark, cube, tmp_path):
    """An eighth of the times, one level and a quarter of the cells: a tenth of the files on the curve, a quarter by time."""
    layout.along_curve(cube, ["time", "level", "latitude", "longitude"], 64).write.parquet(f"{tmp_path}/curve")
    cube.repartitionByRange(64, "latitude").sortWithinPartitions("latitude", "time").write.parquet(f"{tmp_path}/rows")
    low = {"time": datetime(2020, 1, 3), "level": 200, "latitude": 10.0, "longitude": 0.0}
    high = {"time": datetime(2020, 1, 3, 18), "level": 200, "latitude": 70.0, "longitude": 157.5}
    share = files_that_may_hold(f"{tmp_path}/curve", low, high)
    assert share <= 0.1 < files_that_may_hold(f"{tmp_path}/rows", low, high)
    box = lambda df: sorted(df.where(" AND ".join(f"{d} BETWEEN {v!r} AND {high[d]!r}" if d != "time" else f"time BETWEEN TIMESTAMP_NTZ'{v}' AND TIMESTAMP_NTZ'{high[d]}'" for d, v in low.items())).select("t").collect())
    read = spark.read.parquet(f"{tmp_path}/curve")
    assert box(read) == box(cube) and read.count() == cube.count()
    assert box(read.where(F.col("t") > 9)) == box(cube.where("t > 9"))
