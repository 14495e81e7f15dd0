"""Functions of arrays over named dimensions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillcube.operators.ufunc import Signature, apply_ufunc, parse

DIMS = ["time", "latitude", "longitude"]


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(datetime(2020, 1, 1) + timedelta(days=t), 10.0 * a, 90.0 * b, float(t * t + a * t + b), 2.0 * a) for t in range(5) for a in range(3) for b in range(4)]
    return spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, x double, y double").repartition(5)


def test_signatures():
    assert parse(" ( time , level),(time) -> (time),() ") == Signature((("time", "level"), ("time",)), (("time",), ()))
    for bad in ("time->time", "(time)", "(time->(time)", "(time,time)->()", "(a b)->()", "(a,)->()"):
        with pytest.raises(ValueError):
            parse(bad)


def test_axes_hold_labels_in_order(cube):
    """A plane whose axes are named in another order than the cube's, and a sum over it."""
    out = apply_ufunc(cube, lambda p: p[:, 0] - p[:, -1], "(longitude,time)->(longitude)", ["x"], ["d"], DIMS)
    assert out.columns == ["latitude", "longitude", "d"]
    assert {(r.latitude, r.longitude): r.d for r in out.collect()} == {(10.0 * a, 90.0 * b): -(16.0 + 4 * a) for a in range(3) for b in range(4)}
    total = apply_ufunc(cube, np.sum, "(time,latitude,longitude)->()", ["x"], ["s"], DIMS).collect()
    assert total[0].s == cube.agg(F.sum("x")).first()[0] and len(total) == 1


def test_several_inputs_and_outputs(cube):
    out = apply_ufunc(cube, lambda x, y: (x + y, x - y), "(time),()->(time),(time)", ["x", "y"], ["plus", "minus"], DIMS)
    want = {tuple(r) for r in cube.select(*DIMS, F.col("x") + F.col("y"), F.col("x") - F.col("y")).collect()}
    assert {tuple(r) for r in out.select(*DIMS, "plus", "minus").collect()} == want
    with pytest.raises(Exception, match="y varies along latitude"):
        apply_ufunc(cube, lambda x, y: x.sum() + y, "(time,latitude),()->()", ["x", "y"], ["s"], DIMS).collect()


def test_new_labels(cube):
    out = apply_ufunc(cube, lambda x: np.polyfit(np.arange(5), x, 2), "(time)->(degree)", ["x"], ["c"], DIMS, {"degree": [2, 1, 0]})
    got = {(r.latitude, r.longitude, r.degree): round(r.c, 9) + 0.0 for r in out.collect()}
    assert got == {(10.0 * a, 90.0 * b, k): float(v) for a in range(3) for b in range(4) for k, v in ((2, 1), (1, a), (0, b))}


def test_missing_and_repeated_cells(cube):
    holed = cube.where("NOT (longitude = 90 AND time = TIMESTAMP_NTZ'2020-01-02') ").withColumn("x", F.when(F.col("longitude") != 180, F.col("x")))
    with pytest.raises(Exception, match="1 cells of a box have no row"):
        apply_ufunc(holed, np.sum, "(time)->()", ["x"], ["s"], DIMS).collect()
    out = {(r.latitude, r.longitude): r.s for r in apply_ufunc(holed, np.sum, "(time)->()", ["x"], ["s"], DIMS, missing="nan").collect()}
    assert out[0.0, 0.0] == 30 and out[0.0, 90.0] is None and out[0.0, 180.0] is None
    with pytest.raises(Exception, match="two rows"):
        apply_ufunc(cube.unionByName(cube.limit(1)), np.sum, "(time)->()", ["x"], ["s"], DIMS).collect()


def test_what_does_not_fit_raises(cube):
    for call in (
        lambda: apply_ufunc(cube, np.sum, "(level)->()", ["x"], ["s"], DIMS),
        lambda: apply_ufunc(cube, np.sum, "(time),(time)->()", ["x"], ["s"], DIMS),
        lambda: apply_ufunc(cube, np.sum, "(time)->(degree)", ["x"], ["s"], DIMS),
        lambda: apply_ufunc(cube, np.sum, "(time)->()", ["x"], ["s"], DIMS, missing="other"),
        lambda: apply_ufunc(cube, np.sum, "(time)->()", ["x"], ["s"], DIMS, most=4),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="has the shape"):
        apply_ufunc(cube, lambda x: x[1:], "(time)->(time)", ["x"], ["s"], DIMS).collect()
    assert apply_ufunc(cube.limit(0), np.cumsum, "(time)->(time)", ["x"], ["s"], DIMS).collect() == []
