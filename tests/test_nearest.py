"""The nearest of scattered points against a look at all of them."""

import math
import random

import pytest

from skillcube.operators import nearest as N


def chord(a, b):
    xyz = lambda p: (math.cos(math.radians(p[0])) * math.cos(math.radians(p[1])), math.cos(math.radians(p[0])) * math.sin(math.radians(p[1])), math.sin(math.radians(p[0])))
    return math.dist(xyz(a), xyz(b))


def test_equals_a_look_at_all_points(spark):
    """A dense cluster, poles, both sides of the date line, and places far from every point."""
    r = random.Random(3)
    points = [(40 + r.gauss(0, 0.2), 10 + r.gauss(0, 0.2), k) for k in range(150)] + [(90.0, 0.0, 500), (-10.0, 179.9, 501), (-10.5, -179.8, 502), (5.0, 359.0, 503)]
    places = [(r.uniform(-90, 90), r.uniform(-180, 360), k) for k in range(120)] + [(89.0, 123.0, 900), (-10.2, -179.9, 901), (5.0, -1.5, 902), (points[7][0], points[7][1], 903), (-90.0, 77.0, 904)] + [(40.0, 10.0, 905 + k) for k in range(40)]
    out = N.nearest(spark.createDataFrame(places, "latitude double, longitude double, place int"), spark.createDataFrame(points, "latitude double, longitude double, point int")).collect()
    assert len(out) == len(places)
    for row in out:
        best = min((round(chord((row.latitude, row.longitude), p), 9), p[0], p[1]) for p in points)
        assert (row.latitude_near, row.longitude_near) == best[1:] and row.distance == pytest.approx(2 * N.RADIUS * math.asin(best[0] / 2), abs=0.1)


def test_ties_repeats_nulls_and_nothing(spark):
    kind = "latitude double, longitude double, name string"
    points = spark.createDataFrame([(10.0, 0.0, "n"), (-10.0, 0.0, "s"), (-10.0, 0.0, "s2"), (None, 1.0, "x"), (float("nan"), 1.0, "y")], kind)
    places = spark.createDataFrame([(0.0, 0.0, "middle"), (None, 0.0, "null"), (float("nan"), 0.0, "nan"), (80.0, 0.0, "far")], kind)
    got = {}
    for r in N.nearest(places, points, within=5_000_000.0).collect():
        got.setdefault(r.name, []).append(r.name_near)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {"middle": ["s", "s2"], "null": [None], "nan": [None], "far": [None]}
    assert {r.name: r.name_near for r in N.nearest(places, points).where("name = 'far'").collect()} == {"far": "n"}
    assert [r.name_near for r in N.nearest(places, points.limit(0)).collect()] == [None] * 4
    assert N.nearest(places.limit(0), points).collect() == []


def test_no_pair_outside_neighbouring_cubes(spark):
    """The join is by cubes: no plan compares all places with all points."""
    points = spark.createDataFrame([(float(a), float(b)) for a in range(-80, 81, 20) for b in range(0, 360, 30)], "latitude double, longitude double")
    met = N._cubes(points.selectExpr("latitude", "cos(radians(latitude)) * cos(radians(longitude)) AS __x", "cos(radians(latitude)) * sin(radians(longitude)) AS __y", "sin(radians(latitude)) AS __z"), 0.3, True)
    assert met.count() == 27 * points.count()
    plan = N.nearest(points, points)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_places_are_not_copied_into_cubes_around(spark):
    """Shuffled rows: a few per place, and about a dozen per point."""
    r = random.Random(5)
    points = spark.createDataFrame([(r.uniform(-90, 90), r.uniform(0, 360)) for _ in range(300)], "latitude double, longitude double")
    places = spark.createDataFrame([(r.uniform(-90, 90), r.uniform(0, 360)) for _ in range(4000)], "latitude double, longitude double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many points
    try:
        before = shuffled(spark)
        assert N.nearest(places, points).where("distance IS NULL").count() == 0
        rows = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < rows < 8 * 4000 + 16 * 300, rows


def test_cubes_of_many_places_in_parts(spark, monkeypatch):
    """Many places in one cube: every part meets all of the points around, ties included."""
    monkeypatch.setattr(N, "PART", 7)
    r = random.Random(9)
    points = [(r.uniform(-90, 90), r.uniform(0, 360), k) for k in range(60)] + [(51.0, 7.0, 100), (49.0, 7.0, 101)]
    places = [(50 + r.gauss(0, 0.5), 7 + r.gauss(0, 0.5), k) for k in range(300)] + [(0.0, 7.0, 400), (-60.0, 200.0, 401)]
    out = N.nearest(spark.createDataFrame(places, "latitude double, longitude double, place int"), spark.createDataFrame(points, "latitude double, longitude double, point int")).collect()
    assert sorted(row.place for row in out) == sorted(p[2] for p in places)
    for row in out:
        best = min((round(chord((row.latitude, row.longitude), p), 9), p[0], p[1]) for p in points)
        assert (row.latitude_near, row.longitude_near) == best[1:]
