"""Running scores with corrections: streams against a plain computation over the newest reports."""

import random
from datetime import datetime, timedelta

import pytest

from skillcube.sources.io import scratch
from skillcube.streaming import running

SCHEMA = "site long, valid_time timestamp, side string, version long, value double, n int"
T = datetime(2020, 1, 1)


def newest(rows):
    """n, squared, absolute and plain error of each site, from the newest reports."""
    kept = {}
    for site, t, side, version, value, _ in rows:
        if side in running.SIDES and version is not None and site is not None and t is not None:
            kept[site, t, side] = running.newer(kept.get((site, t, side), (None, None)), (version, None if value is None else round(value * 10)))
    out = {}
    for (site, t, side), (_, f) in kept.items():
        o = kept.get((site, t, "observed"), (None, None))[1]
        if side == "forecast" and f is not None and o is not None:
            n, sq, ab, e = out.get(site, (0, 0, 0, 0))
            out[site] = n + 1, sq + (f - o) ** 2, ab + abs(f - o), e + f - o
    return {k: pytest.approx((n, sq / n / 100, ab / n / 10, e / n / 10)) for k, (n, sq, ab, e) in out.items()}


def got(changes):
    return {r.site: (r.n, r.mse, r.mae, r.bias) for r in running.scores(changes, ["site"], 0.1).collect()}


def test_replays_equal_the_newest_reports(spark):
    """In whatever order the files arrive, which differs from run to run; test_corrections_withdrawals_and_restarts fixes the order."""
    r = random.Random(5)
    rows = [(r.randrange(3), T + timedelta(hours=r.randrange(6)), r.choice(running.SIDES), v, r.choice([None, round(r.uniform(-5, 5), 1)]), 1) for v in range(300)]
    rows += rows[:20]  # repeated reports
    rows += [(0, T, "forecast", 900, 1.0, 1), (0, T, "forecast", 900, 2.0, 1), (None, T, "forecast", 1, 1.0, 1), (1, None, "observed", 1, 1.0, 1), (1, T, "other", 999, 1.0, 1), (1, T, None, 999, 1.0, 1), (1, T, "observed", None, 1.0, 1)]
    r.shuffle(rows)
    changes = running.replay(spark, spark.createDataFrame(rows, SCHEMA), "value", ["site"], 0.1, batches=3)
    assert got(changes) == newest(rows)


def feed(spark, batches, **kw):
    """Scores after each batch of reports; the query is started anew for each, from its checkpoint."""
    source, path, checkpoint = (scratch(spark, k) for k in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = running.start(running.differences(stream, ["site"], 0.1, **kw), path, checkpoint)
        query.awaitTermination(120)
        yield got(spark.read.schema("site long, valid_time timestamp, n long, e long, abs_e long, sq_e long").parquet(path))


def test_corrections_withdrawals_and_restarts(spark):
    label = (1, T)
    batches = [[(*label, "forecast", 1, 3.0, 0)], [(*label, "observed", 1, 1.0, 0)], [(*label, "observed", 2, 2.5, 0)], [(*label, "observed", 1, 9.0, 0)], [(*label, "observed", 3, None, 0)], [(*label, "observed", 4, 3.0, 0)]]
    after = list(feed(spark, batches))
    assert [a.get(1) for a in after] == [None, pytest.approx((1, 4, 2, 2)), pytest.approx((1, 0.25, 0.5, 0.5)), pytest.approx((1, 0.25, 0.5, 0.5)), None, (1, 0, 0, 0)]


def test_labels_behind_the_watermark_are_closed(spark):
    late = T + timedelta(days=3)
    batches = [[(1, T, "forecast", 1, 3.0, 0), (1, T, "observed", 1, 1.0, 0)], [(1, late, "forecast", 1, 0.0, 0)], [(1, T, "observed", 2, 3.0, 0), (1, late, "observed", 1, 4.0, 0)]]
    assert list(feed(spark, batches, late_hours=24))[-1] == {1: pytest.approx((2, (4 + 16) / 2, 3, -1))}


def test_no_reports(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(running.replay(spark, empty, "value", ["site"], 0.1)) == {}
