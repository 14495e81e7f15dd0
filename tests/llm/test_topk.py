import numpy as np
from pyspark.sql import functions as F

from skillcube.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int, dim int"


def brute(rows, k):
    ok = [(i, np.array([int(c) for c in np.floor(1024 * np.array(v, np.float64))] + [None], object)[:-1]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(x)) for i, x in ok if i % 100 == 0}:
        v = np.array(v)
        scores = sorted((-int(v @ x), i) for i, x in ok if i != q and len(x) == len(v))[:k]
        out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows], VECTORS)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k).collect())


def f32(x):
    return [float(np.float32(v)) for v in x]


def test_is_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, f32(r.normal(size=8) * 0.3)) for i in range(1500)]
    rows += [(2000 + i, f32(np.full(8, 0.5))) for i in range(300)]  # ties
    assert run(spark, rows) == brute(rows, 10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [0.25, -1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (200, [2.0, 2.0, 2.0]), (300, [5.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []


def test_pruning_skips_blocks():
    r = np.random.default_rng(2)
    blocks = []
    for b in range(20):
        m = np.floor(r.normal(size=(64, 4)) * 10 + (500 if b == 7 else 0))
        blocks.append((np.arange(b * 64, b * 64 + 64), m, m.max(0), m.min(0)))
    seen = []

    class Watched(list):
        def __getitem__(self, i):
            seen.append(int(i))
            return super().__getitem__(i)

    q = np.full((1, 4), 3.0)
    best = topk.visit(q, np.array([-1]), Watched(blocks), 5)
    all_ = np.concatenate([b[1] for b in blocks]) @ q[0]
    ids = np.concatenate([b[0] for b in blocks])
    order = np.lexsort((ids, -all_))[:5]
    assert best[0][0] == ids[order].tolist() and best[0][1] == all_[order].tolist() and set(seen) == {7}


def test_large_components_are_exact(spark):
    r = np.random.default_rng(3)
    for scale in (1e5, 1e9, 1e17, 1e30):
        rows = [(i, f32(r.normal(size=6) * (scale if i % 7 == 0 else 1))) for i in range(400)]
        rows += [(1000 + i, f32(np.full(6, scale))) for i in range(30)]  # ties
        assert run(spark, rows) == brute(rows, 10)


def test_groups_share_the_kth_score(spark, monkeypatch):
    """Clustered vectors: most groups' bounds are below what the first group gives."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "SUMMARIES", 7)
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 8)) * 5
    rows = [(i, f32(centres[i // 50] + r.normal(size=8) * 0.1)) for i in range(2000)]
    assert run(spark, rows) == brute(rows, 10)
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows], VECTORS)
    search = topk.Search(df, F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding", 1024)
    more = search.found()[1].count()
    assert search.groups.count() > 60 and more < 0.5 * 20 * search.groups.count()
