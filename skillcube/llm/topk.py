"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integers, floor(scale * x), and are laid out in blocks of neighbouring ids: a forward index (the matrix of a
block) and the maximum and minimum of every component, which play the part of term maxima. For a query, the sum of the larger
of query * maximum and query * minimum over components bounds every score of a block. GROUP_BLOCKS blocks make a group, with bounds of its own.

1. Blocks of queries meet the summaries of groups, in chunks, and find each query's group with the highest bound.
2. That group alone is searched first: its kth score is a lower bound that all other groups share.
3. Blocks of queries meet the summaries again; a query goes only to the other groups whose bound reaches its kth score.
4. In a group a query visits blocks in descending order of their bounds and stops once the next bound is below its kth score so far.

All of a query's candidates that tie at its kth score are kept until ids decide, so ties are exact. Nothing is broadcast: a task holds one
block of queries and one group of blocks, or one chunk of summaries.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do those with a component that scale takes beyond a double; nor do
rows with a null id. Only vectors of one length are compared with each other. Candidates of a query are the rows with another id; rows with one id are one
query for each distinct vector. Scores are exact at any size: where doubles may round (sums of 2**53 and more), bounds and scores are given room for it and the
candidates that are left are scored in whole numbers; a score beyond a long is ranked by its true value and shown as the nearest long.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillcube.llm.common import read_table, staged

BLOCK = 256
GROUP_BLOCKS = 64
QUERY_BLOCK = 2048
#: Groups whose summaries meet a block of queries at once.
SUMMARIES = 2048
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53
_LONG = 2**63 - 1


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 1024) -> DataFrame:
    """id, v (array<double> of whole numbers), dim of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: x * float(scale)).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # a double from 2**52 on is whole already; zero has one sign
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0))
    return rows.select("id", whole.alias("v"), F.size("v").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


_INDEX = "dim int, grp long, ids binary, matrix binary, high binary, low binary"


def _blocks(block: int, group: int):
    """Rows in order of dim and id to rows of blocks, and for every group a row of its own without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, at_dim, number = TaskContext.get().partitionId(), 0, None, -1
        held: list[pa.Table] = []
        most: list[np.ndarray] = []

        def row(ids, m, high, low) -> pa.RecordBatch:
            data = [[x if x is None else x.tobytes()] for x in (ids, m, high, low)]
            return pa.RecordBatch.from_arrays([pa.array([at_dim], pa.int32()), pa.array([(part << 32) + number], pa.int64()), *(pa.array(x, pa.binary()) for x in data)], ["dim", "grp", "ids", "matrix", "high", "low"])

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal made, at_dim, number, most
            dim = t.column("dim")[0].as_py()
            if dim != at_dim or made % group == 0:  # a group has vectors of one length
                if most:
                    yield row(None, None, *most)
                at_dim, made, number, most = dim, 0, number + 1, []
            m = _matrix(t.column("v"), dim)
            high, low = m.max(0), m.min(0)
            most = [np.maximum(most[0], high), np.minimum(most[1], low)] if most else [high, low]
            made += 1
            yield row(t.column("id").to_numpy(), m, high, low)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            t = pa.concat_tables(held)
            dims = t.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            held = []
            for a, z in zip(cuts, cuts[1:], strict=False):
                while z - a >= block or a < z and z < len(dims):
                    n = min(block, z - a)
                    yield from emit(t.slice(a, n))
                    a += n
                if a < z:
                    held = [t.slice(a)]
        if held and held[0].num_rows:
            yield from emit(held[0])
        if most:
            yield row(None, None, *most)

    return run


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper bounds of every query's scores in every block, room for rounding), [queries, blocks]; the room is 0 where sums are exact."""
    with np.errstate(all="ignore"):
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        size = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T
        room = np.where(size < EXACT, 0.0, size * queries.shape[1] * 2.0**-50)
        return bound + room, room


def _below(score: int | float) -> float:
    """A double that is not above a score."""
    try:
        near = float(score)
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else -np.inf
    return near if near <= score else float(np.nextafter(near, -np.inf))


def visit(queries: np.ndarray, own: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, kth: np.ndarray | None = None) -> list[tuple[list[int], list[int]]]:
    """(ids, scores) of each query's k best over blocks of (ids, matrix, high, low); ties to the smaller id. own: the queries' ids.

    kth: scores that k candidates elsewhere reach; what is below them is left out.
    """
    bound, room = bounds(queries, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    order = np.argsort(np.where(np.isnan(bound), -np.inf, -bound), axis=1, kind="stable")
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    kth = np.full(len(queries), -np.inf) if kth is None else kth.copy()
    open_ = np.arange(len(queries))
    for step in range(len(blocks)):
        at = order[open_, step]
        open_ = open_[~(bound[open_, at] < kth[open_])]
        if not len(open_):
            break
        at = order[open_, step]
        for b in np.unique(at):
            ids, matrix = blocks[b][:2]
            asked = open_[at == b]
            with np.errstate(all="ignore"):
                scores = queries[asked] @ matrix.T
            other = ids[None, :] != own[asked][:, None]
            for q, s, o in zip(asked, scores, other, strict=True):
                new = np.flatnonzero(o & ~(s + room[q, b] < kth[q]))
                if not len(new):
                    continue
                values = s[new]
                if room[q, b]:
                    x = [int(c) for c in queries[q]]
                    values = np.array([sum(u * int(c) for u, c in zip(x, matrix[i], strict=True)) for i in new] + [None], object)[:-1]
                i, v = np.concatenate([best[q][0], ids[new]]), np.concatenate([best[q][1], values])
                if v.dtype == object:
                    top = np.array(sorted(range(len(i)), key=lambda n: (-int(v[n]), i[n]))[:k])  # noqa: B023
                else:
                    top = np.lexsort((i, -v))[:k]
                best[q] = i[top], v[top]
                if len(top) == k:
                    kth[q] = max(kth[q], _below(v[top[-1]]))
    return [(i.tolist(), [int(x) for x in v]) for i, v in best]


def _stacked(rows: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f8").reshape(-1, dim)


_FOUND = "query_id long, tie long, vec_id long, score long, big string"


def _search(k: int):
    """Search of one group of blocks for one block of queries. big: orders the scores that a long cannot tell apart."""

    def run(key: tuple, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("query_id", "tie", "vec_id", "score", "big")}
        if len(queries) and len(blocks):
            dim = int(blocks["dim"].iloc[0])
            one = lambda x: np.frombuffer(x, "<f8")
            index = [(np.frombuffer(i, "<i8"), one(m).reshape(-1, dim), one(h), one(w)) for i, m, h, w in zip(blocks["ids"], blocks["matrix"], blocks["high"], blocks["low"], strict=True)]
            best = visit(_stacked(queries["v"], dim), queries["id"].to_numpy(), index, k, queries["kth"].to_numpy(np.float64))
            for q, tie, (ids, scores) in zip(queries["id"], queries["tie"], best, strict=True):
                out["query_id"] += [q] * len(ids)
                out["tie"] += [tie] * len(ids)
                out["vec_id"] += ids
                out["score"] += [max(-_LONG - 1, min(_LONG, s)) for s in scores]
                out["big"] += ["" if abs(s) < _LONG else f"{s + 10**640:0641d}" for s in scores]
        return pd.DataFrame({c: pd.Series(x, dtype="object" if c == "big" else "int64") for c, x in out.items()})

    return run


_ASKED = "id long, tie long, dim int, v binary, qb int, grp long, kth double"


def _chosen(first: bool):
    """Groups of a chunk that a block of queries has to see: each query's best, or all others whose bound reaches its kth score."""

    def run(key: tuple, queries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        out = [queries.assign(bound=0.0)[:0]]
        for dim in set(queries["dim"]) & set(groups["dim"]):
            q, g = queries[queries["dim"] == dim], groups[groups["dim"] == dim]
            bound = bounds(_stacked(q["v"], dim), _stacked(g["high"], dim), _stacked(g["low"], dim))[0]
            grp = g["grp"].to_numpy()
            if first:
                at = np.argmax(bound, axis=1)
                out.append(q.assign(grp=grp[at], bound=np.nan_to_num(bound[np.arange(len(q)), at], nan=np.inf)))
            else:
                row, at = np.nonzero(~(bound < q["kth"].to_numpy()[:, None]) & (grp[None, :] != q["grp"].to_numpy()[:, None]))
                out.append(q.iloc[row].assign(grp=grp[at], bound=bound[row, at]))
        return pd.concat(out)[["id", "tie", "dim", "v", "qb", "grp", "kth", "bound"]]

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = [x.values.to_numpy().astype("<f8").tobytes() for x in b.column("v")]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), b.column("dim"), pa.array(v, pa.binary())], ["id", "tie", "dim", "v"])


class Search:
    """The index over all vectors and the queries' way through it."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int, id_column: str, vector_column: str, scale: int) -> None:
        self.k = k
        rows = quantized(vectors, id_column, vector_column, scale)
        ordered = rows.repartitionByRange("dim", "id", F.xxhash64("v")).sortWithinPartitions("dim", "id")
        index, _ = staged(ordered.mapInArrow(_blocks(BLOCK, GROUP_BLOCKS), _INDEX), "vector-blocks")
        self.blocks, self.groups = index.where("ids is not null"), index.where("ids is null").select("dim", "grp", "high", "low")
        queries = quantized(vectors.withColumn("__query", is_query).where("__query"), id_column, vector_column, scale).distinct()
        queries = queries.select("id", F.xxhash64("id", "v").alias("tie"), "dim", "v").mapInArrow(_packed, "id long, tie long, dim int, v binary")
        queries, _ = staged(queries, "queries")
        # blocks of queries and chunks of groups by hash, so that none is larger than about its bound
        self.query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        self.chunks = max(1, -(-self.groups.count() // SUMMARIES))
        no_kth = F.lit(float("-inf"))
        self.queries = queries.withColumns({"qb": F.pmod(F.xxhash64("tie"), F.lit(self.query_blocks)).cast("int"), "grp": F.lit(-1).cast("long"), "kth": no_kth})

    def choose(self, queries: DataFrame, first: bool) -> DataFrame:
        """Pairs of queries and groups; every block of queries meets every chunk of summaries."""
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("sc", each(self.chunks))
        right = self.groups.withColumns({"chunk": F.pmod(F.xxhash64("grp"), F.lit(self.chunks)).cast("int"), "by": each(self.query_blocks)})
        return left.groupBy("qb", "sc").cogroup(right.groupBy("by", "chunk")).applyInPandas(_chosen(first), _ASKED + ", bound double")

    def search(self, asked: DataFrame) -> DataFrame:
        pairs = asked.select(F.col("grp").alias("of"), F.col("qb").alias("by")).distinct()
        blocks = self.blocks.join(pairs, F.col("grp") == F.col("of")).select("of", "by", "dim", "ids", "matrix", "high", "low")
        return asked.groupBy("grp", "qb").cogroup(blocks.groupBy("of", "by")).applyInPandas(_search(self.k), _FOUND)

    def found(self) -> tuple[DataFrame, DataFrame]:
        """(candidates with scores, pairs of queries and further groups that had to be searched)."""
        one = self.choose(self.queries, True)
        if self.chunks > 1:
            one = one.groupBy("id", "tie", "dim", "v", "qb").agg(F.max(F.struct("bound", "grp", "kth")).alias("m")).select("id", "tie", "dim", "v", "qb", "m.grp", "m.kth")
        first, _ = staged(one.select("id", "tie", "dim", "v", "qb", "grp", "kth"), "first-groups")
        seeds, _ = staged(self.search(first), "first-scores")
        kth = seeds.groupBy("query_id", "tie").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.k)
        # a score that is shown as the least long may be less, one that a double rounds up is taken a little lower
        low = F.when(F.col("s") > -_LONG - 1, F.col("s").cast("double") - F.when(F.abs(F.col("s")) < int(EXACT), 0.0).otherwise(F.abs(F.col("s").cast("double")) * 2.0**-50))
        known = first.drop("kth").join(kth.select(F.col("query_id").alias("id"), "tie", low.alias("kth")), ["id", "tie"], "left")
        known = known.select("id", "tie", "dim", "v", "qb", "grp", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
        more, _ = staged(self.choose(known, False), "further-groups")
        return seeds.unionByName(self.search(more)), more


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among the rows with another id."""
    found, _ = Search(vectors, is_query, k, id_column, vector_column, scale).found()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tie").orderBy(F.desc("score"), F.desc("big"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0)
