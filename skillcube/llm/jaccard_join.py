"""Exact Jaccard join of documents on word n-grams (3-grams and 90 % unless said otherwise), as a grouped prefix join.

1. A sketch counts shingles in 2**SKETCH_BITS buckets over all documents. It has a fixed size and only sets the global order of
   shingles (rare buckets first, then hash), so any error in it costs time, never a link.
2. Every document becomes its set's size, a digest of the set, its prefix (the first n - ceil(n percent / 100) + 1 shingles in that order) and
   a small histogram of the set. Equal sets collapse first; sets with equal prefixes and size then form one group.
3. Groups meet through the shingles of their prefixes. Pairs pass filters that cannot lose a link: size, position in
   the prefix, and the distance of histograms, which is at most the number of shingles two linked sets may differ in.
4. What passes is expanded to members and verified exactly on whole sets.

Only connectivity is asked for, so no group of near copies is expanded to all its pairs: first every group is verified against
one leader (of the leaders, the smallest group of a shared shingle, the one it shares most with) and every member against its group; then
only pairs whose components still differ are looked at, all of them. Two sets that differ have at least percent / (100 - percent)
shingles in common if they link (nine at 90 %), so smaller sets link to equal ones only.

Words: A-Z lower-cased, parted by spaces and the ASCII controls 9 to 13. A null or empty text has an empty set and its own component. A null doc_id
takes part in links, but a component's id is its smallest non-null doc_id. Rows with equal doc_id are separate documents with that id. Extra
columns are ignored (link table) or kept (keep_first).

A shingle is known by 128 bits, chained from 128-bit digests of its words, and sets are told apart and verified by these; its first 64 bits
alone set the order, prefixes and histograms, which can only cost time. A text is read in parts that end between words; what is kept of it is its
distinct shingles (16 bytes each).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import Known, drop_path, mix64, pieces, read_table, slices, staged, worker_state
from skillcube.llm.components import connected_components

STEP_BYTES = 1 << 20
SKETCH_BITS = 21
_CHUNK = 1 << 15
_FANIN = 64
HISTOGRAM = 64
WIDTH = 3
PERCENT = 90

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_A = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)
_B = np.array([0xD6E8FEB86659FD93, 0x9FB21C651E98DF25], np.uint64)


def shingles(text: bytes, width: int, known: Known) -> Iterator[np.ndarray]:
    """uint64[n, 2] of the word n-grams of a text, part by part; a text of fewer words has its whole sequence as one, and none none."""
    held: list[bytes] = []
    first = True
    for part in pieces(text, STEP_BYTES, _NOT_SPACE):
        words = held + part.lower().split()  # of bytes: A-Z alone change, and the six spaces of ASCII part
        held = words[-(width - 1) :] if width > 1 else []
        if len(words) >= width:
            first = False
            yield _chained(np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8").reshape(-1, 2), width)
    if first and held:
        yield _chained(np.frombuffer(b"".join(map(known.__getitem__, held)), "<u8").reshape(-1, 2), len(held))


def _chained(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    out = np.broadcast_to(_A * np.uint64(width), (n, 2))
    for k in range(width):
        out = mix64(out * _B + h[k : k + n])
    return out


def _unique(x: np.ndarray) -> np.ndarray:
    """Distinct rows of uint64[n, 2], ascending."""
    x = x[np.argsort(x[:, 0], kind="stable")]
    same = x[1:, 0] == x[:-1, 0]
    if (x[1:, 1] != x[:-1, 1])[same].any():  # two shingles that agree in 64 bits
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        same = (x[1:] == x[:-1]).all(1)
    return x[np.concatenate([[True], ~same])] if len(x) else x


def set_of(text: bytes, width: int, known: Known) -> np.ndarray:
    """uint64[n, 2]: a text's distinct shingles, ascending. Parts of a long text meet in rising sizes."""
    found: list[np.ndarray] = []
    for part in shingles(text, width, known):
        part = _unique(part)
        while found and len(found[-1]) <= 2 * len(part):
            part = _unique(np.concatenate([found.pop(), part]))
        found.append(part)
    return _unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros((0, 2), np.uint64)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sets share."""
    if any((u[1:, 0] == u[:-1, 0]).any() for u in (x, y)):
        return len(set(map(tuple, x.tolist())) & set(map(tuple, y.tolist())))
    _, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    return int((x[i, 1] == y[j, 1]).sum())


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    for t in b.column("text"):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _sketched(bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("jaccard join", Known)
        total = np.zeros(1 << bits, np.int64)
        for whole in batches:
            for b in slices(whole, "text", STEP_BYTES):
                held: list[np.ndarray] = []
                for t in _texts(b):
                    for part in shingles(t, width, known):
                        held.append((part[:, 0] >> np.uint64(64 - bits)).astype(np.int32))
                        if len(held) == 4096 or len(part) > 1 << 16:
                            total += np.bincount(np.concatenate(held), minlength=1 << bits)
                            held = []
                if held:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits)
        n = max(1, len(total) // _CHUNK)
        parts = [zlib.compress(c.astype("<i8" if total.max() >= 1 << 32 else "<u4").tobytes(), 1) for c in np.split(total, n)]
        wide = bool(total.max() >= 1 << 32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId() % _FANIN, np.int32)), pa.array([wide] * n), pa.array(parts, pa.binary())], ["chunk", "salt", "wide", "counts"])

    return run


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), "<i8" if w else "<u4").astype(np.int64) for c, w in zip(rows["counts"], rows["wide"], strict=True))
    return pd.DataFrame({"chunk": [key[0]], "salt": [0], "wide": [True], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})


def frequency_classes(texts: DataFrame, bits: int = SKETCH_BITS, width: int = WIDTH) -> np.ndarray:
    """uint8[2**bits]: eight times the binary logarithm of each bucket's count over all texts.

    Partial sketches are added in two levels, so no task holds more than a share of the tasks' chunks.
    """
    kind = "chunk int, salt int, wide boolean, counts binary"
    parts = texts.mapInArrow(_sketched(bits, width), kind).groupBy("chunk", "salt").applyInPandas(_merged, kind).groupBy("chunk").applyInPandas(_merged, kind)
    rows = sorted((r.chunk, bytes(r.counts)) for r in parts.collect())
    total = np.concatenate([np.frombuffer(zlib.decompress(c), "<i8") for _, c in rows]) if rows else np.zeros(1 << bits, np.int64)
    return np.minimum(255, np.round(8 * np.log2(total + 1.0))).astype(np.uint8)


def ordered(u: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles as tokens in the global order: class in the top byte, then the hash's upper bits."""
    bits = int(len(classes)).bit_length() - 1
    return np.sort(classes[(u >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | u >> np.uint64(8))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_size(percent: int = PERCENT) -> int:
    """Shingles that two sets that differ have in common at least if they link."""
    return -(-percent // (100 - percent))


_ROW = "doc_id long, tk long, n long, digest binary, prefix_digest binary, tokens array<long>, histogram binary"


def _described(classes, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("jaccard join", Known)
        order = classes.value
        for whole in batches:
            for b in slices(whole, "text", STEP_BYTES):
                n, digest, of_prefix, tokens, histogram = [], [], [], [], []
                for text in _texts(b):
                    both = set_of(text, width, known)
                    u = both[:, 0]
                    t = ordered(u, order)[: prefix_length(len(u), percent)] if len(u) >= least_size(percent) else np.zeros(0, np.uint64)
                    n.append(len(u))
                    digest.append(hashlib.blake2b(both.tobytes(), digest_size=16).digest())
                    of_prefix.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest())
                    tokens.append(t.view(np.int64))
                    histogram.append(np.bincount((u & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(of_prefix, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(histogram, pa.binary())], ["doc_id", "tk", "n", "digest", "prefix_digest", "tokens", "histogram"])

    return run


def _close(percent: int):
    """Pairs whose histograms are near enough to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(-1, HISTOGRAM).astype(np.int64) for k in ("histogram_a", "histogram_b"))
                n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
                far = n - 2 * -(-percent * n // (100 + percent))
                yield b.select(["a", "b"]).filter(pa.array(np.abs(x - y).sum(1) <= far))

    return run


def _fetched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("jaccard join", Known)
        for whole in batches:
            for b in slices(whole, "text", STEP_BYTES):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([set_of(t, width, known).tobytes() for t in _texts(b)], pa.binary())], ["id", "members"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(k.as_buffer(), np.uint64).reshape(-1, 2) for k in (x, y))
                both = common(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Join:
    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> None:
        self.width, self.percent = width, percent
        self.spark = docs.sparkSession
        text = F.coalesce("text", F.lit(""))
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"))
        classes = self.spark.sparkContext.broadcast(frequency_classes(self.texts.select("text"), width=width))  # 2**SKETCH_BITS bytes
        described, at_described = staged(self.texts.mapInArrow(_described(classes, width, percent), _ROW), "sets")
        one = lambda c: F.first(c).alias(c)  # noqa: E731  equal within a digest
        pick = F.min(F.struct("doc_id", "tk"))  # nulls come first in a struct, so known ids alone are compared
        known = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tk")))
        sets = described.where("n > 0").groupBy("digest").agg(F.coalesce(known, pick).alias("row"), one("n"), one("prefix_digest"), one("tokens"), one("histogram"))
        substitute = -F.abs(F.xxhash64("digest") / 2).cast("long") - 2
        sets, at = staged(sets.withColumn("id", F.coalesce("row.doc_id", substitute)), "equal-sets")
        self.rows, _ = staged(described.select("doc_id", "tk", "n", "digest"), "rows")  # prefixes and histograms are of sets from here on
        drop_path(self.spark, at_described)
        # a doc_id that rows with several sets carry names none of them
        shared, at_shared = staged(sets.groupBy("id").count().where("count > 1").select(F.col("id").alias("shared")), "shared-ids")
        sets = sets.join(shared, F.col("id") == F.col("shared"), "left").withColumn("id", F.when(F.col("shared").isNull(), F.col("id")).otherwise(substitute))
        # only prefixes that several sets have need a group; a small table of known size joins, or a large side that can be split
        heads = sets.where(F.size("tokens") > 0).groupBy(F.col("n").alias("of_n"), F.col("prefix_digest").alias("of_prefix")).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        heads, at_heads = staged(heads, "groups")
        sets = sets.join(heads, (F.col("n") == F.col("of_n")) & (F.col("prefix_digest") == F.col("of_prefix")), "left").withColumn("gid", F.coalesce("head", "id"))
        self.sets, self.at_sets = staged(sets.select("id", "gid", "row", "digest", "n", "tokens", "histogram"), "distinct-sets")
        drop_path(self.spark, at, at_shared, at_heads)

    def near(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of sets that pass size and histograms."""
        side = lambda k: self.sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("histogram").alias(f"histogram_{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.where((F.col("n_a") * 100 >= F.col("n_b") * self.percent) & (F.col("n_b") * 100 >= F.col("n_a") * self.percent))
        return both.select("a", "b", "n_a", "n_b", "histogram_a", "histogram_b").mapInArrow(_close(self.percent), "a long, b long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link. What it takes to tell is removed afterwards."""
        pairs, at_pairs = staged(self.near(pairs), "near-pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # written first: the join then knows its size and broadcasts it only below Spark's threshold
        asked, at_asked = staged(self.sets.join(ids, "id").select("id", F.col("row.doc_id").alias("of"), F.col("row.tk").alias("at")), "asked")
        found = self.texts.join(asked, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tk") == F.col("at"))).select("id", "text").mapInArrow(_fetched(self.width), "id long, members binary")
        found, at_found = staged(found, "members")
        found = found.dropDuplicates(["id"])
        rows = pairs.join(found.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        links, _ = staged(rows.select("a", "b", "x", "y").mapInArrow(_verified(self.percent), "a long, b long"), "links")
        drop_path(self.spark, at_pairs, at_asked, at_found)
        return links

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links that connect every component, labels id -> label of the sets that have links)."""
        groups = self.sets.where(F.size("tokens") > 0)
        heads = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("members"))
        tokens = groups.where("id = gid").join(heads, "gid").select("gid", "n", "members", F.posexplode("tokens").alias("pos", "token"))
        shared = tokens.groupBy("token").agg(F.sum("members").alias("in_sets"), F.min("gid").alias("leader")).where("in_sets > 1").drop("in_sets")
        postings, at_postings = staged(tokens.join(shared, "token").select("token", "gid", "n", "pos", "leader"), "postings")
        # a set's prefix is not needed again
        at_sets = self.at_sets
        self.sets, self.at_sets = staged(self.sets.withColumn("prefixed", F.size("tokens") > 0).drop("tokens"), "distinct-sets")
        drop_path(self.spark, at_sets)
        groups = self.sets.where("prefixed")
        # round 1: a leader for every group, the group for every member
        by = postings.where("gid <> leader").groupBy("gid", "leader").agg(F.count(F.lit(1)).alias("n"))
        best = by.groupBy("gid").agg(F.max(F.struct("n", (-F.col("leader")).alias("leader"))).alias("best"))
        first = best.select((-F.col("best.leader")).alias("a"), F.col("gid").alias("b")).unionByName(groups.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b")))
        links = self.verify(first)
        labels = connected_components(links)
        # round 2: every pair whose components differ still
        members = groups.select("gid", "id").join(labels, "id", "left").select("gid", "id", F.coalesce("label", "id").alias("label"))
        spread = postings.drop("leader").join(members, "gid")
        mixed = spread.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
        open_, at_open = staged(spread.join(mixed, "token").select("token", "id", "n", "pos", "label"), "open-postings")
        drop_path(self.spark, at_postings)
        # linked sets differ in size by one bucket at most, so a hot shingle meets itself in buckets
        bucket = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / self.percent) + 1e-6)).cast("int")  # a little wider, so rounding cannot part a pair by two
        open_ = open_.withColumn("bucket", bucket)
        other = open_.select("token", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "pos", "label")), F.explode(F.array(*(F.col("bucket") + k for k in (-1, 0, 1)))).alias("bucket"))
        need = F.ceil((F.col("n") + F.col("n_b")) * self.percent / (100 + self.percent))  # shingles that linked sets share
        fits = (F.col("label") != F.col("label_b")) & (F.col("id") < F.col("id_b")) & (F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * self.percent)
        fits &= F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) >= need  # holds for the first shingle they share
        second = open_.join(other, ["token", "bucket"]).where(fits).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()
        more = self.verify(second)
        drop_path(self.spark, at_open)
        links = links.unionByName(more)
        return links, connected_components(links)

    def result(self) -> DataFrame:
        """doc_id, tk, n, label, component_id of every row."""
        labels = self.links()[1]
        known = self.sets.select("id", "digest", F.col("row.doc_id").alias("least")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        least = known.groupBy("label").agg(F.min("least").alias("component_id"))
        of_set, _ = staged(known.join(least, "label").select(F.col("digest").alias("d"), "label", "component_id"), "components")
        rows = self.rows.select("doc_id", "tk", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
        joined = rows.join(of_set, F.col("digest") == F.col("d"), "left")
        return joined.select("doc_id", "tk", "n", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def link_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return _Join(docs, width, percent).result().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id (ties: one of the equal rows).

    Rows with an empty set all stay.
    """
    found, _ = staged(_Join(docs, width, percent).result().where("n > 0").select("doc_id", "tk", "label"), "linked")
    best = found.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tk"))), F.min(F.struct("doc_id", "tk"))).alias("row"))
    best = best.select(F.col("row.doc_id").alias("__id"), F.col("row.tk").alias("__tk"), F.lit(True).alias("__best"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__key": F.col("doc_id").cast("long"), "__hash": F.xxhash64(text), "__empty": ~text.rlike(r"[^\x20\x09-\x0D]")})
    joined = keyed.join(best, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__tk")), "left")
    kept = joined.where(F.col("__empty") | F.col("__best"))
    return kept.where("__empty").select(*docs.columns).unionByName(kept.where("not __empty").dropDuplicates(["__key", "__hash"]).select(*docs.columns))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents"))
