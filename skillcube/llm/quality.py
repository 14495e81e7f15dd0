"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole texts with numpy, many texts at once; nothing but the text is an input. The trees are
fitted on at most `max_rows` labelled rows (those with the smallest hashes of doc_id), so the driver's share does not grow.

Nulls: a null text is empty and is scored like it; a null doc_id hashes like the empty string and has no label. Conflicting
labels of one doc_id count as their minimum; null labels do not count. Without labels the score is 0.5; labels of one class give
a constant near that class. Rows with equal doc_id are scored separately. Extra columns are ignored (score table) or kept (filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skillcube.llm import boosting
from skillcube.llm.common import mix64, read_table, slices, utf8, words_of, worker_state

STEP_BYTES = 1 << 19
MAX_ROWS = 20_000
THRESHOLD = 0.3

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


def _classes() -> np.ndarray:
    """bool[classes, 256]: lower, upper, digit, space, newline, sentence end, comma, other ASCII punctuation, non-ASCII, control."""
    c = np.zeros((10, 256), bool)
    c[0, 97:123] = c[1, 65:91] = c[2, 48:58] = c[3, 32] = c[4, 10] = True
    c[5, [33, 46, 63]] = c[6, 44] = True
    c[7, 33:127] = ~c[:7, 33:127].any(0)
    c[8, 192:] = True
    c[9, :32] = True
    return c


_CLASSES = _classes()
#: Statistics of a document, in the columns' order.
FEATURES = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "space", "newline", "stop", "comma", "symbol", "foreign", "control",
    "bang", "word_len", "short_words", "long_words", "distinct_words", "distinct_pairs", "distinct_triples", "distinct_lines",
    "words_per_stop", "words_per_line", "top_symbol",
)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each document over all its values; 1 where there are none."""
    total = np.bincount(doc, minlength=n)
    key = mix64(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[by[1:]] != key[by[:-1]]
    return np.where(total, np.bincount(doc[by[new]], minlength=n) / np.maximum(total, 1), 1.0)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float64[texts, len(FEATURES)] of texts given as utf8() gives them."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    counts = [count(c[raw]) for c in _CLASSES]
    h, start, doc = words_of(raw, offsets, _NOT_SPACE)
    words = np.bincount(doc, minlength=n)
    spaces = np.bincount(doc, minlength=n)  # words are parted by at least one byte
    length = np.empty(len(start), np.int64)
    inside = np.concatenate([[0], np.cumsum(_NOT_SPACE[raw])])
    length[:-1] = inside[start[1:]] - inside[start[:-1]] if len(start) else length[:-1]
    length[-1:] = inside[-1] - inside[start[-1:]]
    lines, _, line_doc = words_of(raw, offsets, _NOT_LINE)
    n_lines = np.bincount(line_doc, minlength=n)
    pair = doc[1:] == doc[:-1]
    h2 = mix64(h[:-1] * np.uint64(3) + h[1:])[pair]
    triple = doc[2:] == doc[:-2]
    h3 = mix64(mix64(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(3) + h[2:])[triple]
    over = lambda a, b: a / np.maximum(b, 1)
    symbols = [count(raw == b) for b in (33, 35, 36, 37, 38, 42, 124)]
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(n_lines), *(c / some for c in counts[:7]), counts[7] / some, counts[8] / some, counts[9] / some,
        symbols[0] / some, over(counts[0] + counts[1], spaces), over(np.bincount(doc, length <= 3, n), words), over(np.bincount(doc, length >= 12, n), words),
        _distinct(h, doc, n), _distinct(h2, doc[1:][pair], n), _distinct(h3, doc[2:][triple], n), _distinct(lines, line_doc, n),
        over(words, counts[5]), over(words, n_lines), np.max(symbols, 0) / some,
    ], 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("quality")
    for whole in batches:
        for b in slices(whole, "text", STEP_BYTES):
            x = statistics(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> boosting.Trees:
    """Fit on at most max_rows labelled documents that are not held out (of several rows with one doc_id, one counts)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # max_rows bounds the broadcast side
    rows = texts.join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text").mapInArrow(_sampled, "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    got = sorted((r.doc_id, r.quality, r.x) for r in rows.collect())
    y = np.array([q for _, q, _ in got], float)
    x = np.array([v for _, _, v in got]).reshape(len(got), len(FEATURES))
    if not len(y):
        return boosting.fit(x, np.zeros(0))
    return boosting.fit(x, (y > 0).astype(float))


def _scored(model: boosting.Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for whole in batches:
            if whole.num_rows == 0:
                continue
            for b in slices(whole, "text", STEP_BYTES):
                yield b.append_column("score", pa.array(model.score(statistics(*utf8(b.column("text"))))))

    return run


def score_documents(docs: DataFrame, model: boosting.Trees) -> DataFrame:
    """docs with the column score, the probability of label 1."""
    docs = docs.drop("score")
    return docs.mapInArrow(_scored(model), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns as they were."""
    return score_documents(docs, fit(docs, labels)).where(F.col("score") >= threshold).select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
