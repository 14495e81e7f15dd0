"""Helpers shared by the operators of this subpackage: table access, the shared work folder and Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts of these characters have no capitals but A-Z.
NO_OTHER_CAPITALS = r"^[\x00-\x7F\xA0-\xBF\xD7\xDF-\xFF]*+$"


def lower_ascii(text: Column) -> Column:
    """A text with A-Z, and nothing else, lower-cased; null is empty. Where a text has no other capitals, the quicker lower() says the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(NO_OTHER_CAPITALS), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local folder serves, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/skillcube-checkpoints-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there must be handed to remove_at_exit."""
    return f"{shared_dir(spark)}/skillcube/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a path when the driver's JVM ends. The path must exist: a missing one would be forgotten."""
    if not _hadoop(spark, path, lambda fs, p: fs.deleteOnExit(p)):
        raise FileNotFoundError(path)


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more."""
    for path in paths:
        _hadoop(spark, path, lambda fs, p: fs.delete(p, True))


def _hadoop(spark: SparkSession, path: str, call) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return call(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)


#: Bytes of long rows that are held at once: in a row group, which is read whole, and in a batch between Spark and Python.
LONG_BYTES = 8 << 20
#: Parquet looks at a row group's size after a hundred rows only, unless told otherwise.
LONG_ROWS = {"parquet.block.size": LONG_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def staged(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd", **options: int) -> tuple[DataFrame, str]:
    """Cut lineage: write df to the shared folder and read it back. A lost executor costs nothing that is staged. options: of the Parquet writer."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.options(compression=codec, **options).mode("overwrite").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile hands Python batches of about LONG_BYTES, or of one row."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(LONG_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, before)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null rows are empty. offsets has one entry more than rows."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Parts of a batch with at most `most` bytes of text each (one row where a single text is longer): bounds the memory of a step."""
    _, offsets = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = min(end, n)
    give_back()


_STATE: dict[str, object] = {}


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live long and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(operator: str, make=lambda: None):
    """What an operator keeps in a reused Python worker between tasks. Another operator's state goes first, so workers do not pile states up."""
    if operator not in _STATE:
        if _STATE:
            _STATE.clear()
            gc.collect()
            give_back()
        _STATE[operator] = make()
    return _STATE[operator]


#: Words of at most so many bytes are remembered with their digests, so many at once.
KNOWN_BYTES, KNOWN_WORDS = 64, 200_000


class Known(dict):
    """Digests of words of 16 bytes, of which a bounded number is remembered."""

    def __missing__(self, word: bytes) -> bytes:
        found = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found


def pieces(text: bytes, most: int, is_word: np.ndarray) -> Iterator[bytes]:
    """Parts of a text of about `most` bytes that no word spans; only a longer word makes a longer part. is_word: bool[256]."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and is_word[text[end]]:
            near = np.flatnonzero(~is_word[np.frombuffer(text, np.uint8, min(4096, len(text) - end), end)])
            end += int(near[0]) if len(near) else 4096
        yield text[at:end] if at or end < len(text) else text
        at = end


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that are hashed at once; a longer word makes a longer step.
HASH_STEP = 1 << 18


def _powers(n: int, kept: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the hash base and of its inverse modulo 2**64; those of a usual step are kept by the worker."""
    make = lambda m: tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, b)]), dtype=np.uint64) for b in (_BASE, _INV))
    if n > 2 * HASH_STEP:
        return make(n)
    if not kept:
        kept.append(make(2 * HASH_STEP))
    return kept[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


PLAIN = np.arange(1, 257, dtype=np.uint64)
_LOWER = PLAIN.copy()
_LOWER[65:91] += np.uint64(32)


def words_of(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once, A-Z lower-cased, for statistics.

    raw/offsets: as utf8() gives them. word_byte: bool[256], the bytes of words (a word never crosses texts).
    Returns (hash uint64 of each word, its byte start, its text's number), in order. Equal words have equal hashes, but words that
    differ may share one by construction (it is a polynomial of the bytes modulo 2**64): what must be exact uses Known or the words.
    """
    h, s, _, doc = spans_of(raw, offsets, word_byte, _LOWER)
    return h, s, doc


def spans_of(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words_of, with the byte end of each word; values: uint64[256], what a byte counts as in the hash (not 0).

    Bytes are taken in steps that end between words, so memory beyond the results does not grow with the texts.
    """
    n, at, parts = len(raw), 0, []
    while at < n:
        end = min(n, at + HASH_STEP)
        while end < n and word_byte[raw[end]]:
            near = np.flatnonzero(~word_byte[raw[end : end + 4096]])
            end = min(n, end + (int(near[0]) if len(near) else 4096))
        parts.append(_spans(raw[at:end], offsets[slice(*np.searchsorted(offsets, [at + 1, end]))] - at, word_byte, values, at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, s, e, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(s, offsets)))


def _spans(raw: np.ndarray, cuts: np.ndarray, word_byte: np.ndarray, values: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of one step; cuts: where texts end inside it."""
    n = len(raw)
    inside = word_byte[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    starts[cuts], ends[cuts - 1] = inside[cuts], inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = values[raw]
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    h = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, s + at, e + at
