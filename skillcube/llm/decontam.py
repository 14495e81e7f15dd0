"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments, each over a few neighbouring documents or a part of a long one: the distinct terms (words) with
their counts, and for each term the ascending list of its positions. It is stored once in the shared folder and can be asked again. A test window
is looked up in segments that have its terms: the rarest term's list, shifted by its offset, gives start positions, and the
next rarer terms' shifted lists are intersected with them one after another. What remains is exact; proximity matches (all
distinct terms of a window within `span` words, in any order) are found from the rarest term in the same way.

Windows are a table of their own. Up to BROADCAST_BYTES of them go to all segments at once. Beyond, every window is joined on the
term of its that the whole index holds least often, so it goes to the segments with that term alone, through a shuffle; neither the driver nor a
task then holds more than a part of the test set.

Memory: a segment is a row of some MB, so row groups of the stored index and batches between Spark and Python are kept to a few of them, whatever
a task's share of the input is. Items go by their texts until a document's texts are known, so copies of an item cost what they add to the result.

Words: A-Z lower-cased, runs of ASCII digits and letters and of non-ASCII characters, compared as they are (no hashes). A null text has no words. Items of
fewer words than a window are one window; items without words match nothing, nor do items with a null id. Equal item ids count once. Rows with equal
doc_id stay separate; extra columns are ignored (find) or kept (drop). Windows never cross documents. A long text is cut into segments that
overlap by OVERLAP words, so no text is too long; a window and its slop may not be longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import LONG_ROWS, pieces, read_table, slices, small_batches, staged, worker_state

SEGMENT_BYTES = 1 << 21
#: What a row costs in a segment besides its words, so that many empty texts close segments too.
ROW_BYTES = 64
#: Windows of so many bytes in all may be sent to every task.
BROADCAST_BYTES = 8 << 20
#: Windows that one row of the join carries at most, about.
BATCH_WINDOWS = 20_000
OVERLAP = 64
WINDOW = 10
SLOP = 2

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_TABLE = bytes(ord(" ") if not _WORD[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


_HEAD = "row long, doc_id long, tk long, n_words long"
_INDEX = f"seg long, terms array<string>, counts array<int>, positions binary, rows array<long>, begins array<int>, bases array<long>, heads array<struct<{_HEAD.replace(' long', ':long')}>>"


class _Open:
    """A segment that is being filled: words, and for each part of a document its row, begin in the segment and begin in the document."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.rows: list[int] = []
        self.begins: list[int] = []
        self.bases: list[int] = []
        self.heads: list[dict] = []
        self.bytes = 0

    def batch(self, seg: int) -> pa.RecordBatch:
        terms = list(dict.fromkeys(self.words))
        number = dict(zip(terms, range(len(terms)), strict=True))
        ids = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        positions = (np.sort(ids << 32 | np.arange(len(ids))) & 0xFFFFFFFF).astype("<u4")
        list_of = lambda x, kind: pa.array([x], pa.list_(kind))
        one = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()))
        head = pa.struct([(k, pa.int64()) for k in ("row", "doc_id", "tk", "n_words")])
        return pa.RecordBatch.from_arrays(
            [pa.array([seg]), one, list_of(np.bincount(ids, minlength=len(terms)), pa.int32()), pa.array([positions.tobytes()], pa.binary()), list_of(self.rows, pa.int64()),
             list_of(self.begins, pa.int32()), list_of(self.bases, pa.int64()), list_of(self.heads, head)],
            ["seg", "terms", "counts", "positions", "rows", "begins", "bases", "heads"],
        )


def _segments(size: int):
    return lambda batches: _cut(batches, size)


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    worker_state("decontamination")
    first, seg, row = TaskContext.get().partitionId() << 32, 0, 0
    now = _Open()
    for whole in batches:
        for b in slices(whole, "text", size):
            for text, doc_id, tk in zip(b.column("text"), b.column("doc_id").to_pylist(), b.column("tk").to_pylist(), strict=True):
                raw, total, tail = text.as_buffer().to_pybytes(), 0, []
                for part in pieces(raw, size, _WORD) if raw else (b"",):
                    if now.bytes and now.bytes + len(part) + ROW_BYTES > size:
                        yield now.batch(first + seg)
                        now, seg = _Open(), seg + 1
                    words = words_of(part)
                    now.rows.append(first + row)
                    now.begins.append(len(now.words))
                    now.bases.append(total - len(tail))
                    now.words += tail + words
                    now.bytes += len(part) + ROW_BYTES
                    total += len(words)
                    tail = (tail + words)[-OVERLAP:]
                now.heads.append({"row": first + row, "doc_id": doc_id, "tk": tk, "n_words": total})
                row += 1
    if row:
        yield now.batch(first + seg)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of the positional index of every whole text, stored in the shared folder."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"))
    with small_batches(docs.sparkSession):
        return staged(rows.mapInArrow(_segments(segment_bytes), _INDEX), "postings", **LONG_ROWS)[0]


def _windowed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("decontamination")
        for b in batches:
            for text, number in zip(b.column("text"), b.column("number").to_pylist(), strict=True):
                held: list[bytes] = []
                short = True
                for part in pieces(text.as_buffer().to_pybytes(), SEGMENT_BYTES, _WORD):
                    words = held + words_of(part)
                    held = words[-(size - 1) :] if size > 1 else []
                    if len(words) >= size:
                        short = False
                        yield of([b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)], number)
                if short and held:
                    yield of([b" ".join(held)], number)

    def of(found: list[bytes], number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(np.full(len(found), number))], ["window", "number"])

    return run


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(win, window) of the distinct windows, words joined by a space, (win, number) of the distinct texts that have them, and (number, item) of the items; all written out."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where("item is not null")
    texts, _ = staged(items.select("text").distinct().select(F.monotonically_increasing_id().alias("number"), "text"), "texts-of-items")
    # written files hide how large repeated strings are in memory, so these are not broadcast by their files' sizes
    of_texts, _ = staged(items.distinct().join(texts.hint("merge"), "text").select("number", "item"), "items-of-texts")
    with small_batches(benchmark.sparkSession):
        rows, _ = staged(texts.mapInArrow(_windowed(size), "window string, number long").distinct(), "windows-of-texts")
    windows, _ = staged(rows.select("window").distinct().select(F.monotonically_increasing_id().alias("win"), "window"), "windows")
    of_windows, _ = staged(rows.join(windows.hint("merge"), "window").select("win", "number"), "texts-of-windows")
    return windows, of_windows, of_texts


class Asked:
    """Windows by length: their numbers in the table and their terms as places in a list of distinct terms."""

    def __init__(self, wins: np.ndarray, windows: pa.Array) -> None:
        words = pc.split_pattern(windows, " ")
        coded = words.flatten().dictionary_encode()
        self.terms = coded.dictionary
        flat, ends = coded.indices.to_numpy().astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))
        sizes = np.diff(ends)
        self.by_size = {int(n): (wins[sizes == n], flat[ends[:-1][sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)}


class Segment:
    def __init__(self, terms: pa.Array, counts: np.ndarray, positions: bytes, begins: np.ndarray) -> None:
        self.terms, self.lists = terms, np.append(0, np.cumsum(counts)).astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.ends = np.append(begins, len(self.positions)).astype(np.int64)
        self._keys: np.ndarray | None = None

    @property
    def keys(self) -> np.ndarray:
        """The postings as one ascending array of term number and position."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.terms)) << 32, np.diff(self.lists)) | self.positions
        return self._keys

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """Numbers of terms in this segment, -1 where absent."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def starts(self, rarest: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position - offset) over the lists of one term per row."""
        n = self.lists[rarest + 1] - self.lists[rarest]
        row = np.repeat(np.arange(len(rarest)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.lists[rarest][row]
        return row, self.positions[at] - offset[row]

    def present(self, windows: np.ndarray) -> np.ndarray:
        return np.flatnonzero((windows >= 0).all(1))

    def exact(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of the exact matches of windows of term numbers, all present."""
        size = windows.shape[1]
        order = np.argsort(self.lists[windows + 1] - self.lists[windows], axis=1, kind="stable")
        rows = np.arange(len(windows))
        row, start = self.starts(windows[rows, order[:, 0]], order[:, 0])
        ok = (start >= 0) & (start + size <= self.ends[-1])
        row, start = row[ok], start[ok]
        for k in range(1, size):
            if not len(row):
                break
            offset = order[row, k]
            want = windows[row, offset] << 32 | (start + offset)
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            row, start = row[ok], start[ok]
        ok = np.searchsorted(self.ends, start, "right") == np.searchsorted(self.ends, start + size - 1, "right")
        return row[ok], start[ok]

    def near(self, windows: np.ndarray, span: int, known: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """(row, document) where all distinct terms of a window lie within span words; known: those that an exact match has shown."""
        size = windows.shape[1]
        order = np.argsort(self.lists[windows + 1] - self.lists[windows], axis=1, kind="stable")
        row, at = self.starts(windows[np.arange(len(windows)), order[:, 0]], np.zeros(len(windows), np.int64))
        for k in range(1, size):
            if not len(row):
                break
            term = windows[row, order[row, k]] << 32
            doc = np.searchsorted(self.ends, at, "right") - 1
            low, high = np.maximum(at - span + 1, self.ends[doc]), np.minimum(at + span, self.ends[doc + 1])
            ok = np.searchsorted(self.keys, term | low) < np.searchsorted(self.keys, term | high)
            row, at = row[ok], at[ok]
        shown = set(known)
        doc = np.searchsorted(self.ends, at, "right") - 1
        for r, d, p in zip(row.tolist(), doc.tolist(), at.tolist(), strict=True):
            if (r, d) in shown:
                continue
            low, high = max(p - span + 1, int(self.ends[d])), min(p + span, int(self.ends[d + 1]))
            held = [self.keys[slice(*np.searchsorted(self.keys, [t << 32 | low, t << 32 | high]))] & 0xFFFFFFFF for t in np.unique(windows[r])]
            if any(all(np.searchsorted(x, s) < np.searchsorted(x, s + span) for x in held) for s in range(low, p + 1)):
                shown.add((r, d))
        return shown


#: Start positions that are intersected at once.
_MOST = 1 << 20


def _merged(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the same positions that do not overlap; doc: each range's document, ascending with a."""
    if not len(a):
        return a, b, doc
    order = np.argsort(a, kind="stable")
    a, reach, doc = a[order], np.maximum.accumulate(b[order]), doc[order]
    first = np.flatnonzero(np.append(True, (a[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))
    return a[first], reach[np.append(first[1:], len(a)) - 1], doc[first]


def _matched(seg: Segment, asked: Asked, rows: np.ndarray, bases: np.ndarray, slop: int | None) -> pa.RecordBatch:
    """row, ranges (in the document), exact and near (numbers of windows) of the documents of a segment that have matches."""
    numbers = seg.numbers(asked.terms)
    none = np.zeros(0, np.int64)
    hit = none, none, none
    exact: dict[int, set] = {}
    near: dict[int, set] = {}
    for size, (wins, terms) in asked.by_size.items():
        windows = numbers[terms]
        there = seg.present(windows)
        cost = (seg.lists[windows[there] + 1] - seg.lists[windows[there]]).min(1) if len(there) else none
        for some in np.split(there, np.flatnonzero(np.diff(np.cumsum(cost) // _MOST)) + 1):
            if not len(some):
                continue
            row, start = seg.exact(windows[some])
            doc = np.searchsorted(seg.ends, start, "right") - 1
            hit = _merged(*(np.append(x, y) for x, y in zip(hit, (start, start + size, doc), strict=True)))
            row, doc = divmod(np.unique(row << 32 | doc), 1 << 32)
            for r, d in zip(row.tolist(), doc.tolist(), strict=True):
                exact.setdefault(d, set()).add(int(wins[some[r]]))
            if slop is not None:
                for r, d in seg.near(windows[some], size + slop, set(zip(row.tolist(), doc.tolist(), strict=True))):
                    near.setdefault(d, set()).add(int(wins[some[r]]))
    ranges: dict[int, list] = {}
    for a, b, d in zip(*(x.tolist() for x in hit), strict=True):
        base = int(bases[d] - seg.ends[d])
        ranges.setdefault(d, []).append({"a": a + base, "b": b + base})
    docs = sorted({*ranges, *near})
    of = lambda found: pa.array([sorted(found.get(d, ())) for d in docs], pa.list_(pa.int64()))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(rows[docs] if docs else [], pa.int64()), pa.array([ranges.get(d, []) for d in docs], kind), of(exact), of(near)], ["row", "ranges", "exact", "near"])


_MATCHED = "row long, ranges array<struct<a:long,b:long>>, exact array<long>, near array<long>"


def _ask(window_rows, slop: int | None):
    """Ask every segment; window_rows: a broadcast (win, window) table, or None where each row brings its own windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("decontamination")
        asked = Asked(*window_rows.value) if window_rows is not None else None
        for b in batches:
            for i in range(b.num_rows):
                get = lambda k: b.column(k)[i].values  # noqa: B023, E731
                seg = Segment(get("terms"), get("counts").to_numpy(), b.column("positions")[i].as_buffer(), get("begins").to_numpy())
                some = asked or Asked(get("wins").to_numpy(), get("windows"))
                yield _matched(seg, some, get("rows").to_numpy(), get("bases").to_numpy(), slop)

    return run


def _candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """seg, wins, windows: for every segment, the windows whose rarest term over the whole index it holds, in batches."""
    terms, _ = staged(windows.select("win", F.explode(F.array_distinct(F.split("window", " "))).alias("term")), "window-terms")
    held = index.select("seg", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("seg", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    held, _ = staged(held.join(terms.select("term").distinct(), "term"), "terms-of-segments")
    total = held.groupBy("term").agg(F.sum("n").alias("total"))
    # a window with a term that no segment has matches nothing
    rarest = terms.join(total, "term", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "term")).alias("rarest")).where("rarest.total > 0")
    found = rarest.select("win", F.col("rarest.term").alias("term")).join(held.select("term", "seg"), "term").select("seg", "win").join(windows, "win")
    batches = max(1, -(-windows.count() // BATCH_WINDOWS))
    found = found.groupBy("seg", F.pmod("win", F.lit(batches)).alias("batch")).agg(F.collect_list(F.struct("win", "window")).alias("w"))
    return staged(found.select(F.col("seg").alias("of"), F.col("w.win").alias("wins"), F.col("w.window").alias("windows")), "asked-segments", **LONG_ROWS)[0]


def _matches(index: DataFrame, windows: DataFrame, slop: int | None) -> DataFrame:
    """row, ranges, exact, near: a row per document with matches."""
    spark = index.sparkSession
    columns = ["terms", "counts", "positions", "rows", "begins", "bases"]
    total = windows.agg(F.sum(F.octet_length("window") + 8)).first()[0] or 0
    if total <= BROADCAST_BYTES:
        table = windows.orderBy("win").toArrow()
        # a bound of bytes is shown for what is broadcast
        rows = spark.sparkContext.broadcast((table.column("win").to_numpy(), table.column("window").combine_chunks()))
        found = index.select(*columns).mapInArrow(_ask(rows, slop), _MATCHED)
    else:
        found = index.join(_candidates(index, windows), F.col("seg") == F.col("of")).select(*columns, "wins", "windows").mapInArrow(_ask(None, slop), _MATCHED)
    with small_batches(spark):
        found, _ = staged(found, "matches")
    return found.groupBy("row").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("ranges", "exact", "near")))  # parts of one document


def _covered(ranges: Column) -> Column:
    """Positions inside any of the ranges."""
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("n"), zero.alias("at"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(zero, r["b"] - F.greatest(r["a"], s["at"]))).alias("n"), F.greatest(s["at"], r["b"]).alias("at"))
    return F.aggregate(F.array_sort(ranges), state, step, lambda s: s["n"])


def find_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """doc_id, tk (hash of the text), n_words, n_hit, items (ids, sorted as strings) with exact matches, near (items with proximity matches), per document.

    slop: words that a proximity match may have besides the window's; None: no proximity matches.
    """
    if window + (slop or 0) > OVERLAP:
        raise ValueError(f"a window and its slop may have {OVERLAP} words")
    windows, of_windows, of_texts = windows_of(benchmark, window)
    matches, _ = staged(_matches(index, windows, slop), "matched-documents")
    items = matches.select("row", F.explode(F.array(F.struct(F.lit("items").alias("kind"), F.col("exact").alias("wins")), F.struct(F.lit("near").alias("kind"), F.col("near").alias("wins")))).alias("k"))
    items = items.select("row", "k.kind", F.explode("k.wins").alias("win")).join(of_windows, "win").select("row", "kind", "number").distinct().join(of_texts, "number").groupBy("row").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("item")))).alias(k) for k in ("items", "near")))
    hits, _ = staged(matches.select(F.col("row").alias("of"), _covered(F.col("ranges")).alias("n_hit")).join(items.withColumnRenamed("row", "of"), "of"), "hits")
    heads = index.select(F.explode("heads").alias("h")).select("h.*")
    none = F.array().cast("array<string>")
    return heads.join(hits.hint("merge"), F.col("row") == F.col("of"), "left").select("doc_id", "tk", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), *(F.coalesce(k, none).alias(k) for k in ("items", "near")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without an exact match of a window, with their columns as they were.

    Rows are told apart by doc_id and text, so a clean row stays whatever other rows share its id.
    """
    hit = find_matches(build_index(docs), benchmark, window, slop=None).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__tk"))
    return docs.join(hit, same, "left_anti")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches of every document, and the items of which a window's words lie close together in any order (n_near, near_sha256)."""
    found = find_matches(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    n = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", "n_hit", n("items").alias("n_items"), digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), n("near").alias("n_near"), digest("near").alias("near_sha256"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the items of which a window's words lie close together in any order, for documents that have such."""
    found = find_matches(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.where(F.size("near") > 0).select("doc_id", F.array_join("near", ",").alias("items"))
