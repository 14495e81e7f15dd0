"""Token-ID output: canonical length-limited Huffman coding of ids, in files that decode block by block.

File format. A written output is a folder with two Parquet tables, so Spark's commit protocol covers it on any store:

* ``codebook``: one row, the code length of every id (uint8, 0: the id does not occur). Canonical codes follow from the lengths.
* ``segments``: one row per segment of whole documents, the payload being
  ``TKH1`` | n_docs u32 | block u32 | first_token u64 | n_tokens u64 | doc_ids i64[n_docs] | null flags u8[n_docs]
  | doc lengths u64[n_docs] | bit offset of every block u64[ceil(n_tokens / block)] | code bits, first bit highest | crc32 u32.

Blocks start at stored bit offsets, so they decode independently; the reader walks all blocks of a segment in step,
with one look-up in a table of 2**MAX_BITS entries per token.

Nulls: a null text is empty, a null doc_id is kept and sorts first. An empty text has the end id alone. Rows with equal
doc_id stay separate, ordered by their text's hash. An empty table gives no segments. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import PLAIN, drop_path, new_path, read_table, remove_at_exit, slices, spans_of, staged, utf8, worker_state

MAX_BITS = 18
BLOCK = 1024
SEGMENT_TOKENS = 1 << 20
#: Bytes of text that a worker tokenizes at once, and pieces that it remembers.
STEP_BYTES = 1 << 21
CACHE_PIECES = 2_000_000


def _safe_classes() -> tuple[str, str]:
    """Letters and numbers below U+0500, where all Unicode versions agree."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for i in range(0x500):
        kinds.get(unicodedata.category(chr(i))[0], []).append(chr(i))
    return "".join(kinds["L"]), "".join(kinds["N"])


LETTERS, NUMBERS = _safe_classes()
#: Separators on which definitions of white space differ, and blocks that newer Unicode versions add to.
UNSAFE = re.compile("[\\x1c-\\x1f\\x85\\u0500-\\u1fff\\u2070-\\U0010ffff]")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Store:
    """Ids of pieces by the pieces' hashes: sorted keys, and for each its run in one array of ids."""

    def __init__(self, kind: np.dtype) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at, self.size = np.zeros(1 << 20, kind), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.n_rows = self.n_ids = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of sorted keys, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.row[i], -1)

    def add(self, keys: np.ndarray, found: list[bytes]) -> np.ndarray:
        """Rows of new sorted keys with their ids."""
        size = np.array([len(x) for x in found], np.int64) // self.ids.itemsize
        new = np.frombuffer(b"".join(found), self.ids.dtype)
        while self.n_ids + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_rows + len(size) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        rows = np.arange(self.n_rows, self.n_rows + len(size))
        self.ids[self.n_ids : self.n_ids + len(new)] = new
        self.at[rows], self.size[rows] = self.n_ids + np.cumsum(size) - size, size
        self.n_rows, self.n_ids = self.n_rows + len(size), self.n_ids + len(new)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, where, keys), np.insert(self.row, where, rows)
        return rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, how many of each)."""
        size = self.size[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.at[rows] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at], size


_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[32] = False
#: Bytes whose texts take the slower path: control characters that are or may be white space, and leads from U+0500 on.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_ODD_BYTE[0xD4:] = True
_FIRST = np.uint64(0xA5A5F00DC0FFEE01)
_MOST_BYTES = 64


class ByteLevelEncoder:
    """Ids of texts by a byte-level tokenizer file of the tokenizers library.

    The library's model encodes each distinct piece once; its ids are remembered by the piece's 64-bit hash. A piece is what stands
    between two spaces, which is safe where no space touches other white space. All other texts go pre-token by pre-token, and those with
    special-token strings or characters outside the blocks where pre-tokenization is certain go through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.shown = self.tok.model, byte_characters()
        self.packed = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.tok.get_vocab_size())]
        self.store = _Store(self.kind)
        self.tails = {c: self._word(c) for c in ".,!?;:"}

    def _word(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))])

    def pieces(self, text: str) -> bytes:
        """Ids of a text without odd characters, pre-token by pre-token."""
        return b"".join(map(self._word, _WORDS.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and what follows it; letters with or without a final mark need no pattern."""
        tail = self.tails.get(chunk[-1:], b"")
        core = chunk[:-1] if tail else chunk
        if not core.isalpha():
            return self.pieces(" " + chunk)
        packed = self.packed
        shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.shown)
        return b"".join([packed[t.id] for t in self.model.tokenize(self.shown[32] + shown)]) + tail

    def text(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else UNSAFE.search(text)
        if odd or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return self.pieces(text)

    def _slow(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts cannot be cut at their spaces."""
        odd = _ODD_BYTE[raw]
        a, b = raw[:-1], raw[1:]
        space = raw == 32
        white = space | (raw == 10)
        odd[:-1] |= space[:-1] & white[1:] | white[:-1] & space[1:] | (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        for s in self.special:
            s = s.encode()
            odd[:-1] |= (a == s[0]) & (b == s[1 % len(s)]) if len(s) > 1 else a == s[0]
            odd[-1:] |= len(s) == 1 and raw[-1:] == s[0]
        slow = np.zeros(len(offsets) - 1, bool)
        slow[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        some = offsets[:-1] < offsets[1:]
        slow[some] |= space[offsets[:-1][some]] | space[offsets[1:][some] - 1]
        return slow

    def encode_array(self, column: pa.Array) -> list[bytes]:
        """Ids of every text of a string column."""
        raw, offsets = utf8(column)
        if not len(raw):
            return [b""] * len(column)
        if self.store.n_rows > CACHE_PIECES:
            self.store = _Store(self.kind)
        slow = self._slow(raw, offsets)
        h, start, end, doc = spans_of(raw, offsets, _NOT_SPACE, PLAIN)
        slow[doc[end - start > _MOST_BYTES]] = True
        first = start == offsets[doc]
        h[first] ^= _FIRST  # no space before it
        keep = ~slow[doc]
        h, start, end, doc, first = h[keep], start[keep], end[keep], doc[keep], first[keep]
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        rows = self.store.find(keys)
        new = np.flatnonzero(rows < 0)
        data = raw.tobytes()
        i = one[new]
        found = [self.pieces(data[a:z].decode()) if f else self._chunk(data[a:z].decode()) for a, z, f in zip(start[i].tolist(), end[i].tolist(), first[i].tolist(), strict=True)]
        rows[new] = self.store.add(keys[new], found)
        ids, size = self.store.take(rows[which])
        ends = np.cumsum(np.bincount(doc, size, len(column)).astype(np.int64)) * self.kind.itemsize
        packed, at = ids.tobytes(), 0
        out = []
        for k, (z, other) in enumerate(zip(ends.tolist(), slow.tolist(), strict=True)):
            out.append(self.text(column[k].as_py()) if other else packed[at:z])
            at = z
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))


def load(path: str) -> ByteLevelEncoder:
    """The encoder for the file at path, kept by the worker with its cache for the tasks to come."""
    return worker_state(f"token output {path}", lambda: ByteLevelEncoder(path))


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over `most`, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    merged, takes = weight, []  # takes: for every level, which entries of the merged list are leaves
    for _ in range(most - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        takes.append(by < n)
        merged = both[by]
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(takes):
        leaves = int(leaf[:need].sum())
        lengths[:leaves] += 1
        need = 2 * (need - leaves)
    lengths[:need] += 1
    out[order] = lengths
    return out


class Code:
    """Canonical codes from lengths: by length, then id."""

    def __init__(self, lengths: np.ndarray, most: int = MAX_BITS) -> None:
        self.most, self.len = most, lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        step = np.int64(1) << (most - self.len[order])
        first = np.cumsum(step) - step if len(order) else np.zeros(0, np.int64)
        self.code = np.zeros(len(lengths), np.uint64)
        self.code[order] = (first >> (most - self.len[order])).astype(np.uint64)
        self.table = np.zeros(1 << most, np.uint32)
        filled = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order].astype(np.uint32), step)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """(code bits, bit offset of every block). A code is shorter than a word of 32 bits, so every word starts at least one code and only
        the last of them reaches into the next word."""
        lens = self.len[ids]
        ends = np.cumsum(lens)
        if not len(ids):
            return b"", np.zeros(0, "<u8")
        at = ends - lens
        shifted = self.code[ids] << (64 - (at & 31) - lens).view(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words = np.zeros(len(first) + 1, np.uint64)
        words[:-1] = np.add.reduceat(shifted >> np.uint64(32), first)
        words[1:] += shifted[np.append(first[1:] - 1, len(ids) - 1)] & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::block].astype("<u8")

    def decode(self, bits: bytes, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        b = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        view = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = starts.astype(np.int64)
        out = np.zeros((block, len(at)), np.uint32)
        mask, top, tail = np.uint32((1 << self.most) - 1), 32 - self.most, n - block * (len(at) - 1)
        for i in range(min(block, n)):
            if i == tail:
                at = at[:-1]
            entry = self.table[view[at >> 3] >> (top - (at & 7)).astype(np.uint32) & mask]
            out[i, : len(at)] = entry >> np.uint32(5)
            at = at + (entry & np.uint32(31))
        return out.T.reshape(-1)[:n]


def pack_segment(code: Code, first: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    bits, starts = code.encode(ids)
    head = struct.pack("<4sIIQQ", b"TKH1", len(doc_ids), BLOCK, first, len(ids))
    body = head + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(lengths, "<u8").tobytes() + starts.tobytes() + bits
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_segment(code: Code, data: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(first token, doc ids, lengths, ids) of a segment; raises on damage."""
    magic, n_docs, block, first, n = struct.unpack_from("<4sIIQQ", data)
    if magic != b"TKH1" or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged token segment")
    at = struct.calcsize("<4sIIQQ")
    docs = np.frombuffer(data, "<i8", n_docs, at)
    nulls = data[at + 8 * n_docs : at + 9 * n_docs]
    lengths = np.frombuffer(data, "<u8", n_docs, at := at + 9 * n_docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", -(-n // block), at := at + 8 * n_docs)
    ids = code.decode(data[at + 8 * len(starts) : -4], starts, n, block) if n else np.zeros(0, np.uint32)
    return first, [None if z else int(d) for d, z in zip(docs, nulls, strict=True)], lengths, ids


def _encode(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, off = load(path), TaskContext.get().partitionId(), 0
        counts = np.zeros(size, np.int64)
        end = np.array([end_id], enc.kind).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", STEP_BYTES):
                ids = [x + end for x in enc.encode_array(batch.column("text"))]
                n = np.array([len(x) for x in ids], np.int64) // enc.kind.itemsize
                starts = off + np.cumsum(n) - n
                off += int(n.sum())
                counts += np.bincount(np.frombuffer(b"".join(ids), enc.kind), minlength=size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], names)
        if off:  # one more row, with the ids' counts instead of ids
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([off]), pa.array([None], pa.int64()), pa.array([-1]), pa.array([counts.tobytes()], pa.binary())], names)

    names = ["part", "off", "doc_id", "n", "ids"]
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.column("ids"):
            total = np.frombuffer(row.as_buffer(), np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])


def _write(kind: str, lengths: bytes, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        docs, sizes, held, first, at = [], [], [], 0, None

        def flush():
            data = pack_segment(code, first, docs, sizes, np.frombuffer(b"".join(held), kind).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(docs)]), pa.array([sum(sizes)]), pa.array([data], pa.binary())], ["first_token", "n_docs", "n_tokens", "data"])

        for b in batches:
            for part, off, doc, n, ids in zip(*(b.column(k).to_pylist() for k in ("part", "off", "doc_id", "n", "ids")), strict=True):
                start = base[part] + off
                if docs and (start != at or at - first >= SEGMENT_TOKENS):
                    yield flush()
                    docs, sizes, held = [], [], []
                if not docs:
                    first = start
                docs.append(doc)
                sizes.append(n)
                held.append(ids)
                at = start + n
        if docs:
            yield flush()

    return run


def _read(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for b in batches:
            for data in b.column("data"):
                first, docs, sizes, ids = unpack_segment(code, data.as_py())
                ids, ends = ids.astype("<u4"), np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int) -> None:
    """Encode every whole text, append end_id, and write ids in ascending doc_id order to `path` (see the file format above).

    The documents are range-partitioned by doc_id, each partition is encoded once in that order into the shared folder, ids
    are counted by partition and summed (at most one row per id reaches the driver), then coded segment by segment.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    size = max(size, end_id + 1)
    kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ids, at = staged(rows.mapInArrow(_encode(tokenizer, end_id, size), "part int, off long, doc_id long, n long, ids binary"), "token-ids", codec="snappy")
    counts = np.zeros(size, np.int64)
    for r in ids.where("n < 0").select("ids").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    totals = {r.part: r.off for r in ids.where("n < 0").select("part", "off").collect()}  # a row per partition
    ids = ids.where("n >= 0")
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS)], "lengths binary, most int").coalesce(1).write.parquet(f"{path}/codebook")
    ids.mapInArrow(_write(kind, lengths.tobytes(), base), "first_token long, n_docs long, n_tokens long, data binary").write.option("compression", "uncompressed").parquet(f"{path}/segments")
    drop_path(spark, at)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in a written output."""
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first().lengths)
    return spark.read.parquet(f"{path}/segments").select("data").mapInArrow(_read(lengths), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-output")
    write_token_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    remove_at_exit(spark, path)
    return read_token_ids(spark, path)
