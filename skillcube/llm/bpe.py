"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding. A merge list has a sufficient lookahead: a number L of symbols such that a token boundary which lies at least L
symbols before the end of what was read is final, whatever follows. `lookahead` computes it from the merges: a merge (a, b)
can only be undone from its right by an earlier merge (b, c) that takes b away, which in turn needs c, which an earlier merge
of c's last part may take away, and so on with falling ranks; the longest such chain, in symbols, is L. The transducer keeps
a window of 4 L symbols, merges it, emits the tokens that end at least L symbols before its end, and goes on behind them. A word's end is final
at once. Every word goes this way; the tokens of words that recur are remembered in a cache of bounded size. Texts are read in chunks, and ids leave
as they become stable, so a text of any length and a word of any length need constant memory (a stretch of more than CHUNK characters without
a space or line break is cut too, unless it has characters whose class depends on the Unicode version: that stretch is pre-tokenized whole).

Decoding. `Decoder` turns ids into text piece by piece: either as the library does for a file without a decoder (token
strings joined by one space), or as text, by a byte-to-text state machine that holds back incomplete UTF-8 sequences.

Null texts are empty; empty texts have no tokens, and both digests are those of the empty string. Rows with equal doc_id
stay separate. Special-token strings in a text become their ids, as in the library's default. Extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from skillcube.llm.common import read_table, slices, worker_state
from skillcube.llm.token_output import LETTERS, NUMBERS, UNSAFE, byte_characters

STEP_BYTES = 1 << 20
CACHE_WORDS = 100_000
#: Characters of a text that are looked at together.
CHUNK = 1 << 16
_RUNS = {True: re.compile(rf"[{LETTERS}]*"), False: re.compile(rf"[^\s{LETTERS}{NUMBERS}]*")}
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def lookahead(merges: list[tuple[str, str]], suffix: str = "</w>") -> int:
    """Symbols to the right of a token boundary that decide whether it is final (see above)."""
    size = lambda t: len(t.removesuffix(suffix)) if t.endswith(suffix) else len(t)
    by_left: dict[str, int] = {}  # token -> longest chain that starts by taking it away, over the merges so far
    spine: dict[str, int] = {}  # token -> longest chain that undoes it from its right
    most = 1
    for a, b in merges:
        undone = max(by_left.get(b, 0), spine.get(b, 0))
        spine[a + b] = max(spine.get(a + b, 0), undone)
        by_left[a] = max(by_left.get(a, 0), size(b) + max(spine.get(b, 0), by_left.get(b, 0)))
        most = max(most, by_left[a], spine[a + b])
    return most + max((size(a + b) for a, b in merges), default=1)


class Bpe:
    """A word-level BPE vocabulary (byte-level symbols, end-of-word suffix) read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.pieces = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.need = lookahead(merges, self.suffix)
        self.shown = byte_characters()
        if any(c + end not in self.vocab for c in self.shown.values() for end in ("", self.suffix)):
            raise ValueError("the vocabulary lacks symbols of single bytes")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges to a window: always the first of the pairs with the lowest rank."""
        ranks = self.ranks
        if len(symbols) <= 64:
            get, none, short = ranks.get, len(ranks), list(symbols)
            rank = [get(p, none) for p in zip(short, short[1:])]
            while rank and (best := min(rank)) < none:
                i = rank.index(best)
                short[i] += short.pop(i + 1)
                del rank[i]
                if i < len(rank):
                    rank[i] = get((short[i], short[i + 1]), none)
                if i:
                    rank[i - 1] = get((short[i - 1], short[i]), none)
            return short
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j < 0 or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [p for p in parts if p is not None]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word from its symbols, each as soon as it is stable: the word has ended, or enough symbols stand behind it."""
        held: list[str] = []
        full = 4 * self.need
        for s in symbols:
            if len(held) == full:
                tokens, at = self.merge(held), 0
                for t in tokens:
                    if at + len(t) > full - self.need:
                        break
                    at += len(t)
                    yield t
                if not at:
                    full *= 2  # never for a lookahead that holds; keeps the result right all the same
                held = held[at:]
            held.append(s)
        if held:
            held[-1] += self.suffix
            yield from self.merge(held)

    def symbols(self, text: str) -> str:
        """The bytes of a text as symbols of the vocabulary."""
        return text.encode().decode("latin-1").translate(self.shown)

    def word(self, symbols: str) -> tuple[int, ...]:
        return tuple([self.vocab[t] for t in self.stream(symbols)])

    def words(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens of a text, and whether they are symbols already."""
        if _unsafe(text):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))], True
        return _WORDS.findall(_lowered(text)), False

    def _chunk(self, text: str) -> list[int]:
        """Ids of a text that no word reaches beyond."""
        words, shown = self.words(text)
        if shown:
            return [i for w in words for i in self.word(w)]
        return self._known(words)

    def _known(self, words: list[str]) -> list[int]:
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self.older.get(w) or self.word(self.symbols(w))
        return list(chain.from_iterable(map(cache.__getitem__, words)))

    def _plain(self, text: str) -> Iterator[list[int]]:
        at = 0
        while len(text) - at > CHUNK:
            end = max(text.rfind(c, at + 1, at + CHUNK) for c in " \n")
            if end > 0:
                yield self._chunk(text[at:end])
            else:  # a stretch without a space
                ends = [k for c in " \n" if (k := text.find(c, at + CHUNK)) >= 0]
                end = min(ends, default=len(text))
                if _unsafe(stretch := text[at:end]):
                    yield self._chunk(stretch)
                else:
                    yield from self._stretch(stretch)
            at = end
        yield self._chunk(text[at:] if at else text)

    def _stretch(self, text: str) -> Iterator[list[int]]:
        """Ids of a long stretch of safe characters; a word of it that does not end goes into the transducer symbol by symbol."""
        parts = _parts(text)
        for words, begun in parts:
            yield self._known(words)
            if begun:

                def symbols(part: str) -> Iterator[str]:
                    yield from self.symbols(part)
                    for (part,), more in parts:
                        yield from self.symbols(part)
                        if not more:
                            return

                tokens = self.stream(symbols(begun))
                while some := [self.vocab[t] for t in islice(tokens, 4096)]:
                    yield some

    def ids(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text as they become stable, without special tokens but those that its own characters spell."""
        if not any(s in text for s in self.special):
            yield from self._plain(text)
            return
        at = 0
        for m in self.split.finditer(text):
            yield from self._plain(text[at : m.start()])
            yield [self.special[m[0]]]
            at = m.end()
        yield from self._plain(text[at:])

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return list(chain.from_iterable(self.ids(text)))


def _unsafe(text: str) -> bool:
    return not text.isascii() and UNSAFE.search(text) is not None or any(c in text for c in "\x1c\x1d\x1e\x1f")


def _lowered(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def _parts(text: str) -> Iterator[tuple[list[str], str]]:
    """(whole words, begin of a word that goes on) of a stretch, chunk by chunk. What follows such a begin: ([part], whether it goes on still)."""
    held, run, at = "", None, 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and unicodedata.combining(text[end]):  # a mark may join what stands before it
            end += 1
        buffer, at = held + _lowered(text[at:end]), end
        last, start, held = end >= len(text), 0, ""
        if run is not None:
            start = run.match(buffer).end()
            more = start == len(buffer) and not last
            yield [buffer[:start]], "more" if more else ""
            if more:
                continue
            run = None
        found = list(_WORDS.finditer(buffer, start))
        if last or not found or found[-1].end() < len(buffer):
            yield [m[0] for m in found], ""
        elif len(open_ := found[-1][0]) > CHUNK // 2 and (run := next((r for r in _RUNS.values() if r.fullmatch(open_)), None)):
            yield [m[0] for m in found[:-1]], open_  # a run of letters or of symbols, which may go on; a contraction does not
        else:  # an apostrophe and what follows it may become one word yet
            yield [m[0] for m in found[:-2]], ""
            held = buffer[found[-2:][0].start() :]


class Decoder:
    """Incremental decoding. text=False: token strings joined by spaces, as the library does for a file without a decoder.
    text=True: the words' text; bytes that are not (yet) UTF-8 are held back until they are complete, or replaced."""

    def __init__(self, bpe: Bpe, text: bool = False) -> None:
        self.bpe, self.text, self.begun = bpe, text, False
        self.bytes = {c: b for b, c in bpe.shown.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        pieces = [p for p in map(self.bpe.pieces.get, ids) if p is not None]
        if not self.text:
            out = (" " if self.begun and pieces else "") + " ".join(pieces)
            self.begun |= bool(pieces)
            return out
        out = []
        for p in pieces:
            if p in self.bpe.special:
                out.append(self.state.decode(b"", True) + p)
                self.state.reset()
                continue
            ends = self.bpe.suffix and p.endswith(self.bpe.suffix)
            raw = bytes(self.bytes[c] for c in (p.removesuffix(self.bpe.suffix) if ends else p))
            out.append(self.state.decode(raw + b" " * bool(ends)))
        return "".join(out)

    def end(self) -> str:
        return self.state.decode(b"", True) if self.text else ""


def load(path: str) -> Bpe:
    """The vocabulary at path, kept by the worker with its cache."""
    return worker_state(f"bpe {path}", lambda: Bpe(path))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for b in slices(whole, "text", STEP_BYTES):
                yield b.append_column("ids", pa.array([bpe.encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32())))

    return run


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs with the column ids (array<int>): the ids of every whole text. Other columns stay."""
    docs = docs.drop("ids").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.mapInArrow(_encoded(tokenizer), StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        shown = [str(i) for i in range(max(bpe.pieces) + 1)]
        for whole in batches:
            for b in slices(whole, "text", STEP_BYTES):
                n, by_ids, by_text = [], [], []
                for t in b.column("text").to_pylist():
                    decoder, total, of_ids, of_text = Decoder(bpe), 0, hashlib.sha256(), hashlib.sha256()
                    for ids in bpe.ids(t):
                        of_ids.update((" " * bool(total and ids) + " ".join(map(shown.__getitem__, ids))).encode())
                        of_text.update(decoder.feed(ids).encode())
                        total += len(ids)
                    of_text.update(decoder.end().encode())
                    n.append(total)
                    by_ids.append(of_ids.hexdigest())
                    by_text.append(of_text.hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(by_ids), pa.array(by_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to, for every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_digests(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
