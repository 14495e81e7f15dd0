import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skillcube.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return B.Bpe(PATH)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60))
def test_encode_and_decode_any_text(text):
    library, own = _both()
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert B.Decoder(own).feed(ids) == library.decode(ids, skip_special_tokens=False)


_KEPT = []


def _both():
    if not _KEPT:
        _KEPT.extend((Tokenizer.from_file(PATH), B.Bpe(PATH)))
    return _KEPT


def test_special_strings_and_case(own, library):
    for t in ("a<|endoftext|>b", "<|startoftext|><|endoftext|>", "ΣΑΣ İX", "I'LL don'T", "é́ ½³ ﬁ Ǆ", "日本\x1cx", ""):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_long_words_stream_in_constant_windows(own, library):
    r = random.Random(1)
    pieces = [v.replace("</w>", "") for v in own.vocab if v.isascii()]
    longs = ["a" * 9000, "the" * 3000, "in" * 5000 + "g", "!?" * 4000, "".join(r.choice("aaabcdehilnoprst") for _ in range(9000)), "".join(r.choice(pieces) for _ in range(4000)), "äöü" * 3000]
    for t in longs:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
    fed = []

    def symbols():
        for c in "ab" * 20000:
            fed.append(c)
            yield c

    stream = own.stream(symbols())
    next(stream)
    assert len(fed) <= 4 * own.need + 1


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "'", "s", "'re", "!", "é", "e\u0301", "\u0301", " ", "\n", "\t", "1", "the", "ß", "日", "<|endoftext|>", "xyz" * 9, "\u00a0"]), max_size=40).map("".join), chunk=st.integers(2, 12))
def test_chunks_do_not_show(text, chunk):
    library, own = _both()
    was, B.CHUNK = B.CHUNK, chunk
    try:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    finally:
        B.CHUNK = was


def test_ordinary_documents_go_through_the_transducer(own, words, monkeypatch):
    text, seen = words(5, 500) + " It's 12 o'clock!", []
    stream = own.stream

    def watched(symbols):
        tokens = list(stream(symbols))
        seen.append("".join(tokens).removesuffix("</w>"))
        return iter(tokens)

    monkeypatch.setattr(own, "stream", watched)
    monkeypatch.setattr(own, "cache", {})
    monkeypatch.setattr(own, "older", {})
    own.encode(text)
    assert sorted(seen) == sorted(set(own.words(text)[0]))


def test_a_long_text_needs_constant_memory(own):
    for text in ("some words again " * 600_000, "ab" * 1_000_000):  # 10 MB; 2 MB in one word
        n = 0
        tracemalloc.start()
        for ids in own.ids(text):
            n += len(ids)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n and peak < 8 << 20


def test_lookahead_of_chains():
    assert B.lookahead([("b", "c")]) >= 1
    # (a, b) is undone by (b, c), which is undone by (c, d)
    assert B.lookahead([("c", "d"), ("b", "c"), ("a", "b")]) >= 2


def test_text_decoder_holds_back_bytes(own):
    ids = own.encode("wörld ok")
    decoder = B.Decoder(own, text=True)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == "wörld ok "


def test_table(spark, make_docs, library, tmp_path):
    docs = [(1, None), (2, ""), (3, "Hello wörld's"), (3, "Hello wörld's"), (None, "x"), (4, "word " * 100000)]
    make_docs(docs).withColumnRenamed("lang", "ids").write.parquet(f"{tmp_path}/documents.parquet")
    rows = B.op7_bpe(spark, f"file://{tmp_path}").collect()
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    out = B.encode_documents(make_docs(docs), PATH)
    assert out.columns[-1] == "ids" and out.count() == 6
    assert B.token_digests(make_docs([]), PATH).count() == 0
