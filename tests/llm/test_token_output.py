import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skillcube.llm import token_output as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_is_the_library(library):
    import random

    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\n\n", ".", "12", "é", "\t", "'s", "\xa0", "ß", "$$$", " x", "\x1c", "日本", "<|endoftext|>", " ", "Ünder"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 16))) for _ in range(3000)]
    enc = T.ByteLevelEncoder(PATH)
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([2**i for i in range(30)] + [0])
    lengths = T.code_lengths(counts, 8)
    assert lengths.max() == 8 and lengths[-1] == 0 and sum(2.0 ** -int(x) for x in lengths[:-1]) == 1.0
    even = T.code_lengths(np.full(8, 5), 18)
    assert even.tolist() == [3] * 8
    assert T.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and T.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(5, int), 2)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_code_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 3000).astype(np.int64)
    code = T.Code(T.code_lengths(np.bincount(np.append(ids, 1), minlength=3001)))
    segment = T.pack_segment(code, 5, [1, None], [n, 0], ids)
    first, docs, lengths, back = T.unpack_segment(code, segment)
    assert (first, docs, lengths.tolist(), back.tolist()) == (5, [1, None], [n, 0], ids.tolist())
    with pytest.raises(ValueError):
        T.unpack_segment(code, segment[:-5] + bytes([segment[-5] ^ 1]) + segment[-4:])


def test_files(spark, make_docs, library, tmp_path):
    long = "word and other " * 40000
    docs = make_docs([(7, "b c"), (3, None), (5, ""), (5, "twice"), (5, "twice"), (9, long), (None, "no id"), (-2, "<|endoftext|>x")]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n")
    T.write_token_ids(docs, PATH, f"file://{tmp_path}/out", end_id=2)
    rows = T.read_token_ids(spark, f"file://{tmp_path}/out").collect()
    assert len(rows) == 8
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, -2, 3, 5, 5, 5, 7, 9]
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    got = {r.doc_id: r.ids_crc32 for r in rows}
    assert got[9] == crc(long) and got[3] == crc("") and got[-2] == crc("<|endoftext|>x") and got[None] == crc("no id")


def test_empty_table(spark, make_docs, tmp_path):
    T.write_token_ids(make_docs([]), PATH, f"file://{tmp_path}/out", end_id=2)
    assert T.read_token_ids(spark, f"file://{tmp_path}/out").count() == 0
