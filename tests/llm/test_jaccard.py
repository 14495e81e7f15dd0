import random
import re
import tracemalloc

import numpy as np
import pytest

from skillcube.llm import jaccard_join as J
from skillcube.llm.common import Known
from skillcube.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def variants(words, seed=0):
    """Copies, near copies around the threshold, chains, short texts, shared passages."""
    r = random.Random(seed)
    docs, passage = [], words(99, 60)
    for k in range(12):
        w = words(100 + k, 200).split()
        docs.append(" ".join(w))
        for _ in range(6):
            v = list(w)
            for _ in range(r.randint(0, 9)):
                v[r.randrange(len(v))] = f"new{r.randrange(10**6)}"
            docs.append(" ".join(v))
        docs.append(" ".join(w).upper())
        docs.append(words(500 + k, 80) + " " + passage + " " + words(900 + k, 80))
    w = words(77, 400).split()
    for k in range(40):  # a chain: neighbours link, the ends do not
        w = list(w)
        w[k * 9] = f"c{k}"
        docs.append(" ".join(w))
    docs += ["one", "one", "One  two", "one two", "one two three", "a b c d e f g h i j", "a b c d e f g h i j k", "", " \t ", "x " * 5000]
    r.shuffle(docs)
    return list(enumerate(docs))


def link(make_docs, docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.link_documents(make_docs(docs).withColumnRenamed("lang", "digest")).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_is_brute_force(make_docs, words, seed):
    docs = variants(words, seed)
    assert link(make_docs, docs) == brute(docs)


def test_two_rounds_without_leaders_luck(make_docs, words):
    """A large group of near copies that edit different places: all in one component, or in several, as brute force says."""
    r = random.Random(4)
    w = words(5, 150).split()
    docs = []
    for i in range(150):
        v = list(w)
        for _ in range(r.choice([1, 3, 5])):
            v[r.randrange(len(v))] = f"z{r.randrange(10**6)}"
        docs.append((i, " ".join(v)))
    assert link(make_docs, docs) == brute(docs)


def test_nulls_and_repeats(make_docs, words):
    a, b = words(1, 50), words(2, 50)
    docs = [(5, a), (3, a), (None, a), (None, b), (7, None), (None, None), (8, b), (9, a + " tail"), (4, "x y z"), (4, a), (4, "x y z")]
    assert link(make_docs, docs) == brute(docs)
    assert link(make_docs, []) == []
    only = [(None, a), (None, a)]
    assert link(make_docs, only) == brute(only)


def test_keep_first(make_docs, words):
    docs = variants(words)
    docs += [(0, docs[0][1])]
    out = J.keep_first(make_docs(docs).withColumnRenamed("source", "label"))
    want = {c for d, n, c in brute(docs) if n} | {d for d, n, _ in brute(docs) if not n}
    ids = sorted(r.doc_id for r in out.collect())
    assert ids == sorted(want) and out.columns == ["doc_id", "text", "lang", "label", "n_chars"]


def test_prefix_filter_is_exact():
    for n in range(9, 300):
        p = J.prefix_length(n)
        assert p == n - -(-9 * n // 10) + 1 and p >= 1


def test_shingles_match_words(monkeypatch):
    texts = ["a b c d", "", "a", "a b", "A  b\tc", "é b c", "x " * 3000 + "a\u00a0b c"]
    known = Known()
    for step in (1 << 20, 7):
        monkeypatch.setattr(J, "STEP_BYTES", step)
        sets = [J.set_of(t.encode(), 3, known) for t in texts]
        assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
        assert J.common(sets[4], sets[0]) == 1 and J.common(sets[5], sets[0]) == 0 and J.common(sets[0], sets[0]) == 2
    assert J.common(np.array([[1, 1], [1, 2]], np.uint64), np.array([[1, 2], [3, 3]], np.uint64)) == 1


def thue_morse(k):
    """A word over a and b and its complement: any polynomial hash modulo 2**64 gives both one value from 1,024 letters on."""
    bits = [i.bit_count() % 2 for i in range(1 << k)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("k", [10, 11])
def test_words_that_collide_in_a_polynomial_hash_do_not_link(make_docs, words, k):
    one, other = thue_morse(k)
    docs = [(1, f"{one} foo bar"), (2, f"{other} foo bar"), (3, f"{one} foo bar"), (4, f"{words(1, 12)} {one}"), (5, f"{words(1, 12)} {other}")]
    assert link(make_docs, docs) == brute(docs)


def test_a_long_text_takes_memory_for_its_set_alone():
    text = b"some words that come again and again " * 300_000  # 11 MB
    known = Known()
    tracemalloc.start()
    assert len(J.set_of(text, 3, known)) == 7
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (200, 201), (201, 200)] + [(300, 301 + i) for i in range(100)]
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[102] == 100 and got[201] == 200 and got[400] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_size():
    assert J.least_size() == 9 and J.least_size(80) == 4 and J.least_size(85) == 6


@pytest.mark.parametrize("seed", [0, 1])
def test_is_brute_force_at_five_words_and_eighty_percent(make_docs, words, seed):
    docs = [t for _, t in variants(words, seed)]
    r = random.Random(seed)
    for k in range(6):  # short texts: sets of four shingles and more can link
        w = words(300 + k, 8 + k).split()
        docs += [" ".join(w), " ".join([*w, "tail"]), " ".join([*w, "tail", "end"]), " ".join(w[1:])]
    for k in range(6):  # a changed word about every 30 to 60 words
        w = [f"w{k}x{i}" for i in range(600)]
        for step in (30, 40, 45, 50, 57, 60):
            docs.append(" ".join(x if i % step else f"new{r.randrange(10**6)}" for i, x in enumerate(w)))
    docs = list(enumerate(docs))
    got = sorted(((d.doc_id, d.n_shingles, d.component_id) for d in J.link_documents(make_docs(docs), 5, 80).collect()), key=str)
    sets = [five_words(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and label[i] != label[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got == sorted(((d, len(s), c if s else d) for (d, _), s, c in zip(docs, sets, label, strict=True)), key=str)


def five_words(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
