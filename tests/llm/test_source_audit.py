"""The audit against every term of every pair."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillcube.llm import source_audit as S

DOCS = "doc_id long, text string, lang string, source string, term string, n long"


def expected(docs, top):
    texts = {}
    for _, t, lang, s, *_ in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        texts.setdefault(lang or "", []).append((s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, them in texts.items():
        df = Counter(w for _, ws in them for w in set(ws))
        kept = [w for w, n in df.items() if n >= 3]
        counts = {s: Counter(w for x, ws in them if x == s for w in ws if df[w] >= 3) for s in {s for s, _ in them}}
        whole = sum(counts.values(), Counter())
        p_of = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        ps, q = {s: p_of(c) for s, c in counts.items()}, p_of(whole)
        f = lambda p, q: (p - q) ** 2 // q
        for s in counts:
            pair = sorted(((sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in counts if o != s), key=lambda x: (-x[0], x[1].encode()))
            term = sorted(((f(ps[s][w], q[w]), w) for w in kept if counts[s][w] and ps[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, o, v, k) for part, rows in (("pair", pair), ("term", term)) for k, (v, o) in enumerate(rows, 1)]
    return sorted(out)


def corpus(words):
    r = random.Random(4)
    docs = []
    for k in range(120):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["hot", "hot", "hot", "a", "b", "Ü", None])
        docs.append((k, words(k, r.choice([0, 3, 40, 300]), 250).title() + " " + r.choice(["", "Über-x", "日本語 a1b", "it's", "zzz zzz zzz"]), lang, source, "t", 1))
    docs += [(900, None, "fr", "s", "t", 1), (901, "", "fr", "other", "t", 1), (902, "only here", "fr", "third", "t", 1), (903, "1 2 3", "it", "alone", None, None), (3, docs[3][1], *docs[3][2:]), (None, "Word", None, None, None, None)]
    return docs


@pytest.mark.parametrize("top", [200, 7])
def test_equals_every_term_of_every_pair(spark, words, top):
    docs = corpus(words)
    df = spark.createDataFrame(docs, DOCS)
    assert sorted(map(tuple, S.source_audit(df, top).collect())) == expected(docs, top)


def test_small_steps_give_the_same(words, monkeypatch):
    """Texts longer than a step, and tasks that hand rows on early, change nothing."""
    docs = [(t or "", lang or "", s or "") for _, t, lang, s, *_ in corpus(words)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs, strict=True)], ["text", "lang", "source"])

    def counted():
        total = Counter()
        for b in S.count_terms(iter([batch])):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"]] += r["n"] + 1_000_000 * r["documents"]
        return total

    whole = counted()
    monkeypatch.setattr(S, "STEP", 100)
    monkeypatch.setattr(S, "ROWS", 50)
    assert counted() == whole and sum(whole.values())


def test_terms_are_put_together_across_batches():
    rows = [("x", "en", s, n, 1) for s, n in (("a", 1), ("a", 2), ("b", 5))] + [("y", "en", "a", 1, 2)] + [("z", "de", "c", 4, 3), ("z", "en", "c", 9, 2), ("z", "en", "d", 1, 1)]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("term", "lang", "source", "n", "documents"))})
    want = [("en", "x", 8, [("a", 3), ("b", 5)]), ("de", "z", 4, [("c", 4)]), ("en", "z", 10, [("c", 9), ("d", 1)])]
    for size in (1, 2, 3, 7):
        got = [r for b in S.sum_terms(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [(r["lang"], r["term"], r["total"], [(c["source"], c["n"]) for c in r["counts"]]) for r in got] == want


def test_combinations_with_zeros(spark):
    """Two sources, five terms: (2, 1) twice, (3, 0), (0, 4) and one that neither has."""
    joint = spark.createDataFrame([("en", "a", "b", 2, 1, 2)], "lang string, a string, b string, x long, y long, terms long")
    histograms = spark.createDataFrame([("en", "a", 2, 2), ("en", "a", 3, 1), ("en", "b", 1, 2), ("en", "b", 4, 1)], "lang string, source string, n long, terms long")
    pairs = spark.createDataFrame([("en", "a", "b", 5)], "lang string, a string, b string, vocabulary long")
    got = {(r.x, r.y): r.terms for r in S.all_combinations(joint, histograms, pairs).collect()}
    assert got == {(2, 1): 2, (3, 0): 1, (0, 4): 1, (0, 0): 1}


def test_counts_beyond_a_long(spark):
    big = 50_000_000_000
    row = spark.range(1).select(S.probability(*map(F.lit, (big, 10 * big, 7))).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (big + 1) // (10 * big + 7)


def test_empty_table(spark):
    assert S.source_audit(spark.createDataFrame([], DOCS)).collect() == []
