"""Exact duplicates against plain grouping by text."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skillcube.llm import exact_dedup as E

UPPER = {c: c + 32 for c in range(65, 91)}


def expected(pairs):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) pairs without repeated rows."""
    groups = {}
    for i, t in pairs:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    out = []
    for low, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(low.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("n_chunks").collect()), key=str)


def texts(words):
    r = random.Random(5)
    base = ["", "a", "A", "É é", "É É", "ä Ä A", words(1, 900), words(2, 4000), "x" * 50_000, "ab " * 20_000, "日本" * 9000, "\n\n\t", "Σ ς", "İ i"]
    base += [base[6].upper(), base[6] + " ", base[7][:-1], base[7][1:], base[8] + "y", "Y" + base[8], base[10] + "語"]
    return [(i, t) for i, t in enumerate(base + [r.choice(base) for _ in range(60)])] + [(1000, None), (1001, None), (None, base[6])]


def test_equals_grouping_by_text(make_docs, words):
    pairs = texts(words)
    assert result(E.exact_duplicates(make_docs(pairs))) == expected(pairs)


def test_identifiers_that_clash_are_found(make_docs, words):
    """With a hash that tells little apart the next attempt is taken; one that never does raises."""
    pairs = texts(words)
    weak = lambda chunk, attempt: F.length(chunk).cast("long") if attempt == 0 else F.xxhash64(F.lit(attempt), chunk)
    cuts = E.cut(make_docs(pairs))
    assert E.verified(cuts, weak) == 1 and E.verified(cuts) == 0
    assert result(E.exact_duplicates(make_docs(pairs), weak)) == expected(pairs)
    with pytest.raises(RuntimeError):
        E.exact_duplicates(make_docs(pairs), lambda chunk, attempt: F.length(chunk).cast("long"))


def test_chunks_join_to_the_text(spark, make_docs, words, tmp_path):
    pairs = texts(words)
    E.cut(make_docs(pairs)).write.parquet(f"{tmp_path}/cuts")
    cuts = spark.read.parquet(f"{tmp_path}/cuts")
    sizes = [[len(c) for c in r.chunks] for r in cuts.collect()]
    assert all(E.LEAST <= n <= E.MOST for s in sizes for n in s[:-1]) and any(len(s) > 3 for s in sizes)
    recipes = E.recipes(cuts, 0)
    rebuilt = recipes.join(E.rebuild(recipes, E.chunk_store(cuts)), "row").select("doc.doc_id", "text")
    assert sorted(map(tuple, rebuilt.collect()), key=str) == sorted(((i, (t or "").translate(UPPER)) for i, t in pairs), key=str)


def test_shared_passages_share_chunks(make_docs, words):
    """A long passage at another place in another text is cut alike, so most of its chunks are stored once."""
    passage = words(3, 30_000)
    cuts = E.cut(make_docs([(1, words(4, 700) + passage), (2, words(5, 333) + " Other " + passage + words(6, 50))]))
    chunks = [set(r.chunks) for r in cuts.collect()]
    assert len(chunks[0] & chunks[1]) > 0.8 * min(map(len, chunks))


def test_repeated_rows_and_other_columns(spark):
    rows = [(7, "Same", 1.5, "a"), (7, "Same", 1.5, "a"), (7, "same", 2.5, None), (3, "SAME", 0.0, "b"), (None, None, None, None), (None, "", None, "c"), (9, "alone", None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe double, row string").withColumns({"doc": F.lit(1), "size": F.lit(2), "keep_row": F.lit(3)})
    out = E.exact_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in out) == [(0, 0, 2), (0, 0, 2), (3, 7, 4), (7, 7, 4), (7, 7, 4), (7, 7, 4), (9, 9, 1)]
    assert sum(r.kept for r in out) == 3 and sum(r.kept for r in out if r.group_size == 4) == 1
    kept = E.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(((r.doc_id or 0), (r.text or "").lower()) for r in kept.collect()) == [(0, ""), (7, "same"), (9, "alone")]


def test_empty_table(make_docs):
    assert E.exact_duplicates(make_docs([])).collect() == [] and E.drop_copies(make_docs([])).count() == 0


def test_a_hot_group(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Copy of a page").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    out = E.exact_duplicates(docs)
    assert out.where("group_size = 10000 AND keep_id = 29997").count() == 10_000 and out.where("kept").count() == 20_001


def test_no_python_on_the_main_path(make_docs):
    plan = E.exact_duplicates(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
