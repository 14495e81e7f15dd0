"""The audit against all orders applied one after the other."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from skillcube.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, source string, part string, n long", "doc_id long, quality int, toxic int, good int"


def fails(i, text, seen):
    """The filters that a text fails; seen: doc_ids by text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f for f, yes in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", re.search(r"[#$%&*|]", text)),
            ("E", i is not None and any(j < i for j in seen[text] if j is not None)),
        ) if yes
    }


def expected(docs, labels):
    seen, rows = {}, {}
    for i, t, *_ in docs:
        seen.setdefault(t or "", []).append(i)
    for i, t, s, *_ in docs:
        good, toxic = (max([int(r[k] == 1) for r in labels if r[0] == i and i is not None], default=0) for k in (1, 2))
        for part in (s or "", None):
            rows.setdefault(part, []).append((fails(i, t, seen), good, toxic))
    out = {}
    for part, them in rows.items():
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = them
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                removals[f] += len(gone)
                failing = [r for r in them if f in r[0]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(None if r.whole else r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def corpus(words):
    r = random.Random(2)
    base = [words(k, 60, 2000) for k in range(12)] + [words(1, 30), "", None, " \t\n", "A B C " + words(3, 60, 2000), "ABCDEFGH " * 9, words(4, 60, 2000) + " 5 % | #", "a " * 80, words(5, 49, 2000) + " x", "É" * 60]
    docs = [(k, r.choice(base), r.choice(["s", "s", "s", "t", None, ""]), "x", k) for k in range(150)] + [(None, base[0], "t", "x", 1), (5, base[1], "t", "x", 1), (5, base[1], "t", "x", 1)]
    return docs, [(k, r.choice([0, 1, None]), r.choice([0, 1]), 3) for k in range(0, 120)] + [(3, 1, 1, 0), (None, 1, 1, 0), (7, 0, 0, 0)]


def test_equals_all_orders(spark, words):
    docs, labels = corpus(words)
    got = result(A.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    want = expected(docs, labels)
    assert len(want) == 600 * 4 and got == want


def test_parts_that_nothing_survives(spark):
    """Zeros are rows: no document of a passes A, none of b fails anything."""
    good = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "short", "a", "", 0), (2, None, "a", "", 0), (3, good, "b", "", 0)], DOCS)
    audit = A.filter_audit(docs, spark.createDataFrame([], LABELS)).where("NOT whole")
    assert audit.count() == 1200
    assert {tuple(r) for r in audit.where("part = 'b'").select("kept", "removed", "shapley").distinct().collect()} == {(1, 0, 0)}
    assert {r[0] for r in audit.where("part = 'a' AND filter_order = 'ABCDE'").select("kept").collect()} == {0}


def test_empty_table(spark):
    assert A.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_the_cube_has_every_subset(spark, words):
    docs, labels = corpus(words)
    kept = A.survivors(A.flagged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert kept.count() == 32 * 4 and kept.groupBy("part", "whole", "subset").count().where("count > 1").count() == 0
    whole = {r.subset: r.n for r in kept.where("whole").collect()}
    assert whole[0] == len(docs) and all(whole[s] <= whole[s & ~(1 << k)] for s in whole for k in range(5))
    assert kept.agg(F.sum(F.col("n") * F.when(F.col("whole"), 1).otherwise(-1))).first()[0] == 0
