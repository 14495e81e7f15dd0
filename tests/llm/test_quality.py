import zlib

import numpy as np
import pyarrow as pa
import pytest

from skillcube.llm import boosting, quality
from skillcube.llm.common import utf8


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x, y)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.97
    one = model.base + sum(walk(model, t, x[3]) for t in range(len(model.feature)))
    assert model.margin(x[3:4])[0] == pytest.approx(one)


def walk(model, t, row):
    node = 0
    for _ in range(model.depth):
        node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
    return model.value[t, node - (2**model.depth - 1)]


def test_degenerate_labels():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert boosting.fit(np.ones((9, 3)), np.ones(9)).score(np.ones((1, 3)))[0] > 0.9


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "Hello world. Hello!", None, "ÄÖ ü\nline\nline\n", "   ", "x", "a b c " * 3000]
    all_ = quality.statistics(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(all_[i], quality.statistics(*utf8(pa.array([t], pa.string())))[0])
    names = dict(zip(quality.FEATURES, all_[1], strict=True))
    assert names["distinct_words"] == 1.0 and names["log_words"] == pytest.approx(np.log(4)) and np.isfinite(all_).all()
    assert dict(zip(quality.FEATURES, all_[3], strict=True))["distinct_lines"] == pytest.approx(2 / 3)


def corpus(words):
    rows, labels = [], []
    for i in range(400):
        junk = i % 3 == 0
        t = words(i, 60)
        rows.append((i, " | ".join(t.split()) if junk else t.capitalize() + "."))
        labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark, make_docs, words, tmp_path):
    rows, labels = corpus(words)
    rows += [(1000, None), (1001, ""), (1002, "a b " * 50000), (1002, "a b " * 50000)]
    make_docs(rows).withColumnRenamed("lang", "score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op3_quality(spark, f"file://{tmp_path}").collect()
    assert len(got) == 404
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [r for r in got if r.held_out and r.doc_id < 400]
    assert test and all(r.predicted == int(r.doc_id % 3 != 0) for r in test)
    same = [r.score for r in got if r.doc_id in (1000, 1001)]
    assert same[0] == same[1]


def test_keep_good_keeps_columns(spark, make_docs, words):
    rows, labels = corpus(words)
    docs = make_docs(rows).withColumnRenamed("source", "score")
    out = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i in range(400) if i % 3}


def test_no_labels_and_empty_table(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(make_docs([(1, "x")]), labels)
    assert quality.score_documents(make_docs([(1, "x")]), model).first().score == 0.5
    assert quality.score_documents(make_docs([]), model).count() == 0
