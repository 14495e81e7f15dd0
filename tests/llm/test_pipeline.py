import corpus_pipeline


def tables(spark, make_docs, words, path):
    good = [(i, words(i, 80).capitalize() + ".") for i in range(150)]
    junk = [(200 + i, " | ".join(words(i, 80).split())) for i in range(60)]
    item = words(5000, 30)
    leak = [(300, "Some text. " + item + " and more. " + words(1, 50))]
    copies = [(400, good[3][1]), (401, good[4][1] + " extra")]
    secret = [(500, words(700, 80).capitalize() + '. password = "hunter2222".')]
    docs = good + junk + leak + copies + secret
    make_docs(docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return good, junk


def test_stages(spark, make_docs, words, tmp_path):
    sf = f"file://{tmp_path}"
    good, junk = tables(spark, make_docs, words, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "encode"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encode":
            assert out.columns == columns
        out.write.parquet(f"{sf}/stage-{name}")
        docs = spark.read.parquet(f"{sf}/stage-{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    bad = {i for i, _ in junk}
    assert not kept[0] & bad and {i for i, _ in good} <= kept[0]
    assert kept[1] == kept[0] - {400, 401} and kept[2] == kept[1] - {300} and kept[3] == kept[2] == kept[4]
    text = spark.read.parquet(f"{sf}/stage-secrets").where("doc_id = 500").first()
    assert "hunter2222" not in text.text and "[SECRET]" in text.text and text.n_chars == len(text.text)
    ran = {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()}
    assert ran == {(r.doc_id, r.n_tokens) for r in docs.collect()}


def test_stages_take_empty_tables(spark, make_docs, words, tmp_path):
    sf = f"file://{tmp_path}"
    tables(spark, make_docs, words, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), sf).count() == 0


def test_near_copies_with_a_word_in_fifty_changed_go(spark, make_docs):
    w = [f"w{i}" for i in range(1000)]
    near = [x if i % 50 != 25 else f"new{i}" for i, x in enumerate(w)]
    far = [x if i % 40 != 20 else f"far{i}" for i, x in enumerate(w)]  # 5-word similarity 0.777
    docs = make_docs([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))])
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == {1, 3}
