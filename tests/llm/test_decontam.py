import hashlib
import re

import pyarrow.parquet as pq

from skillcube.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = tokens(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def cases(words):
    item = words(1, 25)
    items = [(1, item), (2, "Tiny Item"), (3, None), (4, "..."), (10, item.split(" ", 5)[5]), (None, words(9, 12)), (5, "rep rep rep rep rep rep rep rep rep rep rep")]
    w = item.split()
    docs = [
        (0, None), (1, ""), (2, words(2, 300)), (3, "x " + item.upper() + " y"), (4, "before " + " ".join(w[3:13]) + " after"), (5, " ".join(w[3:12])), (6, "a tiny, ITEM! here tiny é item"),
        (7, "rep " * 30), (8, words(3, 60000) + " " + " ".join(w[:12])), (8, " ".join(w[:12])), (9, " ".join(reversed(w[:10]))), (11, "tiny"), (12, "item"),
    ]
    return docs, items


def find(spark, make_docs, docs, items, **kw):
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc int")
    rows = decontam.find_matches(decontam.build_index(make_docs(docs), kw.pop("segment_bytes", decontam.SEGMENT_BYTES)), benchmark, **kw)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows.collect()), key=str), rows


def test_is_brute_force(spark, make_docs, words):
    docs, items = cases(words)
    assert find(spark, make_docs, docs, items)[0] == brute(docs, items)


def near_brute(docs, items, size=10, slop=2):
    """Items of which all distinct words of a window lie within size + slop words."""
    out = {}
    for d, t in docs:
        w, found = tokens(t), set()
        for i, item in items:
            x = tokens(item)
            n = min(size, len(x))
            for k in range(len(x) - n + 1 if n and i is not None else 0):
                need = set(x[k : k + n])
                if any(need <= set(w[s : s + n + slop]) for s in range(max(1, len(w) - n - slop + 1))):
                    found.add(str(i))
        out[d] = sorted(found)
    return out


def test_windows_by_their_rarest_term(spark, make_docs, words, monkeypatch):
    docs, items = cases(words)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontam, "BATCH_WINDOWS", 3)
    assert find(spark, make_docs, docs, items)[0] == brute(docs, items)
    assert find(spark, make_docs, docs, [])[0] == brute(docs, []) and find(spark, make_docs, [], items)[0] == []


def test_long_texts_are_cut_into_segments(spark, make_docs, words, monkeypatch):
    docs, items = cases(words)
    near = near_brute(docs, items)
    near.pop(8)
    want = brute(docs, items)
    for bound in (0, 8 << 20):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", bound)
        got, rows = find(spark, make_docs, docs, items, segment_bytes=400)
        assert got == want and {r.doc_id: r["near"] for r in rows.collect() if r.doc_id != 8} == near


def test_texts_without_words_close_segments(spark, make_docs):
    """A segment is bounded by its rows too: empty and word-free texts do not make one endless segment."""
    docs = [(i, [None, "", "...", "one two"][i % 4]) for i in range(4000)]
    index = decontam.build_index(make_docs(docs).coalesce(1), 1 << 12)
    heads = [len(r.heads) for r in index.select("heads").collect()]
    assert sum(heads) == 4000 and max(heads) <= (1 << 12) // decontam.ROW_BYTES
    found = decontam.find_matches(index, spark.createDataFrame([("a", "one two")], "item_id string, text string"))
    assert sum(r.n_hit > 0 for r in found.collect()) == 1000


def test_what_a_task_holds_at_once_is_bounded(spark, make_docs, words):
    """Row groups of the index hold a few segments, however many one task writes; batches are small only meanwhile."""
    text, before = words(5, 20000), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    index = decontam.build_index(make_docs([(i, text) for i in range(200)]).coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(sizes) > 15 << 20 and max(sizes) < 12 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_copies_of_items_and_of_words_do_not_multiply(spark, make_docs, words):
    item = words(1, 25)
    items = [(i, item) for i in range(50)] + [(7, "rep " * 11), (7, item), (60, "rep " * 11)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows, of_windows, *_ = decontam.windows_of(benchmark)
    assert windows.count() == of_windows.count() == 17
    docs = [(1, f"x {item} y"), (2, "rep " * 30000), (3, "clean")]
    index = decontam.build_index(make_docs(docs))
    assert sorted(len(r.ranges) for r in decontam._matches(index, windows, None).collect()) == [1, 1]
    assert find(spark, make_docs, docs, items)[0] == brute(docs, items)


def test_words_that_collide_in_a_polynomial_hash(spark, make_docs):
    bits = [i.bit_count() % 2 for i in range(1024)]
    one, other = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    docs, items = [(1, f"zero {other} one two end"), (2, f"zero {one} one two end")], [(1, f"{one} one two")]
    assert find(spark, make_docs, docs, items)[0] == brute(docs, items)


def test_rows_that_share_an_id_go_alone(spark, make_docs, words):
    item = words(1, 25)
    docs = [(1, "clean words alone"), (1, f"x {item}"), (None, item), (None, "clean too"), (None, None)]
    out = decontam.drop_contaminated(make_docs(docs), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "clean words alone"), (None, "clean too"), (None, None)], key=str)


def test_proximity(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    shuffled = "beta alpha gamma delta epsilon x zeta eta theta kappa iota"
    apart = "alpha beta gamma delta epsilon a b c d zeta eta theta iota kappa"
    rows = {r.doc_id: r for r in find(spark, make_docs, [(1, item), (2, shuffled), (3, apart)], [(1, item)])[1].collect()}
    assert [rows[i]["near"] for i in (1, 2, 3)] == [["1"], ["1"], []] and [rows[i].n_hit for i in (1, 2, 3)] == [10, 0, 0]


def test_drop_and_empty(spark, make_docs, words):
    docs, items = cases(words)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = {d for d, _, n, _ in brute(docs, items) if not n} - {8}
    out = decontam.drop_contaminated(make_docs(docs).withColumnRenamed("lang", "n_hit"), benchmark)
    assert {r.doc_id for r in out.collect()} == clean and out.columns == ["doc_id", "text", "n_hit", "source", "n_chars"]
    assert find(spark, make_docs, [], items)[0] == []
    assert all(n == 0 for _, _, n, _ in find(spark, make_docs, docs, [])[0])


def test_query(spark, make_docs, words, tmp_path):
    docs, items = cases(words)
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op6_decontam(spark, f"file://{tmp_path}").collect()), key=str)
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)]
    assert got == sorted(want, key=str)
