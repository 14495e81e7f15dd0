"""How far the word frequencies of sources diverge, from joint histograms of counts.

Words are counted once by language, source and term. Sources of a language are then compared through the histogram of the pairs of counts
(count in one source, count in the other): the divergence of a term depends on its two counts alone, so it is worked out once for each
combination that occurs and multiplied by the number of terms with it. Only terms that both sources have are paired; combinations with a zero
are implied by what is left of each source's own histogram, and (0, 0) by the size of the vocabulary. Terms with the same counts in the same
sources are one row before anything is paired.

Defined results. A null text, language or source is ''. A language keeps the terms in at least LEAST_DOCUMENTS of its documents (rows that
repeat a doc_id are documents of their own). Sources without kept terms are compared too; where a language keeps no term, divergences are 0.
Ties are ranked by the item's UTF-8 bytes. An empty table gives no rows. Whole numbers throughout, in decimals where a product may outgrow a
long; a divergence that is no long itself raises, as sums do in ANSI mode. A task holds the distinct terms of one text and a bounded number of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillcube.llm.common import give_back, pieces, read_table, slices, staged, utf8

#: Documents of a language that a kept term is in at least; the scale of probabilities; ranks of terms that are reported.
LEAST_DOCUMENTS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: Bytes of text that are counted at once, and rows of counts that a task holds before it hands them on.
STEP, ROWS = 1 << 22, 1 << 20
#: Counts below this keep SCALE * count within a long.
_SMALL = 9_000_000_000
_COUNTS = "lang string, source string, term string, n long, documents long"

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Terms are runs of letters A-Z, a-z and of anything beyond ASCII.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)): add-one smoothing in whole numbers."""
    wide = lambda c: c.cast("decimal(19,0)")
    short = F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), total + terms)
    return F.lit(1) + F.when(n < _SMALL, short).otherwise(F.call_function("div", wide(F.lit(SCALE)) * wide(n + 1), wide(total + terms)))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most SCALE + 1, so it is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame) -> DataFrame:
    """lang, source of every group that occurs."""
    return docs.select(F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source")).distinct()


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The lower-cased terms of many texts in order, and the text that each is in."""
    letter = _LETTER[raw]
    starts, ends = letter.copy(), letter.copy()
    starts[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    starts[cuts], ends[cuts - 1] = letter[cuts], letter[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    at = np.zeros(len(s) + 1, np.int32)
    np.cumsum(e - s, out=at[1:])
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(at), pa.py_buffer(_LOW[raw[letter]])), np.searchsorted(offsets, s, "right") - 1


def _counted(terms: pa.StringArray, text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
    """group, number of the term, the terms, n, documents: a row for each group and term. group: that of each text."""
    coded = terms.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    each, n = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)  # of each text and term
    key, where = np.unique(group[each // size] * size + each % size, return_inverse=True)
    return key // size, key % size, coded.dictionary, np.bincount(where, n, len(key)).astype(np.int64), np.bincount(where, minlength=len(key)).astype(np.int64)


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("documents", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "documents_sum"]).rename_columns(["lang", "source", "term", "n", "documents"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by lang, source and term, summed within the task as far as ROWS allows."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in slices(batch, "text", STEP):
            for table in _tables(part):
                held.append(table)
                rows += table.num_rows
                if rows > ROWS:
                    held = [_summed(held)]
                    rows = held[0].num_rows
                    if 2 * rows > ROWS:
                        yield from held[0].to_batches()
                        held, rows = [], 0
    if held:
        yield from _summed(held).to_batches()
    give_back()


def _tables(part: pa.RecordBatch) -> Iterator[pa.Table]:
    raw, offsets = utf8(part.column("text"))
    lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    if len(raw) <= STEP:
        found = [_counted(*_terms(raw, offsets), group)]
    else:  # one long text: its parts are summed before it counts as one document
        found = [_counted(*_terms(x, np.array([0, len(x)])), group) for x in (np.frombuffer(p, np.uint8) for p in pieces(raw.tobytes(), STEP, _LETTER))]
    made = []
    for g, term, terms, n, documents in found:
        of = lambda column, k: column.dictionary.take(pa.array(k))
        made.append(pa.table({"lang": of(lang, g // len(source.dictionary)), "source": of(source, g % len(source.dictionary)), "term": terms.take(pa.array(term)), "n": n, "documents": documents}))
    if len(made) == 1:
        yield made[0]
    else:
        whole = _summed(made)
        yield whole.set_column(4, "documents", pa.array(np.ones(whole.num_rows, np.int64)))


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in columns:
        x = table.column(c).combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return new


def _profiles(rows: pa.Table) -> pa.RecordBatch:
    """The kept terms among whole terms, sorted by term, lang and source."""
    by_term, by_source = _changes(rows, ["term", "lang"]), _changes(rows, ["term", "lang", "source"])
    at = np.flatnonzero(by_source)
    n, documents = (np.add.reduceat(rows.column(c).to_numpy(), at) for c in ("n", "documents"))
    first = np.flatnonzero(by_term[at])  # of each term among its sources
    kept = np.add.reduceat(documents, first) >= LEAST_DOCUMENTS
    sizes, totals = np.diff(np.append(first, len(at)))[kept], np.add.reduceat(n, first)[kept]
    inside = np.repeat(kept, np.diff(np.append(first, len(at))))
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    counts = pa.StructArray.from_arrays([rows.column("source").combine_chunks().take(pa.array(at[inside])), pa.array(n[inside])], ["source", "n"])
    term = rows.select(["lang", "term"]).take(pa.array(at[first[kept]])).combine_chunks()
    return pa.RecordBatch.from_arrays([*(term.column(c).combine_chunks() for c in ("lang", "term")), pa.array(totals), pa.ListArray.from_arrays(pa.array(ends), counts)], ["lang", "term", "total", "counts"])


def sum_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles of rows that are sorted by term, lang and source. A term is handed on once the next one begins."""
    rest: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, new]).combine_chunks() if rest is not None else new
        if rows.num_rows:
            last = int(np.flatnonzero(_changes(rows, ["term", "lang"]))[-1])
            if last:
                yield _profiles(rows.slice(0, last))
            rest = rows.slice(last)
    if rest is not None and rest.num_rows:
        yield _profiles(rest)
    give_back()


def term_profiles(docs: DataFrame) -> DataFrame:
    """lang, term, total, counts (an array of source and n, by source) of every kept term."""
    named = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # one shuffle, by term. A term has at most a row for each source and task
    counts = named.mapInArrow(count_terms, _COUNTS).repartition("lang", "term")
    return counts.sortWithinPartitions("term", "lang", "source").mapInArrow(sum_terms, "lang string, term string, total long, counts array<struct<source:string,n:long>>")


def joint_counts(profiles: DataFrame) -> DataFrame:
    """lang, a, b, x, y, terms: of how many terms sources a < b have the counts x > 0 and y > 0."""
    same = profiles.groupBy("lang", "counts").agg(F.count("*").alias("terms")).where(F.size("counts") > 1)
    left = same.select("lang", "terms", "counts", F.posexplode("counts").alias("at", "a"))
    rest = F.slice("counts", F.col("at") + 2, F.size("counts"))
    both = left.where(F.col("at") + 1 < F.size("counts")).select("lang", "terms", "a", F.explode(rest).alias("b"))
    return both.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(F.sum("terms").alias("terms"))


def count_histograms(profiles: DataFrame) -> DataFrame:
    """lang, source, n, terms: of how many terms a source has the count n > 0."""
    one = profiles.groupBy("lang", "counts").agg(F.count("*").alias("terms")).select("lang", "terms", F.explode("counts").alias("c"))
    return one.groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("n")).agg(F.sum("terms").alias("terms"))


def all_combinations(joint: DataFrame, histograms: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, x, y, terms with the combinations that a zero makes. pairs: lang, a < b, vocabulary.

    What a source's own histogram has beyond the joint one meets a zero; signed rows are summed.
    """
    zero, terms = F.lit(0).cast("long"), F.col("terms")
    cell = lambda x, y, n: F.struct(x.alias("x"), y.alias("y"), n.alias("terms"))
    keys = ["lang", "a", "b"]
    inside = joint.select(*keys, F.explode(F.array(cell(F.col("x"), F.col("y"), terms), cell(F.col("x"), zero, -terms), cell(zero, F.col("y"), -terms), cell(zero, zero, terms))).alias("c"))
    of_a = pairs.select(*keys).join(histograms.withColumnRenamed("source", "a"), ["lang", "a"]).select(*keys, F.explode(F.array(cell(F.col("n"), zero, terms), cell(zero, zero, -terms))).alias("c"))
    of_b = pairs.select(*keys).join(histograms.withColumnRenamed("source", "b"), ["lang", "b"]).select(*keys, F.explode(F.array(cell(zero, F.col("n"), terms), cell(zero, zero, -terms))).alias("c"))
    neither = pairs.select(*keys, cell(zero, zero, F.col("vocabulary")).alias("c"))
    rows = inside.unionByName(of_a).unionByName(of_b).unionByName(neither).select(*keys, "c.x", "c.y", "c.terms")
    return rows.groupBy(*keys, "x", "y").agg(F.sum("terms").alias("terms")).where("terms > 0")


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(by))


def source_audit(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. docs: text, lang, source.

    Part pair: every other source of the language, by divergence over all kept terms. Part term: the `top` terms that are more frequent in
    the source than in its language and diverge most from it.
    """
    profiles, _ = staged(term_profiles(docs), "term-profiles")
    groups, _ = staged(groups_of(docs), "groups")
    langs = profiles.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_total"))
    histograms, _ = staged(count_histograms(profiles), "count-histograms")
    totals = histograms.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    none = F.lit(0).cast("long")
    sized = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    sizes, _ = staged(sized.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("vocabulary", "lang_total", "total"))), "group-sizes")

    left = sizes.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "vocabulary")
    pairs = left.join(sizes.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b")), "lang").where("a < b")
    cells = all_combinations(joint_counts(profiles), histograms, pairs.select("lang", "a", "b", "vocabulary")).join(pairs, ["lang", "a", "b"])
    p, q = probability(F.col("x"), F.col("total_a"), F.col("vocabulary")), probability(F.col("y"), F.col("total_b"), F.col("vocabulary"))
    cells = cells.select("lang", "a", "b", "terms", p.alias("p"), q.alias("q"))
    times = lambda f: F.sum(f * F.col("terms"))
    known = cells.groupBy("lang", "a", "b").agg(times(divergence(F.col("p"), F.col("q"))).alias("ab"), times(divergence(F.col("q"), F.col("p"))).alias("ba"))
    both = pairs.select("lang", "a", "b").join(known, ["lang", "a", "b"], "left")  # without a vocabulary there are no cells
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value"))))
    by_pair = _ranked(both.select("lang", ways.alias("w")).select("lang", "w.source", "w.item", F.coalesce("w.value", none).alias("value")))

    each = profiles.select("lang", "term", F.col("total").alias("in_lang"), F.explode("counts").alias("c")).select("lang", "term", "in_lang", "c.source", "c.n").join(sizes, ["lang", "source"])
    p, q = probability(F.col("n"), F.col("total"), F.col("vocabulary")), probability(F.col("in_lang"), F.col("lang_total"), F.col("vocabulary"))
    over = each.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    by_term = _ranked(over).where(F.col("rank") <= top)

    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return by_pair.select(*columns("pair")).unionByName(by_term.select(*columns("term")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return source_audit(read_table(spark, sf_dir, "documents"))
