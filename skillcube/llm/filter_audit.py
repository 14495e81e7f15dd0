"""What every order of five filters keeps, from one cube of failure flags.

Documents are counted once by part and failure flags. A SQL CUBE over the flags and the part then holds, in the rows of a grouping set whose
selected flags are all false, how many documents survive that subset of filters, whatever came first. Each step of an order is a pair of
subsets, so all 120 orders are read off by joining 80 pairs of subsets for each part.

Defined results. A null text is empty and has no words; a null source is the part ''. Filter E compares whole texts over the whole table, by
SHA-256; a null doc_id is neither smaller nor larger than another, and rows that repeat a doc_id do not fail because of each other. Labels
may be missing (no good, no toxic document) or repeated (1 anywhere counts). An empty table gives no rows. Zero counts are rows too.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import read_table, staged

FILTERS = "ABCDE"
#: Limits of the filters: words; percent of distinct words; percent of capitals; characters that no text should hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
_EVERY = (1 << len(FILTERS)) - 1
_WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters A to D, which look at one text. text: never null."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), "D": text.rlike(MARKS),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (true: the filter drops the document), good, toxic (0 or 1) of every row of docs (doc_id, text, source)."""
    text = F.coalesce(docs["text"], F.lit(""))
    seen = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), text.alias("text"))
    seen = seen.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *(c.alias(k) for k, c in text_flags(F.col("text")).items()))
    seen, _ = staged(seen, "flags")
    # texts that occur once are not joined; a hot text is counted in parts, and joined by a written table whose partitions Spark can split
    first, _ = staged(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "first-texts")
    marks = labels.groupBy(labels["doc_id"].alias("labelled")).agg(F.max((labels["quality"] == 1).cast("long")).alias("good"), F.max((labels["toxic"] == 1).cast("long")).alias("toxic"))
    marks, _ = staged(marks, "label-marks")
    both = seen.join(first, "digest", "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    fails = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("part", *FILTERS[:4], fails.alias("E"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(flags: DataFrame) -> DataFrame:
    """part, whole (true: all parts together, part is null), subset (bit k: filter k is applied), n, good, toxic: who passes every filter of the subset.

    All 32 subsets of every part are there, with zeros where nobody passes.
    """
    cells = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cube = cells.cube("part", *FILTERS).agg(F.grouping("part").alias("whole"), *(F.grouping(f).alias(f"no_{f}") for f in FILTERS), *(F.sum(c).alias(c) for c in _COUNTS))
    passes = [F.coalesce(~F.col(f), F.lit(True)) for f in FILTERS]  # a flag outside the grouping set is null
    subset = sum((F.when(F.col(f"no_{f}") == 0, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    for p in passes:
        cube = cube.where(p)
    found = cube.select("part", (F.col("whole") == 1).alias("whole"), subset.alias("subset"), *_COUNTS)
    every = found.where("subset = 0").select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit(_EVERY))).alias("subset"))
    same = F.col("e.part").eqNullSafe(F.col("f.part")) & (F.col("e.whole") == F.col("f.whole")) & (F.col("e.subset") == F.col("f.subset"))
    return every.alias("e").join(found.alias("f"), same, "left").select("e.part", "e.whole", "e.subset", *(F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in _COUNTS))


def _steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, before, filter: 600 rows, whatever the input."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            rows.append(("".join(order), k, before, FILTERS.index(f)))
            before |= 1 << FILTERS.index(f)
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int").coalesce(1)


def filter_orders(kept: DataFrame) -> DataFrame:
    """The audit of every order, from survivors(): a row per part, order and step.

    A filter's shapley is its removals summed over all orders: the orders in which a subset comes first, times what it removes after it.
    """
    pairs = kept.select("part", "whole", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in _COUNTS), F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("filter"))
    pairs = pairs.where(F.getbit("before", "filter") == 0).withColumn("after", F.col("before").bitwiseOR(F.expr("shiftleft(1, filter)")))
    # joined by part and subset; pairs of subsets are 80 for each part
    same = F.col("p.part").eqNullSafe(F.col("k.part")) & (F.col("p.whole") == F.col("k.whole")) & (F.col("p.after") == F.col("k.subset"))
    pairs = pairs.alias("p").join(kept.alias("k"), same).select(
        "p.part", "p.whole", "p.before", "p.filter", F.col("k.n").alias("kept"), (F.col("n_before") - F.col("k.n")).alias("removed"), (F.col("good_before") - F.col("k.good")).alias("good_lost"), (F.col("toxic_before") - F.col("k.toxic")).alias("toxic_lost")
    )
    ways = [factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    orders = F.element_at(F.array(*map(F.lit, ways)), F.bit_count("before") + 1)
    by_filter = pairs.groupBy("part", "whole", "filter").agg(
        F.sum(orders * F.col("removed")).alias("shapley"),
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.bit_count("before") == len(FILTERS) - 1, F.col("removed"))).alias("unique_fails"),
    )
    same = F.col("p.part").eqNullSafe(F.col("f.part")) & (F.col("p.whole") == F.col("f.whole")) & (F.col("p.filter") == F.col("f.filter"))
    full = pairs.alias("p").join(by_filter.alias("f"), same).select("p.*", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "shapley")
    steps = full.join(F.broadcast(_steps(kept.sparkSession)), ["before", "filter"])
    return steps.select("part", "whole", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the filters for every part and for the whole table. docs: doc_id, text, source; labels: doc_id, quality, toxic."""
    kept, _ = staged(survivors(flagged(docs, labels)), "survivors")
    return filter_orders(kept)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every source, over all documents."""
    audit = filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return audit.where("NOT whole").drop("whole")
