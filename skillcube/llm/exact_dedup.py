"""Exact duplicates by chunk recipes. Only DataFrame functions.

A normalised text is cut where its content says so, so a passage that texts share is cut alike in each of them. Texts are cut once and written
so. Every distinct chunk then moves once (tasks drop their own repeats before the shuffle) and gets an identifier that is verified: by their
bytes, no two different chunks have the same one. A document becomes its recipe, the ordered list of its chunks' identifiers; texts are equal
exactly if their recipes are, so documents are grouped and joined by a few bytes for each chunk and long texts don't move again.

Defined results. A null text counts as empty, and all empty texts are one group. A-Z are lower-cased and nothing else is. Of equal texts the
row with the largest doc_id stays; a null doc_id is smaller than any other. Of rows that repeat a doc_id and its text one stays. An empty
table gives no rows. Other columns, whatever they are called, have no influence. A text is held whole by the task that cuts it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import drop_path, lower_ascii, read_table, staged

#: Code points of a chunk: at least and at most. Only the last chunk of a text is shorter.
LEAST, MOST = 2048, 16384
#: So many marked characters in a row end a chunk.
RUN = 3
#: How many hashes are tried before giving up.
TRIES = 8


def _marks() -> str:
    """A class of about one letter in six: code points of Latin-1 by their remainder, some ranges of other scripts."""
    latin = "".join(f"\\x{c:02x}" for c in range(0x21, 0x100) if c % 6 == 1)
    ranges = [(0x0430, 6), (0x3040, 16), *((0x4E00 + 0x1400 * k, 0x400) for k in range(4)), (0xAC00, 0x700)]
    return "[" + latin + "".join(f"\\x{{{a:x}}}-\\x{{{a + n - 1:x}}}" for a, n in ranges) + "]"


PATTERN = rf"(?s).{{{LEAST},{MOST - RUN}}}?{_marks()}{{{RUN}}}|.{{1,{MOST}}}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def hashed(chunk: Column, attempt: int) -> Column:
    """The identifier of a chunk; another attempt is another hash."""
    return F.xxhash64(F.lit(attempt), chunk)


Identify = Callable[[Column, int], Column]


def cut(docs: DataFrame, carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row, doc (a struct of the columns that are carried), chunks, text_sha256. Rows are numbered by Spark: write them before using the numbers twice."""
    low = docs.select(F.struct(*(docs[c] for c in carried)).alias("doc"), lower_ascii(docs["text"]).alias("low"))
    return low.select(F.monotonically_increasing_id().alias("row"), "doc", chunks_of(F.col("low")).alias("chunks"), F.sha2(F.col("low").cast("binary"), 256).alias("text_sha256"))


def chunk_store(cuts: DataFrame, attempt: int = 0, identify: Identify = hashed) -> DataFrame:
    """id, chunk: every distinct chunk once."""
    return cuts.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk"), attempt).alias("id"), "chunk").distinct()


def verified(cuts: DataFrame, identify: Identify = hashed) -> int:
    """The first attempt whose identifiers tell all chunks apart: chunks with one identifier are compared by their bytes."""
    for attempt in range(TRIES):
        if chunk_store(cuts, attempt, identify).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return attempt
    raise RuntimeError("different chunks share an identifier under every hash")


def recipes(cuts: DataFrame, attempt: int, identify: Identify = hashed) -> DataFrame:
    """row, doc, text_sha256 and recipe, the list of identifiers."""
    return cuts.select("row", "doc", "text_sha256", F.transform("chunks", lambda c: identify(c, attempt)).alias("recipe"))


def rebuild(recipes: DataFrame, store: DataFrame) -> DataFrame:
    """row, text: normalised texts from recipes and the chunk store. A text is put together by one task."""
    parts = recipes.select("row", F.posexplode_outer("recipe").alias("pos", "id")).join(store, "id", "left")
    ordered = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("parts"))
    return ordered.select("row", F.array_join("parts.chunk", "").alias("text"))


def _grouped(docs: DataFrame, identify: Identify, carried: Sequence[str]) -> DataFrame:
    """row, doc, recipe, text_sha256, keep_id, keep_row, group_size. Hot groups are counted in parts and joined by written tables, whose partitions Spark can split."""
    cuts, at = staged(cut(docs, carried), "cuts")
    made, _ = staged(recipes(cuts, verified(cuts, identify), identify), "recipes")
    drop_path(docs.sparkSession, at)
    # rows of one doc_id first, then the largest doc_id: both steps are sums and maxima of plain longs
    order = F.coalesce(F.col("doc.doc_id"), F.lit(-(1 << 63)))
    by_id = made.groupBy("recipe", order.alias("order")).agg(F.max("row").alias("row"), F.max("doc.doc_id").alias("id"), F.count("*").alias("n"))
    groups = by_id.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.max_by("row", "order").alias("keep_row"), F.sum("n").alias("size")).where("size > 1")
    found = made.join(staged(groups, "recipe-groups")[0], "recipe", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc.doc_id")).otherwise(F.col("keep_id"))
    return found.select("row", "doc", "recipe", "text_sha256", keep.alias("keep_id"), F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"))


def exact_duplicates(docs: DataFrame, identify: Identify = hashed) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row of docs (doc_id long, text)."""
    rows = _grouped(docs, identify, ["doc_id"])
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def drop_copies(docs: DataFrame, identify: Identify = hashed) -> DataFrame:
    """docs without the rows whose text another row keeps; all columns as they were."""
    return _grouped(docs, identify, docs.columns).where(F.col("row") == F.col("keep_row")).select("doc.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of equal texts stays, over all documents."""
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("n_chunks")
