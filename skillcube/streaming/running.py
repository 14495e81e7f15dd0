"""Running scores of arriving forecasts and observations, with corrections taken back.

Reports arrive in any order: a label (place and valid time), a side ("forecast" or "observed"), a version and a value. The largest version of a side counts (of
equal versions the larger value), and a null value withdraws the report. Each label keeps its two newest reports as state. Whenever its error changes, it
emits the difference: the old error's share is taken back and the new one's is added, in whole units, so that sums of differences are exact and come
back to zero. Sums of the differences up to any micro-batch are the scores of all that has arrived by then, as a batch over the newest reports has them.

State is one small row a label, spread over the cluster by label, in RocksDB and therefore not bounded by memory. With `late_hours` a label's state goes when the
watermark has passed its valid time: reports behind the watermark are then refused (Spark counts them in numRowsDroppedByWatermark), so it has to be longer
than the longest lead time and the latest correction together. Without it labels stay, and any correction counts. Lost executors and restarts replay from the checkpoint;
the file sink commits a micro-batch once.

Reports whose side is neither of the two, whose version is null or that lack a part of their label are ignored. No reports: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from skillcube.sources.io import remove_at_exit, scratch

SIDES = ("forecast", "observed")
#: Differences of sums: pairs, errors, absolute and squared errors, in units and squared units.
SUMS = ("n", "e", "abs_e", "sq_e")
_STATE = StructType([StructField(c, LongType()) for c in ("forecast_version", "forecast", "observed_version", "observed")])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newer(a: tuple, b: tuple) -> tuple:
    """The report (version, value) that counts; a version of None is no report, and a withdrawal yields to a value of its version."""
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    return max(a, b, key=rank)


def share(forecast: int | None, observed: int | None) -> tuple[int, int, int, int]:
    """What a label adds to the sums."""
    if forecast is None or observed is None:
        return 0, 0, 0, 0
    e = forecast - observed
    return 1, e, abs(e), e * e


class _Labels(StatefulProcessor):
    """State and differences of one label at a time."""

    def __init__(self, names: list[str], expires: bool) -> None:
        self.names, self.expires = names, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reports", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        before = tuple(known) if known is not None else (None, None, None, None)
        sides = {SIDES[0]: before[:2], SIDES[1]: before[2:]}
        until = None
        for r in rows:
            sides[r.side] = newer(sides[r.side], (r.version, r.units))
            until = r.until
        after = (*sides[SIDES[0]], *sides[SIDES[1]])
        if after == before:
            return
        self.state.update(after)
        if self.expires and known is None:
            self.handle.registerTimer(until)
        change = [new - old for new, old in zip(share(after[1], after[3]), share(before[1], before[3]), strict=True)]
        if any(change):
            yield Row(**dict(zip(self.names, (*key, *change), strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def differences(reports: DataFrame, space: Sequence[str], unit: float, late_hours: int | None = None) -> DataFrame:
    """*space, valid_time and differences of SUMS, from a stream of reports (*space, valid_time, side, version, value).

    Values are rounded to whole units. The session needs the RocksDB state store (`start` sets it for its query).
    """
    label = [*space, "valid_time"]
    time = F.col("valid_time") if late_hours is None else F.col("valid_time").cast("timestamp").alias("valid_time")
    rows = reports.select(*space, time, "side", F.col("version").cast("long").alias("version"), F.round(F.col("value") / F.lit(unit)).cast("long").alias("units"))
    rows = rows.where(F.col("side").isin(*SIDES) & F.col("version").isNotNull()).dropna(subset=label).withColumn("until", F.unix_millis(F.col("valid_time").cast("timestamp")))
    if late_hours is not None:
        rows = rows.withWatermark("valid_time", f"{late_hours} hours")
    kept = rows.schema
    out = StructType([*(kept[c] for c in label), *(StructField(c, LongType()) for c in SUMS)])
    return rows.groupBy(*label).transformWithState(_Labels(out.names, late_hours is not None), out, "append", "none" if late_hours is None else "eventtime")


def start(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append differences to a Parquet table; returns the streaming query. trigger: of DataStreamWriter.trigger, by default all that is there."""
    spark = changes.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
    finally:
        spark.conf.set(_PROVIDER, before)


def scores(changes: DataFrame, by: Sequence, unit: float) -> DataFrame:
    """n, mse, mae and bias for each group of columns or expressions, from differences; groups whose pairs were all taken back have no row."""
    total = changes.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("abs_e").alias("abs_e"), F.sum(F.col("sq_e").cast("decimal(38,0)")).alias("sq_e")).where("n > 0")
    mean = lambda c, u: F.col(c).cast("double") / F.col("n") * F.lit(u)
    return total.select(*(c for c in total.columns if c not in SUMS), "n", mean("sq_e", unit * unit).alias("mse"), mean("abs_e", unit).alias("mae"), mean("e", unit).alias("bias"))


def replay(spark: SparkSession, reports: DataFrame, arrival: str, space: Sequence[str], unit: float, batches: int = 4, late_hours: int | None = None) -> DataFrame:
    """The differences that a table of reports leaves if it arrives in files, in about so many micro-batches; the stored result, to be read as a batch."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source, path, checkpoint = (scratch(spark, f"replay-{k}") for k in ("reports", "changes", "checkpoint"))
    reports.repartitionByRange(files, arrival).write.parquet(source)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(source)
    changes = differences(stream, space, unit, late_hours)
    for p in (source, path, checkpoint):
        remove_at_exit(spark, p)
    start(changes, path, checkpoint).awaitTermination()
    return spark.read.schema(changes.schema).parquet(path)
