"""Frames that several results need: each is computed once, written to the shared folder and read by all of its users.

Two frames are the same if Spark's optimizer says that they have the same result (semanticHash finds candidates, sameSemantics decides), so
configurations that were built apart meet here. A frame that has one user is left alone: it stays part of that user's plan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skillcube.sources.io import remove, remove_at_exit, scratch


@dataclass
class _Kept:
    frame: DataFrame
    users: int
    path: str | None = None
    table: DataFrame | None = None


class Shared:
    """Counts users first (want), then hands out frames (get). close() removes what was written; otherwise it goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._kept: dict[int, list[_Kept]] = {}

    def _find(self, frame: DataFrame) -> _Kept | None:
        return next((k for k in self._kept.get(frame.semanticHash(), ()) if k.frame.sameSemantics(frame)), None)

    def want(self, frame: DataFrame, users: int = 1) -> None:
        """So many more users will ask for this frame."""
        known = self._find(frame)
        if known:
            known.users += users
        elif not self._is_table(frame):
            self._kept.setdefault(frame.semanticHash(), []).append(_Kept(frame, users))

    def get(self, frame: DataFrame) -> DataFrame:
        """The frame itself for a single user, else its table, which the first of them writes."""
        known = self._find(frame)
        if known is None or known.users < 2:
            return frame
        if known.path is None:
            path = scratch(self.spark, "shared")
            frame.write.option("compression", "zstd").parquet(path)
            remove_at_exit(self.spark, path)
            known.path, known.table = path, self.spark.read.schema(frame.schema).parquet(path)
        # columns by position: frames that are the same may call them differently
        return known.table if known.table.columns == frame.columns else known.table.toDF(*frame.columns)

    def _is_table(self, frame: DataFrame) -> bool:
        return any(k.table is frame for ks in self._kept.values() for k in ks)

    def users(self) -> list[int]:
        """How many users each frame has that was written."""
        return sorted(k.users for ks in self._kept.values() for k in ks if k.path)

    def release(self, frame: DataFrame) -> None:
        """A user is done; the last one's table is removed."""
        known = self._find(frame)
        if known:
            known.users -= 1
            if known.users <= 0:
                self._drop([known])
                self._kept[frame.semanticHash()].remove(known)

    def _drop(self, kept: Iterable[_Kept]) -> None:
        for k in kept:
            if k.path:
                remove(self.spark, k.path)

    def close(self) -> None:
        self._drop(k for ks in self._kept.values() for k in ks)
        self._kept.clear()

    def __enter__(self) -> Shared:
        return self

    def __exit__(self, *_) -> None:
        self.close()
