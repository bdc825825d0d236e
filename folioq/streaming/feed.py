"""What was committed: callbacks, and a log that a stream can follow."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..sources.storage import Files

Change = tuple[str, str, DataFrame | None]
LOG = "collection string, op string, id string, at timestamp"


class Feed:
    """Changes are told after their commit, never before. `log`: a folder that gets them as Parquet files.

    What goes to the log is written before the commit, below the database's own folder, and named by the version; after the commit its files
    are moved to the log. Whoever comes after a crash between the two moves what the version still names, so no change is lost or told twice.
    """

    def __init__(self, spark: SparkSession, log: str | None = None) -> None:
        self.spark, self.log = spark, log and log.rstrip("/")
        self.waiting: list[Change] = []
        self.listeners: list[Callable[[str, str, DataFrame | None], None]] = []

    def on_commit(self, listener: Callable[[str, str, DataFrame | None], None]) -> Callable[[], None]:
        """`listener` gets (collection, operation, ids). Returns what stops it. The ids are those of the version before; look at them at once."""
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener)

    def note(self, collection: str, op: str, ids: DataFrame | None) -> None:
        self.waiting.append((collection, op, ids))

    def forget(self) -> None:
        self.waiting.clear()

    def written(self, files: Files) -> list[str]:
        """The waiting changes as folders of Parquet files, not yet in the log."""
        names = []
        for collection, op, ids in self.waiting if self.log else ():
            rows = ids if ids is not None else self.spark.createDataFrame([(None,)], "_id string")
            rows = rows.select(F.lit(collection).alias("collection"), F.lit(op).alias("op"), F.col("_id").cast("string").alias("id"), F.current_timestamp().alias("at"))
            names.append(f"_changes/{uuid.uuid4().hex}")
            rows.write.parquet(f"{files.root}/{names[-1]}")
        return names

    def publish(self, files: Files, names: list[str]) -> None:
        """Move written changes to the log; those that are there already are passed over."""
        for name in names if self.log else ():
            for part in files.names(name):
                if part.endswith(".parquet"):
                    files.move(f"{name}/{part}", f"{self.log}/{part}")
            files.delete(name)

    def take(self) -> list[Change]:
        told, self.waiting = self.waiting, []
        return told

    def tell(self, changes: list[Change]) -> None:
        for change in changes:
            for listener in list(self.listeners):
                listener(*change)

    def stream(self) -> DataFrame:
        """The log as a stream."""
        return self.spark.readStream.schema(LOG).parquet(self.log)
