"""Results kept until their table changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom import storage
from ledgerloom.operators.ledger import fingerprint


class VersionedCache:
    """Results as Parquet under a folder, named by the table's fingerprint: one of an earlier state is never read, and goes
    when the next is made.  They survive the loss of executors and of the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, name: str, records: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        version = hashlib.md5(str(tuple(fingerprint(records).first())).encode()).hexdigest()
        at = f"{self.path}/{name}/{version}"
        if not storage.exists(self.spark, f"{at}/_SUCCESS"):
            build(records).write.mode("overwrite").parquet(at)
            for old in storage.children(self.spark, f"{self.path}/{name}"):
                if old != version:
                    storage.remove(self.spark, f"{self.path}/{name}/{old}")
        return self.spark.read.parquet(at)

    def forget(self) -> None:
        storage.remove(self.spark, self.path)
