"""A server replica kept by a stream of ops: each micro-batch makes the next version of its tables, once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import storage
from ledgerloom.operators import mutations, outbox, replication


class Replica:
    """Versions of three tables (rows, applied, conflicts) under a folder.

    A version holds what its batch has changed: rows in their new state, entries of the two ledgers.  Every ``fan_in`` versions one holds
    the tables whole, so a batch writes what it changes and a reader merges few versions.  A version is a folder that
    counts once its marker is written, after all three tables; the marker holds the number of the batch that made it, so
    a batch delivered again is known.  Readers take the marked versions and never see half of one.
    """

    TABLES = ("rows", "applied", "conflicts")

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str], fan_in: int = 16):
        self.spark, self.path, self.fields, self.fan_in = spark, path, list(fields), fan_in

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in storage.children(self.spark, self.path) if n.startswith("v") and storage.exists(self.spark, f"{self.path}/{n}/done/_SUCCESS")]

    def _at(self, version: int, table: str) -> str:
        return f"{self.path}/v{version:06d}/{table}"

    def _live(self) -> list[int]:
        """The last whole version and those after it."""
        versions = self.versions()
        marks = {v: storage.exists(self.spark, self._at(v, "whole")) for v in versions}
        last = max(v for v, whole in marks.items() if whole)
        return [v for v in versions if v >= last]

    def read(self, table: str) -> DataFrame:
        parts = [self.spark.read.parquet(self._at(v, table)).withColumn("_version", F.lit(v)) for v in self._live()]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if table != "rows" or len(parts) == 1:
            return every.drop("_version")
        named = every.filter("sync_id IS NOT NULL").groupBy("sync_id").agg(F.max("_version").alias("_last"))
        kept = every.join(named, "sync_id", "left").filter("_last IS NULL OR _last = _version")
        return kept.select(*(c for c in every.columns if c != "_version"))

    def last_batch(self) -> int:
        return self.spark.read.parquet(self._at(max(self.versions()), "done")).first()["batch"]

    def commit(self, tables: dict[str, DataFrame], batch: int, whole: bool = True) -> int:
        version = max(self.versions(), default=0) + 1
        for name in self.TABLES:
            tables[name].write.mode("overwrite").parquet(self._at(version, name))
        if whole:
            storage.put(self.spark, self._at(version, "whole"), "")
        self.spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).coalesce(1).write.mode("overwrite").parquet(self._at(version, "done"))
        return version

    def apply(self, deliveries: DataFrame, batch: int, now: str) -> None:
        """Applies a batch of deliveries in order and commits the next version; a batch already committed does nothing."""
        if batch <= self.last_batch():
            return
        rows, applied, conflicts = (self.read(t) for t in self.TABLES)
        ops = replication.first_deliveries(replication.decode_ops(deliveries))
        first = rows.agg(F.coalesce(F.max("server_rev"), F.lit(0))).first()[0]
        results, changed = replication.apply_ops(ops, rows, applied, conflicts, self.fields, now, first)
        results, changed = storage.cut(results), storage.cut(changed)
        flat = changed.select("sync_id", *(F.col(f"row.{f}").alias(f) for f in self.fields), "deleted_at", "server_rev")
        collisions = replication.collisions_of(results, changed, rows, ops) if "invoice_no" in self.fields else None
        old = rows.join(flat.select("sync_id"), "sync_id", "left_semi")
        entered = outbox.record_applied(applied, results, now).join(applied.select("op_id"), "op_id", "left_anti").select(*applied.columns)
        opened = outbox.record_conflicts(conflicts, results, now, collisions).join(conflicts.select("id"), "id", "left_anti")
        self.commit({"rows": mutations.upsert(old, flat), "applied": entered, "conflicts": opened}, batch, whole=False)
        if len(self._live()) > self.fan_in:
            self.commit({t: self.read(t) for t in self.TABLES}, batch)

    def follow(self, feed: DataFrame, checkpoint: str, now: str) -> StreamingQuery:
        return feed.writeStream.foreachBatch(lambda df, n: self.apply(df, n, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
