"""A table rebuilt from a feed of inserts, updates and deletes: a log-structured merge.

``ChangeLog`` keeps runs of changes in the shared folder: Parquet, in the same number of buckets by key for all
runs, each bucket sorted by key and holding the newest change of each key.  ``append`` thins a batch to the
newest change of each key before and after its shuffle and writes a level-0 run.  ``read`` lays the runs' buckets
beside one another and merges them: nothing is shuffled, as all changes of a key lie in the same bucket of every run, and
the sort in front of the merge meets runs in order.  Tombstones then drop out.  ``compact`` does the same for the runs of a level
once there are many of them and writes one run to the next level.  It keeps tombstones, as an older change may
still arrive late, unless told that none will.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import storage


class ChangeLog:
    """Columns: ``key`` string, ``seq`` struct (ordered), ``tombstone`` boolean, ``value`` struct.

    ``buckets`` is fixed by the first run; by default as many as the session has shuffle partitions then.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 8, buckets: int | None = None):
        self.spark, self.path, self.fan_in, self._buckets = spark, path, fan_in, buckets
        self.home = f"{path}/runs"

    def _names(self) -> list[str]:
        return [n.removeprefix("run=") for n in storage.children(self.spark, self.home) if n.startswith("run=L")]

    def runs(self) -> list[tuple[int, str]]:
        """(level, path) of the complete runs; those a later run has replaced don't count."""
        names = [n for n in self._names() if storage.exists(self.spark, f"{self.home}/run={n}/_SUCCESS")]
        replaced = {int(m) for n in names if "-of-" in n for m in n.split("-of-")[1].split("_")}
        return [(int(n[1:].split("-")[0]), f"{self.home}/run={n}") for n in names if int(n.split("-")[1]) not in replaced]

    def _next(self) -> int:
        return 1 + max((int(n.split("-")[1]) for n in self._names()), default=-1)

    @property
    def buckets(self) -> int:
        there = next(iter(self._names()), None)
        return int(there.split("-")[2][1:]) if there else self._buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, changes: DataFrame, run: str) -> str:
        path, name = f"{self.home}/run={run}", f"ledgerloom_run_{uuid.uuid4().hex}"
        if not storage.exists(self.spark, f"{self.home}/_columns"):  # an empty run has no file that tells them
            storage.put(self.spark, f"{self.home}/_columns", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema))
        changes.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return path

    def _merged(self, runs: Sequence[str]) -> DataFrame:
        """The runs as partitions of one bucketed table, so that a task reads a bucket's files of all runs.  Only what
        the catalog knows can be bucketed: the table is a name for what lies in the folder now."""
        name = f"ledgerloom_log_{uuid.uuid4().hex}"
        columns = storage.get(self.spark, f"{self.home}/_columns")
        self.spark.sql(f"CREATE TABLE {name} ({columns}, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.home}'")
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        all_runs = self.spark.table(name)
        return self._newest(all_runs.filter(F.col("run").isin(*(r.rpartition("run=")[2] for r in runs))).drop("run"))

    @staticmethod
    def _newest(changes: DataFrame) -> DataFrame:
        """The newest change of each key.  The planner puts a sort and a limit of one row a key on both sides
        of an exchange, so a key with a large share of all changes sends one row a task."""
        w = Window.partitionBy("key").orderBy(F.col("seq").desc())
        return changes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    def append(self, changes: DataFrame) -> str:
        """Writes a batch as a run."""
        return self._write(self._newest(changes), f"L0-{self._next():08d}-b{self.buckets}")

    def read(self, with_tombstones: bool = False) -> DataFrame:
        """The state after all changes: ``key, seq, tombstone, value``."""
        runs = [p for _, p in self.runs()]
        if not runs:
            raise ValueError(f"no runs under {self.path}")
        state = self._merged(runs)
        return state if with_tombstones else state.filter("NOT tombstone")

    def compact(self, every: bool = False, complete: bool = False) -> bool:
        """Merges the runs of each level that holds ``fan_in`` or more (or all runs); tells whether it did.
        ``complete``: no older change will arrive, so a merge of all runs may drop its tombstones.

        The new run's name tells the runs that it replaces, so a reader sees either them or it.  Replaced runs are removed
        afterwards; a failure in between leaves both, of which only the new one counts.
        """
        done = False
        while True:
            runs = self.runs()
            level = 0 if every else next((lv for lv in sorted({lv for lv, _ in runs}) if sum(x == lv for x, _ in runs) >= self.fan_in), None)
            if level is None or (every and (done or len(runs) < 2)):
                return done
            part = [p for lv, p in runs if every or lv == level]
            merged = self._merged(part)
            if complete and len(part) == len(runs):
                merged = merged.filter("NOT tombstone")
            numbers = "_".join(str(int(p.rpartition("run=")[2].split("-")[1])) for p in part)
            self._write(merged, f"L{max(lv for lv, _ in runs if every or lv == level) + 1}-{self._next():08d}-b{self.buckets}-of-{numbers}")
            for p in part:
                storage.remove(self.spark, p)
            done = True


def as_changes(feed: DataFrame, key: Column, seq: Sequence[Column], tombstone: Column, value: Column) -> DataFrame:
    return feed.select(key.cast("string").alias("key"), F.struct(*(s.alias(f"s{i}") for i, s in enumerate(seq))).alias("seq"), tombstone.alias("tombstone"), value.alias("value"))


_END = "~end of payload~"


def whole_object(text: Column) -> Column:
    """Whether a text is one whole JSON object: not cut short, nothing after it, no other kind of value.

    The engine's parsers stop at the end of the first value, so the text is parsed as a member of an
    object that has another member after it, and both must be all there is.
    """
    wrapped = F.concat(F.lit('{"w":'), text, F.lit(f',"{_END}":0}}'))
    strict = F.from_json(wrapped, f"w string, `{_END}` int, _bad string", {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    keys = F.json_object_keys(wrapped)
    return F.coalesce((F.ltrim(text).startswith("{")) & (keys == F.array(F.lit("w"), F.lit(_END))) & strict["_bad"].isNull() & strict[_END].isNotNull(), F.lit(False))


ENVELOPE = "payload string, local_row_rev string"


def outbox_changes(outbox: DataFrame, with_payload: bool = True) -> DataFrame:
    """The changes that an outbox's deliveries carry.

    A delivery without sync_id, or whose payload_json isn't one whole JSON object, carries nothing.  op_type is
    read without case and blanks at its ends; one that is neither upsert nor delete carries nothing.  Order within a sync_id:
    base_rev, local_row_rev (nulls first), then op_id so that ties have one result; an op delivered again has
    the same place and changes nothing.
    """
    op = F.lower(F.regexp_replace("op_type", r"[\s\p{Z}]+", ""))
    env = F.from_json("payload_json", ENVELOPE)
    feed = outbox.filter(F.col("sync_id").isNotNull() & (F.trim("sync_id") != "")).withColumn("_op", op).filter(F.col("_op").isin("upsert", "delete")).filter(whole_object(F.col("payload_json"))).withColumn("_env", env)
    value = [F.col("op_id").alias("op_id"), *([F.col("_env.payload").alias("payload")] if with_payload else [])]
    return as_changes(
        feed,
        F.col("sync_id"),
        [F.col("base_rev").cast("bigint"), F.expr("try_cast(try_cast(_env.local_row_rev AS double) AS bigint)"), F.col("op_id")],
        F.col("_op") == "delete",
        F.struct(*value),
    )
