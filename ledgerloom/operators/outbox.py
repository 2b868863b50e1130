"""Writing the op queue and its ledgers: ops from changes, states, push batches, results, conflicts, revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import merge as M
from ledgerloom.operators.ranking import rank_within
from ledgerloom.operators.replication import newest

OUTCOME = {"applied": "applied", "noop": "applied", "conflict": "blocked"}


def identified(rows: DataFrame) -> DataFrame:
    """The rows, all of which must have a sync_id; one without stops the job that reads them."""
    bad = F.col("sync_id").isNull() | (F.trim("sync_id") == "")
    return rows.withColumn("sync_id", F.when(bad, F.raise_error(F.lit("a row without sync_id can't be changed"))).otherwise(F.col("sync_id")))


def changes_between(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``sync_id, op_type, payload, base, base_rev, deleted_at``: what made ``after`` of ``before``.

    Rows of ``after`` that are new or differ in a field (by the field's class) give an upsert, those newly deleted a
    delete; rows that ``before`` alone has give nothing, as deleting leaves the row.  Both sides have one row for a sync_id,
    ``deleted_at`` and ``server_rev``; rows without sync_id are left out.
    """
    side = lambda df, s: df.filter(F.col("sync_id").isNotNull()).select("sync_id", F.struct(*fields).alias(s), F.col("deleted_at").alias(f"{s}_deleted"), F.col("server_rev").alias(f"{s}_rev"))
    both = side(after, "payload").join(side(before, "base"), "sync_id", "left")
    both = both.withColumns({f"_{s}": M.comparable(fields, lambda f, s=s: F.col(f"{s}.{f}")) for s in ("payload", "base")})
    removed = F.col("payload_deleted").isNotNull() & F.col("base_deleted").isNull() & F.col("base").isNotNull()
    edited = F.col("payload_deleted").isNull() & (F.col("base").isNull() | (F.col("_payload") != F.col("_base")))
    op = F.when(removed, "delete").when(edited, "upsert")
    return both.withColumn("op_type", op).filter("op_type IS NOT NULL").select("sync_id", "op_type", "payload", "base", F.coalesce("base_rev", F.lit(0)).alias("base_rev"), F.col("payload_deleted").alias("deleted_at"))


def enqueue(changes: DataFrame, first_id: int, created_at: str, row_rev: Column | None = None) -> DataFrame:
    """Outbox rows of changes, all pending, ids in order of sync_id from ``first_id``.

    op_id is a hash of what the op is, so making the same op again gives the same id.
    """
    rev = (row_rev if row_rev is not None else F.lit(1)).cast("bigint")
    whole = F.to_json(
        F.struct(
            "sync_id", "op_type",
            F.struct("payload.*", "deleted_at").alias("payload"), "base", "base_rev", rev.alias("local_row_rev"), F.lit(created_at).alias("created_at"),
        ), {"ignoreNullFields": "false"},
    )
    ranked = rank_within(identified(changes).withColumn("payload_json", whole), [], [F.asc("sync_id"), F.asc("op_type")], "_n")
    return ranked.select(
        (F.col("_n") + F.lit(first_id - 1)).alias("id"), F.sha2("payload_json", 256).alias("op_id"), "sync_id", "op_type", "payload_json", "base_rev", F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempts"),
        F.lit(None).cast("string").alias("next_retry_at"), F.lit(None).cast("string").alias("last_error"), F.lit(created_at).alias("created_at"), F.lit(created_at).alias("updated_at"),
    )


def with_states(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """The outbox with each op's newest state by ``events(op_id, seq, status, last_error)``; failed ones count an attempt each."""
    last = events.groupBy("op_id").agg(F.max_by(F.struct("status", "last_error"), "seq").alias("_e"), F.count_if(F.col("status") == "failed").alias("_failed"))
    out = outbox.join(last, "op_id", "left")
    return out.withColumns({"status": F.coalesce("_e.status", "status"), "last_error": F.when(F.col("_e").isNotNull(), F.col("_e.last_error")).otherwise(F.col("last_error")), "attempts": F.col("attempts") + F.coalesce("_failed", F.lit(0))}).select(*outbox.columns)


def requeued(outbox: DataFrame) -> DataFrame:
    """Ops in flight when a session broke off wait again."""
    return outbox.withColumn("status", F.when(F.col("status") == "in_flight", "pending").otherwise(F.col("status")))


def push_batches(ops: DataFrame, size: int = 50) -> DataFrame:
    """Waiting ops and the number of the batch that each is sent in, in order of id."""
    waiting = ops.filter(F.col("status") == "pending")
    return rank_within(waiting, [], [F.asc("id")], "_n").withColumn("batch", ((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


def push_outcomes(results: DataFrame) -> DataFrame:
    """``op_id, status`` that results leave ops in; an error leaves them failed."""
    known = F.create_map(*(F.lit(x) for kv in OUTCOME.items() for x in kv))
    return results.select("op_id", F.coalesce(F.try_element_at(known, F.col("result")), F.lit("failed")).alias("status"))


def record_applied(applied: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """The ledger of applied ops with new results; replayed ones, conflicts and no-ops aren't entered."""
    cols = [c for c in results.columns if c != "op_id"]
    fresh = results.filter((F.col("result") == "applied") & (F.col("reason") != "replayed"))
    new = fresh.groupBy("op_id").agg(F.min_by(F.struct(*cols), "id").alias("_f")).select("op_id", "_f.*").join(applied.select("op_id"), "op_id", "left_anti")
    top = applied.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = rank_within(new.withColumnRenamed("id", "_o"), [], [F.asc("_o")], "_n")
    return applied.unionByName(rows.select((F.col("_n") + F.lit(top)).alias("id"), "op_id", "sync_id", "op_type", "result", "server_rev_after", F.lit(None).cast("string").alias("conflict_json"), F.lit(at).alias("applied_at")))


def record_conflicts(conflicts: DataFrame, results: DataFrame, at: str, collisions: DataFrame | None = None) -> DataFrame:
    """The conflicts with those that results opened, one for each field, and the advisory ones of ``collisions``; ids after the last."""
    found = results.filter(F.size("conflicts") > 0).select(F.col("id").alias("_o"), "sync_id", F.posexplode("conflicts").alias("_p", "_c"))
    if collisions is not None:
        told = F.struct(F.lit("invoice_collision").alias("kind"), F.lit("invoice_no").alias("field"))
        found = found.unionByName(collisions.select(F.col("id").alias("_o"), "sync_id", F.lit(-1).alias("_p"), told.alias("_c")))
    top = conflicts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = rank_within(found, [], [F.asc("_o"), F.asc("_p")], "_n").select((F.col("_n") + F.lit(top)).alias("id"), "sync_id", F.col("_c.kind").alias("kind"), F.col("_c.field").alias("field_name"), F.lit("open").alias("status"), F.lit(at).alias("created_at"))
    return conflicts.unionByName(rows, allowMissingColumns=True)


def server_changes(changed: DataFrame, fields: Sequence[str], first_rev: int) -> DataFrame:
    """Rows changed on the server: one new revision each, in order of sync_id, the snapshot as new base, no local revision."""
    ranked = rank_within(identified(changed), [], [F.asc("sync_id")], "_n")
    return ranked.withColumns({"server_rev": F.col("_n") + F.lit(first_rev), "row_rev": F.lit(0).cast("bigint"), "base_json": V.canonical_json(fields)}).drop("_n")


def sync_status(outbox: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row: ops by state that matters, and open conflicts."""
    ops = outbox.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_flight", "failed", "blocked")))
    return ops.crossJoin(conflicts.agg(F.count_if(F.col("status") == "open").alias("open_conflicts")))  # one row each


def order_view(sequences: DataFrame, records: DataFrame) -> DataFrame:
    """``key, pos, sync_id, label``: the rows of ordered id lists (``key``, ``ids`` as JSON) with their names, in order."""
    named = records.filter(F.col("sync_id").isNotNull()).groupBy("sync_id").agg(F.min_by("name", "id").alias("_name"))
    laid = sequences.select("key", F.posexplode(V.json_list("ids")).alias("pos", "sync_id"))
    return laid.join(named, "sync_id", "left").select("key", (F.col("pos") + 1).cast("bigint").alias("pos"), "sync_id", F.coalesce(F.nullif(V.strip("_name"), F.lit("")), F.lit("Unnamed record")).alias("label"))


def settled(server: DataFrame, resolved: DataFrame, fields: Sequence[str], first_rev: int) -> DataFrame:
    """Server rows with the values of applied resolutions (``id, sync_id, field_name, outcome, value``): one new revision a row,
    month by the date.  Of several resolutions of a field the one with the highest id counts.  A deleted row stays deleted unless one of
    ``deleted_at`` says otherwise (null: alive).  Only rows that change come out."""
    one = resolved.filter(F.col("outcome") == "applied").groupBy("sync_id", "field_name").agg(F.max_by(F.struct("value"), F.col("id") if "id" in resolved.columns else F.lit(0))["value"].alias("value"))
    done = one.groupBy("sync_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("_v"))
    rows = newest(server).join(done, "sync_id")
    if "deleted_at" in server.columns:
        fields = [*fields, "deleted_at"]
    kinds = dict(server.dtypes)
    rows = rows.withColumns({f: F.when(F.map_contains_key("_v", F.lit(f)), F.try_element_at("_v", F.lit(f)).try_cast(kinds[f])).otherwise(F.col(f)) for f in fields})
    if "bid_date" in fields and "month" in fields:
        rows = rows.withColumn("month", F.coalesce(F.nullif(V.month_of("bid_date"), F.lit("")), "month"))
    return server_changes(rows.drop("_v"), [f for f in fields if f != "deleted_at"], first_rev)


def reordered(server: DataFrame, resolution: DataFrame, fields: Sequence[str], first_rev: int) -> DataFrame:
    """Server rows in the places that ``order_resolution`` has applied: one new revision a row in order of month and place."""
    placed = resolution.filter(F.col("outcome") == "applied").select("sync_id", F.col("sr_no").alias("_sr"), F.col("month").alias("_month"))
    rows = newest(server).join(placed, "sync_id").withColumns({"sr_no": F.col("_sr"), "month": F.col("_month")})
    ranked = rank_within(rows, [], [F.asc("_month"), F.asc("_sr"), F.asc("sync_id")], "_n")
    return ranked.withColumns({"server_rev": F.col("_n") + F.lit(first_rev), "row_rev": F.lit(0).cast("bigint"), "base_json": V.canonical_json(fields)}).drop("_n", "_sr", "_month")


def converged(local: DataFrame, server: DataFrame, waiting: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``sync_id, row, server_rev`` for each local row once its conflicts are settled: fields changed here alone since
    the base survive where the server still has the base's value, else the server's stand.  ``waiting``: sync_ids
    with open conflicts, left alone.  Rows deleted on the server take its state whole."""
    schema = "struct<" + ", ".join(f"{f}: {dict(server.dtypes)[f]}" for f in fields) + ">"
    mine = local.filter(F.col("sync_id").isNotNull()).select("sync_id", F.struct(*fields).alias("offline"), F.from_json("base_json", schema).alias("base"))
    theirs = newest(server).select("sync_id", F.struct(*fields).alias("online"), "server_rev", F.col("deleted_at").isNotNull().alias("_gone"))
    both = mine.join(theirs, "sync_id").join(waiting.select("sync_id"), "sync_id", "left_anti").withColumn("base", F.coalesce("base", "offline"))
    order = M.comparable_order(fields)
    both = both.withColumns({f"_c{s}": M.comparable(fields, lambda f, s=s: F.col(f"{s}.{f}")) for s in ("base", "offline", "online")})
    keep = {f: (F.col("_cbase")[i] == F.col("_conline")[i]) & (F.col("_cbase")[i] != F.col("_coffline")[i]) & ~F.col("_gone") for i, f in enumerate(order)}
    return both.select("sync_id", F.struct(*(F.when(keep[f], F.col(f"offline.{f}")).otherwise(F.col(f"online.{f}")).alias(f) for f in fields)).alias("row"), "server_rev")
