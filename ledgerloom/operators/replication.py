"""Synchronising two replicas: pull by revision, coalesce and apply ops, order, conflicts and their resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.functions import values as V
from ledgerloom.operators import merge as M
from ledgerloom.operators.changelog import whole_object
from ledgerloom.operators.ranking import rank_within
from ledgerloom.operators.scan import HOT_ROWS, hot_groups, last_before
from ledgerloom.schema import BUSINESS_FIELDS, FIELD_LABELS, FIELD_TYPES, FINANCIAL_FIELDS, KIND_LABELS, UNMERGED_FIELDS

# States of an op, kinds of conflict that hold a row back, choices of a resolution.
ACTIVE = ("pending", "in_flight", "blocked")
COALESCED = ("pending", "in_flight")
ADVISORY_KINDS = ("invoice_collision",)
CHOICES = ("KEEP_OFFLINE", "KEEP_ONLINE", "MERGE")

_STRUCT = "struct<" + ", ".join(f"{f}: {t}" for f, t in FIELD_TYPES.items()) + ", deleted_at: string>"
ENVELOPE = f"struct<payload: {_STRUCT}, base: {_STRUCT}, local_row_rev: bigint, created_at: string>"


def decode_ops(outbox: DataFrame) -> DataFrame:
    """The ops of an outbox with payload and base as structs; op_type in plain form.

    Deliveries whose payload isn't one whole JSON object, or without sync_id, carry no op and are left out.
    """
    op = F.lower(F.regexp_replace("op_type", r"[\s\p{Z}]+", ""))
    env = F.from_json("payload_json", ENVELOPE)
    whole = outbox.filter(F.col("sync_id").isNotNull()).filter(whole_object(F.col("payload_json")))
    return whole.withColumn("_e", env).select("id", "op_id", "sync_id", op.alias("op_type"), "base_rev", "status", "_e.payload", "_e.base", "_e.local_row_rev")


def first_deliveries(ops: DataFrame) -> DataFrame:
    """Each op_id once, as it came first."""
    cols = [c for c in ops.columns if c != "op_id"]
    return ops.groupBy("op_id").agg(F.min_by(F.struct(*cols), "id").alias("_f")).select("op_id", *(F.col(f"_f.{c}") for c in cols))


# Pull


def pull(rows: DataFrame, since: int) -> DataFrame:
    """Rows of a later revision, deleted ones too, in order of revision."""
    return rows.filter(F.col("server_rev") > since).orderBy("server_rev", "id")


def watermark(pulled: DataFrame, skipped: DataFrame, since: int) -> DataFrame:
    """One row: the revision to pull from next, just before the first row skipped, else the highest pulled."""
    top = pulled.agg(F.max("server_rev").alias("top"))
    low = skipped.agg(F.min("server_rev").alias("low"))
    return top.crossJoin(low).select(F.when(F.col("low").isNotNull(), F.greatest(F.lit(since), F.col("low") - 1)).otherwise(F.greatest(F.lit(since), F.coalesce("top", F.lit(since)))).alias("watermark"))  # one row each


def active_ids(ops: DataFrame) -> DataFrame:
    """Rows that local ops still wait on."""
    return ops.filter(F.col("status").isin(*ACTIVE)).select("sync_id").distinct()


def merge_pulled(pulled: DataFrame, local: DataFrame, ops: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``sync_id, server_rev, action, resolved, conflicts`` of each pulled row that no local op waits on.

    ``action``: insert (not here yet), update, or attention where both sides changed a field.  ``local`` has
    ``base_json``, the last state agreed on; rows without it are merged against themselves, so the pulled side wins.
    """
    free = pulled.join(active_ids(ops), "sync_id", "left_anti").select("sync_id", "server_rev", F.struct(*fields).alias("online"))
    schema = "struct<" + ", ".join(f"{f}: {FIELD_TYPES[f]}" for f in fields) + ">"
    mine = local.filter(F.col("sync_id").isNotNull()).select("sync_id", F.struct(*fields).alias("offline"), F.from_json("base_json", schema).alias("_b"), F.lit(True).alias("_here"))
    both = free.join(mine, "sync_id", "left").withColumn("base", F.coalesce("_b", "offline"))
    merged = M.merge_rows(both, fields)
    action = F.when(F.col("_here").isNull(), "insert").when(F.size("conflicts") > 0, "attention").otherwise("update")
    return merged.select("sync_id", "server_rev", action.alias("action"), F.when(F.col("_here").isNull(), F.col("online").cast(merged.schema["resolved"].dataType) if list(fields) == merged.schema["resolved"].dataType.names else F.struct(*(F.col(f"online.{f}").alias(f) for f in merged.schema["resolved"].dataType.names))).otherwise(F.col("resolved")).alias("resolved"), "conflicts")


# Push


def coalesce_ops(ops: DataFrame) -> DataFrame:
    """Upserts waiting for one row made one: the newest payload on the oldest base; deletes stay as they are.

    ``op_id, sync_id, payload, base, base_rev, superseded`` (the number of ops it stands for besides itself).
    """
    waiting = ops.filter(F.col("status").isin(*COALESCED) & (F.col("op_type") == "upsert"))
    return waiting.groupBy("sync_id").agg(F.max_by("op_id", "id").alias("op_id"), F.max_by("payload", "id").alias("payload"), F.min_by("base", "id").alias("base"), F.min_by("base_rev", "id").alias("base_rev"), (F.count("*") - 1).alias("superseded"))


def row_of(records: DataFrame, sync_id: str) -> DataFrame:
    """A sync_id's row with what synchronising keeps of it: of several the newest."""
    return newest(records.filter(F.col("sync_id") == sync_id))


def business_row(records: DataFrame, sync_id: str) -> DataFrame:
    """The business fields of a sync_id's row."""
    return row_of(records, sync_id).select(*(f for f in BUSINESS_FIELDS if f in records.columns))


def revision(rows: DataFrame) -> DataFrame:
    """One row: the revision the table has reached, 0 if none."""
    return rows.agg(F.coalesce(F.max("server_rev"), F.lit(0)).alias("revision"))


def status_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("status").agg(F.count("*").alias("n"))


def open_conflicts(conflicts: DataFrame, status: str = "open") -> DataFrame:
    return conflicts.filter(F.col("status") == status).orderBy("id")


# Apply


def newest(server: DataFrame) -> DataFrame:
    """Each sync_id's row of the highest revision, of several the last by id."""
    cols = [c for c in server.columns if c != "sync_id"]
    by = F.struct(*(c for c in ("server_rev", "id") if c in cols))
    return server.filter(F.col("sync_id").isNotNull()).groupBy("sync_id").agg(F.max_by(F.struct(*cols), by).alias("_r")).select("sync_id", *(F.col(f"_r.{c}") for c in cols))


# Places of the server's rows and of open conflicts before all ops.
_SERVER, _HELD = -(2**60), -(2**61)


def apply_ops(ops: DataFrame, server: DataFrame, applied: DataFrame, conflicts: DataFrame, fields: Sequence[str], now: str, first_rev: int, stop_at_error: bool = False, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(results, changed)``: the result of each op, and the rows that ops changed, in their last state.

    results: ``id, op_id, sync_id, op_type, result, reason, conflicts, server_rev_after``; changed: ``sync_id, row,
    deleted_at, server_rev``.  Ops are applied in order of id.  A row's state before an op is, field by field, what the
    last op before it that edited the field has set: a scan, whose chunks spread a row with very many ops over tasks.  It holds up to the
    row's first conflict, and after this one, as after one open before, all ops of the row are held back.

    An op already in ``applied`` (by op_id) gives its stored result and does nothing; so does a later delivery of one applied here, with
    the revision of the first.  Conflicts, errors and no-ops aren't stored, so an op delivered again after one is
    tried again.  Ops that would order a month's rows otherwise than the server meanwhile has are parked as conflicts, the first of
    them with the month's one ordering conflict.  An op_type that is neither upsert nor delete is an error.  Revisions follow ``first_rev``
    in order of id over all applied ops.  ``stop_at_error``: nothing from the first op in error on is processed.
    """
    engine = _Engine(ops, server, applied, conflicts, fields, now, hot_rows)
    final = engine.settle(engine.todo)
    if stop_at_error:
        first = final.filter("result = 'error'").agg(F.min("id")).first()[0]
        if first is not None:
            final = engine.settle(engine.todo.filter(F.col("id") < first))
    new = final.filter("role = 'takes' AND result = 'applied'")
    revs = storage.cut(rank_within(new.select("id", "sync_id"), [], [F.asc("id")], "_n").select(F.col("id").alias("_at"), F.col("sync_id").alias("_row"), (F.col("_n") + F.lit(first_rev)).alias("_rev")))
    place = F.when(F.col("reason") == "replayed", F.coalesce("first", "id")).otherwise(F.col("id"))
    results = final.join(revs.select("_at", "_rev"), place == F.col("_at"), "left").select("id", "op_id", "sync_id", "op_type", "result", "reason", "conflicts", F.when(F.col("result") == "applied", F.coalesce("stored_rev", "_rev")).alias("server_rev_after"))
    last = revs.groupBy(F.col("_row").alias("sync_id")).agg(F.max("_rev").alias("server_rev"))
    return results, engine.rows_after(new).join(last, "sync_id")


class _Engine:
    """Ops as facts in columns, decided by a table of conditions."""

    def __init__(self, ops: DataFrame, server: DataFrame, applied: DataFrame, conflicts: DataFrame, fields: Sequence[str], now: str, hot_rows: int):
        self.fields, self.now, self.hot_rows = list(fields), now, hot_rows
        self.order = M.comparable_order([f for f in fields if f != "month"])
        self.at = {f: i for i, f in enumerate(self.order)}
        forms = lambda s: M.comparable(self.order, lambda f: F.col(f"{s}.{f}"))
        based = (F.coalesce("base_rev", F.lit(0)) != 0) & F.coalesce(*(F.col(f"base.{f}").cast("string") for f in fields)).isNotNull()
        month = lambda s: (F.col(f"{s}.month") if "month" in self.fields else F.lit(None).cast("string")).alias(f"{s}_month")
        gone = lambda s: F.col(f"{s}.deleted_at").isNotNull().alias(f"{s}_gone")
        self.todo = storage.cut(
            ops.select(
                "id", "op_id", "sync_id", "op_type", "payload", "base", forms("payload").alias("off"), forms("base").alias("was"), ((F.col("op_type") == "upsert") & ~based).alias("makes"),
                month("payload"), month("base"), F.coalesce(gone("payload"), F.lit(False)).alias("payload_gone"), F.coalesce(gone("base"), F.lit(False)).alias("base_gone"), F.col("base").isNotNull().alias("has_base"),
            )
        )
        self.hot = hot_groups(self.todo, "sync_id", hot_rows)
        self.stored = applied.groupBy("op_id").agg(F.min_by("result", "id").alias("stored"), F.min_by("server_rev_after", "id").alias("stored_rev"))
        deleted = F.col("deleted_at") if "deleted_at" in server.columns else F.lit(None).cast("string")
        mine = newest(server).join(self.todo.select("sync_id").distinct(), "sync_id", "left_semi")
        self.server = storage.cut(mine.select("sync_id", F.struct(*(F.col(f).cast(FIELD_TYPES[f]).alias(f) for f in fields)).alias("row"), deleted.alias("gone_at")))
        blocking = conflicts.filter((F.col("status") == "open") & ~F.col("kind").isin(*ADVISORY_KINDS))
        self.held = blocking.select("sync_id").distinct().join(self.todo.select("sync_id").distinct(), "sync_id", "left_semi")
        self.parked = self._parked(server, blocking)

    def _parked(self, server: DataFrame, blocking: DataFrame) -> DataFrame:
        """``id, opens``: ops held back by their month's order, and whether this one opens the month's conflict."""
        moves = month_moves(self.todo).select("id", "month")
        none = moves.select("id", F.lit(True).alias("opens")).limit(0)
        if moves.isEmpty():
            return none
        bad = storage.cut(ordering_plan(self.todo, server).filter("action = 'conflict'").select("month"))
        open_months = blocking.filter("kind = 'sr_ordering'").select("month").distinct() if "month" in blocking.columns else bad.limit(0)
        mine = moves.join(bad, "month")
        first = mine.join(open_months, "month", "left_anti").groupBy("month").agg(F.min("id").alias("_first"))
        return storage.cut(mine.join(first, "month", "left").select("id", (F.col("id") == F.col("_first")).alias("opens")))

    def _roles(self, todo: DataFrame) -> DataFrame:
        """Which delivery of an op takes effect: ``id, role, first, there, stored, stored_rev``.

        ``there``: the row is known when the op comes.  takes: the op's first delivery that finds its row or makes it; again:
        later ones; early: those before, in error.
        """
        light = todo.select("id", "op_id", "sync_id", "op_type", "makes", *(c for c in ("_known",) if c in todo.columns)).join(self.stored, "op_id", "left")
        if "_known" in todo.columns:
            light = light.withColumn("stored", F.coalesce("stored", "_known"))
        live = F.col("stored").isNull() & (F.coalesce("op_id", F.lit("")) != "") & F.col("op_type").isin("upsert", "delete")
        born = light.filter(live & F.col("makes")).select("sync_id", "id").unionByName(self.server.select("sync_id", F.lit(_SERVER).alias("id")))
        light = light.join(born.groupBy("sync_id").agg(F.min("id").alias("_born")), "sync_id", "left").withColumn("there", F.coalesce(F.col("_born") < F.col("id"), F.lit(False)))
        finds = live & (F.col("there") | F.col("makes"))
        light = light.withColumn("_finds", finds)
        first = light.filter("_finds").groupBy("op_id", "sync_id").agg(F.min("id").alias("first"))
        light = light.join(first, ["op_id", "sync_id"], "left")
        role = (
            F.when(F.col("stored").isNotNull(), "stored")
            .when(F.coalesce("op_id", F.lit("")) == "", "nameless")
            .when(F.col("id") == F.col("first"), "takes")
            .when(F.col("id") > F.col("first"), "again")
            .when(~F.col("op_type").isin("upsert", "delete") | F.col("op_type").isNull(), "unknown")
            .otherwise("early")
        )
        return light.select("id", role.alias("role"), "first", "there", "stored", "stored_rev")

    def _steps(self, todo: DataFrame) -> DataFrame:
        """The ops in their roles, with the state of the row before each."""
        size = len(self.order)
        ops = todo.drop("_known", "payload", "base").join(self._roles(todo), "id").join(self.parked, "id", "left")
        takes, update = F.col("role") == "takes", F.col("there") & (F.col("op_type") == "upsert")
        edits = F.zip_with("off", "was", lambda o, w: F.when(o != w, o))
        sets = F.when(takes & (F.col("op_type") == "upsert"), F.when(F.col("there"), edits).otherwise(F.col("off")))
        ops = ops.withColumns({"sets": sets, "dies": takes & F.col("there") & ((F.col("op_type") == "delete") | F.col("payload_gone")), "holds": F.lit(False), "update": takes & update})
        rows = self.server.select("sync_id", F.lit(_SERVER).alias("id"), M.comparable(self.order, lambda f: F.col(f"row.{f}")).alias("sets"), F.col("gone_at").isNotNull().alias("dies"), F.col("row").alias("row"), *([F.col("row.month").alias("_own_month")] if "month" in self.fields else []))
        marks = self.held.select("sync_id", F.lit(_HELD).alias("id"), F.lit(True).alias("holds"))
        every = ops.unionByName(rows, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
        scanned = last_before(every, "sync_id", "id", {f"_n{i}": F.col("sets")[i] for i in range(size)} | {"gone": F.when(F.col("dies"), True), "held": F.when(F.col("holds"), True)}, self.hot, self.hot_rows)
        scanned = scanned.withColumn("cur", F.array(*(F.col(f"_n{i}") for i in range(size)))).drop(*(f"_n{i}" for i in range(size)))
        if "month" not in self.fields:
            return scanned.withColumns({"sets_month": F.lit(None).cast("string"), "month_now": F.lit(None).cast("string")})
        d = self.at.get("bid_date")
        dated = F.lit("") if d is None else V.month_of(F.when(F.col("update"), F.coalesce(F.col("sets")[d], F.col("cur")[d])).otherwise(F.col("off")[d]))
        typed = F.nullif(F.col("payload_month"), F.lit(""))
        own = F.when(takes & (F.col("op_type") == "upsert"), F.coalesce(F.nullif(dated, F.lit("")), typed))
        scanned = scanned.withColumn("sets_month", F.coalesce(F.col("_own_month"), own)).drop("_own_month")
        return last_before(scanned, "sync_id", "id", {"month_now": F.col("sets_month")}, self.hot, self.hot_rows)

    def _decided(self, steps: DataFrame) -> DataFrame:
        """The decision table: each op by the facts on it and on the row before it, the first condition that holds."""
        month = "month" in self.fields
        alike = lambda a, b: V.norm_text(a) == V.norm_text(b)
        moved = F.exists(F.zip_with("was", "cur", lambda w, c: w != c), lambda x: x) | (~alike("base_month", "month_now") if month else F.lit(False))
        edited = F.exists(F.zip_with("was", "off", lambda w, o: w != o), lambda x: x) | (~alike("base_month", "payload_month") if month else F.lit(False))
        facts = F.transform(F.arrays_zip("was", "off", "cur"), lambda x: (x["was"] != x["off"]) & (x["was"] != x["cur"]) & (x["off"] != x["cur"]))
        steps = steps.withColumns({"_moved": moved, "_edited": edited, "_clash": facts})
        told = lambda kind, f: F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field"))
        clash = lambda f: F.col("_clash")[self.at[f]] if f in self.at else F.lit(False)
        merged = F.array_compact(F.array(*(F.when(clash(f), told(M.conflict_kind(f), f)) for f in sorted(self.order) if f not in UNMERGED_FIELDS)))
        steps = steps.withColumn("_merged", merged)
        nothing = F.array().cast("array<struct<kind:string,field:string>>")
        verdict = lambda result, reason="", found=nothing: F.struct(F.lit(result).alias("result"), F.lit(reason).alias("reason"), found.alias("conflicts"))
        removes, gone = F.col("op_type") == "delete", F.coalesce("gone", F.lit(False))
        alive, was_gone = ~F.col("payload_gone"), F.col("base_gone")
        against = verdict("conflict", "", F.array(told("delete_edit", "deleted_at")))
        opened = F.when(F.col("opens"), F.array(told("sr_ordering", "sr_no"))).otherwise(nothing)
        table = [
            (F.col("role") == "stored", F.struct(F.col("stored").alias("result"), F.lit("replayed").alias("reason"), nothing.alias("conflicts"))),
            (F.col("role") == "nameless", verdict("error", "op without id")),
            (F.col("role") == "unknown", verdict("error", "unknown op_type")),
            (F.col("role") == "again", verdict("again")),
            (F.coalesce("held", F.lit(False)), verdict("conflict", "open conflict")),
            ((F.col("role") == "early") & removes, verdict("error", "delete of an unknown row")),
            (F.col("role") == "early", verdict("error", "new row with a base")),
            (F.col("opens").isNotNull(), verdict("conflict", "month order", F.concat(opened, "_merged"))),
            (removes & gone, verdict("noop", "already deleted")),
            (removes & F.col("has_base") & F.col("_moved"), against),
            (removes | ~F.col("there"), verdict("applied")),
            (F.size("_merged") > 0, verdict("conflict", "", F.col("_merged"))),
            (gone & alive & F.col("_edited"), against),
            (was_gone & ~(~alive & gone), against),
            (clash("invoice_no"), verdict("conflict", "", F.array(told("field", "invoice_no")))),
            (clash("sr_no"), verdict("conflict", "", F.array(told("sr_ordering", "sr_no")))),
        ]
        decision = reduce(lambda c, x: c.when(*x), table[1:], F.when(*table[0])).otherwise(verdict("applied"))
        return steps.withColumn("_v", F.when(F.col("id") > _SERVER, decision)).select("*", "_v.*").drop("_v", "_moved", "_edited", "_clash", "_merged")

    def _once(self, todo: DataFrame) -> DataFrame:
        decided = self._decided(self._steps(todo))
        stopped = last_before(decided, "sync_id", "id", {"stop": F.when(F.col("result") == "conflict", True)}, self.hot, self.hot_rows).filter(F.col("id") > _SERVER)
        late = F.coalesce("stop", F.lit(False)) & F.col("role").isin("takes", "early")
        nothing = F.array().cast("array<struct<kind:string,field:string>>")
        stopped = storage.cut(stopped.withColumns({"result": F.when(late, "conflict").otherwise(F.col("result")), "reason": F.when(late, "open conflict").otherwise(F.col("reason")), "conflicts": F.when(late, nothing).otherwise(F.col("conflicts"))}))
        again = stopped.filter("role = 'again'").drop("result", "reason")
        firsts = stopped.filter("role = 'takes'").select(F.col("id").alias("first"), F.col("result").alias("_first"))
        known = again.join(firsts, "first").withColumns(
            {
                "result": F.when(F.col("_first") == "applied", "applied").when(F.col("stop"), "conflict").otherwise(F.col("_first")),
                "reason": F.when(F.col("_first") == "applied", "replayed").when(F.coalesce("stop", F.lit(False)) | (F.col("_first") == "conflict"), "open conflict").otherwise("already deleted"),
            }
        )
        return stopped.filter("role <> 'again'").unionByName(known.select(*stopped.columns))

    def settle(self, todo: DataFrame) -> DataFrame:
        """The ops decided.  Where rows share op_ids: again and again, each time with the first applied deliveries of the
        time before stored for later ones, until they stay the same.  Each time at least one more op in order of id is right."""
        named = todo.filter("op_id <> ''").groupBy("op_id").agg(F.min("sync_id").alias("_a"), F.max("sync_id").alias("_b"))
        shared = storage.cut(named.filter("_a <> _b").select("op_id"))
        final, before = self._once(todo), None
        if shared.isEmpty():
            return final
        while True:
            first = storage.cut(final.filter("result = 'applied' AND role = 'takes'").join(shared, "op_id", "left_semi").groupBy("op_id").agg(F.min("id").alias("_first")))
            if before is not None and first.exceptAll(before).isEmpty() and before.exceptAll(first).isEmpty():
                place = first.withColumnRenamed("_first", "_elsewhere")
                return final.join(place, "op_id", "left").withColumn("first", F.when((F.col("role") == "stored") & F.col("stored_rev").isNull(), F.col("_elsewhere")).otherwise(F.col("first"))).drop("_elsewhere")
            known = todo.join(first, "op_id", "left").withColumn("_known", F.when(F.col("id") > F.col("_first"), F.lit("applied"))).drop("_first")
            final, before = self._once(known), first

    def rows_after(self, new: DataFrame) -> DataFrame:
        """``sync_id, row, deleted_at``: each field as the last applied op left it that set it or met it unchanged."""
        new = new.join(self.todo.select("id", "payload", "base"), "id")
        steps = new.select("sync_id", "id", "op_type", "payload", "base", "off", "was", "cur", "there", "update", "sets_month", F.lit(None).cast(self.server.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("gone_at"))
        olds = self.server.join(new.select("sync_id").distinct(), "sync_id", "left_semi").select("sync_id", F.lit(_SERVER).alias("id"), "row", "gone_at")
        every = steps.unionByName(olds, allowMissingColumns=True)
        upsert, server = F.col("op_type") == "upsert", F.col("id") == _SERVER

        def value(f: str) -> Column:
            at = self.at[f]
            edited, same = F.col("off")[at] != F.col("was")[at], F.col("cur")[at] == F.col("was")[at]
            if f in UNMERGED_FIELDS:
                mine = F.when(edited & same, F.struct("id", F.col(f"payload.{f}").alias("v")))
            else:
                mine = F.when(edited, F.struct("id", F.col(f"payload.{f}").alias("v"))).when(same, F.struct("id", F.col(f"base.{f}").alias("v")))
            return F.max(F.when(server, F.struct("id", F.col(f"row.{f}").alias("v"))).when(upsert & ~F.col("there"), F.struct("id", F.col(f"payload.{f}").alias("v"))).when(upsert, mine))["v"]

        month = F.max(F.when(server, F.struct("id", F.col("row.month").alias("v"))).when(F.col("sets_month").isNotNull(), F.struct("id", F.col("sets_month").alias("v"))))["v"] if "month" in self.fields else None
        dead = F.when(server, F.col("gone_at")).when(F.col("op_type") == "delete", F.coalesce("payload.deleted_at", F.lit(self.now))).when(F.col("update"), F.col("payload.deleted_at"))
        gone = F.max(F.when(dead.isNotNull(), F.struct("id", dead.alias("v"))))["v"]
        agg = every.groupBy("sync_id").agg(*((month if f == "month" else value(f)).alias(f"_{f}") for f in self.fields), gone.alias("deleted_at"))
        return agg.select("sync_id", F.struct(*(F.col(f"_{f}").cast(FIELD_TYPES[f]).alias(f) for f in self.fields)).alias("row"), "deleted_at")


def collisions_of(results: DataFrame, changed: DataFrame, server: DataFrame, ops: DataFrame) -> DataFrame:
    """``id, sync_id, invoice, others``: the last applied op that gave a known row another invoice, where another sync_id has this one,
    in the table or among the rows applied.  Advisory: nothing is held back."""
    known = newest(server).select("sync_id", F.lit(True).alias("_known"))
    edits = ops.filter((F.col("op_type") == "upsert") & (V.norm_text("payload.invoice_no") != V.norm_text("base.invoice_no"))).select("id")
    own = results.filter((F.col("result") == "applied") & (F.col("reason") != "replayed")).join(edits, "id", "left_semi").join(known, "sync_id", "left_semi").groupBy("sync_id").agg(F.max("id").alias("id"))
    inv = changed.select("sync_id", V.norm_text("row.invoice_no").alias("invoice")).filter("invoice <> ''")
    owned = server.filter(F.col("sync_id").isNotNull()).select("sync_id", V.norm_text("invoice_no").alias("invoice")).filter("invoice <> ''")
    owners = owned.unionByName(inv).distinct().groupBy("invoice").agg(F.count("*").alias("n"))
    return inv.join(owners.filter("n > 1"), "invoice").join(own, "sync_id").select("id", "sync_id", "invoice", (F.col("n") - 1).alias("others"))


# Order


def month_moves(ops: DataFrame) -> DataFrame:
    """Upserts that give a row another place in the same month, and the month: that of the date, else the one typed."""
    month = lambda s: F.coalesce(F.nullif(V.month_of(f"{s}.bid_date"), F.lit("")), F.nullif(F.col(f"{s}.month"), F.lit("")))
    moves = ops.filter((F.col("op_type") == "upsert") & F.col("base").isNotNull() & ~F.col("payload.sr_no").eqNullSafe(F.col("base.sr_no")))
    return moves.withColumn("month", month("payload")).filter(F.col("month") == month("base"))


def ordering_plan(ops: DataFrame, server: DataFrame) -> DataFrame:
    """``(month, action, ops)`` for each month whose rows upserts would move: unchanged, use_offline, use_online or conflict.

    The month's orders by base, offline and online places are compared by each row's rank in the three, not
    as lists, so a month of any size is spread over tasks.
    """
    moved = month_moves(ops).groupBy("sync_id").agg(F.max_by("month", "id").alias("m"), F.max_by("payload.sr_no", "id").alias("off"), F.min_by("base.sr_no", "id").alias("base"), F.count("*").alias("n"))
    months = moved.select(F.col("m").alias("month")).distinct()
    live = newest(server).filter(F.col("deleted_at").isNull()).join(months, "month", "left_semi").select("sync_id", "month", F.coalesce("sr_no", F.lit(0)).alias("on"))
    three = live.join(moved, "sync_id", "left").select("sync_id", "month", "n", "on", F.coalesce("base", "on").alias("base"), F.coalesce("off", "on").alias("off"))
    return order_actions(three)


def order_actions(three: DataFrame) -> DataFrame:
    """``(month, action, ops)`` of each month by its rows' places in three orders: ``sync_id, month, base, off, on, n``."""
    for side in ("base", "off", "on"):
        three = rank_within(three, ["month"], [F.asc(side), F.asc("sync_id")], f"r_{side}")
    same = three.groupBy("month").agg(F.bool_and(F.col("r_off") == F.col("r_base")).alias("ob"), F.bool_and(F.col("r_on") == F.col("r_base")).alias("nb"), F.bool_and(F.col("r_off") == F.col("r_on")).alias("on_"), F.coalesce(F.sum("n"), F.lit(0)).alias("ops"))
    return same.select("month", M.sequence_action(F.col("ob"), F.col("nb"), F.col("on_")).alias("action"), "ops")


def order_choices(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """``month, sequence, online`` of open ordering conflicts under the choices made for them (``id, choice, value``, lists as JSON), as
    ``order_resolution`` takes them; of several for one month the newest."""
    made = conflicts.filter("status = 'open' AND kind = 'sr_ordering'").join(choices.select("id", "choice", F.col("value").alias("_own")), "id").filter(F.col("choice").isin(*CHOICES))
    chosen = F.when(F.col("choice") == "KEEP_OFFLINE", F.col("offline_value")).when(F.col("choice") == "KEEP_ONLINE", F.col("online_value")).otherwise(F.col("_own"))
    last = made.groupBy("month").agg(F.max_by(F.struct(chosen.alias("s"), F.col("online_value").alias("o")), "id").alias("_c"))
    return last.select("month", V.json_list("_c.s").alias("sequence"), V.json_list("_c.o").alias("online"))


def order_resolution(conflicts: DataFrame, server: DataFrame) -> DataFrame:
    """``(sync_id, month, sr_no, outcome)`` by the chosen orders: ``month, sequence`` (array of sync_ids), one row for each month.

    ``conflicts`` may have ``online``, the online order recorded with the conflict: a month whose live order is no longer that gives
    one row, reopened, without sync_id and sr_no.  Of the others a month is left alone unless the sequence is a
    permutation of its live rows.
    """
    if "online" in conflicts.columns:
        now = rank_within(newest(server).filter(F.col("deleted_at").isNull()).join(conflicts.select("month"), "month", "left_semi").select("month", "sync_id", F.coalesce("sr_no", F.lit(0)).alias("_sr")), ["month"], [F.asc("_sr"), F.asc("sync_id")], "_now")
        then = conflicts.select("month", F.posexplode("online").alias("_pos", "sync_id")).select("month", "sync_id", (F.col("_pos") + 1).cast("bigint").alias("_then"))
        moved = now.join(then, ["month", "sync_id"], "full").filter(~F.col("_now").eqNullSafe(F.col("_then"))).select("month").distinct()
        kept = order_resolution(conflicts.join(moved, "month", "left_anti").drop("online"), server)
        return kept.unionByName(conflicts.join(moved, "month", "left_semi").select(F.lit(None).cast("string").alias("sync_id"), "month", F.lit(None).cast("bigint").alias("sr_no"), F.lit("reopened").alias("outcome")))
    chosen = conflicts.select("month", F.posexplode("sequence").alias("pos", "sync_id"))
    live = newest(server).filter(F.col("deleted_at").isNull()).select("sync_id", "month", F.lit(True).alias("_here"))
    both = chosen.withColumn("_asked", F.lit(True)).join(live, ["month", "sync_id"], "full").join(conflicts.select("month").distinct(), "month", "left_semi")
    fine = both.groupBy("month").agg(F.bool_and(F.col("_here").isNotNull() & F.col("_asked").isNotNull()).alias("ok"), (F.count("*") == F.countDistinct("sync_id")).alias("once")).filter("ok AND once").select("month")
    return chosen.join(fine, "month", "left_semi").select("sync_id", "month", (F.col("pos") + 1).cast("bigint").alias("sr_no"), F.lit("applied").alias("outcome"))


# Conflicts


def resolve_fields(conflicts: DataFrame, choices: DataFrame, server: DataFrame) -> DataFrame:
    """``(id, sync_id, field_name, outcome, value)``: open field conflicts under the choices made for them.

    ``choices``: ``id, choice, value``.  outcome: applied; reopened where the online value (by the field's class), or for a delete against an
    edit whether the row is deleted, is no longer what the conflict recorded; invalid for an unknown choice, an advisory
    conflict, or one on a month's order (``order_resolution`` settles these); gone where there is no row.  The value of a settled delete
    is the time of deletion, null for a row that lives.
    """
    fields = [f for f in BUSINESS_FIELDS if f in server.columns]
    now = F.try_element_at(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f"_row.{f}").cast("string")))), F.col("field_name"))
    gone = F.col("deleted_at") if "deleted_at" in server.columns else F.lit(None).cast("string")
    rows = newest(server).select("sync_id", F.struct(*fields).alias("_row"), gone.alias("_gone"), F.lit(True).alias("_here"))
    todo = conflicts.filter("status = 'open'").join(choices.select("id", "choice", F.col("value").alias("_own")), "id").join(rows, "sync_id", "left")
    todo, now = todo.withColumn("_now", now), F.col("_now")
    deletes = F.col("kind") == "delete_edit"
    own = F.when(deletes, F.col("offline_value")).otherwise(F.col("_own"))
    value = F.when(F.col("choice") == "KEEP_OFFLINE", F.col("offline_value")).when(F.col("choice") == "KEEP_ONLINE", F.col("online_value")).otherwise(own)
    known = F.col("field_name").isin(*fields)
    same = lambda f: M.values_equal(f, now, F.col("online_value"))
    typed = F.when(F.col("field_name").isin(*FINANCIAL_FIELDS), same(FINANCIAL_FIELDS[0])).when(F.col("field_name") == "bid_date", same("bid_date")).otherwise(same("name"))
    moved = F.when(deletes, V.as_deleted("online_value").isNotNull() != F.col("_gone").isNotNull()).otherwise(~typed)
    settles = F.col("kind").isin("field", "financial", "serial") & known | deletes
    outcome = F.when(~F.col("choice").isin(*CHOICES) | ~settles, "invalid").when(F.col("_here").isNull(), "gone").when(moved, "reopened").otherwise("applied")
    told = todo.withColumn("outcome", outcome)
    return told.select("id", "sync_id", "field_name", "outcome", F.when(F.col("outcome") == "applied", F.when(deletes, V.as_deleted(value)).otherwise(value)).alias("value"))


def retired(ops: DataFrame, server: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Blocked ops whose conflict was settled elsewhere: the row is newer than their base and has no open conflict."""
    still = conflicts.filter("status = 'open'").select("sync_id").distinct()
    newer = server.filter(F.col("sync_id").isNotNull()).groupBy("sync_id").agg(F.max("server_rev").alias("_rev"))
    return ops.filter("status = 'blocked'").join(newer, "sync_id").filter("_rev > base_rev").join(still, "sync_id", "left_anti").select("id", "op_id", "sync_id", "base_rev", F.col("_rev").alias("server_rev"))


def shown_value(value: str) -> Column:
    """A conflict's value as shown: blank for null, but orders and invoices as they are."""
    return F.when(F.col("kind").isin("sr_ordering", "invoice_collision"), F.col(value)).otherwise(F.coalesce(value, F.lit("")))


def conflict_lists(conflicts: DataFrame) -> DataFrame:
    """Each row's open conflicts in four lists (fields, orders, invoices, deletes), by id, with labels of fields and kinds."""
    item = F.struct("id", F.col("field_name").alias("field"), V.label("field_name", FIELD_LABELS).alias("field_label"), "kind", V.label("kind", KIND_LABELS).alias("kind_label"), *(shown_value(f"{s}_value").alias(s) for s in ("base", "offline", "online")))
    of = lambda name, *kinds: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), item))).alias(name)
    named = F.array_sort(F.collect_set(V.label("kind", KIND_LABELS))).alias("types")
    return conflicts.filter("status = 'open' AND sync_id IS NOT NULL").groupBy("sync_id").agg(of("fields", "field", "financial", "serial"), of("orders", "sr_ordering"), of("invoices", "invoice_collision"), of("deletes", "delete_edit"), named)


def by_label(views: DataFrame) -> DataFrame:
    """Views in order of their label, case aside."""
    return views.orderBy(F.lower("label"), "sync_id")


def conflict_views(conflicts: DataFrame, records: DataFrame) -> DataFrame:
    """Each row's open conflicts, counted by kind, with the row's label: its name, and its invoice or phone."""
    blank = lambda c: F.nullif(V.strip(c), F.lit(""))
    named = newest(records).select("sync_id", F.coalesce(blank("name"), F.lit("Unnamed record")).alias("label"), F.coalesce(blank("invoice_no"), blank("phone"), F.lit("")).alias("detail"))
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds)).alias(f"{kinds[0]}_conflicts")
    views = conflicts.filter("status = 'open'").groupBy("sync_id").agg(
        F.count("*").alias("n"), count("field", "financial", "serial"), count("sr_ordering"), count("invoice_collision"), count("delete_edit"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min_by("created_at", "id").alias("created_at"),
    )
    return views.join(named, "sync_id", "left").withColumns({"label": F.coalesce("label", F.lit("Unnamed record")), "detail": F.coalesce("detail", F.lit(""))})
