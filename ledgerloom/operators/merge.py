"""Three-way merge of two copies of a row against their last common state, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.schema import BUSINESS_FIELDS, FINANCIAL_FIELDS, UNMERGED_FIELDS


def values_equal(field: str, a: Column, b: Column) -> Column:
    """Equality by the field's class: amounts by number, dates by day, texts without case and spacing."""
    if field in FINANCIAL_FIELDS:
        na, nb = V.norm_number(a), V.norm_number(b)
        blank = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
        neither = (blank(a) & blank(b)) | (V.norm_text(a) == V.norm_text(b))
        return F.when(na.isNull() & nb.isNull(), neither).otherwise(na.eqNullSafe(nb))
    if field == "bid_date":
        return V.norm_date(a) == V.norm_date(b)
    return V.norm_text(a) == V.norm_text(b)


def _comparable(field: str, c: Column) -> Column:
    """A text that is the same for values that are equal by the field's class, and only for these."""
    if field in FINANCIAL_FIELDS:
        n = V.norm_number(c)
        return F.coalesce(F.concat(F.lit("#"), n.cast("string")), V.norm_text(c))
    return V.norm_date(c) if field == "bid_date" else V.norm_text(c)


def comparable(fields: Sequence[str], side: Callable[[str], Column]) -> Column:
    """The comparable forms of a row's fields as one array.

    Fields of a class go through one lambda, so the generated code doesn't grow with the number of fields.
    """
    classes = [[f for f in fields if f in FINANCIAL_FIELDS], [f for f in fields if f == "bid_date"], [f for f in fields if f not in FINANCIAL_FIELDS and f != "bid_date"]]

    def form(members: list[str]) -> Column:
        return F.transform(F.array(*(side(f).cast("string") for f in members)), lambda x: _comparable(members[0], x))

    return F.concat(*(form(c) for c in classes if c))


def comparable_order(fields: Sequence[str]) -> list[str]:
    return [f for f in fields if f in FINANCIAL_FIELDS] + [f for f in fields if f == "bid_date"] + [f for f in fields if f not in FINANCIAL_FIELDS and f != "bid_date"]


def action_of(base: Column, offline: Column, online: Column) -> Column:
    """unchanged, use_offline, use_online, converged or conflict, by three comparable forms."""
    return F.when((base == offline) & (base == online), "unchanged").when(base == online, "use_offline").when(base == offline, "use_online").when(offline == online, "converged").otherwise("conflict")


def resolved_value(action: Column, base: Column, offline: Column, online: Column) -> Column:
    """The merged value; null for a conflict, which leaves the field open."""
    return F.when(action.isin("use_offline", "converged"), offline).when(action == "use_online", online).when(action == "unchanged", base)


def conflict_kind(field: str) -> str:
    return "financial" if field in FINANCIAL_FIELDS else "serial" if field == "serial_no" else "field"


def merge_rows(df: DataFrame, fields: Sequence[str] = BUSINESS_FIELDS, base: str = "base", offline: str = "offline", online: str = "online") -> DataFrame:
    """``df`` (with three structs of ``fields``) and ``actions`` (map), ``resolved`` (struct) and ``conflicts`` (array).

    A null struct stands for all-null fields.  sr_no, invoice_no and month aren't merged field by field: sr_no is the offline one,
    month is told by the merged date, else taken from offline, online or base, whichever has it first.
    """
    merged = [f for f in fields if f not in UNMERGED_FIELDS]
    side = lambda s, f: F.col(f"{s}.{f}")
    order = comparable_order(merged)
    df = df.withColumns({f"_c_{s}": comparable(merged, lambda f, s=s: side(s, f)) for s in (base, offline, online)})
    df = df.withColumn("_a", F.zip_with(F.zip_with(f"_c_{base}", f"_c_{offline}", lambda b, o: F.struct(b.alias("b"), o.alias("o"))), f"_c_{online}", lambda p, n: action_of(p["b"], p["o"], n)))
    df = df.withColumns({f"_a_{f}": F.col("_a")[i] for i, f in enumerate(order)})
    df = df.withColumns({f"_r_{f}": resolved_value(F.col(f"_a_{f}"), side(base, f), side(offline, f), side(online, f)) for f in merged})
    resolved = {f: F.col(f"_r_{f}") for f in merged}
    if "sr_no" in fields:
        resolved["sr_no"] = side(offline, "sr_no")
    if "month" in fields and "bid_date" in merged:
        resolved["month"] = F.coalesce(F.nullif(V.month_of("_r_bid_date"), F.lit("")), *(F.nullif(side(s, "month"), F.lit("")) for s in (offline, online, base)))
    text = lambda c: c.cast("string")
    found = [
        F.when(F.col(f"_a_{f}") == "conflict", F.struct(F.lit(conflict_kind(f)).alias("kind"), F.lit(f).alias("field"), text(side(base, f)).alias("base"), text(side(offline, f)).alias("offline"), text(side(online, f)).alias("online")))
        for f in sorted(merged)
    ]
    df = df.withColumns(
        {
            "actions": F.create_map(*(x for f in merged for x in (F.lit(f), F.col(f"_a_{f}")))),
            "resolved": F.struct(*(resolved[f].alias(f) for f in fields if f in resolved)),
            "conflicts": F.array_compact(F.array(*found)),
        }
    )
    return df.drop("_a", *(f"_{x}_{f}" for x in "ar" for f in merged), *(f"_c_{s}" for s in (base, offline, online)))


def tombstone_action(base_alive: Column, off_alive: Column, on_alive: Column) -> Column:
    """``struct(action, why)`` for who of the three still has the row."""
    pair = lambda a, w: F.struct(F.lit(a).alias("action"), F.lit(w).alias("why"))
    return (
        F.when(~base_alive & ~off_alive & ~on_alive, pair("unchanged", "both_deleted"))
        .when(~base_alive, pair("conflict", "resurrect"))
        .when(off_alive & on_alive, pair("unchanged", "alive"))
        .when(~off_alive & ~on_alive, pair("apply", "both"))
        .when(~off_alive, pair("apply", "offline"))
        .otherwise(pair("apply", "online"))
    )


def sequence_action(off_is_base: Column, on_is_base: Column, off_is_on: Column) -> Column:
    """What to do with an order of rows, by which of its three forms are the same."""
    return F.when(off_is_base & on_is_base, "unchanged").when(on_is_base, "use_offline").when(off_is_base, "use_online").when(off_is_on, "use_offline").otherwise("conflict")


def changed_fields(fields: Sequence[str], a: str, b: str) -> Column:
    return F.array_compact(F.array(*(F.when(~values_equal(f, F.col(f"{a}.{f}"), F.col(f"{b}.{f}")), F.lit(f)) for f in fields)))
