"""Reconciliation of tables: every check is a table of violations (project, code, entity, difference)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive

TOLERANCE = 1e-4


def _found(rows: DataFrame, code: str, entity: str, difference: Column) -> DataFrame:
    return rows.select("project_id", F.lit(code).alias("code"), F.col(entity).cast("long").alias("entity_id"), difference.cast("double").alias("difference"))


def bag_ledger(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Bagged quantity of a line against what its active bags hold."""
    held = items.filter("active").groupBy("line_id").agg(F.sum("qty_remaining").alias("held"))
    gap = F.col("qty_active_bagged") - F.coalesce("held", F.lit(0))
    return _found(lines.filter("active").join(held, "line_id", "left").filter(F.abs(gap) > TOLERANCE), "BAG_LEDGER", "line_id", gap)


def backorder_excess(lines: DataFrame) -> DataFrame:
    over = F.col("qty_pending_backorder") + F.col("qty_confirmed_backorder") - derive.not_yet_located()
    return _found(lines.filter("active").filter(over > 0), "BACKORDER_EXCESS", "line_id", over)


def orphan_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Bag items with stock that stand on an inactive line."""
    gone = lines.filter("not active").select("line_id")
    return _found(items.filter("qty_remaining > 0").join(gone, "line_id", "left_semi"), "ORPHAN_BAG_ITEM", "line_id", F.col("qty_remaining"))


def notice_without_request(notices: DataFrame, requests: DataFrame) -> DataFrame:
    return _found(notices.filter("active and kind <> 'REJECTED'").join(requests.filter("active and qty_pending > 0").select("id"), "id", "left_anti"), "NOTICE_WITHOUT_REQUEST", "id", F.col("qty_notified"))


#: Quantities of a line that may not be below zero (fixed values).
QUANTITIES = ("requested", "confirmed_located", "active_bagged", "available", "issued", "pending_backorder", "confirmed_backorder")


def row_constraints(lines: DataFrame) -> DataFrame:
    """One row for each rule of a sound line that a line breaks: the schema's checks and those of a loaded sheet. Nulls break the rules on missing drawings only."""
    q = {n: F.col(f"qty_{n}") for n in QUANTITIES}
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = {
        "NOTHING_REQUESTED": q["requested"] <= 0, "LOCATED_SPLIT": F.abs(q["confirmed_located"] - (q["available"] + q["active_bagged"] + q["issued"])) > 1e-4,
        "ISSUED_OVER_REQUESTED": q["issued"] > q["requested"], "LOCATED_OVER_REQUESTED": q["confirmed_located"] > q["requested"],
    } | {f"NEGATIVE_{n.upper()}": c < 0 for n, c in q.items()} | {"NO_ISO_NUMBER": blank("iso_number"), "NO_ISO_SHEET": blank("iso_sheet")}
    broken = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return lines.select("project_id", F.explode(broken).alias("code"), F.col("line_id").cast("long").alias("entity_id"), F.col("qty_requested").cast("double").alias("difference"))


#: Issues and what takes them back: corrections carry a negative quantity, reversals the quantity that they undo.
ISSUES = ("DIRECT_ISSUE", "ISSUE_FROM_AVAILABLE", "ISSUE_FROM_BAG")


def backorder_ledger(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Backorder totals of a line against its active requests; the difference adds both totals' gaps."""
    asked = requests.filter("active").groupBy("line_id").agg(F.sum("qty_pending").alias("p"), F.sum("qty_confirmed").alias("c"))
    pending = F.abs(F.col("qty_pending_backorder") - F.coalesce("p", F.lit(0)))
    confirmed = F.abs(F.col("qty_confirmed_backorder") - F.coalesce("c", F.lit(0)))
    return _found(lines.filter("active").join(asked, "line_id", "left").filter((pending > TOLERANCE) | (confirmed > TOLERANCE)), "BACKORDER_LEDGER", "line_id", pending + confirmed)


def issued_history(lines: DataFrame, movements: DataFrame) -> DataFrame:
    """Issued quantity of a line against its issue movements."""
    kept = movements.filter(F.regexp_replace("action", "^(CORRECTION|REVERSAL)_", "").isin(*ISSUES))
    told = kept.groupBy("line_id").agg(F.sum(F.when(F.col("action").startswith("REVERSAL_"), -F.col("quantity")).otherwise(F.col("quantity"))).alias("told"))
    return issued_difference(lines, told)


def issued_difference(lines: DataFrame, told: DataFrame) -> DataFrame:
    """Issued quantity of a line against told(line_id, told)."""
    gap = F.col("qty_issued") - F.coalesce("told", F.lit(0))
    return _found(lines.filter("active").join(told, "line_id", "left").filter(F.abs(gap) > TOLERANCE), "ISSUED_HISTORY", "line_id", gap)


def status(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines whose stored status contradicts their quantities; the difference is what remains."""
    left, marked = derive.remaining(), F.col("line_status")
    wrong = ((marked == "Issued") & (left > TOLERANCE)) | ((marked == "Open") & (F.col("qty_confirmed_located") > TOLERANCE)) | ((left <= TOLERANCE) & (F.col("qty_requested") > 0) & (marked != "Issued"))
    return _found(lines.filter("active").join(stored, "line_id").filter(wrong), "STATUS", "line_id", left)


def report(*violations: DataFrame) -> DataFrame:
    """Count and total difference of each project and check."""
    return reduce(DataFrame.unionByName, violations).groupBy("project_id", "code").agg(F.count("*").alias("violations"), F.round(F.sum("difference"), 4).alias("difference"))


def repair_backorder_totals(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Lines whose backorder totals differ from their active requests, with both values."""
    asked = requests.filter("active").groupBy("line_id").agg(F.sum("qty_pending").alias("p"), F.sum("qty_confirmed").alias("c"))
    both = lines.filter("active").join(asked, "line_id", "left").select("line_id", "qty_pending_backorder", "qty_confirmed_backorder", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("c", F.lit(0)).alias("c"))
    off = both.filter("qty_pending_backorder <> p or qty_confirmed_backorder <> c")
    return off.select("line_id", *[F.col(a).cast("double").alias(b) for a, b in (("qty_pending_backorder", "pending_from"), ("p", "pending_to"), ("qty_confirmed_backorder", "confirmed_from"), ("c", "confirmed_to"))])


def sweep_stale_notices(notices: DataFrame, requests: DataFrame, issued: DataFrame, requested: int = 1000) -> DataFrame:
    """Active notices: superseded when their line has all it asked for (issued(line_id, issued)), or, unless they are rejections, when the request behind them is closed."""
    live = requests.filter("active").select("id", F.lit(True).alias("live"))
    rows = notices.filter("active").join(live, "id", "left").join(issued, "line_id", "left")
    reason = F.when(F.coalesce("issued", F.lit(0)) >= requested, "No longer outstanding").when(F.col("kind").isin("CONFIRMED", "RETURNED") & F.col("live").isNull(), "The request behind it is closed")
    return rows.select("id", "kind", F.when(reason.isNotNull(), "Superseded").otherwise("Active").alias("status"), reason.alias("reason"))
