"""Column expressions of the quantity ledger: ceilings, status and percentages of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def zero() -> Column:
    return F.lit(0).cast("decimal(14,4)")


def num(name: str) -> Column:
    return F.coalesce(F.col(name), zero())


def floor0(value: Column) -> Column:
    return F.greatest(zero(), value)


def not_yet_located() -> Column:
    return floor0(num("qty_requested") - num("qty_confirmed_located"))


def remaining() -> Column:
    return floor0(num("qty_requested") - num("qty_issued"))


def locatable() -> Column:
    """What is neither found nor locked under a pending backorder."""
    return floor0(F.least(not_yet_located(), remaining()) - num("qty_pending_backorder"))


def reservable() -> Column:
    return floor0(num("qty_available") + locatable())


def new_backorder() -> Column:
    return floor0(remaining() - num("qty_available") - num("qty_active_bagged") - num("qty_pending_backorder") - num("qty_confirmed_backorder"))


def lendable() -> Column:
    return floor0(num("qty_available"))


def shortage() -> Column:
    return floor0(remaining() - num("qty_available") - num("qty_active_bagged"))


def line_status() -> Column:
    asked = num("qty_requested") > 0
    return (
        F.when((remaining() <= 0) & asked, "Issued").when(num("qty_issued") > 0, "Partially Issued").when(num("qty_confirmed_backorder") > 0, "Backordered")
        .when(num("qty_pending_backorder") > 0, "Pending Backorder").when((num("qty_active_bagged") >= num("qty_requested")) & asked, "Bagged").when(num("qty_active_bagged") > 0, "Partially Bagged")
        .when((num("qty_confirmed_located") >= num("qty_requested")) & asked, "Located").when(num("qty_confirmed_located") > 0, "Partially Located").otherwise("Open")
    )


def iso_key() -> Column:
    return F.concat_ws("|", F.upper("iso_number"), F.upper("iso_sheet"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 without a whole."""
    return F.when(whole > 0, F.floor(part.cast("double") * 100 / whole.cast("double") + 0.5)).otherwise(0).cast("long")


def with_derived(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"not_yet_located": not_yet_located(), "remaining": remaining(), "iso_key": iso_key(), "line_status": line_status()})


def action_limits(lines: DataFrame) -> DataFrame:
    """One row for each line and action, with the most that the action may move."""
    limits = {
        "CONFIRM_AVAILABLE": locatable(), "BAG": reservable(), "DIRECT_ISSUE": F.least(locatable(), remaining()),
        "ISSUE_FROM_AVAILABLE": F.least(num("qty_available"), remaining()), "BACKORDER_REQUESTED": new_backorder(), "ISSUE_FROM_BAG": F.least(num("qty_active_bagged"), remaining()),
    }
    pairs = F.array(*[F.struct(F.lit(a).alias("action"), v.cast("double").alias("limit")) for a, v in limits.items()])
    return lines.select("line_id", F.explode(pairs).alias("x")).select("line_id", "x.action", F.col("x.limit").alias("max_quantity"))
