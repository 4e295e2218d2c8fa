"""Oldest-first allocation of a budget, as one window: what is taken is the budget less all that stands before, held to the row's own quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def take(quantity: Column, budget: Column, partition: list[str], order: list[str]) -> Column:
    before = F.sum(quantity).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(F.lit(0).cast("decimal(14,4)"), F.least(quantity, budget - F.coalesce(before, F.lit(0))))


def _budgets(requests: DataFrame, located: DataFrame, totals: DataFrame) -> DataFrame:
    """Active requests of located lines, with what each could give and the line's budget for confirmed parts: no more than the line's own total."""
    zero = F.lit(0).cast("decimal(14,4)")
    rows = requests.filter("active").join(located, "line_id").join(totals.select("line_id", F.col("confirmed").alias("owed"), F.col("pending").alias("waits")), "line_id")
    pool = F.when(F.col("status").isin("Confirmed", "Partially Confirmed"), F.col("qty_confirmed")).otherwise(zero)
    waiting = F.when(F.col("status") == "Pending", F.col("qty_pending")).otherwise(zero)
    budget = F.least("located", F.greatest(zero, F.col("owed")))
    out = rows.withColumns({"pool": pool, "waiting": waiting, "budget": budget})
    return out.withColumn("desync", F.sum("pool").over(Window.partitionBy("line_id")) < F.col("budget"))


def settle_backorders(requests: DataFrame, located: DataFrame, totals: DataFrame) -> DataFrame:
    """located(line_id, located) settles confirmed parts first (of confirmed and partly confirmed requests), then, with the rest, pending requests; oldest first, neither beyond the line's
    totals(line_id, confirmed, pending). Lines whose requests hold less than their confirmed total asks for are left alone; backorder_desync names them."""
    zero = F.lit(0).cast("decimal(14,4)")
    order = ["reported_at", "id"]
    first = _budgets(requests, located, totals).filter("not desync").withColumn("take_confirmed", take(F.col("pool"), F.col("budget"), ["line_id"], order))
    spent = first.withColumn("left_over", F.least(F.col("located") - F.sum("take_confirmed").over(Window.partitionBy("line_id")), F.greatest(zero, F.col("waits"))))
    both = spent.withColumn("take_pending", take(F.col("waiting"), F.col("left_over"), ["line_id"], order))
    left = F.col("qty_confirmed") - F.col("take_confirmed") + F.col("qty_pending") - F.col("take_pending")
    return both.filter("take_confirmed > 0 or take_pending > 0").select("id", "line_id", F.col("take_confirmed").cast("double").alias("take_confirmed"), F.col("take_pending").cast("double").alias("take_pending"), F.when(left == 0, "Fulfilled").otherwise(F.col("status")).alias("status"))


def backorder_desync(requests: DataFrame, located: DataFrame, totals: DataFrame) -> DataFrame:
    """Located lines whose requests cannot give what their confirmed total asks for; they need repair before anything is settled."""
    held = _budgets(requests, located, totals).filter("desync").groupBy("line_id").agg(F.sum("pool").alias("held"), F.first("budget").alias("asked"))
    return held.select("line_id", F.col("held").cast("double").alias("held"), F.col("asked").cast("double").alias("asked"))


def settle_notices(notices: DataFrame, located: DataFrame, asked: DataFrame) -> DataFrame:
    """Located quantities answer rejection notices and new requests answer returned ones, oldest first; one that is fully answered is resolved."""
    answers = located.select("line_id", F.lit("REJECTED").alias("kind"), F.col("located").alias("answer")).union(asked.select("line_id", F.lit("RETURNED"), "asked"))
    rows = notices.filter("active").join(answers, ["line_id", "kind"])
    taken = rows.withColumn("taken", take(F.col("qty_notified"), F.col("answer"), ["line_id", "kind"], ["raised_at", "id"])).filter("taken > 0")
    return taken.select("id", "line_id", "kind", F.col("taken").cast("double").alias("taken"), F.when(F.col("taken") >= F.col("qty_notified"), "Resolved").otherwise("Active").alias("status"))


def resubmit_returned(requests: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(line_id, asked) absorbs returned requests oldest first: a fully covered one revives; what is left is a new request."""
    rows = requests.filter("active and status = 'Returned for Review'").join(asked, "line_id")
    taken = rows.withColumn("taken", take(F.col("qty_pending"), F.col("asked"), ["line_id"], ["reported_at", "id"]))
    out = taken.groupBy("line_id", "asked").agg(F.count_if(F.col("taken") >= F.col("qty_pending")).alias("revived"), F.sum("qty_pending").alias("covered"))
    return out.select("line_id", "revived", F.greatest(F.lit(0).cast("decimal(14,4)"), F.col("asked") - F.col("covered")).cast("double").alias("new_request"))


def resubmit_requests(requests: DataFrame, asked: DataFrame) -> DataFrame:
    """The request rows of the same: returned ones that are answered (one that is wholly covered waits for the office again, a partly covered one stays returned), and a new one for what is left (no id yet)."""
    rows = requests.filter("active and status = 'Returned for Review' and qty_pending > 0").join(asked, "line_id")
    taken = rows.withColumn("applied", take(F.col("qty_pending"), F.col("asked"), ["line_id"], ["reported_at", "id"])).filter("applied > 0")
    revives = F.col("applied") >= F.col("qty_pending")
    answered = taken.select("line_id", "id", F.col("applied").cast("double").alias("applied"), F.col("qty_pending").cast("double").alias("qty_pending"), F.when(revives, "Pending").otherwise("Returned for Review").alias("status"))
    absorbed = taken.groupBy("line_id").agg(F.sum("applied").alias("absorbed"))
    left = asked.join(absorbed, "line_id", "left").withColumn("rest", F.col("asked") - F.coalesce("absorbed", F.lit(0))).filter("rest > 0")
    fresh = left.select("line_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("applied"), F.col("rest").cast("double").alias("qty_pending"), F.lit("Pending").alias("status"))
    return answered.union(fresh)
