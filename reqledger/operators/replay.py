"""Replay of the movement log. A refused command changes nothing, so a line's commands are folded in order; the fold is one aggregate expression over the line's sorted log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Q = "decimal(14,4)"
STATE = ("located", "available", "bagged", "issued", "pending")
#: Deltas of each action on the buckets, by accepted quantity (fixed values); BAG draws on stock first and finds the rest.
DELTAS = {"CONFIRM_AVAILABLE": (1, 1, 0, 0, 0), "DIRECT_ISSUE": (1, 0, 0, 1, 0), "ISSUE_FROM_AVAILABLE": (0, -1, 0, 1, 0), "BACKORDER_REQUESTED": (0, 0, 0, 0, 1)}


def _step(requested: Column):
    def step(s: Column, c: Column) -> Column:
        q, zero = c["quantity"], F.lit(0).cast(Q)
        floor0 = lambda x: F.greatest(zero, x)
        remaining = floor0(requested - s["issued"])
        locatable = floor0(F.least(floor0(requested - s["located"]), remaining) - s["pending"])
        limit = (
            F.when(c["action"] == "CONFIRM_AVAILABLE", locatable).when(c["action"] == "BAG", floor0(s["available"] + locatable)).when(c["action"] == "DIRECT_ISSUE", F.least(locatable, remaining))
            .when(c["action"] == "ISSUE_FROM_AVAILABLE", F.least(s["available"], remaining)).otherwise(floor0(remaining - s["available"] - s["bagged"] - s["pending"]))
        )
        ok = (q > 0) & (q <= limit)
        fresh = floor0(q - s["available"])
        out = []
        for i, name in enumerate(STATE):
            change = F.lit(0).cast(Q)
            for action, d in DELTAS.items():
                change = F.when(c["action"] == action, q * d[i]).otherwise(change)
            bag = {"located": fresh, "available": fresh - q, "bagged": q}.get(name, F.lit(0).cast(Q))
            change = F.when(c["action"] == "BAG", bag).otherwise(change)
            out.append(F.when(ok, s[name] + change).otherwise(s[name]).cast(Q).alias(name))
        return F.struct(*out, (s["accepted"] + ok.cast("long")).alias("accepted"), (s["refused"] + (~ok).cast("long")).alias("refused"))

    return step


def replay_ledger(movements: DataFrame, requested: float = 1000) -> DataFrame:
    """State of each line after its log, with the numbers of accepted and refused commands.

    Memory is bounded by one line's log (three short fields for each command)."""
    log = movements.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "action", "quantity"))).alias("log"))
    begin = F.struct(*[F.lit(0).cast(Q).alias(n) for n in STATE], F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("refused"))
    folded = log.select("line_id", F.aggregate("log", begin, _step(F.lit(requested).cast(Q))).alias("s"))
    return folded.select("line_id", *[F.col(f"s.{n}").cast("double").alias(n) for n in STATE], "s.accepted", "s.refused")


def bucket_sums(movements: DataFrame) -> DataFrame:
    """Sums of signed movements by line and bucket, exact, and the number of commands; sums of parts add up to the sums of the whole."""
    change = lambda i: F.sum(sum((F.when(F.col("action") == a, F.col("quantity") * d[i]).otherwise(0) for a, d in DELTAS.items()), F.lit(0)))
    bagged = F.sum(F.when(F.col("action") == "BAG", F.col("quantity")).otherwise(0))
    return movements.groupBy("line_id").agg(*[change(i).cast("decimal(28,4)").alias(n) for i, n in enumerate(STATE) if n != "bagged"], bagged.cast("decimal(28,4)").alias("bagged"), F.count("*").alias("commands"))


def told_sums(sums: DataFrame) -> DataFrame:
    return sums.withColumns({n: F.col(n).cast("double") for n in STATE})


def ledger_balance(movements: DataFrame) -> DataFrame:
    """What the log alone says of each bucket, whatever the order."""
    return told_sums(bucket_sums(movements))


def state_as_of(movements: DataFrame, when: str) -> DataFrame:
    """Issued and pending totals of each line by the log up to a time."""
    past = movements.filter(F.col("ts") <= F.expr(f"timestamp_ntz '{when}'"))
    issued = F.when(F.col("action").isin("DIRECT_ISSUE", "ISSUE_FROM_AVAILABLE"), F.col("quantity")).otherwise(0)
    return past.groupBy("line_id").agg(F.sum(issued).cast("double").alias("issued"), F.sum(F.when(F.col("action") == "BACKORDER_REQUESTED", F.col("quantity")).otherwise(0)).cast("double").alias("pending"), F.max("id").alias("last_id"))


def line_history(movements: DataFrame, customers: DataFrame) -> DataFrame:
    """The log with names of users, each line's newest first."""
    named = movements.join(customers.select(F.col("c_custkey").alias("line_id"), F.col("c_name").alias("user_name")), "line_id", "left")
    order = Window.partitionBy("line_id").orderBy(F.desc("ts"), F.desc("id"))
    return named.select("line_id", "id", "action", F.col("quantity").cast("double").alias("quantity"), F.coalesce("user_name", F.lit("unknown")).alias("user_name"), F.row_number().over(order).alias("place"))


def decide_backorders(requests: DataFrame) -> DataFrame:
    """Office decisions by rule of id: confirm all, confirm half (the rest stays pending), reject, or return; with the ledger deltas."""
    rows = requests.filter("active and status = 'Pending'").withColumn("decision", F.element_at(F.array(*map(F.lit, ("CONFIRM", "CONFIRM_HALF", "REJECT", "RETURN"))), (F.col("line_id") % 4 + 1).cast("int")))
    half = F.floor(F.col("qty_pending") / 2).cast(Q)
    confirm = F.when(F.col("decision") == "CONFIRM", F.col("qty_pending")).when(F.col("decision") == "CONFIRM_HALF", half).otherwise(F.lit(0).cast(Q))
    left = F.when(F.col("decision").isin("REJECT", "RETURN"), F.lit(0).cast(Q)).otherwise(F.col("qty_pending") - confirm)
    status = F.when(F.col("decision") == "REJECT", "Rejected").when(F.col("decision") == "RETURN", "Returned for Review").when(left > 0, "Partially Confirmed").otherwise("Confirmed")
    return rows.select("id", "decision", status.alias("status"), confirm.cast("double").alias("confirmed_delta"), (left - F.col("qty_pending")).cast("double").alias("pending_delta"))
