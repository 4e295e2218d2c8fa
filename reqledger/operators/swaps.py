"""Borrowed material and corrections: what is owed and repaid, by line and by age, and what reversing a group of movements would leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered
from .replay import DELTAS, STATE
from .waterfall import take

Q = "decimal(14,4)"
#: Actions whose notes a line shows (fixed values).
NOTED = ("BAG", "DIRECT_ISSUE", "ISSUE_FROM_AVAILABLE", "BACKORDER_REQUESTED")


def _owed() -> Column:
    return F.greatest(F.lit(0).cast(Q), F.col("qty_borrowed") - F.col("qty_repaid"))


def repay_swaps(swaps: DataFrame, located: DataFrame) -> DataFrame:
    """Located quantities of a donor settle its debts oldest first, each delivery once; cancelled and settled swaps take no part."""
    owing = swaps.filter("status <> 'Cancelled'").withColumn("owed", _owed()).filter("owed > 0").join(located.withColumnRenamed("line_id", "donor_id"), "donor_id")
    rows = owing.withColumn("applied", take(F.col("owed"), F.col("located"), ["donor_id"], ["created_at", "id"])).filter("applied > 0")
    left = F.col("owed") - F.col("applied")
    return rows.select("id", "donor_id", F.col("applied").cast("double").alias("applied"), left.cast("double").alias("outstanding"), F.when(left <= 0, "Repaid").otherwise("Partially Repaid").alias("status"))


def open_swaps(swaps: DataFrame, as_of: str) -> DataFrame:
    """Swaps with something owed, with their age in whole days, each project's oldest first."""
    owing = swaps.filter("status <> 'Cancelled'").withColumn("owed", _owed()).filter("owed > 0")
    days = F.expr(f"cast(floor((unix_micros(timestamp '{as_of} UTC') - unix_micros(cast(created_at as timestamp))) / 86400000000) as bigint)")
    placed = numbered(owing, "project_id", ["created_at", "id"], "place")
    return placed.select("project_id", "id", "donor_id", "receiver_id", F.col("owed").cast("double").alias("owed"), F.greatest(F.lit(0), days).alias("age_days"), "place")


def swaps_by_line(swaps: DataFrame) -> DataFrame:
    """What each line has lent and borrowed; both roles of a swap are rows, so no join on either-or is needed."""
    roles = F.array(F.struct(F.col("donor_id").alias("line_id"), F.lit("lent").alias("role")), F.struct(F.col("receiver_id").alias("line_id"), F.lit("borrowed").alias("role")))
    rows = swaps.filter("status <> 'Cancelled'").select("qty_borrowed", F.explode(roles).alias("r"))
    part = lambda role: F.coalesce(F.sum(F.when(F.col("r.role") == role, F.col("qty_borrowed"))), F.lit(0)).cast("double").alias(role)
    return rows.groupBy("r.line_id").agg(F.count("*").alias("swaps"), part("lent"), part("borrowed"))


def correctable_history(movements: DataFrame) -> DataFrame:
    """Movements of a line's day as one group that a correction would reverse together."""
    return movements.groupBy("line_id", "day").agg(F.count("*").alias("movements"), F.sum("quantity").cast("double").alias("quantity"), F.max("id").alias("last_id"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


def plan_corrections(movements: DataFrame, requested: float = 1000) -> DataFrame:
    """For each group of movements, what its line would hold once the group is reversed, and why that is refused if it is.

    Sums by group come first; a line's state is the sum over its groups, so the log is shuffled once."""
    deltas = DELTAS | {"BAG": (0, -1, 1, 0, 0)}
    cell = lambda i: F.sum(reduce(lambda x, a: F.when(F.col("action") == a, F.col("quantity") * deltas[a][i]).otherwise(x), deltas, F.lit(0).cast(Q)))
    groups = movements.groupBy("line_id", "day").agg(*[cell(i).alias(f"d_{n}") for i, n in enumerate(STATE)])
    line = Window.partitionBy("line_id")
    after = groups.withColumns({n: F.sum(f"d_{n}").over(line) - F.col(f"d_{n}") for n in STATE})
    broken = [F.when(F.col(n) < 0, F.lit(f"{n} below zero")) for n in STATE] + [F.when(F.col(n) > requested, F.lit(f"{n} over requested")) for n in ("located", "issued")]
    return after.select("line_id", "day", *[F.col(n).cast("double").alias(n) for n in STATE], F.concat_ws("; ", *broken).alias("refused_because"))


def field_notes(movements: DataFrame, backorders: DataFrame, most: int = 20) -> DataFrame:
    """The newest notes of each line from movements and requests, with how many there are and whether the list is cut."""
    moved = movements.filter(F.col("action").isin(*NOTED)).select("line_id", "ts", "id", F.col("action").alias("note"))
    asked = backorders.select("line_id", F.col("reported_at").alias("ts"), "id", F.col("status").alias("note"))
    line = Window.partitionBy("line_id")
    rows = moved.unionByName(asked).withColumns({"place": F.row_number().over(line.orderBy(F.desc("ts"), F.desc("id"), "note")), "notes": F.count("*").over(line)}).filter(F.col("place") <= most)
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", F.col("id").cast("string"), "note").alias("text"))))
    out = rows.groupBy("line_id", "notes").agg(listed.alias("l"))
    return out.select("line_id", "notes", (F.col("notes") > most).alias("truncated"), F.array_join(F.transform("l", lambda x: x["text"]), ",").alias("listed"))


def bag_closure(items: DataFrame) -> DataFrame:
    """A bag stays active while any of its items is active and holds something."""
    live = F.bool_or(F.col("active") & (F.col("qty_remaining") > 0))
    return items.groupBy("bag_id").agg(F.count("*").alias("items"), F.when(live, "Active").otherwise("Closed").alias("status"))
