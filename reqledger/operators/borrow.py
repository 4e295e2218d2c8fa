"""Borrowing between lines: a batch of requests decided in order, where donors run out and receivers fill up.

What one request takes decides what the next may have, on both sides, so requests that compete are decided one after the other. Most do not compete: a line that can
serve all that is asked of it, and needs all that is asked for it, refuses nothing whatever the order. A donor and its receiver are of one material, so requests of different materials never meet:
a material's requests are folded in order with the balances of their lines as state. Of a material with more than LARGE requests only the contended lines tie requests together, and the components of that
smaller graph are folded instead."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import derive
from ..sources.written import written
from .components import components
from .decisions import incompatible
from .fold import folded

UNIT = 10_000
#: Requests of a material that one fold takes, which bounds its state.
LARGE = 200_000


def _needs() -> Column:
    """What a line still needs beyond its shelf and bags; below zero where it has more than it needs, as what it lends then is not missed."""
    return derive.remaining() - F.col("qty_available") - F.col("qty_active_bagged")


def _step(state: dict, r: dict) -> Iterator[dict]:
    """Balances are (on the shelf, still needed) by contended line; others are taken from the row, as no order changes their answer."""
    donor = state.setdefault(r["donor_id"], [r["shelf"], r["donor_needs"]]) if r["donor_tied"] else [r["shelf"], 0]
    receiver = state.setdefault(r["receiver_id"], [r["receiver_shelf"], r["needs"]]) if r["receiver_tied"] else [0, r["needs"]]
    q = r["quantity"]
    if donor[0] <= 0:
        code = "NOTHING_TO_LEND"
    elif q > donor[0]:
        code = "LIMIT_EXCEEDED"
    elif receiver[1] <= 0:
        code = "NOT_SHORT"
    elif q > receiver[1]:
        code = "LIMIT_EXCEEDED"
    else:
        code = "OK"
        # What a line lends it needs again; what it borrows is issued at once.
        donor[0], donor[1], receiver[1] = donor[0] - q, donor[1] + q, receiver[1] - q
    yield {"id": r["id"], "donor_id": r["donor_id"], "receiver_id": r["receiver_id"], "quantity": r["given"], "code": code}


def plan_swaps(requests: DataFrame, lines: DataFrame, large: int = LARGE) -> DataFrame:
    """Each request (id, asked_at, donor_id, receiver_id, quantity) with OK or the code of its refusal, in order of asked_at and id.

    Requests of unknown lines are refused with NOT_FOUND. Null quantities count as zero."""
    sides = lines.select("line_id", F.struct("commodity_code", "size", "uom").alias("of"), F.col("qty_available").alias("shelf"), _needs().alias("needs"))
    side = lambda role: sides.select(F.col("line_id").alias(f"{role}_id"), F.struct("of", "shelf", "needs").alias(role))
    named = requests.select("id", "asked_at", "donor_id", "receiver_id", F.col("quantity").alias("given"), F.coalesce("quantity", F.lit(0)).alias("quantity")).join(side("donor"), "donor_id", "left").join(side("receiver"), "receiver_id", "left")
    code = F.when(F.col("donor").isNull() | F.col("receiver").isNull(), "NOT_FOUND").when(F.col("quantity") <= 0, "LEDGER_RULE").when(F.col("donor_id") == F.col("receiver_id"), "SAME_LINE").when(incompatible(F.col("donor.of"), F.col("receiver.of")).isNotNull(), "INCOMPATIBLE")
    judged = written(named.withColumn("code", code), "requests")
    material = F.to_json(F.struct(*[F.upper(F.trim(F.coalesce(F.col(f"donor.of.{c}"), F.lit("")))).alias(c) for c in ("commodity_code", "size", "uom")]))
    asked = judged.filter("code is null").withColumn("material", material)
    big = written(asked.groupBy("material").count().filter(F.col("count") > large).select("material"), "materials")
    if big.isEmpty():
        rows = _rows(_whole(asked))
    else:
        rows = _rows(_whole(asked.join(big, "material", "left_anti"))).union(_rows(_parted(asked.join(big, "material", "left_semi"), sides)))
    out = StructType([*requests.select("id", "donor_id", "receiver_id", "quantity").schema.fields, StructField("code", StringType())])
    decided = folded(rows, "group", ["asked_at", "id"], out, lambda _: {}, _step, lambda _: iter(()))
    return judged.filter("code is not null").select("id", "donor_id", "receiver_id", F.col("given").alias("quantity"), "code").union(decided)


def _whole(asked: DataFrame) -> DataFrame:
    """Every request in the group of its material."""
    return asked.withColumns({"donor_tied": F.lit(True), "receiver_tied": F.lit(True), "group": F.concat(F.lit("m"), "material")})


def _parted(asked: DataFrame, sides: DataFrame) -> DataFrame:
    """Every request in the group of its component of contended lines; those that meet no contended line are groups of their own."""
    # A line is contended if more is asked of it, or for it, than it could give or take at the start; both roles count.
    roles = F.explode(F.array(F.struct(F.col("donor_id").alias("line_id"), F.col("quantity").alias("out"), F.lit(0).cast("decimal(14,4)").alias("into")), F.struct(F.col("receiver_id").alias("line_id"), F.lit(0).cast("decimal(14,4)").alias("out"), F.col("quantity").alias("into"))))
    demand = asked.select(roles.alias("r")).groupBy("r.line_id").agg(F.sum("r.out").alias("out"), F.sum("r.into").alias("into"))
    tied = demand.join(sides, "line_id").filter("out > shelf or into > needs").select("line_id", F.lit(True).alias("tied"))
    both = written(asked.join(tied.select(F.col("line_id").alias("donor_id"), F.col("tied").alias("donor_tied")), "donor_id", "left").join(tied.select(F.col("line_id").alias("receiver_id"), F.col("tied").alias("receiver_tied")), "receiver_id", "left").fillna(False, ["donor_tied", "receiver_tied"]), "asked")
    edges = both.filter("donor_tied or receiver_tied").select(F.when(F.col("donor_tied"), F.col("donor_id")).otherwise(F.col("receiver_id")).alias("a"), F.when(F.col("receiver_tied"), F.col("receiver_id")).otherwise(F.col("donor_id")).alias("b"))
    group = components(edges)
    keyed = both.withColumn("node", F.when(F.col("donor_tied"), F.col("donor_id")).when(F.col("receiver_tied"), F.col("receiver_id"))).join(group, "node", "left")
    return keyed.withColumn("group", F.when(F.col("component").isNull(), F.concat(F.lit("r"), "id")).otherwise(F.concat(F.lit("c"), "component")))


def _rows(grouped: DataFrame) -> DataFrame:
    units = lambda c: F.round(F.col(c) * UNIT).cast("long")
    return grouped.select("id", "asked_at", "donor_id", "receiver_id", "given", units("quantity").alias("quantity"), units("donor.shelf").alias("shelf"), units("donor.needs").alias("donor_needs"), units("receiver.shelf").alias("receiver_shelf"), units("receiver.needs").alias("needs"), "donor_tied", "receiver_tied", "group")


def movements(swaps: DataFrame) -> DataFrame:
    """The two movements of each accepted request."""
    pair = F.array(F.struct(F.col("donor_id").alias("line_id"), F.lit("SWAP_LENT").alias("action"), (-F.col("quantity")).alias("quantity")), F.struct(F.col("receiver_id").alias("line_id"), F.lit("SWAP_BORROWED").alias("action"), F.col("quantity").alias("quantity")))
    return swaps.filter("code = 'OK'").select("id", F.explode(pair).alias("m")).select("id", "m.line_id", "m.action", F.col("m.quantity").cast("double").alias("quantity"))


def after(swaps: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines that lent or borrowed as they are afterwards."""
    moved = movements(swaps).groupBy("line_id").agg(*[F.coalesce(F.sum(F.when(F.col("action") == a, F.abs("quantity"))), F.lit(0)).cast("decimal(14,4)").alias(n) for a, n in (("SWAP_LENT", "lent"), ("SWAP_BORROWED", "borrowed"))])
    now = lines.join(moved, "line_id").withColumns({"qty_confirmed_located": F.col("qty_confirmed_located") - F.col("lent") + F.col("borrowed"), "qty_available": F.col("qty_available") - F.col("lent"), "qty_issued": F.col("qty_issued") + F.col("borrowed")})
    return now.select("line_id", *[F.col(c).cast("double").alias(n) for c, n in (("lent", "lent"), ("borrowed", "borrowed"), ("qty_confirmed_located", "located"), ("qty_available", "available"), ("qty_issued", "issued"))], derive.line_status().alias("line_status"))
