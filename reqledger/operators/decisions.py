"""Notices that decisions raise, pairs of lines that may lend, draft validation, numbering and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from .order import numbered

# Notice texts, refusal texts and issue codes.
REJECTED, RETURNED, CONFIRMED = " rejected — source it on site", " returned — more detail needed", " confirmed — on order"
NO_CODE, OTHER_CODE, OTHER_SIZE, OTHER_UNIT = "no commodity code to match on", "a different commodity code", "a different size", "a different unit of measure"
ERRORS = ("NO_FMR_NUMBER", "NO_ISO", "NO_SHEET", "NO_LINES", "NO_DESCRIPTION", "BAD_QUANTITY", "ZERO_QUANTITY")
READABLE_SIZE = r'^[\d\-/]+"?(x[\d\-/]+"?)?$'


def raise_notices(decided: DataFrame) -> DataFrame:
    """One notice for each line, request and kind that decisions call for: quantities add up, the latest text holds. A full confirmation and an empty decision raise none."""
    kind = F.when(F.col("decision") == "REJECT", "REJECTED").when(F.col("decision") == "RETURN", "RETURNED").when((F.col("decision") == "CONFIRM") & ~F.col("whole"), "CONFIRMED")
    rows = decided.withColumn("kind", kind).filter("kind is not null and quantity > 0")
    total = rows.groupBy("line_id", "request_id", "kind").agg(F.sum("quantity").alias("quantity"), F.max_by("uom", F.struct("ts", "id")).alias("uom"), F.max_by("notes", F.struct("ts", "id")).alias("notes"))
    severity = F.when(F.col("kind") == "REJECTED", "critical").when(F.col("kind") == "RETURNED", "warning").otherwise("info")
    told = F.when(F.col("kind") == "REJECTED", REJECTED).when(F.col("kind") == "RETURNED", RETURNED).otherwise(CONFIRMED)
    amount = F.concat(F.col("quantity").cast("long").cast("string"), F.lit(" "), F.col("uom"))
    return total.select("line_id", "request_id", "kind", severity.alias("severity"), F.col("quantity").cast("double").alias("quantity"), F.concat(amount, told).alias("headline"), "notes")


def incompatible(donor: Column, receiver: Column) -> Column:
    """Why a donor cannot lend to a receiver, the first reason in order; null where it can. Both are structs of code, size and unit."""

    def key(side: Column, name: str) -> Column:
        return F.upper(F.trim(F.coalesce(side[name], F.lit(""))))

    return (
        F.when(key(donor, "commodity_code") == "", NO_CODE).when(key(donor, "commodity_code") != key(receiver, "commodity_code"), OTHER_CODE)
        .when(key(donor, "size") != key(receiver, "size"), OTHER_SIZE).when(key(donor, "uom") != key(receiver, "uom"), OTHER_UNIT)
    )


def refusals(pairs: DataFrame) -> DataFrame:
    """The reason of each pair; pairs has donor and receiver as structs."""
    return pairs.select(F.col("donor.line_id").alias("donor_id"), F.col("receiver.line_id").alias("receiver_id"), incompatible(F.col("donor"), F.col("receiver")).alias("reason"))


def neighbours(lines: DataFrame) -> DataFrame:
    """Each line of a requisition as donor, with the next one as receiver."""
    side = lines.select("req_id", "line_number", F.struct("line_id", "commodity_code", "size", "uom").alias("donor"))
    after = side.select("req_id", (F.col("line_number") - 1).alias("line_number"), F.col("donor").alias("receiver"))
    return side.join(after, ["req_id", "line_number"])


def validate_drafts(drafts: DataFrame, lines: DataFrame, strict: bool = True) -> DataFrame:
    """(draft_id, line_number, code, severity), a row for each broken rule of a draft (line 0) and of its lines."""
    present = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    counted = drafts.join(lines.groupBy("draft_id").agg(F.count("*").alias("n")), "draft_id", "left")
    head = {"NO_FMR_NUMBER": ~present("number") & F.lit(strict), "NO_IWP": ~present("iwp"), "NO_ISO": N.drawing(F.col("raw_drawing")).isNull(), "NO_SHEET": N.sheet(F.col("raw_sheet")).isNull(), "NO_LINES": F.col("n").isNull()}
    quantity, size = N.quantity(F.col("raw_quantity")), N.size(F.col("raw_size"))
    body = {"NO_DESCRIPTION": ~present("description"), "BAD_QUANTITY": quantity.isNull(), "ZERO_QUANTITY": quantity <= 0, "ODD_SIZE": present("raw_size") & ~size.rlike(READABLE_SIZE)}
    broken = lambda rules: F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())).alias("code")
    found = counted.select("draft_id", F.lit(0).alias("line_number"), broken(head)).union(lines.select("draft_id", "line_number", broken(body)))
    return found.withColumn("severity", F.when(F.col("code").isin(*ERRORS), "error").otherwise("warning"))


#: States of a draft that may be given a number (fixed values).
NUMBERED_FROM = ("PENDING_MATERIAL_MANAGER", "NUMBER_ASSIGNED")


def assign_numbers(drafts: DataFrame, published: DataFrame) -> DataFrame:
    """The number that each draft that may have one gets. A typed number holds unless it is published in the project or an earlier draft there typed it too, whatever the case;
    drafts without one get consecutive numbers, in order of id, after the highest that the project has published or that is typed."""
    typed = F.upper(F.trim(F.coalesce("number", F.lit(""))))
    waiting = drafts.filter(F.col("state").isin(*NUMBERED_FROM) & ~F.col("archived")).select("draft_id", "project_id", typed.alias("typed"))
    taken = published.select("project_id", F.upper(F.trim("number")).alias("typed")).distinct().withColumn("taken", F.lit(True))
    first = waiting.filter("typed <> ''").groupBy("project_id", "typed").agg(F.min("draft_id").alias("first"))
    asked = waiting.filter("typed <> ''").join(first, ["project_id", "typed"]).join(taken, ["project_id", "typed"], "left")
    code = F.when(F.col("taken") | (F.col("draft_id") != F.col("first")), "NUMBER_IN_USE").otherwise("OK")
    held = asked.select("draft_id", "project_id", code.alias("code"), F.when(code == "OK", F.col("typed")).alias("assigned"))
    numbers = taken.select("project_id", "typed").union(waiting.select("project_id", "typed")).filter(F.col("typed").rlike("^[0-9]+$"))
    highest = numbers.groupBy("project_id").agg(F.max(F.col("typed").cast("long")).alias("highest"))
    placed = numbered(waiting.filter("typed = ''"), "project_id", ["draft_id"], "place").join(highest, "project_id", "left")
    return held.union(placed.select("draft_id", "project_id", F.lit("OK"), (F.coalesce("highest", F.lit(0)) + F.col("place")).cast("long").cast("string")))


def publishable(drafts: DataFrame, issues: DataFrame, lines: DataFrame) -> DataFrame:
    """Requisitions that publishing makes: selected drafts with a number, not archived, without an error in their batch; with the count of their lines."""
    blocked = issues.filter("severity = 'error'").join(drafts.select("draft_id", "batch_id"), "draft_id").select("batch_id").distinct()
    ready = drafts.filter("selected and not archived and state = 'NUMBER_ASSIGNED'").join(blocked, "batch_id", "left_anti")
    counts = lines.groupBy("draft_id").agg(F.count("*").alias("line_count"))
    return ready.join(counts, "draft_id").select(F.sha2(F.concat_ws("|", "project_id", F.col("draft_id").cast("string")), 256).alias("req_key"), "draft_id", "project_id", "batch_id", "line_count")
