"""Drafts on their way to publication: replay of the approval chain, lines grouped into drafts, their issues and staging status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Every move of the approval chain: the states it may start from, and the state it leads to (fixed values).
MOVES = {
    "SUBMIT": (("DRAFT", "PLANNER_RETURNED"), "PENDING_PLANNER_REVIEW"), "PLANNER_APPROVE": (("PENDING_PLANNER_REVIEW",), "PLANNER_APPROVED"),
    "PLANNER_RETURN": (("PENDING_PLANNER_REVIEW",), "PLANNER_RETURNED"), "SEND_TO_MATERIAL": (("PLANNER_APPROVED",), "PENDING_MATERIAL_MANAGER"),
    "ASSIGN_NUMBER": (("PENDING_MATERIAL_MANAGER", "NUMBER_ASSIGNED"), "NUMBER_ASSIGNED"), "PUBLISH": (("NUMBER_ASSIGNED",), "PUBLISHED"),
}
REFUSALS = ("FORBIDDEN", "BAD_STATE", "MISSING_REASON")
#: Issues of a draft line that block it; the others are warnings (fixed values).
ERRORS = ("NO_SHEET", "BAD_QUANTITY", "ZERO_QUANTITY")
READABLE_SIZE = r'^[\d\-/]+"?(x[\d\-/]+"?)?$'


def _next_state(state: Column, action: Column) -> Column:
    pairs = [F.lit(x) for move, (sources, to) in MOVES.items() for s in sources for x in (f"{move}@{s}", to)]
    return F.try_element_at(F.create_map(*pairs), F.concat(action, F.lit("@"), state))


def _step(s: Column, c: Column) -> Column:
    to = _next_state(s["state"], c["action"])
    short = (c["action"] == "PLANNER_RETURN") & (F.length(F.trim(F.coalesce(c["reason"], F.lit("")))) < 3)
    code = F.when(~c["allowed"], "FORBIDDEN").when(to.isNull(), "BAD_STATE").when(short, "MISSING_REASON").otherwise("")
    counts = [(s[k.lower()] + (code == k).cast("long")).alias(k.lower()) for k in REFUSALS]
    return F.struct(F.when(code == "", to).otherwise(s["state"]).alias("state"), (s["accepted"] + (code == "").cast("long")).alias("accepted"), *counts)


def replay_workflow(transitions: DataFrame) -> DataFrame:
    """State of each draft after its moves in order, with accepted moves and refusals by reason; a refused move changes nothing.

    Memory is bounded by one draft's moves."""
    log = transitions.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "action", "allowed", "reason"))).alias("log"))
    begin = F.struct(F.lit("DRAFT").alias("state"), *[F.lit(0).cast("long").alias(k) for k in ("accepted", *map(str.lower, REFUSALS))])
    return log.select("draft_id", F.aggregate("log", begin, _step).alias("s")).select("draft_id", "s.*")


def group_extracted(materials: DataFrame) -> DataFrame:
    """Normalised rows as lines of one draft for each drawing, numbered in order of id, with their issues; rows without a drawing go."""
    found = {"NO_SHEET": F.col("sheet").isNull(), "BAD_QUANTITY": F.col("quantity").isNull(), "ZERO_QUANTITY": F.col("quantity") <= 0, "ODD_SIZE": ~F.col("size").rlike(READABLE_SIZE)}
    issues = F.array_join(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]), lambda x: x.isNotNull()), ",")
    number = F.row_number().over(Window.partitionBy("drawing").orderBy("part_id"))
    return materials.filter("drawing is not null").select("drawing", "part_id", number.alias("line_number"), issues.alias("issues"))


def stage_status(lines: DataFrame) -> DataFrame:
    """Lines, errors and warnings of each draft; one with an error is blocked."""
    codes = F.filter(F.split("issues", ","), lambda x: x != "")
    errors = F.size(F.filter(codes, lambda x: x.isin(*ERRORS)))
    out = lines.select("drawing", errors.alias("e"), (F.size(codes) - errors).alias("w")).groupBy("drawing").agg(F.count("*").alias("line_count"), F.sum("e").alias("errors"), F.sum("w").alias("warnings"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "Blocked").otherwise("Ready"))


def next_numbers(requisitions: DataFrame) -> DataFrame:
    """The next requisition number of each project: one above its largest whole number, or 1."""
    largest = F.max(F.when(F.col("req_number").rlike("^[0-9]+$"), F.col("req_number").try_cast("long")))
    return requisitions.groupBy("project_id").agg((F.coalesce(largest, F.lit(0)) + 1).cast("long").alias("next_number"))


def package_numbers(requisitions: DataFrame) -> DataFrame:
    """Whether the requisitions of a project's day name one package, several or none."""
    out = requisitions.groupBy("project_id", "date_required").agg(F.countDistinct("iwp_number").alias("candidates"), F.min("iwp_number").alias("first"))
    fate = F.when(F.col("candidates") == 0, "missing").when(F.col("candidates") == 1, "unique").otherwise("multiple")
    return out.select("project_id", "date_required", "candidates", fate.alias("fate"), F.when(F.col("candidates") == 1, F.col("first")).alias("package_number"))


def content_hashes(lines: DataFrame) -> DataFrame:
    """SHA-256 of the drawing, its revision and its rows in order, for each requisition."""
    row = F.concat_ws("|", F.col("line_number").cast("string"), "commodity_code", "size", "description")
    rows = F.array_sort(F.collect_list(F.struct("line_number", row.alias("row"))))
    out = lines.groupBy("req_id", "iso_number", "iso_revision").agg(F.count("*").alias("rows"), rows.alias("r"))
    text = F.concat_ws("\n", F.concat_ws("|", "iso_number", "iso_revision"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"))
    return out.select("req_id", "iso_number", "iso_revision", "rows", F.sha2(text, 256).alias("content_hash"))


def reconcile_copies(pages: DataFrame) -> DataFrame:
    """Values that all copies of a drawing's revision share are common; those that only some have conflict."""
    keys = ["drawing_number", "revision"]
    copies = pages.groupBy(*keys).agg(F.countDistinct("content_hash").alias("copies"))
    held = pages.groupBy(*keys, F.col("source_path").alias("value")).agg(F.countDistinct("content_hash").alias("held_by"))
    return held.join(copies, keys).select(*keys, "value", "held_by", "copies", F.when(F.col("held_by") == F.col("copies"), "common").otherwise("conflict").alias("fate"))


def split_by_confidence(rows: DataFrame, least: float = 0.65) -> DataFrame:
    """How many rows are clean and how many need review; sinks partition by the same bucket."""
    bucket = F.when(F.col("confidence") >= least, "clean").otherwise("review")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.count_if(F.col("warnings") != "").alias("with_warnings"))
