"""Imports before they are published: batches and their items, issues and counts, the review queue, what is staged already, line numbers, profiles, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Each move of the approval chain with the states it leads from and the permission it takes; profiles that every project has.
TRANSITIONS = (
    ("SUBMIT", ("DRAFT", "PLANNER_RETURNED"), "owner_edit"), ("PLANNER_APPROVE", ("PENDING_PLANNER_REVIEW",), "plan_review"), ("PLANNER_RETURN", ("PENDING_PLANNER_REVIEW",), "plan_review"),
    ("SEND_TO_MATERIAL", ("PLANNER_APPROVED",), "plan_review"), ("ASSIGN_NUMBER", ("PENDING_MATERIAL_MANAGER", "NUMBER_ASSIGNED"), "assign_number"), ("PUBLISH", ("NUMBER_ASSIGNED",), "assign_number"),
)
BUILT_IN = ("default", "extracted", "takeoff")
#: A description longer than this overruns its cell.
CELL = 52


def _severity(name: str, alias: str, open_only: bool) -> Column:
    held = F.col("severity") == name
    return F.count_if(held & ~F.col("resolved") if open_only else held).alias(alias)


def issue_counts(issues: DataFrame, *keys: str, open_only: bool = True) -> DataFrame:
    return issues.groupBy(*keys).agg(_severity("error", "errors", open_only), _severity("warning", "warnings", open_only))


def _sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("draft_id").agg(F.count("*").alias("lines"), F.count_if(F.length("description") > CELL).alias("overflow"))


def review_queue(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Each open item once for each permission that can act on it, with the moves that are possible and its lines, counted and listed.
    Reviewers are not joined in: a reviewer reads the rows of their permissions, so the table grows with items only."""
    moves = F.array(*[F.struct(F.lit(a).alias("action"), F.array(*map(F.lit, sources)).alias("sources"), F.lit(p).alias("permission")) for a, sources, p in TRANSITIONS])
    waiting = items.filter("not archived and not published and state <> 'PUBLISHED'")
    possible = waiting.select("draft_id", "project_id", "state", F.explode(F.filter(moves, lambda m: F.array_contains(m["sources"], F.col("state")))).alias("m"))
    rows = possible.groupBy("draft_id", "project_id", "state", F.col("m.permission").alias("permission")).agg(F.array_join(F.array_sort(F.collect_set("m.action")), ",").alias("actions"))
    listed = lines.groupBy("draft_id").agg(F.count("*").alias("line_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "raw_quantity"))), lambda x: F.concat_ws("x", x["line_number"].cast("string"), x["raw_quantity"])), ",").alias("listed"))
    return rows.join(listed, "draft_id", "left").select("draft_id", "project_id", "state", "permission", "actions", F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("listed", F.lit("")).alias("listed"))


def review_counts(queue: DataFrame, members: DataFrame) -> DataFrame:
    """How many items wait for each active member. The queue is counted by project and permission (a short table) before members meet it."""
    waiting = queue.groupBy("project_id", "permission").agg(F.count("*").alias("n"))
    holds = F.filter(F.array(*[F.when(F.col(p), F.lit(p)) for p in ("owner_edit", "plan_review", "assign_number")]), lambda x: x.isNotNull())
    held = members.filter("active").select("user_id", "project_id", F.explode_outer(holds).alias("permission"))
    return held.join(waiting, ["project_id", "permission"], "left").groupBy("user_id", "project_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("waiting"))


def draft_list(batches: DataFrame, items: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """Unpublished batches with their items. Counts are the item's own; where it has none of a kind, the batch's stand in."""
    own = items.select("batch_id", "draft_id").join(_sizes(lines).select("draft_id", "lines"), "draft_id", "left").join(issue_counts(issues, "draft_id"), "draft_id", "left")
    rows = batches.filter("not published").join(own, "batch_id", "left")
    return rows.select("batch_id", "draft_id", "source", "archived", F.coalesce("lines", "line_count").alias("line_count"), F.coalesce("errors", "error_count").alias("error_count"), F.coalesce("warnings", "warning_count").alias("warning_count"))


def batch_counts(items: DataFrame, lines: DataFrame, issues: DataFrame, open_only: bool) -> DataFrame:
    """Sheets, lines, errors and warnings of each batch. Lines and issues are counted by item first, so neither multiplies the other."""
    each = items.select("batch_id", "draft_id").join(_sizes(lines), "draft_id", "left").join(issue_counts(issues, "draft_id", open_only=open_only), "draft_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.groupBy("batch_id").agg(F.count("*").alias("sheets"), total("lines"), total("errors"), total("warnings"), total("overflow"))


def batch_recount(items: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    return batch_counts(items, lines, issues, True).drop("overflow")


def staging_summary(items: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """What an import tells when it is read: all issues, resolved or not."""
    return batch_counts(items, lines, issues, False).drop("overflow")


def package_summary(items: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """staging_summary with the distinct lines that need a look and the descriptions that overrun their cell."""
    look = items.select("batch_id", "draft_id").join(issues.filter("line_number is not null").select("draft_id", "line_number").distinct(), "draft_id").groupBy("batch_id").agg(F.count("*").alias("lines_to_check"))
    return batch_counts(items, lines, issues, False).join(look, "batch_id", "left").na.fill(0, ["lines_to_check"])


def batch_review(items: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each item of a batch, with its lines and its issues listed in order."""
    by_line = lines.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "description"))).alias("l"))
    by_issue = issues.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "code"))).alias("i"))
    joined = items.select("batch_id", "draft_id").join(by_line, "draft_id", "left").join(by_issue, "draft_id", "left")
    told = lambda rows, field: F.coalesce(F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["line_number"].cast("string"), x[field])), ","), F.lit(""))
    return joined.select("batch_id", "draft_id", told("l", "description").alias("lines"), told("i", "code").alias("issues"))


def existing_or_staged(incoming: DataFrame, published: DataFrame, waiting: DataFrame) -> DataFrame:
    """Sheets that come in with a number: which requisition has it already, and whether an item waits under it in any case of letters
    or an earlier sheet of this import has it. A number that waits is dropped from the sheet; the sheet stays."""
    known = published.select("project_id", F.col("req_number").alias("number"), F.col("req_id").alias("existing_req_id"))
    staged = waiting.filter("number is not null and not published and not archived").select("project_id", F.upper("number").alias("upper_")).distinct().withColumn("staged", F.lit(True))
    again = F.row_number().over(Window.partitionBy("project_id", "upper_").orderBy("draft_id")) > 1
    rows = incoming.withColumn("upper_", F.upper("number")).withColumn("again", F.col("number").isNotNull() & again)
    out = rows.join(known, ["project_id", "number"], "left").join(staged, ["project_id", "upper_"], "left").withColumn("waiting_already", F.coalesce("staged", F.lit(False)) | F.col("again"))
    return out.select("draft_id", "project_id", "existing_req_id", "waiting_already", F.when(~F.col("waiting_already"), F.col("number")).alias("number"))


def renumber_lines(lines: DataFrame) -> DataFrame:
    """Line numbers of each draft without gaps, in their order."""
    place = F.row_number().over(Window.partitionBy("draft_id").orderBy("line_number"))
    return lines.select("draft_id", F.col("line_number").alias("old_number"), place.cast("long").alias("new_number"))


def profiles(projects: DataFrame, owned: DataFrame) -> DataFrame:
    """The profiles that a project can use: its own, and the built-in ones whose name it has not taken."""
    shipped = projects.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, BUILT_IN))).alias("name"))
    taken = owned.select(F.col("project_id"), F.lower("name").alias("name"))
    return owned.select("project_id", "name", F.lit(False).alias("built_in")).union(shipped.join(taken, ["project_id", "name"], "left_anti").select("project_id", "name", F.lit(True)))


def upsert(stored: DataFrame, arrived: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """stored with the rows of arrived put in or over those of the same keys; of several arrivals the last by order holds.
    One aggregation by key: arrivals are combined before the shuffle and no row is joined."""
    rest = [c for c in stored.columns if c not in keys]
    mark = lambda df, fresh: df.select(*keys, F.struct(F.lit(fresh).alias("fresh_"), *[F.col(c) for c in order]).alias("at_"), F.struct(*rest).alias("row_"))
    return mark(stored, 0).union(mark(arrived, 1)).groupBy(*keys).agg(F.max_by("row_", "at_").alias("row_")).select(*keys, "row_.*")
