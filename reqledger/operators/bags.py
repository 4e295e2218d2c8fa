"""Bags: the queue of active ones, duplicates, and the counters that tag numbers carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Form of the tags that the system issues (fixed value).
TAG = r"^([A-Z][A-Z0-9-]*)-(\d{4})-(\d+)$"


def tag_parts(tag: Column) -> tuple[Column, Column, Column]:
    """Prefix, year and counter of a tag; null for tags that were printed elsewhere."""
    text = F.upper(F.trim(tag))
    part = lambda i: F.when(text.rlike(TAG), F.regexp_extract(text, TAG, i))
    return part(1), part(2).cast("int"), part(3).cast("long")


def parse_tags(stock: DataFrame) -> DataFrame:
    prefix, year, counter = tag_parts(F.col("tag_number"))
    return stock.select("tag_number").distinct().select("tag_number", prefix.alias("prefix"), year.alias("year"), counter.alias("counter"))


def next_counters(stock: DataFrame) -> DataFrame:
    """The counter that each project, prefix and year goes on with; foreign tags do not count."""
    prefix, year, counter = tag_parts(F.col("tag_number"))
    known = stock.select("project_id", prefix.alias("prefix"), year.alias("year"), counter.alias("counter")).filter("prefix is not null")
    return known.groupBy("project_id", "prefix", "year").agg((F.max("counter") + 1).alias("next_counter"))


def active_queue(stock: DataFrame, lines: DataFrame, requisitions: DataFrame, as_of: str, stale_days: int = 14) -> DataFrame:
    """Bag items with something left, with line and requisition, whether they are untouched or partly issued, and whether they have waited too long."""
    named = stock.filter("active and qty_remaining > 0").join(lines.select("line_id", "line_number", "iso_number", "iso_sheet", "commodity_code"), "line_id").join(requisitions.select("req_id", "req_number", "priority"), "req_id")
    ready = F.when(F.col("qty_issued") > 0, "PARTIALLY_ISSUED").otherwise("READY_FOR_FIELD")
    stale = F.col("bagged_at") <= F.lit(as_of).cast("date") - stale_days
    return named.select("project_id", "tag_number", "line_id", "req_number", "line_number", "commodity_code", "priority", "bagged_at", ready.alias("readiness"), stale.alias("stale"), F.concat_ws("|", F.upper("iso_number"), F.upper("iso_sheet")).alias("iso_key"), F.col("qty_remaining").cast("double").alias("qty_remaining"))


def queue_summary(queue: DataFrame) -> DataFrame:
    """Counts of a project's queue before any filter by readiness."""
    return queue.groupBy("project_id").agg(F.countDistinct("tag_number").alias("active_tags"), F.count("*").alias("active_items"), F.count_if(F.col("readiness") == "READY_FOR_FIELD").alias("ready"), F.count_if(F.col("readiness") == "PARTIALLY_ISSUED").alias("partial"), F.count_if("stale").alias("stale"), F.sum("qty_remaining").alias("quantity"))


def fold_duplicates(rows: DataFrame) -> DataFrame:
    """Active rows of one bag and line become one, under the least id, with their quantities added; inactive rows stay."""
    folded = rows.filter("active").groupBy("bag_id", "line_id").agg(F.min("row_id").alias("row_id"), F.sum("quantity").alias("quantity"), F.count("*").alias("merged")).withColumn("active", F.lit(True))
    rest = rows.filter("not active").select("bag_id", "line_id", "row_id", "quantity", F.lit(1).cast("long").alias("merged"), "active")
    return folded.unionByName(rest).withColumn("quantity", F.col("quantity").cast("double"))
