"""Drawing packages: revision selection, duplicates, purchase roll-ups, search terms and bag numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bags import next_counters
from .order import numbered


def select_revisions(pages: DataFrame) -> DataFrame:
    """Of each drawing's copies: which are accepted, superseded, duplicates, or set aside because their revisions cannot be ordered or their contents differ."""
    per = pages.groupBy("drawing_number").agg(F.countDistinct("revision").alias("revisions"), F.bool_and(F.col("revision").rlike("^[0-9]+$")).alias("numeric"), F.max(F.col("revision").try_cast("int")).alias("newest"))
    rows = pages.join(per, "drawing_number").withColumn("current", (F.col("revisions") == 1) | (F.col("revision").try_cast("int") == F.col("newest")))
    hashes = rows.filter("current").groupBy("drawing_number").agg(F.countDistinct("content_hash").alias("contents"))
    order = Window.partitionBy("drawing_number", "current").orderBy("source_path", "page")
    ranked = rows.join(hashes, "drawing_number", "left").withColumn("place", F.row_number().over(order))
    fate = (
        F.when((F.col("revisions") > 1) & ~F.col("numeric"), "unorderable_multiple_revisions").when(~F.coalesce("current", F.lit(False)), "superseded")
        .when(F.col("contents") > 1, "duplicate_revision_conflict").when(F.col("place") == 1, "accepted").otherwise("duplicate")
    )
    return ranked.select("drawing_number", "revision", "page", fate.alias("fate"))


def scan_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("fate").agg(F.count("*").alias("pages"), F.countDistinct("drawing_number").alias("drawings"))


def purchase_rollup(lines: DataFrame) -> DataFrame:
    """Quantity to buy by project, material and unit."""
    return lines.filter("active").groupBy("project_id", "commodity_code", "size", "uom").agg(F.sum("qty_requested").cast("double").alias("quantity"), F.count("*").alias("line_count"))


def iso_candidates(terms: DataFrame) -> DataFrame:
    """Readings of a search term: itself, and drawing and sheet where it ends in one or two digits, also without the sheet's leading zero."""
    body = F.regexp_replace(F.upper(F.trim("term")), "^ISO:", "")
    drawing, sheet = F.regexp_extract(body, r"^(.*)-(\d{1,2})$", 1), F.regexp_extract(body, r"^(.*)-(\d{1,2})$", 2)
    plain = body.rlike(r"[|/]|\b(SHT|SHEET)\b") | ~body.rlike(r"^(.*)-(\d{1,2})$")
    bare = F.concat(drawing, F.lit("|"), sheet.try_cast("int").cast("string"))
    found = F.when(plain, F.array(body)).otherwise(F.array_distinct(F.array(body, F.concat(drawing, F.lit("|"), sheet), bare)))
    return terms.select("term", F.explode(found).alias("candidate")).filter("candidate <> ''")


def assign_bag_numbers(items: DataFrame, requisitions: DataFrame, stock: DataFrame, prefix: str = "BT") -> DataFrame:
    """Numbers of bags without one, in order within project and year of their requisition. A year goes on after the highest number that the project has used in it, or starts at 1; five places, growing beyond."""
    bags = items.groupBy("project_id", "bag_id", "req_id").agg(F.count("*").alias("items")).join(requisitions.select("req_id", F.year("date_required").alias("year")), "req_id")
    base = next_counters(stock).filter(F.col("prefix") == prefix).select("project_id", "year", "next_counter")
    placed = numbered(bags.withColumn("counter", F.concat_ws("|", "project_id", "year")), "counter", ["bag_id"], "place").join(base, ["project_id", "year"], "left")
    n = (F.coalesce("next_counter", F.lit(1)) + F.col("place") - 1).cast("long").cast("string")
    return placed.select("bag_id", "items", F.concat(F.lit(f"{prefix}-"), F.col("year").cast("string"), F.lit("-"), F.when(F.length(n) >= 5, n).otherwise(F.lpad(n, 5, "0"))).alias("tag_number"))


def one_draft_per_number(requisitions: DataFrame) -> DataFrame:
    """Of drafts with one number in a project the first stays; later ones lose it."""
    drafts = requisitions.select("req_id", "project_id", F.upper(F.concat(F.lit("f"), (F.col("req_id") / 3).cast("long").cast("string"))).alias("number"))
    first = F.row_number().over(Window.partitionBy("project_id", "number").orderBy("req_id")) == 1
    return drafts.select("req_id", F.when(first, F.col("number")).alias("number"), F.when(~first, F.lit("ALREADY_STAGED")).alias("issue"))


#: What each thing that a person would have to check takes off (fixed values).
DEDUCTIONS = {"no quantity": 0.25, "no description": 0.25, "no commodity code": 0.10, "no size": 0.05, "column positions uncertain": 0.15, "row assembled from wrapped lines": 0.05, "category unclear": 0.10}
#: Words that head columns (fixed values).
HEADING = r"(?i)^(commodity|commodity\s*code|code|item|item\s*no\.?|no\.?|#|size|npd|bore|desc|description|material|qty|quantity|quant|uom|unit|units|u/m|loc|location|storage|storage\s*location|remarks|notes)$"
CELLS = ("commodity_code", "size", "description", "quantity", "uom", "storage_location")


def row_confidence(rows: DataFrame) -> DataFrame:
    """1 less a deduction for each thing that a person would have to check, with the warnings."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [blank("quantity"), blank("description"), blank("commodity_code"), blank("size"), F.col("columns_uncertain"), F.col("wrapped"), blank("category")]
    lost = sum((F.when(c, F.lit(d)).otherwise(0.0) for c, d in zip(checks, DEDUCTIONS.values(), strict=True)), F.lit(0.0))
    told = F.array_join(F.filter(F.array(*[F.when(c, F.lit(w)) for c, w in zip(checks, DEDUCTIONS, strict=True)]), lambda x: x.isNotNull()), "; ")
    return rows.select("part_id", F.round(F.greatest(F.lit(0.0), 1 - lost), 3).alias("confidence"), told.alias("warnings"))


def read_paste(texts: DataFrame) -> DataFrame:
    """Pasted text as material lines of six cells, split at tabs, or at commas where a line has none. A first line of headings only (two at least) is left out."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split("text", "\r?\n"), bare), lambda x: x != "")
    cells = lambda x: F.transform(F.when(x.contains("\t"), F.split(x, "\t")).otherwise(F.split(x, ",")), bare)
    rows = texts.select("doc_id", F.posexplode(F.transform(lines, cells)).alias("pos", "cells"))
    filled = F.filter("cells", lambda x: x != "")
    heading = (F.col("pos") == 0) & (F.size(filled) >= 2) & F.forall(filled, lambda x: x.rlike(HEADING))
    return rows.filter(~heading).select("doc_id", F.col("pos").cast("long").alias("row"), *[F.get("cells", i).alias(c) for i, c in enumerate(CELLS)])
