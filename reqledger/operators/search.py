"""Search over lines, and what belongs to a requisition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import derive
from ..sources.written import written


def search_lines(terms: DataFrame, lines: DataFrame, requisitions: DataFrame, limit: int = 200) -> DataFrame:
    """For each term, active lines whose requisition number or drawing starts with it or whose drawing and sheet it names, at most limit of
    them by number and line, with how many there are. A line's prefixes and its drawing and sheet are its keys, and one join on equal keys meets the terms, so no pair is
    compared in vain, none is found twice, and none is shuffled but the first of each task."""
    heads = requisitions.select("req_id", "req_number")
    rows = lines.filter("active").join(heads, "req_id").select("line_id", "req_number", "line_number", F.upper("req_number").alias("number"), F.upper("iso_number").alias("iso"), derive.iso_key().alias("iso_key"))
    # Written, so that its size is known before the join is planned.
    asked = written(terms.select("term", F.upper("term").alias("key")).distinct(), "terms")
    # Prefixes only of the lengths that terms have (a few numbers).
    sizes = asked.agg(F.collect_set(F.length("key")).alias("sizes"))
    keys = asked.select("term", "key", F.struct(F.lit(True).alias("prefix"), F.col("key").alias("text")).alias("sought")).union(
        asked.select("term", "key", F.struct(F.lit(False).alias("prefix"), F.regexp_replace("key", r"^(.*)-(\d{1,2})$", "$1|$2").alias("text")).alias("sought")))
    starts = lambda c: F.coalesce(F.expr(f"transform(filter(sizes, n -> n <= length({c})), n -> left({c}, n))"), F.array().cast("array<string>"))
    prefixes = F.transform(F.array_distinct(F.concat(starts("number"), starts("iso"))), lambda x: F.struct(F.lit(True).alias("prefix"), x.alias("text")))
    own = F.array_append(prefixes, F.struct(F.lit(False).alias("prefix"), F.col("iso_key").alias("text")))
    begins = F.coalesce(F.startswith("number", "key"), F.lit(False)) | F.coalesce(F.startswith("iso", "key"), F.lit(False))
    met = rows.crossJoin(F.broadcast(sizes)).select("line_id", "req_number", "line_number", "number", "iso", F.explode(own).alias("sought")).join(keys, "sought")
    # What a term's beginning finds is not found again by its drawing and sheet.
    found = met.filter(F.col("sought.prefix") | ~begins).select("term", "line_id", "req_number", "line_number")
    order = Window.partitionBy("term").orderBy("req_number", "line_number", "line_id")
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    matches = found.groupBy("term").agg(F.count("*").alias("matches"))
    return ranked.join(matches, "term").select("term", "line_id", "place", "matches", (F.col("matches") > limit).alias("truncated"))


def requisition_detail(requisitions: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Each active requisition with its lines as a list and totals, and the bags that hold some of it. Everything is aggregated before it is joined."""
    held = items.filter("active and qty_remaining > 0").groupBy("req_id").agg(F.count("*").alias("bag_items"), F.sum("qty_remaining").alias("in_bags"))
    line = F.struct("line_number", "line_id", derive.line_status().alias("status"))
    own = lines.filter("active").groupBy("req_id").agg(F.array_sort(F.collect_list(line)).alias("l"), F.sum("qty_requested").alias("requested"), F.sum("qty_issued").alias("issued"), F.sum(derive.remaining()).alias("remaining"))
    zero = lambda c: F.coalesce(F.col(c), derive.zero()).cast("double").alias(c)
    out = requisitions.filter("active").join(own, "req_id", "left").join(held, "req_id", "left")
    listed = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["status"])), ",")
    return out.select("req_id", "req_number", "priority", F.coalesce(F.size("l"), F.lit(0)).alias("line_count"), F.coalesce(listed, F.lit("")).alias("listed"), zero("requested"), zero("issued"), zero("remaining"), F.coalesce("bag_items", F.lit(0)).alias("bag_items"), zero("in_bags"), derive.percent(F.coalesce("issued", derive.zero()), F.coalesce("requested", derive.zero())).alias("pct_issued"))
