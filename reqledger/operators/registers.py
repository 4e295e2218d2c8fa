"""Registers, queues and dashboards: joins and grouped aggregates over all projects at once. Lines are aggregated before they are joined, so nothing fans out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import derive
from .order import numbered

SUMS = {
    "requested": "qty_requested", "located": "qty_confirmed_located", "available": "qty_available", "bagged": "qty_active_bagged",
    "issued": "qty_issued", "pending": "qty_pending_backorder", "confirmed": "qty_confirmed_backorder",
}


def _line_sums(lines: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(c).alias(k) for k, c in SUMS.items()]
    return lines.filter("active").groupBy(*keys).agg(F.count("*").alias("line_count"), *sums, F.sum(derive.remaining()).alias("remaining"))


def _zeroed(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), derive.zero()).cast("double").alias(n) for n in names]


def register(requisitions: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each active requisition, with its line sums and the share issued."""
    joined = requisitions.filter("active").join(_line_sums(lines, "req_id"), "req_id", "left")
    return joined.select("req_id", "project_id", "req_number", "priority", "date_required", F.coalesce("line_count", F.lit(0)).alias("line_count"), *_zeroed(*SUMS, "remaining"), derive.percent(F.coalesce("issued", derive.zero()), F.coalesce("requested", derive.zero())).alias("pct_issued"))


def exceptions() -> dict[str, Column]:
    return {
        "has_remaining": F.col("remaining") > 0, "not_fully_located": F.col("located") < F.col("requested"), "has_available": F.col("available") > 0,
        "has_bagged": F.col("bagged") > 0, "pending_backorder": F.col("pending") > 0, "confirmed_backorder": F.col("confirmed") > 0,
    }


def register_exceptions(registered: DataFrame) -> DataFrame:
    """Requisitions of each project under each exception, in one scan."""
    return registered.groupBy("project_id").agg(F.count("*").alias("requisitions"), *[F.count_if(c).alias(k) for k, c in exceptions().items()])


def register_totals(registered: DataFrame) -> DataFrame:
    return registered.groupBy("project_id").agg(F.count("*").alias("requisitions"), F.sum("line_count").alias("line_count"), *[F.sum(k).alias(k) for k in (*SUMS, "remaining")])


def register_filters(requisitions: DataFrame, lines: DataFrame) -> DataFrame:
    """Priorities of each project's requisitions, and statuses of those with lines."""
    listed = lambda c, name: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name)
    return requisitions.join(header_rollup(lines), "req_id", "left").groupBy("project_id").agg(listed("priority", "priorities"), listed("status", "statuses"))


def register_page(registered: DataFrame, page: int, size: int, sort: str = "remaining") -> DataFrame:
    """A page of each project's register by a sort key, largest first; the size is held to 10 to 100."""
    size = min(100, max(10, size))
    records = registered.groupBy("project_id").agg(F.count("*").alias("records"))
    places = numbered(registered, "project_id", [F.col(sort).desc_nulls_last(), "req_number"], "record")
    here = places.filter(F.col("record").between((page - 1) * size + 1, page * size)).join(records, "project_id")
    return here.select("project_id", "record", "records", F.ceil(F.col("records") / size).alias("pages"), "req_number", F.col(sort).alias("sort_value"))


def drawing_summary(lines: DataFrame) -> DataFrame:
    out = lines.filter("active").groupBy("project_id", "iso_number", "iso_sheet", "iso_revision").agg(F.count("*").alias("line_count"), F.countDistinct("req_id").alias("requisitions"), F.sum("qty_requested").alias("requested"), F.sum("qty_issued").alias("issued"), F.sum(derive.remaining()).alias("remaining"))
    return out.withColumn("pct_issued", derive.percent(F.col("issued"), F.col("requested"))).withColumns({c: F.col(c).cast("double") for c in ("requested", "issued", "remaining")})


def header_rollup(lines: DataFrame) -> DataFrame:
    s = _line_sums(lines, "req_id")
    status = (
        F.when((F.col("remaining") <= 0) & (F.col("requested") > 0), "Complete").when(F.col("issued") > 0, "Partially Issued")
        .when(F.col("pending") + F.col("confirmed") > 0, "Backordered").when(F.col("located") > 0, "In Progress").otherwise("Open")
    )
    return s.select("req_id", status.alias("status"))


def backorder_queue(backorders: DataFrame, status: str | None = None) -> DataFrame:
    """Active requests of each project in order of line and time, numbered for paging."""
    rows = backorders.filter("active") if status is None else backorders.filter("active").filter(F.col("status") == status)
    placed = numbered(rows, "project_id", ["line_id", "reported_at", "id"], "place")
    return placed.select("project_id", "id", "line_id", "status", F.col("qty_pending").cast("double").alias("qty_pending"), F.col("qty_confirmed").cast("double").alias("qty_confirmed"), "place")


def outstanding_notices(notices: DataFrame) -> DataFrame:
    """Active notices of each project: critical before warning before info, oldest first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    placed = numbered(notices.filter("active"), "project_id", [rank, "raised_at", "id"], "place")
    return placed.select("project_id", "id", "line_id", "kind", "severity", F.col("qty_notified").cast("double").alias("qty_notified"), "place")


def notices_by_line(notices: DataFrame) -> DataFrame:
    """Active notices of each line as a list, newest first."""
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("raised_at", "id", "kind"))))
    listed = notices.filter("active").groupBy("line_id").agg(newest.alias("n"))
    return listed.select("line_id", F.size("n").alias("notices"), F.array_join(F.transform("n", lambda x: F.concat_ws(":", x["id"].cast("string"), x["kind"])), ",").alias("listed"))


def active_bags_by_line(items: DataFrame) -> DataFrame:
    return items.filter("active and qty_remaining > 0").groupBy("line_id").agg(F.count("*").alias("bags"), F.sum("qty_remaining").cast("double").alias("qty_in_bags"), F.array_join(F.array_sort(F.collect_set("bag_id")), ",").alias("bag_ids"))


def dashboard_activity(movements: DataFrame, as_of: str) -> DataFrame:
    """Movements of the 24 hours before as_of, by project and type."""
    last = movements.filter((F.col("ts") > F.expr(f"timestamp_ntz '{as_of}' - interval 24 hours")) & (F.col("ts") <= F.expr(f"timestamp_ntz '{as_of}'")))
    return last.groupBy("project_id", "action").agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"))


def dashboard_backorders(backorders: DataFrame) -> DataFrame:
    return backorders.filter("active").groupBy("project_id", "status").agg(F.count("*").alias("n"), F.sum(F.col("qty_pending") + F.col("qty_confirmed")).cast("double").alias("quantity"))


def dashboard_bags(items: DataFrame) -> DataFrame:
    return items.filter("active").groupBy("project_id").agg(F.count("*").alias("items"), F.sum("qty_remaining").cast("double").alias("quantity"))


def health(requisitions: DataFrame, backorders: DataFrame, notices: DataFrame, stock: DataFrame, movements: DataFrame, as_of: str, backorder_days: int = 7, notice_days: int = 3, bag_days: int = 30) -> DataFrame:
    """Stale requests, notices and bag items of each project, and its last movement; a project with none has zeros."""
    before = lambda name, days: F.col(name) < F.expr(f"timestamp_ntz '{as_of}' - interval {days} days")
    late = backorders.filter("active and status = 'Pending'").groupBy("project_id").agg(F.count_if(before("reported_at", backorder_days)).alias("stale_backorders"))
    told = notices.filter("active").groupBy("project_id").agg(F.count_if(before("raised_at", notice_days)).alias("stale_notices"))
    held = stock.filter("active and qty_remaining > 0").groupBy("project_id").agg(F.count_if(before("bagged_at", bag_days)).alias("stale_bags"))
    last = movements.groupBy("project_id").agg(F.max("day").alias("last_activity"))
    out = requisitions.select("project_id").distinct()
    for part in (late, told, held, last):
        out = out.join(part, "project_id", "left")
    counts = ["stale_backorders", "stale_notices", "stale_bags"]
    out = out.na.fill(0, counts)
    return out.withColumn("ok", sum((F.col(c) for c in counts), F.lit(0)) == 0)


def donor_candidates(lines: DataFrame, most: int = 25) -> DataFrame:
    """For each short line, the lines of its project with equal code, size and unit that have stock, most stock first.

    A line takes at most `most` donors, and only itself can be passed over, so the most + 1 best of each material are all that any line can need. They are one short
    list by material, in order, so a line's places are read off its list and no pair is shuffled."""
    key = [F.col("project_id"), *[F.upper(F.trim(c)).alias(f"k_{c}") for c in ("commodity_code", "size", "uom")]]
    names = ["project_id", "k_commodity_code", "k_size", "k_uom"]
    live = lines.filter("active").filter(F.trim("commodity_code") != "")
    donors = live.filter(derive.lendable() > 0).select(*key, F.col("line_id").alias("donor_id"), derive.lendable().alias("lendable"))
    best = Window.partitionBy(*names).orderBy(F.desc("lendable"), "donor_id")
    donors = donors.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most + 1)
    lists = donors.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("n", "donor_id", "lendable"))).alias("donors"))
    short = live.filter(derive.shortage() > 0).select(*key, F.col("line_id").alias("receiver_id"), derive.shortage().alias("shortage"))
    others = F.slice(F.filter("donors", lambda d: d["donor_id"] != F.col("receiver_id")), 1, most)
    ranked = short.join(lists, names).select("receiver_id", "shortage", F.posexplode(others).alias("at", "d"))
    return ranked.select("receiver_id", "d.donor_id", (F.col("at") + 1).alias("place"), F.col("d.lendable").cast("double").alias("lendable"), F.col("shortage").cast("double").alias("shortage"))


def time_saved(lines: DataFrame) -> DataFrame:
    """Seconds of typing that a requisition's lines would have taken: fixed, per drawing, per line and per long description (fixed values)."""
    out = lines.filter("active").groupBy("req_id").agg(F.countDistinct("iso_number").alias("drawings"), F.count_if(F.length("description") > 52).alias("overflow"), F.count("*").alias("rows"))
    seconds = F.lit("17.30").cast("decimal(12,2)") + F.lit("33.36").cast("decimal(12,2)") * F.col("drawings") + F.lit("20").cast("decimal(12,2)") * (F.col("rows") - F.col("overflow")) + F.lit("26").cast("decimal(12,2)") * F.col("overflow")
    return out.select("req_id", "drawings", "overflow", seconds.cast("double").alias("seconds"))
