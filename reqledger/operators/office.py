"""The office's screens over all projects: pauses, corrections, chains of split requests, the searched register, pick lists, order of the bag queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells, derive
from ..sources.sheets import stored
from . import registers, takeoff
from .order import numbered

PAUSED = "Material movement is paused"
#: Doublings after which a chain of splits must be a ring: more than any table has rows.
DOUBLINGS = 48
SORTS = {"LAST_ACTIVITY": "last_activity", "DATE_REQUIRED": "date_required", "NUMBER": "req_number", "REMAINING": "remaining", "FULFILLMENT": "fulfillment", "REQUESTED": "requested"}


def field_gate(movements: DataFrame, controls: DataFrame) -> DataFrame:
    """Movements with the refusal that a paused project gives them, null where its field is open. Projects without controls are open."""
    locks = controls.filter("field_locked").select("project_id", F.when(F.col("reason").isNull(), PAUSED + " on this project.").otherwise(F.concat(F.lit(PAUSED + ": "), "reason")).alias("refusal"))
    return movements.join(locks, "project_id", "left").select("id", "project_id", "refusal")


def correction_history(corrections: DataFrame, requisitions: DataFrame, lines: DataFrame, limit: int = 100) -> DataFrame:
    """The latest corrections of each project. They are ranked before they are joined, so only those travel."""
    order = Window.partitionBy("project_id").orderBy(F.col("applied_at").desc(), "id")
    last = corrections.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    named = last.join(requisitions.select("req_id", "req_number"), "req_id").join(lines.select("line_id", "line_number", "description"), "line_id")
    return named.select("project_id", "place", "id", "req_number", "line_number", "description", "types", "reason")


def split_lineage(requests: DataFrame) -> DataFrame:
    """For each request the one that its chain of splits began with, its depth, and the chain's count, quantity and depth.
    Pointers are doubled: n rounds follow chains of 2^n splits, each round one join that is written, so plans stay short. A request
    whose parent is not there begins a chain; a ring of splits is an error."""
    known = requests.select(F.col("id").alias("split_from_id"), F.lit(True).alias("known"))
    linked = requests.join(known, "split_from_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    steps = stored(linked.select("id", F.when(F.col("known"), F.col("split_from_id")).otherwise(F.col("id")).alias("root"), F.col("known").cast("long").alias("depth")))
    for _ in range(DOUBLINGS):
        above = steps.select(F.col("id").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        ahead = stored(steps.join(above, "root").select("id", F.col("above").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "more"))
        steps = ahead.drop("more")
        if not ahead.filter("more > 0").take(1):
            break
    else:
        raise ValueError("a request is split from itself")
    sized = steps.join(requests.select("id", "qty_requested"), "id")
    chains = sized.groupBy("root").agg(F.count("*").alias("requests"), F.sum("qty_requested").cast("double").alias("quantity"), F.max("depth").alias("chain_depth"))
    return steps.join(chains, "root").select("id", F.col("root").alias("root_id"), "depth", "requests", "quantity", "chain_depth")


def register_search(requisitions: DataFrame, lines: DataFrame, term: str = "", kind: str = "AUTO", status: str | None = None, priority: str | None = None,
                    exception: str = "ALL", sort: str = "LAST_ACTIVITY", descending: bool = True, page: int = 1, size: int = 25) -> DataFrame:
    """A page of each project's register: requisitions that match a term (by number, package, drawing, or any of these and who asked), a status,
    a priority and an exception, sorted. Headers are filtered before lines meet them; only the first page * size rows of a project are ranked."""
    head, term, size = requisitions.filter("active"), term.strip(), min(100, max(10, size))
    if priority:
        head = head.filter(F.col("priority") == priority)
    if term:
        rules = F.lit(False)
        if kind in ("NUMBER", "AUTO"):
            rules |= cells.starts(F.col("req_number"), term)
        if kind in ("IWP", "AUTO"):
            rules |= cells.holds(F.col("iwp_number"), term)
        if kind == "AUTO":
            rules |= cells.holds(F.col("requested_by"), term)
        if kind in ("ISO", "AUTO"):
            terms = takeoff.iso_candidates(lines.sparkSession.createDataFrame([(term,)], "term string")).select(F.col("candidate").alias("iso_key_"))
            live = lines.filter("active").withColumn("iso_key_", derive.iso_key())
            named = live.join(F.broadcast(terms), "iso_key_", "left_semi").select("req_id").union(live.filter(cells.starts(F.col("iso_number"), term)).select("req_id")).distinct().withColumn("drawn_", F.lit(True))
            head = head.join(named, "req_id", "left").filter(rules | F.coalesce("drawn_", F.lit(False))).drop("drawn_")
        else:
            head = head.filter(rules)
    if status:
        head = head.join(registers.header_rollup(lines).filter(F.col("status") == status).select("req_id"), "req_id", "left_semi")
    rows = registers.register(head, lines).join(head.select("req_id", "last_activity"), "req_id")
    if exception != "ALL":
        rows = rows.filter(registers.exceptions()[exception.lower()])
    rows = rows.withColumn("fulfillment", F.when(F.col("requested") > 0, F.col("issued") / F.col("requested")).otherwise(0.0))
    key = F.col(SORTS[sort])
    order = Window.partitionBy("project_id").orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "req_number")
    top = rows.withColumn("record", F.row_number().over(order)).filter(F.col("record") <= page * size)
    counts = rows.groupBy("project_id").agg(F.count("*").alias("records"))
    last = F.least(F.lit(page), F.ceil(F.col("records") / size))
    here = top.join(counts, "project_id").filter(F.col("record").between((last - 1) * size + 1, last * size))
    return here.select("project_id", "record", "records", "req_number", "priority", "line_count", "requested", "remaining", "pct_issued")


def pick_lists(projects: DataFrame, values: DataFrame, places: DataFrame, used: int = 100) -> DataFrame:
    """Values of each project's lists, those shared by all projects with them; storage locations also take the first that its lines use."""
    live = values.filter("active")
    own = live.filter("project_id is not null").select("project_id", "list_name", "value")
    shared = live.filter("project_id is null").select("list_name", "value").withColumn("all_", F.lit(1)).join(projects.select("project_id").distinct().withColumn("all_", F.lit(1)), "all_").select("project_id", "list_name", "value")
    seen = places.filter("storage_location <> ''").select("project_id", F.col("storage_location").alias("value")).distinct()
    first = seen.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("value"))).filter(F.col("place") <= used)
    return own.union(shared).union(first.select("project_id", F.lit("STORAGE_LOCATION"), "value")).distinct()


def bag_queue_order(queue: DataFrame) -> DataFrame:
    """The place of each bag item from the oldest and from the newest, tags between equals."""
    oldest = numbered(queue, "project_id", ["bagged_at", "tag_number", "line_id"], "oldest_first")
    both = numbered(oldest, "project_id", [F.col("bagged_at").desc(), "tag_number", "line_id"], "newest_first")
    return both.select("project_id", "tag_number", "line_id", "oldest_first", "newest_first")
