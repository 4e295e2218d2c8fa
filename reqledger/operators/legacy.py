"""Sheets of the former system to tables: old keys to new ones, typed rows, statuses by their present names, and the gate that refuses a load with problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..sources.written import written

# Statuses of the former system and their present names.
STATUS_ALIASES = {"pending admin review": "Pending", "returned to field": "Returned for Review", "partially confirmed": "Partially Confirmed"}


def new_id(sheet: str, key: Column) -> Column:
    """The same for the same old key, so that a load that is run again meets its own rows."""
    return F.sha2(F.concat_ws("|", F.lit(sheet), key), 256)


def resolve_ids(headers: DataFrame, lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Each row of three sheets with its new key, or as an orphan: a line without its header, a request without its header or its line. Joins on equal keys; orphans are kept apart, not lost.
    Lines are judged once and written, as requests ask for the good ones."""
    head = headers.select("fmr_id").distinct()
    has = lambda df, key, name: df.select(F.col(key)).withColumn(name, F.lit(True))
    judged = written(lines.select("line_id", "fmr_id").join(has(head, "fmr_id", "h"), "fmr_id", "left").select("line_id", F.coalesce("h", F.lit(False)).alias("known")), "lines")
    good_lines = judged.filter("known").select("line_id").distinct()
    line_rows = judged.select(F.lit("lines").alias("sheet"), F.col("line_id").alias("old_id"), "known")
    asked = requests.join(has(head, "fmr_id", "h"), "fmr_id", "left").join(has(good_lines, "line_id", "l"), "line_id", "left")
    request_rows = asked.select(F.lit("requests").alias("sheet"), F.col("request_id").alias("old_id"), (F.coalesce("h", F.lit(False)) & F.coalesce("l", F.lit(False))).alias("known"))
    rows = headers.select(F.lit("headers").alias("sheet"), F.col("fmr_id").alias("old_id"), F.lit(True).alias("known")).union(line_rows).union(request_rows)
    made = F.sha2(F.concat_ws("|", "sheet", "old_id"), 256)
    return rows.select("sheet", "old_id", F.when(F.col("known"), made).alias("new_id"), (~F.col("known")).alias("orphan"))


def typed_headers(headers: DataFrame) -> DataFrame:
    return headers.select(
        "fmr_id", new_id("headers", F.col("fmr_id")).alias("req_key"), cells.text(F.col("fmr_number")).alias("req_number"), cells.iso_date(F.col("date_required")).alias("date_required"),
        F.coalesce(cells.text(F.col("current_status")), F.lit("Open")).alias("status"), cells.yes(F.col("active")).alias("active"),
    )


def typed_lines(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of known headers with their quantities as numbers and what follows from them."""
    number = lambda c: cells.number(F.col(c)).alias(c)
    rows = lines.select("line_id", "fmr_id", number("qty_requested"), number("qty_confirmed_located"), number("qty_issued")).join(typed_headers(headers), "fmr_id")
    left = lambda a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(b))
    return rows.select(new_id("lines", F.col("line_id")).alias("line_key"), "req_key", "req_number", "date_required", "status", "active", "qty_requested", left("qty_requested", "qty_confirmed_located").alias("not_yet_located"), left("qty_requested", "qty_issued").alias("remaining"))


def status_name(cell: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in STATUS_ALIASES.items() for x in kv])
    given = cells.text(cell)
    return F.when(given.isNull(), "Pending").otherwise(F.coalesce(F.try_element_at(names, F.lower(given)), given))


def typed_requests(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests whose header and line are known, under their new keys and present statuses."""
    known = resolved.filter("sheet = 'requests' and not orphan").select(F.col("old_id").alias("request_id"), "new_id")
    return requests.join(known, "request_id").select(F.col("new_id").alias("request_key"), status_name(F.col("status")).alias("status"), cells.number(F.col("qty_pending")).alias("qty_pending"), cells.uuid(F.col("correlation_id")).alias("correlation_id"))


def line_problems(lines: DataFrame) -> DataFrame:
    """Rows that the ledger's rules would refuse, with the codes of all rules they break, in one scan."""
    n = lambda c: cells.number(F.col(c))
    requested, located, issued = n("qty_requested"), n("qty_confirmed_located"), n("qty_issued")
    missing = lambda c: cells.text(F.col(c)).isNull()
    rules = {
        "NOTHING_REQUESTED": requested <= 0, "LOCATED_SPLIT": F.abs(located - (n("qty_available") + n("qty_active_bagged") + issued)) > 1e-4, "ISSUED_OVER_REQUESTED": issued > requested,
        "LOCATED_OVER_REQUESTED": located > requested, "NEGATIVE": F.least(requested, located, issued, n("qty_available"), n("qty_active_bagged")) < 0, "NO_ISO": missing("iso_number"), "NO_SHEET": missing("iso_sheet"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return lines.select("line_id", F.array_join(found, ",").alias("problems")).filter("problems <> ''")


def load_gate(lines: DataFrame) -> DataFrame:
    """Sound rows, rows with problems, and whether the whole load is refused: one problem refuses it."""
    counts = lines.select(F.lit(0).alias("broken")).union(line_problems(lines).select(F.lit(1))).agg(F.count_if(F.col("broken") == 0).alias("n"), F.count_if(F.col("broken") == 1).alias("bad"))
    return counts.select((F.col("n") - F.col("bad")).alias("sound"), "bad", (F.col("bad") > 0).alias("refused"))
