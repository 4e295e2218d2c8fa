"""All queries of the library by name. Each reads the given tables through the domain views; plans/oracles.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive, normalize
from ..operators import drafts, integrity, registers, replay, swaps, takeoff, waterfall
from ..sources.bridge import domain
from ..streaming import streams
from . import desk, field, office, oracles

AS_OF = oracles.AS_OF
Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *views: str) -> Query:
    return lambda spark, sf_dir: f(*domain(spark, sf_dir, *views))


def _double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _located(movements: DataFrame) -> DataFrame:
    return movements.filter("action = 'CONFIRM_AVAILABLE'").groupBy("line_id").agg(F.sum("quantity").cast("decimal(14,4)").alias("located"))


def _asked(movements: DataFrame) -> DataFrame:
    return movements.filter("action = 'BACKORDER_REQUESTED'").groupBy("line_id").agg(F.sum("quantity").cast("decimal(14,4)").alias("asked"))


def _issued(movements: DataFrame) -> DataFrame:
    return movements.filter("action in ('DIRECT_ISSUE', 'ISSUE_FROM_AVAILABLE')").groupBy("line_id").agg(F.sum("quantity").alias("issued"))


def _registered(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _over(lambda r, x: f(registers.register(r, x)), "requisitions", "lines")


def line_state(lines: DataFrame) -> DataFrame:
    return _double(derive.with_derived(lines).select("line_id", "iso_key", "not_yet_located", "remaining", "line_status"), "not_yet_located", "remaining")


def line_ceilings(lines: DataFrame) -> DataFrame:
    cells = {"locatable": derive.locatable(), "reservable": derive.reservable(), "new_backorder": derive.new_backorder(), "lendable": derive.lendable(), "shortage": derive.shortage()}
    return lines.select("line_id", *[c.cast("double").alias(k) for k, c in cells.items()])


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.run(streams.ledger(streams.movements(spark, sf_dir)), "update")
    last = rows.groupBy("line_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "line_id"]), F.col("accepted") + F.col("refused")).alias("s"))
    return last.select("line_id", "s.*")


def integrity_report(lines: DataFrame, items: DataFrame, notices: DataFrame, requests: DataFrame, counted: DataFrame) -> DataFrame:
    return integrity.report(integrity.bag_ledger(lines, items), integrity.backorder_excess(lines), integrity.orphan_items(lines, items), integrity.notice_without_request(notices, requests), integrity.row_constraints(counted))


def integrity_report_all(lines: DataFrame, items: DataFrame, notices: DataFrame, requests: DataFrame, counted: DataFrame, movements: DataFrame, stored: DataFrame) -> DataFrame:
    five = (integrity.bag_ledger(lines, items), integrity.backorder_excess(lines), integrity.orphan_items(lines, items), integrity.notice_without_request(notices, requests), integrity.row_constraints(counted))
    return integrity.report(*five, integrity.backorder_ledger(lines, requests), integrity.issued_history(lines, movements), integrity.status(lines, stored))


def queries() -> dict[str, Query]:
    return {
        "register": _over(registers.register, "requisitions", "lines"),
        "register_totals": _registered(registers.register_totals),
        "register_exceptions": _registered(registers.register_exceptions),
        "register_page": _registered(lambda r: registers.register_page(r, 2, 25)),
        "register_filters": _over(registers.register_filters, "requisitions", "lines"),
        "line_state": _over(line_state, "lines"),
        "line_ceilings": _over(line_ceilings, "lines"),
        "action_limits": _over(derive.action_limits, "lines"),
        "drawing_summary": _over(registers.drawing_summary, "lines"),
        "header_rollup": _over(registers.header_rollup, "lines"),
        "backorder_queue": _over(registers.backorder_queue, "backorders"),
        "outstanding_notices": _over(registers.outstanding_notices, "notices"),
        "notices_by_line": _over(registers.notices_by_line, "notices"),
        "active_bags_by_line": _over(registers.active_bags_by_line, "bag_items"),
        "dashboard_activity": _over(lambda m: registers.dashboard_activity(m, AS_OF), "movements"),
        "dashboard_backorders": _over(registers.dashboard_backorders, "backorders"),
        "dashboard_bags": _over(registers.dashboard_bags, "bag_items"),
        "health": _over(lambda r, b, n, s, m: registers.health(r, b, n, s, m, AS_OF), "requisitions", "backorders", "notices", "bag_stock", "movements"),
        "donor_candidates": _over(registers.donor_candidates, "lines"),
        "time_saved": _over(registers.time_saved, "lines"),
        "settle_backorders": _over(lambda b, m, t: waterfall.settle_backorders(b, _located(m), t), "backorders", "movements", "line_totals"),
        "backorder_desync": _over(lambda b, m, t: waterfall.backorder_desync(b, _located(m), t), "backorders", "movements", "line_totals"),
        "settle_notices": _over(lambda n, m: waterfall.settle_notices(n, _located(m), _asked(m)), "notices", "movements"),
        "resubmit_returned": _over(lambda b, m: waterfall.resubmit_returned(b, _asked(m)), "backorders", "movements"),
        "resubmit_requests": _over(lambda b, m: waterfall.resubmit_requests(b, _asked(m)), "backorders", "movements"),
        "chk_bag_ledger": _over(integrity.bag_ledger, "lines", "bag_items"),
        "chk_backorder_excess": _over(integrity.backorder_excess, "lines"),
        "chk_orphan_bag_item": _over(integrity.orphan_items, "lines", "bag_items"),
        "chk_notice_without_request": _over(integrity.notice_without_request, "notices", "backorders"),
        "chk_row_constraints": _over(integrity.row_constraints, "counted_lines"),
        "integrity_report": _over(integrity_report, "lines", "bag_items", "notices", "backorders", "counted_lines"),
        "chk_backorder_ledger": _over(integrity.backorder_ledger, "lines", "backorders"),
        "chk_issued_history": _over(integrity.issued_history, "lines", "movements"),
        "chk_status": _over(integrity.status, "lines", "stored_statuses"),
        "integrity_report_all": _over(integrity_report_all, "lines", "bag_items", "notices", "backorders", "counted_lines", "movements", "stored_statuses"),
        "repair_backorder_totals": _over(integrity.repair_backorder_totals, "lines", "backorders"),
        "sweep_stale_notices": _over(lambda n, b, m: integrity.sweep_stale_notices(n, b, _issued(m)), "notices", "backorders", "movements"),
        "replay_ledger": _over(replay.replay_ledger, "movements"),
        "ledger_balance": _over(replay.ledger_balance, "movements"),
        "state_as_of": _over(lambda m: replay.state_as_of(m, AS_OF), "movements"),
        "decide_backorders": _over(replay.decide_backorders, "backorders"),
        "line_history": lambda spark, d: replay.line_history(domain(spark, d, "movements")[0], spark.read.parquet(f"{d}/customer.parquet")),
        "select_revisions": _over(takeoff.select_revisions, "iso_pages"),
        "scan_counts": _over(lambda p: takeoff.scan_counts(takeoff.select_revisions(p)), "iso_pages"),
        "purchase_rollup": _over(takeoff.purchase_rollup, "lines"),
        "iso_candidates": _over(lambda x: takeoff.iso_candidates(x.select(F.concat_ws("-", "iso_number", "iso_sheet").alias("term")).distinct()), "lines"),
        "assign_bag_numbers": _over(takeoff.assign_bag_numbers, "bag_items", "requisitions", "bag_stock"),
        "one_draft_per_number": _over(takeoff.one_draft_per_number, "requisitions"),
        "normalize_materials": _over(normalize.normalize_materials, "material_text"),
        "row_confidence": _over(takeoff.row_confidence, "extracted"),
        "read_paste": lambda spark, d: takeoff.read_paste(spark.read.parquet(f"{d}/documents.parquet")),
        "replay_workflow": _over(drafts.replay_workflow, "transitions"),
        "group_extracted": _over(lambda m: drafts.group_extracted(normalize.normalize_materials(m)), "material_text"),
        "stage_status": _over(lambda m: drafts.stage_status(drafts.group_extracted(normalize.normalize_materials(m))), "material_text"),
        "number_sequence_resume": _over(drafts.next_numbers, "requisitions"),
        "package_number": _over(drafts.package_numbers, "requisitions"),
        "content_hash": _over(drafts.content_hashes, "lines"),
        "spool_reconcile": _over(drafts.reconcile_copies, "iso_pages"),
        "write_split": _over(lambda m: drafts.split_by_confidence(takeoff.row_confidence(m)), "extracted"),
        "repay_swaps": _over(lambda s, m: swaps.repay_swaps(s, _located(m)), "swaps", "movements"),
        "open_swaps": _over(lambda s: swaps.open_swaps(s, AS_OF), "swaps"),
        "swaps_for_line": _over(swaps.swaps_by_line, "swaps"),
        "correctable_history": _over(swaps.correctable_history, "movements"),
        "plan_corrections": _over(swaps.plan_corrections, "movements"),
        "field_notes_topk": _over(swaps.field_notes, "movements", "backorders"),
        "bag_closure": _over(swaps.bag_closure, "bag_items"),
        "stream_sessions": lambda spark, d: streams.run(streams.sessions(streams.movements(spark, d)), "complete"),
        "stream_dedup": lambda spark, d: streams.run(streams.dedup(streams.movements(spark, d).union(streams.movements(spark, d)))),
        "stream_activity": lambda spark, d: streams.run(streams.activity(streams.movements(spark, d)), "complete"),
        "stream_ledger": stream_ledger,
    } | desk.queries(_over) | office.queries(_over) | field.queries(_over)


def oracle_sql() -> dict[str, str]:
    told = oracles.oracle_sql()
    return told | desk.oracle_sql() | office.oracle_sql() | field.oracle_sql() | {"stream_balance": told["ledger_balance"], "stream_integrity": told["chk_issued_history"]}
