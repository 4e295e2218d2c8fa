"""Approval chain, debts and corrections on small hand-made tables."""

from datetime import date

from pyspark.sql import functions as F

from reqledger.operators import drafts, swaps

MOVE = "id long, draft_id long, ts long, action string, allowed boolean, reason string"


def test_refused_moves_change_nothing(spark):
    log = [(1, 7, 1, "PUBLISH", True, None), (2, 7, 2, "SUBMIT", False, None), (3, 7, 3, "SUBMIT", True, None), (4, 7, 4, "PLANNER_RETURN", True, " a "), (5, 7, 5, "PLANNER_RETURN", True, "wrong size"), (6, 7, 6, "SUBMIT", True, None), (7, 7, 7, "UNKNOWN", True, None), (8, 8, 1, "SUBMIT", True, None)]
    got = {r.draft_id: r for r in drafts.replay_workflow(spark.createDataFrame(log, MOVE)).collect()}
    assert (got[7].state, got[7].accepted, got[7].forbidden, got[7].bad_state, got[7].missing_reason) == ("PENDING_PLANNER_REVIEW", 3, 1, 2, 1)
    assert got[8].accepted == 1


def test_one_delivery_settles_several_debts_once(spark):
    q = "decimal(14,4)"
    owed = spark.sql(f"SELECT cast(id AS long) id, cast(5 AS long) donor_id, id created_at, cast(b AS {q}) qty_borrowed, cast(r AS {q}) qty_repaid, s status FROM VALUES (1, 10, 4, 'Open'), (2, 5, 0, 'Open'), (3, 9, 0, 'Cancelled'), (4, 3, 0, 'Open') AS t(id, b, r, s)")
    located = spark.sql(f"SELECT cast(5 AS long) line_id, cast(9 AS {q}) located")
    got = {r.id: (r.applied, r.outstanding, r.status) for r in swaps.repay_swaps(owed, located).collect()}
    assert got == {1: (6.0, 0.0, "Repaid"), 2: (3.0, 2.0, "Partially Repaid")}


def test_correction_that_would_leave_less_than_nothing_is_refused(spark):
    q = "decimal(14,4)"
    rows = [(1, 1, date(2024, 1, 1), "CONFIRM_AVAILABLE", 10), (2, 1, date(2024, 1, 2), "ISSUE_FROM_AVAILABLE", 4)]
    log = spark.createDataFrame(rows, "id long, line_id long, day date, action string, quantity long").withColumn("quantity", F.col("quantity").cast(q))
    got = {r.day.day: r for r in swaps.plan_corrections(log).collect()}
    assert "available below zero" in got[1].refused_because and got[2].refused_because == "" and got[2].available == 10.0
