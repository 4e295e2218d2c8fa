"""The field log, borrowing and components on small hand-made tables, and a line with very many commands."""

import random

import pytest

from reqledger.operators import borrow, fieldlog
from reqledger.operators.components import components

LOG = "id long, line_id long, ts long, action string, quantity decimal(14,4), tag string, place string, issued_to string, notes string, requested decimal(14,4)"


def log(spark, *commands, requested=100):
    from decimal import Decimal

    rows = [(i, 7, i, a, None if q is None else Decimal(q), tag, "RACK", "crew", notes, Decimal(requested)) for i, (a, q, tag, notes) in enumerate(commands, 1)]
    return fieldlog.replay_full(spark.createDataFrame(rows, LOG))


def rows(replayed, kind):
    return [tuple(r) for r in fieldlog.part(replayed, kind).orderBy("id" if kind not in ("line", "bag") else "line_id").collect()]


def test_pending_backorders_lock_and_bags_locate(spark):
    told = log(spark, ("BACKORDER_REQUESTED", 30, None, "why"), ("CONFIRM_AVAILABLE", 80, None, ""), ("CONFIRM_AVAILABLE", 30, None, ""), ("BAG", 50, "B1", ""), ("ISSUE_FROM_BAG", 50, "B1", ""), ("BAG", 1, "B1", ""), ("ISSUE_FROM_BAG", 1, "B2", ""), ("DIRECT_ISSUE", 0, None, ""), ("UNDO", 1, None, ""))
    assert rows(told, "refusal") == [(7, 2, "CONFIRM_AVAILABLE", "LIMIT_EXCEEDED"), (7, 6, "BAG", "BAG_CLOSED"), (7, 7, "ISSUE_FROM_BAG", "NOT_FOUND"), (7, 8, "DIRECT_ISSUE", "LEDGER_RULE"), (7, 9, "UNDO", "BAD_ACTION")]
    # 30 located settles the whole request; the bag then finds 20 more.
    assert rows(told, "request") == [(7, 1, None, "Fulfilled", 0.0, 0.0, False)]
    assert rows(told, "line") == [(7, "Partially Issued", 50.0, 0.0, 0.0, 50.0, 0.0, 0.0, 4, 5)]
    assert rows(told, "bag") == [(7, "B1", 50.0, 50.0, "Closed")]


def test_a_returned_request_is_answered_by_asking_again(spark):
    told = log(spark, ("BACKORDER_REQUESTED", 60, None, "why"), ("OFFICE_RETURN", None, None, ""), ("OFFICE_RETURN", None, None, "heat number?"), ("BACKORDER_REQUESTED", 60, None, "it is 7"))
    assert rows(told, "refusal") == [(7, 2, "OFFICE_RETURN", "MISSING_FIELD")]
    assert rows(told, "request") == [(7, 1, None, "Pending", 0.0, 60.0, True)]
    assert rows(told, "notice") == [(7, 3, 1, "RETURNED", 60.0, 60.0, "Resolved")]


def test_partial_decisions_split_and_notify(spark):
    told = log(spark, ("BACKORDER_REQUESTED", 40, None, "why"), ("OFFICE_CONFIRM", 10, None, ""), ("OFFICE_RETURN", 10, None, "detail?"), ("OFFICE_REJECT", 20, None, ""), ("OFFICE_REJECT", 99, None, ""), ("DIRECT_ISSUE", 15, None, ""))
    # The confirmed 10 and nothing else is left on the first; what was returned waits on its own row, with its own notice.
    assert rows(told, "request") == [(7, 1, None, "Fulfilled", 0.0, 0.0, False), (7, 3, 1, "Returned for Review", 0.0, 10.0, True)]
    assert rows(told, "notice") == [(7, 2, 1, "CONFIRMED", 10.0, 0.0, "Superseded"), (7, 3, 3, "RETURNED", 10.0, 0.0, "Active"), (7, 4, 1, "REJECTED", 20.0, 15.0, "Active")]
    assert rows(told, "refusal") == [(7, 5, "OFFICE_REJECT", "LIMIT_EXCEEDED")]


def test_a_hot_line_is_carried_from_batch_to_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "300")
    try:
        n = 20_000
        hot = spark.range(n).selectExpr("id", "cast(if(id % 3 = 0, id, 1) as long) line_id", "id ts", "element_at(array('CONFIRM_AVAILABLE', 'DIRECT_ISSUE'), cast(id % 2 + 1 as int)) action", "cast(1 as decimal(14,4)) quantity", "'' tag", "'RACK' place", "'crew' issued_to", "'' notes", "cast(9000 as decimal(14,4)) requested")
        told = fieldlog.part(fieldlog.replay_full(hot), "line").filter("line_id = 1").collect()[0]
        assert (told.accepted, told.located) == (9000, 9000.0) and told.accepted + told.refused == n - len(range(0, n, 3))
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(9999, 9999)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}


def test_competing_borrowers(spark):
    lines = spark.sql("SELECT cast(line_id AS long) line_id, code commodity_code, '1\"' size, 'EA' uom, " + ", ".join(f"cast({c} AS decimal(14,4)) {c}" for c in ("qty_requested", "qty_issued", "qty_available", "qty_active_bagged", "qty_confirmed_located", "qty_pending_backorder", "qty_confirmed_backorder")) + " FROM VALUES "
                      "(1, 'A', 20, 0, 10, 0, 10, 0, 0), (2, 'A', 8, 0, 0, 0, 0, 0, 0), (3, 'A', 9, 0, 0, 0, 0, 0, 0), (4, 'B', 5, 0, 5, 0, 5, 0, 0) AS t(line_id, code, qty_requested, qty_issued, qty_available, qty_active_bagged, qty_confirmed_located, qty_pending_backorder, qty_confirmed_backorder)")
    asked = spark.sql("SELECT cast(id AS long) id, cast(id AS long) asked_at, cast(d AS long) donor_id, cast(r AS long) receiver_id, cast(q AS decimal(14,4)) quantity FROM VALUES (1, 1, 2, 6), (2, 1, 3, 5), (3, 1, 3, 4), (4, 1, 3, 1), (5, 4, 3, 1), (6, 2, 2, 1), (7, 1, 99, 1), (8, 1, 2, 0), (9, 1, 2, 1) AS t(id, d, r, q)")
    swaps = borrow.plan_swaps(asked, lines)
    assert {r.id: r.code for r in swaps.collect()} == {1: "OK", 2: "LIMIT_EXCEEDED", 3: "OK", 4: "NOTHING_TO_LEND", 5: "INCOMPATIBLE", 6: "SAME_LINE", 7: "NOT_FOUND", 8: "LEDGER_RULE", 9: "NOTHING_TO_LEND"}
    assert {r.line_id: (r.available, r.issued, r.line_status) for r in borrow.after(swaps, lines).collect()} == {1: (0.0, 0.0, "Open"), 2: (0.0, 6.0, "Partially Issued"), 3: (0.0, 4.0, "Partially Issued")}
    assert borrow.movements(swaps).selectExpr("sum(quantity)", "count(*)").first()[:] == (0.0, 4)
