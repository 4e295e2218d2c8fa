"""The reference's checks that look across tables, on small hand-made tables."""

from reqledger.operators import integrity

LINE = "line_id long, project_id string, active boolean, qty_requested double, qty_issued double, qty_confirmed_located double, qty_pending_backorder double, qty_confirmed_backorder double"


def found(rows):
    return {r.entity_id: r.difference for r in rows.collect()}


def test_issued_history_nets_corrections_and_reversals(spark):
    lines = spark.createDataFrame([(i, "P", i != 5, 10.0, 4.0, 4.0, 0.0, 0.0) for i in range(1, 6)], LINE)
    log = [(1, "DIRECT_ISSUE", 6.0), (1, "CORRECTION_DIRECT_ISSUE", -2.0), (2, "ISSUE_FROM_BAG", 6.0), (2, "REVERSAL_ISSUE_FROM_BAG", 2.0), (3, "ISSUE_FROM_AVAILABLE", 4.0), (3, "ISSUE_FROM_AVAILABLE", 4.0), (3, "BAG", 9.0)]
    assert found(integrity.issued_history(lines, spark.createDataFrame(log, "line_id long, action string, quantity double"))) == {3: -4.0, 4: 4.0}


def test_backorder_ledger_does_not_net_its_two_totals(spark):
    lines = spark.createDataFrame([(1, "P", True, 9.0, 0.0, 0.0, 3.0, 1.0), (2, "P", True, 9.0, 0.0, 0.0, 1.0, 3.0)], LINE)
    asked = spark.createDataFrame([(1, 3.0, 1.0, True), (2, 3.0, 1.0, True), (1, 5.0, 0.0, False)], "line_id long, qty_pending double, qty_confirmed double, active boolean")
    assert found(integrity.backorder_ledger(lines, asked)) == {2: 4.0}


def test_status_that_contradicts_quantities(spark):
    lines = spark.createDataFrame([(1, "P", True, 9.0, 4.0, 4.0, 0.0, 0.0), (2, "P", True, 9.0, 0.0, 2.0, 0.0, 0.0), (3, "P", True, 9.0, 9.0, 9.0, 0.0, 0.0), (4, "P", True, 9.0, 9.0, 9.0, 0.0, 0.0)], LINE)
    stored = spark.createDataFrame([(1, "Issued"), (2, "Open"), (3, "Located"), (4, "Issued")], "line_id long, line_status string")
    assert found(integrity.status(lines, stored)) == {1: 5.0, 2: 9.0, 3: 0.0}
