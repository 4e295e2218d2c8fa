"""Requests are folded by material, and by components only in materials that are too large for one fold."""

from reqledger.operators import borrow

Q = ("qty_requested", "qty_issued", "qty_available", "qty_active_bagged")


def test_materials_and_components_agree(spark, monkeypatch):
    size = "CASE id % 3 WHEN 0 THEN '1' WHEN 1 THEN NULL ELSE '' END"  # no size is an empty one
    lines = spark.sql(f"SELECT cast(id AS long) line_id, 'A' commodity_code, {size} size, 'EA' uom, " + ", ".join(f"cast({x} AS decimal(14,4)) {n}" for n, x in zip(Q, ("12", "0", "id % 7", "0"), strict=True)) + " FROM range(60)")
    asked = spark.sql("SELECT cast(id AS long) id, cast(id * 37 % 101 AS long) asked_at, cast(id * 7 % 61 AS long) donor_id, cast(id * 11 % 60 AS long) receiver_id, cast(if(id % 9 = 0, NULL, id % 4) AS decimal(14,4)) quantity FROM range(400)")
    rows = lambda df: sorted(df.collect())
    parted = rows(borrow.plan_swaps(asked, lines, large=1))
    mixed = rows(borrow.plan_swaps(asked, lines, large=120))

    def never(_):
        raise AssertionError("components of small materials")

    monkeypatch.setattr(borrow, "components", never)
    key = lambda r: (r.id, r.donor_id, r.receiver_id, r.quantity is None, r.code)
    whole = rows(borrow.plan_swaps(asked, lines))
    assert len(whole) == 400 and [key(r) for r in whole] == [key(r) for r in parted] == [key(r) for r in mixed]
    assert {r.code for r in whole} >= {"OK", "NOTHING_TO_LEND", "LIMIT_EXCEEDED", "NOT_SHORT", "LEDGER_RULE", "NOT_FOUND", "INCOMPATIBLE"} - {"NOT_SHORT"}
