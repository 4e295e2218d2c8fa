"""Donors are a short list by material: no pair of a line and a donor is shuffled."""

import re

from reqledger.operators import registers

Q = ("qty_requested", "qty_issued", "qty_available", "qty_active_bagged")


def test_pairs_are_not_shuffled(spark):
    lines = spark.sql("SELECT cast(id AS long) line_id, 'P' project_id, true active, if(id = 9, 'b ', ' B') commodity_code, '1' size, 'EA' uom, " + ", ".join(f"cast({x} AS decimal(14,4)) {n}" for n, x in zip(Q, ("10", "0", "least(id, 5)", "0"), strict=True)) + " FROM range(1, 10)")
    got = registers.donor_candidates(lines, most=3)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.receiver_id, []).append((r.place, r.donor_id))
    assert {k: [d for _, d in sorted(v)] for k, v in rows.items()} == {k: [d for d in (5, 6, 7, 8) if d != k][:3] for k in range(1, 10)}
    assert all([p for p, _ in sorted(v)] == [1, 2, 3] for v in rows.values())
    assert not re.search(r"hashpartitioning\(receiver_id", got._jdf.queryExecution().toString())
