"""A term meets a line once, whichever way it finds it, and matches are not shuffled by line."""

import re

from reqledger.operators import search


def test_matches_are_not_shuffled_by_line(spark):
    lines = spark.sql("SELECT cast(id AS long) line_id, id % 3 req_id, cast(id AS int) line_number, if(id = 5, NULL, 'd-1') iso_number, '01' iso_sheet, true active FROM range(8)")
    heads = spark.sql("SELECT cast(id AS long) req_id, if(id = 0, 'D-1-01', concat('x', id)) req_number FROM range(3)")
    terms = spark.sql("SELECT * FROM VALUES ('d-1-01'), ('D-1'), ('d-1'), ('X1'), ('nothing'), ('D-1|01') AS t(term)")
    got = search.search_lines(terms, lines, heads, limit=5)
    found = {}
    for r in got.collect():
        found.setdefault((r.term, r.matches, r.truncated), []).append((r.place, r.line_id))
    assert {k: [i for _, i in sorted(v)] for k, v in found.items()} == {
        ("d-1-01", 7, True): [0, 3, 6, 1, 4], ("D-1", 7, True): [0, 3, 6, 1, 4], ("d-1", 7, True): [0, 3, 6, 1, 4], ("X1", 3, False): [1, 4, 7], ("D-1|01", 7, True): [0, 3, 6, 1, 4]}
    assert not re.search(r"hashpartitioning\([^)]*line_id", got._jdf.queryExecution().toString())
