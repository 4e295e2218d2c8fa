"""Files that are missing or odd, chains of splits, and cells that hold nothing."""

import pytest
from pyspark.sql import functions as F

from reqledger.functions import cells
from reqledger.operators import office, staging, words
from reqledger.sources import sheets


def test_a_missing_sheet_is_empty(spark, tmp_path):
    got = sheets.read_export(spark, str(tmp_path / "none.csv"), ["a", "b"])
    assert got.columns == ["a", "b"] and got.count() == 0


def test_cells_keep_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('" a ",b\n"say ""hi"", now","two\nlines"\n" ",\n')
    assert [tuple(r) for r in sheets.read_export(spark, str(tmp_path / "x.csv"), ["a", "b"]).collect()] == [('say "hi", now', "two\nlines")]


def test_long_chains_of_splits(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 1.0) for i in range(40)], "id long, split_from_id long, qty_requested double")
    got = {r.id: (r.root_id, r.depth, r.requests) for r in office.split_lineage(chain).collect()}
    assert got == {i: (0, i, 40) for i in range(40)}
    assert office.split_lineage(chain.limit(0)).count() == 0


def test_cells_without_anything(spark):
    row = spark.createDataFrame([(None,), ("",)], "x string").select(cells.number(F.col("x")).alias("n"), cells.yes(F.col("x")).alias("y"), cells.uuid(F.col("x")).alias("u"), cells.size_from_date(F.col("x")).alias("s"), cells.iso_date(F.col("x")).alias("d")).collect()
    assert [tuple(r) for r in row] == [(0.0, False, None, None, None)] * 2


def test_the_last_arrival_holds(spark):
    stored = spark.createDataFrame([("a", 1, 9), ("b", 2, 9)], "k string, v int, at int")
    arrived = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("c", 5, 1)], "k string, v int, at int")
    assert sorted(tuple(r) for r in staging.upsert(stored, arrived, ["k"], ["at"]).collect()) == [("a", 4, 2), ("b", 2, 9), ("c", 5, 1)]


@pytest.mark.parametrize(("tops", "lines"), [([0.0, 5.0, 10.0], [1, 1, 2]), ([0.0, 4.0, 8.0, 9.0], [1, 1, 2, 2])])
def test_a_line_is_held_by_its_first_word(spark, tops, lines):
    placed = spark.createDataFrame([(1, i, 0.0, t) for i, t in enumerate(tops)], "page_id long, word_id long, x0 double, top double")
    assert [r.line for r in words.line_grouping(placed).orderBy("word_id").collect()] == lines
