"""Header fields of sheets and rows of drawing lists on small hand-made inputs."""

from reqledger.operators import bom, grids
from reqledger.operators.words import line_grouping


def sheet(spark, *rows, name="FMR 1", sheet_id=1):
    return spark.createDataFrame([(sheet_id, name, i, r) for i, r in enumerate(rows)], "sheet_id long, sheet_name string, row int, cells_text string")


def fields(df):
    return {r.field: (r.value, r.place) for r in df.collect()}


def test_values_beside_below_and_within_their_labels(spark):
    grid = sheet(spark, "FIELD MATERIAL REQUEST", "FMR No:;SHT:;;FMR-7;IWP: IP-30", "Drawing No;;;", "D-100;Craft\nPipe;Rev = 2", "Priority;Need By:;", "Item;Description;Qty;Store", "1;PIPE;3;W9")
    got = fields(grids.labeled_values(grid))
    # A label is no value; what stands three cells on is. A table heading of a field's name is the last resort.
    assert got["fmr_number"] == ("FMR-7", "label") and got["iwp_number"] == ("IP-30", "label") and got["iso_number"] == ("D-100", "label") and got["craft"] == ("Pipe", "label")
    assert got["iso_revision"] == ("2", "label") and got["warehouse"] == ("W9", "column")


def test_sheets_in_are_sheets_out_and_rejects(spark):
    good = sheet(spark, "FMR No;5;ISO No;d 1", "Item;Description;Qty", "1;PIPE;3", sheet_id=1)
    bare = sheet(spark, "FMR No;6", "nothing;here", sheet_id=2)
    empty = sheet(spark, "FMR No;7;ISO No;D-2", "Item;Description;Qty", ";;", sheet_id=3)
    skipped = sheet(spark, "FMR No;8", name="Legend", sheet_id=4)
    out = grids.extract_corpus(good.union(bare).union(empty).union(skipped))
    assert {r.sheet_id: (r.iso_number, r.iso_sheet, r.lines, r.rejected_for) for r in out.collect()} == {1: ("D-1", "01", 1, ""), 2: (None, "01", 0, "MISSING_HEADER:iso_number,NO_TABLE"), 3: ("D-2", "01", 0, "NO_LINES")}
    assert sorted((r.sheet_id, r.code, r.field) for r in grids.rejects(out).collect()) == [(2, "MISSING_HEADER", "iso_number"), (2, "NO_TABLE", ""), (3, "NO_LINES", "")]


def words(spark, *lines):
    rows = [(1, 100 * i + j, float(x), float(top), text) for i, (top, line) in enumerate(lines) for j, (x, text) in enumerate(line)]
    return bom.placed(spark.createDataFrame(rows, "page_id long, word_id long, x0 double, top double, text string"))


def test_rows_of_a_list(spark):
    placed = words(
        spark, (10, [(10, "NO"), (60, "DESCRIPTION"), (200, "REMARKS")]), (20, [(10, "BILL"), (40, "OF"), (60, "MATERIALS")]), (30, [(10, "PT"), (100, "DESC"), (205, "SIZE"), (300, "QTY")]), (38, [(11, "NO")]), (50, [(10, "PIPE")]), (60, [(12, "1"), (40, "PIPE,"), (64, "SMLS"), (206, "6\""), (302, "29.5'")]),
        (70, [(42, "API"), (64, "5L")]), (80, [(10, "FLANGES")]), (85.5, [(42, "loose"), (84, "text")]), (95, [(12, "2"), (42, "FLANGE"), (206, "4\""), (270, "9"), (304, "2")]), (105, [(10, "ISSUED"), (60, "FOR"), (100, "CONSTRUCTION")]), (115, [(12, "3"), (42, "AFTER"), (302, "1")]),
    )
    edges = bom.column_edges(placed)
    assert {r.name: r.x for r in edges.collect()} == {"item_no": 10.0, "description": 100.0, "size": 205.0, "qty": 300.0}
    # The rule left of the description stands in the gap of the words, not half way between the headings.
    assert {r.name: r.x_from for r in edges.collect()}["description"] < 40
    got = {r.item_no: (r.category, r.description, r["size"], r.qty, r.lines) for r in bom.material_rows(placed, edges).collect()}
    assert got == {"1": ("PIPE", "PIPE, SMLS API 5L", '6"', "29.5'", 2), "2": ("FLANGES", "FLANGE", '4"', "2", 1)}
    assert {r.row_no: (r.quantity, r.note) for r in bom.pick_quantities(placed, edges).collect()}[1] == ("29.5'", "")


def test_heading_rows_meet_their_sheet_in_one_pass(spark):
    """No table of headings is joined to the rows, so none is sent whole to the driver, and the grid is read once."""
    grid = spark.createDataFrame([(1, "A", 0, "FMR No:;7"), (1, "A", 1, "Item;Qty;Description;#"), (1, "A", 2, "1;2;pipe;x"), (1, "A", 3, ";;total"), (1, "A", 4, "2;2;pipe;x")], "sheet_id long, sheet_name string, row int, cells_text string")
    for found, n in ((grids.labeled_values(grid), 1), (grids.extract_corpus(grid), 1), (grids.material_lines(grid), 1)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("LogicalRDD") == 1
        assert found.count() == n
    head = grids.header_rows(grid).first()
    assert (head.header_row, head.score, head.line_number, head.quantity) == (1, 3, 0, 1)


def test_placed_words_come_back_without_a_join(spark):
    """The text goes through the page's fold with its word, so all words of the pages are shuffled once."""
    rows = spark.createDataFrame([(1, i, float(i), 9.0 * (i // 2), f" w{i} ") for i in range(4)], "page_id long, word_id long, x0 double, top double, text string")
    lines = line_grouping(rows, carried=("text",))
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1 and "Join" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.word_id, r.text, r.x0, r.top, r.line) for r in bom.placed(rows).collect()) == [(i, f"w{i}", float(i), 9.0 * (i // 2), 1 + i // 2) for i in range(4)]
