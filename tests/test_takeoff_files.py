"""The takeoff form: packed files, sheets left out, and the mark of sheets without rows."""

from pathlib import Path

from reqledger.sources import sheets


def test_packed_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("a", "VALVES", "D-1"), ("b", "SUPPORTS", "D-2"), ('say "x"', "PIPE & FITTINGS", "D-1")], "description string, takeoff_sheet string, line_number string")
    for n, given in enumerate((rows, rows.limit(0), rows.filter("takeoff_sheet = 'SUPPORTS'"))):
        path = f"{tmp_path}/{n}"
        sheets.write_takeoff(given, path, without=("SUPPORTS",))
        files = [f for f in Path(path).rglob("part-*")]
        assert files and all(f.name.endswith(".csv.gz") for f in files)
        got = {r.on_sheet: (r.rows, r.drawings) for r in sheets.read_takeoff(spark, path).collect()}
        want = dict.fromkeys(sheets.TAKEOFF_SHEETS, 0) | ({"COMBINED": 2, "VALVES": 1, "PIPE & FITTINGS": 1} if n == 0 else {})
        assert {k: v[0] for k, v in got.items()} == want and got["SUPPORTS"][0] == 0
        assert sorted(r.description for r in sheets.read_takeoff_rows(spark, path).filter("on_sheet = 'COMBINED'").collect()) == (["a", 'say "x"'] if n == 0 else [])
