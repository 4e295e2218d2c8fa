"""Lines of the former system are judged once; requests read what was written."""

from reqledger.operators import legacy


def test_lines_are_read_once(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('L1', 'F1'), ('L2', 'F9'), ('L3', NULL), ('L1', 'F1') AS t(line_id, fmr_id)").write.parquet(f"{tmp_path}/given_lines")
    headers = spark.sql("SELECT * FROM VALUES ('F1'), ('F1'), ('F2') AS t(fmr_id)")
    requests = spark.sql("SELECT * FROM VALUES ('R1', 'F1', 'L1'), ('R2', 'F1', 'L2'), ('R3', 'F9', 'L1') AS t(request_id, fmr_id, line_id)")
    got = legacy.resolve_ids(headers, spark.read.parquet(f"{tmp_path}/given_lines"), requests)
    assert sorted((r.sheet, r.old_id, r.orphan) for r in got.collect()) == [("headers", "F1", False), ("headers", "F1", False), ("headers", "F2", False), ("lines", "L1", False), ("lines", "L1", False), ("lines", "L2", True), ("lines", "L3", True), ("requests", "R1", False), ("requests", "R2", True), ("requests", "R3", True)]
    assert "given_lines" not in got._jdf.queryExecution().toString()
