"""Sheets and manifests as files: exports of quoted text, takeoff sheets, manifests of runs, and tables written for reuse in the shared folder."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.streams import shared_root

# Sheets of the takeoff form, in its order, and its columns.
TAKEOFF_SHEETS = ("COMBINED", "BLINDS", "PIPE & FITTINGS", "BOLTS & GASKETS", "SUPPORTS", "VALVES", "BIRDSCREENS", "OTHER MATERIALS")
FORM = ("cwa", "iwp", "line_number", "sheet", "pipe_spec", "description", "size", "commodity_code", "quantity", "uom", "epic_paint_code", "cust_paint_code", "color")
NOTHING = "(nothing on this package)"


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder and read again: later steps read them there, and a lost executor loses nothing of them."""
    path = fresh(rows.sparkSession, "stored")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_export(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a sheet as text: quotes, doubled quotes and line breaks in cells are kept, headings trimmed, rows without any
    text dropped. A column or a sheet that is not there is empty. A file is read by one task, as cells may hold line breaks; files are read apart."""
    try:
        found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    held = {c.strip(): c for c in found.columns}
    cells = found.select(*[(F.col(f"`{held[c]}`") if c in held else F.lit(None).cast("string")).alias(c) for c in columns])
    return cells.filter(F.exists(F.array(*columns), lambda x: F.trim(x) != ""))


def write_takeoff(rows: DataFrame, path: str, without: tuple[str, ...] = ()) -> None:
    """Each row under the sheets it is on (COMBINED and its own), a folder for each sheet, all cells quoted, files packed by gzip; sheets without rows hold a line that says so.
    Rows whose own sheet is one of `without` are left out; that is asked of the exploded rows, so that a row's sheet is worked out once. Which sheets have rows is told by their folders."""
    spark, own = rows.sparkSession, F.col("takeoff_sheet")
    place = lambda on: F.struct(on.alias("on_sheet"), own.alias("own"))
    cells = rows.select(F.explode(F.array(place(F.lit("COMBINED")), place(own))).alias("place"), *[(F.col(c).cast("string") if c in rows.columns else F.lit("")).alias(c) for c in FORM])
    form = spark.createDataFrame([(s,) for s in TAKEOFF_SHEETS], "on_sheet string")
    wanted = cells.filter(~F.col("place.own").isin(*without)) if without else cells
    write = lambda df, mode: df.write.mode(mode).partitionBy("on_sheet").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").option("compression", "gzip").csv(path)
    write(wanted.select("place.on_sheet", *FORM), "errorifexists")
    files = spark.read.format("binaryFile").load(path)
    there = files.select("on_sheet").distinct() if "on_sheet" in files.columns else form.limit(0)
    empty = form.join(there, "on_sheet", "left_anti").select("on_sheet", *[F.lit(NOTHING if c == "cwa" else "").alias(c) for c in FORM])
    write(empty, "append")


def _empty() -> Column:
    """The line of a sheet without rows: its mark and nothing else, so that an area of that name is still a row."""
    blank = [F.coalesce(c, F.lit("")) == "" for c in FORM if c != "cwa"]
    return reduce(lambda x, y: x & y, blank, F.col("cwa").eqNullSafe(NOTHING))


def read_takeoff_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows as they were written, cell by cell."""
    found = spark.read.schema(", ".join(f"{c} string" for c in (*FORM, "on_sheet"))).option("header", True).csv(path).filter(~_empty())
    return found.select("on_sheet", *[F.coalesce(c, F.lit("")).alias(c) for c in FORM])


def read_takeoff(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each sheet that write_takeoff wrote; 0 for a sheet with nothing on it."""
    found = spark.read.schema(", ".join(f"{c} string" for c in (*FORM, "on_sheet"))).option("header", True).csv(path)
    return found.groupBy("on_sheet").agg(F.count_if(~_empty()).alias("rows"), F.countDistinct("line_number").alias("drawings"))


def write_manifests(materials: DataFrame, reasons: DataFrame, path: str) -> None:
    """One JSON record for each run (a page's scan): its package, metrics, and rows and doubtful rows of each drawing. Records are only added."""
    doubts = materials.join(reasons.filter("reasons <> ''").select("row_id", F.lit(1).alias("doubt")), "row_id", "left")
    isos = doubts.groupBy(F.col("page").alias("run_id"), "drawing").agg(F.count("*").alias("rows"), F.count("doubt").alias("review_rows"))
    runs = isos.groupBy("run_id").agg(F.struct(F.sum("rows").alias("rows"), F.sum("review_rows").alias("review_rows")).alias("metrics"), F.array_sort(F.collect_list(F.struct("drawing", "rows", "review_rows"))).alias("isos"))
    package = F.concat(F.lit("PK-"), (F.col("run_id") % 20).cast("string"))
    runs.select(F.lit(1).alias("schema_version"), "run_id", package.alias("package_number"), "metrics", "isos").write.mode("append").json(path)


def manifest_history(spark: SparkSession, path: str) -> DataFrame:
    """Runs, drawings, rows and the share of doubtful rows of each package over all its manifests."""
    schema = "schema_version int, run_id long, package_number string, metrics struct<rows: long, review_rows: long>, isos array<struct<drawing: string, rows: long, review_rows: long>>"
    each = spark.read.schema(schema).json(path).select("package_number", "run_id", F.explode_outer("isos").alias("iso"))
    out = each.groupBy("package_number").agg(F.countDistinct("run_id").alias("runs"), F.countDistinct("iso.drawing").alias("drawings"), F.sum("iso.rows").alias("rows"), F.sum("iso.review_rows").alias("review_rows"))
    return out.withColumn("review_rate", F.round(F.col("review_rows") / F.col("rows"), 4))
