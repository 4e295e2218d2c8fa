"""Drawing packages: triage of pages, review of material rows, takeoff rows; and permissions of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normalize as N

# Phrases that tell page classes, in the order they are tried; permissions of the named profiles.
COVERS = ("INSTALLATION WORK PACKAGE", "ISSUED TO CONSTRUCTION", "ISSUED FOR CONSTRUCTION", "JSAS FOR THIS IWP", "JSA'S FOR THIS IWP", "JSA FOR THIS IWP")
WELD_LOG = ("SECTION 15117", "FABRICATION OF METALLIC PIPE AND TUBING", "ATTACHMENT A - WELD/BRAZE LOG SHEET")
PIPE_SUPPORT = ("PIPE HANGERS AND SUPPORTS", "ATTACHMENT C")
IWP_VALUE = r"(?i)\b[A-Z]{2}-[A-Z0-9]+(?:-[A-Z0-9]+){1,}\b"
FEWEST_CHARACTERS = 40
VIEWS = ("EAST SIDE", "LOOKING EAST", "LOOKING NORTH", "LOOKING SOUTH", "LOOKING WEST", "NORTH SIDE", "SOUTH SIDE", "WEST SIDE")
DOUBT_ERRORS = ("missing_quantity", "missing_description")
SAFE = ("pipe_support", "weld_log", "logistics", "attachment", "iso")
#: A run of image pages is no longer than this, and each has at most so many characters of text.
LONGEST_RUN, SPARSE = 6, 80
FLAGS = ("search", "field_transact", "admin_backorder", "owner_edit", "plan_review", "assign_number")
PROFILES = {"READ_ONLY": "100000", "FIELD": "110000", "PLANNER": "100010", "ADMIN": "101001", "OWNER": "111111"}


def classify_pages(pages: DataFrame) -> DataFrame:
    """The class of each page: the first rule that holds. What no rule takes is quarantined under a code."""
    text = F.trim(F.regexp_replace(F.upper("text"), r"\s+", " "))
    rows = pages.withColumn("plain", text)
    has = lambda p: F.col("plain").contains(p)
    every = lambda ps: F.forall(F.array(*map(F.lit, ps)), has)
    some = lambda ps: F.exists(F.array(*map(F.lit, ps)), has)
    iso = has("ISOMETRIC DRAWING NUMBER") & has("BILL OF MATERIALS")
    squeezed = F.replace(F.col("plain"), F.lit(" "), F.lit(""))
    kind = (
        F.when(F.length(F.trim("text")) < FEWEST_CHARACTERS, "ocr_required").when(iso, "iso").when(some(COVERS) & (has("IWP NUMBER") | F.col("text").rlike(IWP_VALUE)), "cover")
        .when(every(WELD_LOG), "weld_log").when(every(PIPE_SUPPORT), "pipe_support").when(has("FIELD MATERIAL REQUEST"), "attachment").when(has("LOGISTICS PLAN"), "logistics")
        .when(squeezed.contains("ISOSINPROCESSING") & squeezed.contains("ISOREVWORKFLOWSTATUS"), "workflow_status").when(has("INSTALLATION WORK PACKAGE"), "iwp_cover_ambiguous")
        .when(has("ISOMETRIC DRAWING NUMBER") | has("BILL OF MATERIALS"), "partial_iso_structure").otherwise("unrecognized_page")
    )
    return rows.select("page_id", kind.alias("kind"))


def page_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("kind").agg(F.count("*").alias("pages"))


def material_review(rows: DataFrame) -> DataFrame:
    """Reasons, sorted, for which a person must look at a material row; a point number that a page has twice is one."""
    repeated = rows.groupBy("page", "point").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    both = rows.join(repeated, ["page", "point"])
    missing = {f"missing_{c}": F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in ("description", "nominal_size", "commodity_code", "quantity")}
    rules = missing | {"duplicate_bom_point_number": F.col("row_id") != F.col("first")}
    found = F.array_sort(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()))
    return both.select("row_id", F.array_join(found, ",").alias("reasons"))


def takeoff_rows(materials: DataFrame) -> DataFrame:
    """Rows of the takeoff form: sheet off the end of the drawing, pipe in feet without its mark, all else by the piece."""
    kind = N.item_type(F.col("description"), F.col("commodity_code"))
    feet = r"^\s*([\d.]+)\s*'?\s*$"
    plain = F.trim(F.coalesce("quantity", F.lit("")))
    rows = materials.withColumn("item_type", kind)
    amount = F.when((F.col("item_type") == "PIPE") & plain.rlike(feet), F.regexp_extract(plain, feet, 1)).otherwise(plain)
    return rows.select(
        "row_id", *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("cwa", "cwa"), ("iwp", "iwp"), ("description", "description"), ("nominal_size", "size"), ("commodity_code", "commodity_code"))], F.col("drawing").alias("line_number"), F.regexp_extract("drawing", r"-(\d{1,2})\s*$", 1).alias("sheet"), F.coalesce("schedule", F.lit("")).alias("pipe_spec"), amount.alias("quantity"),
        F.when(F.col("item_type") == "PIPE", "LF").otherwise("EA").alias("uom"), "item_type", N.takeoff_sheet(F.col("item_type"), F.col("description"), F.col("commodity_code")).alias("takeoff_sheet"),
    )


def on_sheets(rows: DataFrame) -> DataFrame:
    """Every takeoff row on the combined sheet and on its own."""
    return rows.select("row_id", F.explode(F.array(F.lit("COMBINED"), F.col("takeoff_sheet"))).alias("on_sheet"), "item_type", "quantity")


def takeoff_counts(rows: DataFrame) -> DataFrame:
    """Rows and drawings of each sheet, and pipe that cannot be ordered for want of a schedule."""
    return rows.groupBy("takeoff_sheet").agg(F.count("*").alias("rows"), F.countDistinct("line_number").alias("drawings"), F.count_if((F.col("item_type") == "PIPE") & (F.col("pipe_spec") == "")).alias("missing_pipe_spec"))


def member_profiles(members: DataFrame) -> DataFrame:
    """The named profile whose six permissions a member has; CUSTOM for any other set."""
    bits = F.concat(*[F.when(F.coalesce(f, F.lit(False)), "1").otherwise("0") for f in FLAGS])
    named = F.create_map(*[F.lit(x) for key, flags in PROFILES.items() for x in (flags, key)])
    return members.select("user_id", "project_id", F.coalesce(F.try_element_at(named, bits), F.lit("CUSTOM")).alias("profile"))


def permission_audit(projects: DataFrame, members: DataFrame) -> DataFrame:
    """Active owners of every project; a project with fewer than two is at risk."""
    owners = members.filter("active and owner_edit").groupBy("project_id").agg(F.count("*").alias("owners"))
    out = projects.select("project_id").distinct().join(owners, "project_id", "left").na.fill(0, ["owners"])
    return out.withColumn("at_risk", F.col("owners") < 2)


def image_runs(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """Short runs of pages that are one image each, and whether the run is an approved attachment: a page of a known class stands on both sides,
    and either the run names a view or one of those pages is a pipe support. pages has package_id, page, page_id, text and images."""
    lone = pages.filter((F.length(F.trim(F.coalesce("text", F.lit("")))) <= SPARSE) & (F.col("images") == 1))
    within = Window.partitionBy("package_id").orderBy("page")
    runs = lone.withColumn("island", F.col("page") - F.row_number().over(within))
    short = runs.withColumn("n", F.count("*").over(Window.partitionBy("package_id", "island"))).filter(F.col("n") <= LONGEST_RUN)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    named = short.groupBy("package_id", "island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.upper(F.regexp_replace(told, r"\s+", " ")).alias("told"))
    kinds = pages.select("package_id", "page", "page_id").join(classes, "page_id")
    left = kinds.select("package_id", (F.col("page") + 1).alias("first_page"), F.col("kind").alias("before"))
    right = kinds.select("package_id", (F.col("page") - 1).alias("last_page"), F.col("kind").alias("after"))
    out = named.join(left, ["package_id", "first_page"], "left").join(right, ["package_id", "last_page"], "left")
    view = F.exists(F.array(*map(F.lit, VIEWS)), lambda m: F.contains(F.col("told"), m))
    approved = F.col("before").isin(*SAFE) & F.col("after").isin(*SAFE) & (view | (F.col("before") == "pipe_support") | (F.col("after") == "pipe_support"))
    return out.select("package_id", "first_page", "last_page", "before", "after", F.coalesce(approved, F.lit(False)).alias("approved"))


def row_modes(rows: DataFrame) -> DataFrame:
    """Which modes of a scan keep a material row: without pipe (as by default), with pipe, and pipe only. The mode of spools alone keeps none."""
    pipe = F.coalesce(F.col("description"), F.lit("")).rlike(N.PIPE)
    return rows.select("row_id", (~pipe).alias("by_default"), F.lit(True).alias("include_pipe"), pipe.alias("pipe_only"), F.lit(False).alias("spools_only"))


def group_drawings(rows: DataFrame, reasons: DataFrame, drawings: DataFrame) -> DataFrame:
    """Issues of the drafts that drawings become: each doubt about a material row, at its line and point, an error where quantity or description
    is missing; a drawing without material; and that every draft lacks its number. reasons has row_id and a comma-joined list."""
    placed = rows.withColumn("line_number", F.row_number().over(Window.partitionBy("drawing").orderBy("row_id")).cast("long"))
    doubts = placed.join(reasons, "row_id").select("drawing", "line_number", F.col("point").cast("string").alias("source_row"), F.explode(F.split("reasons", ",")).alias("reason")).filter("reason <> ''")
    by_row = doubts.select("drawing", "line_number", "source_row", F.upper("reason").alias("code"), F.when(F.col("reason").isin(*DOUBT_ERRORS), "error").otherwise("warning").alias("severity"))
    every = drawings.select("drawing").union(rows.select("drawing")).distinct()
    about = lambda df, code, severity: df.select("drawing", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(code), F.lit(severity))
    empty = every.join(rows.select("drawing").distinct(), "drawing", "left_anti")
    return by_row.union(about(empty, "NO_MATERIAL", "error")).union(about(every, "NEEDS_FMR_NUMBER", "warning"))
