"""Workbook sheets as rows of cells: where the material table begins, its lines and their issues, how a profile's headings fit, and headings worth learning.
Headings are matched within a row by array expressions, so a sheet is never multiplied by the aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normalize as N
from .decisions import READABLE_SIZE

# Fixed values of the baseline profile: headings of each field, words that end the table, words of headings that suggest a field (tried in this order).
COLUMNS = {
    "line_number": ("Item", "Item No", "Line", "No", "#"),
    "commodity_code": ("Commodity Code", "Commodity", "Cmdty", "Material Code", "Code", "Part No"),
    "size": ("Size", "NPS", "DN", "Dia", "Diameter"),
    "description": ("Description", "Material Description", "Material", "Desc"),
    "quantity": ("Qty", "Quantity", "Qty Req", "Qty Required", "Req Qty"),
    "uom": ("UOM", "Unit", "U/M", "Units"),
    "storage_location": ("Location", "Storage Location", "Bin", "Rack"),
}
STOPS = r"(?i)^(total|grand total|subtotal|end of)"
HINTS = {
    "quantity": ("QTY", "QUANT", "AMOUNT", "EACH", "COUNT", "REQD", "REQUIRED"),
    "description": ("DESC", "MATERIAL", "ITEM DESC", "NOMENCLATURE", "DETAIL"),
    "commodity_code": ("COMMODITY", "CMDTY", "CODE", "PART", "STOCK", "CATALOG", "IDENT"),
    "size": ("SIZE", "NPS", "DN", "DIA", "BORE", "NPD"),
    "uom": ("UOM", "UNIT", "U/M", "MEASURE"),
    "line_number": ("ITEM", "LINE", "NO", "SEQ", "MARK"),
    "storage_location": ("LOCATION", "BIN", "RACK", "SHELF", "STORE", "WHSE"),
}
ESSENTIAL = ("description", "quantity")
SEARCHED, BLANKS = 40, 3
#: Labels of the fields above a table, and those fields that a sheet must have; names of sheets that hold none (fixed values).
HEADER = {
    "fmr_number": ("FMR No", "FMR Number", "FMR #", "FMR"),
    "iwp_number": ("IWP No", "IWP Number", "IWP #", "IWP"),
    "iso_number": ("ISO No", "ISO Number", "Drawing No", "Drawing", "ISO"),
    "iso_sheet": ("Sheet", "Sht", "Sheet No", "ISO Sheet"),
    "iso_revision": ("Rev", "Revision"),
    "requested_by": ("Requested By", "Requestor", "Requested"),
    "date_required": ("Date Required", "Required Date", "Need By", "RAD"),
    "priority": ("Priority", "Urgency"),
    "destination": ("Destination", "Deliver To", "Delivery"),
    "warehouse": ("Warehouse", "Store", "Stores"),
    "craft": ("Craft", "Discipline"),
}
MUST_HAVE, DEFAULT_SHEET = ("fmr_number", "iso_number"), "01"
SKIPPED = r"(?i)^instructions|^notes$|^legend|^cover"
#: Rows above the table that are searched where there is none, and how far a value stands from its label.
HEADER_ROWS, RIGHT, BELOW = 30, 3, 2


def _squash(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def _is(fields: list[str], columns: dict) -> Callable[[Column], Column]:
    """Whether a heading without punctuation is one of the fields' own. Headings of punctuation alone have none of it left: _odd tells those."""
    squashed = sorted({s for f in fields for a in columns[f] if (s := "".join(c for c in a.upper() if c.isascii() and c.isalnum()))})
    return lambda n: n.isin(squashed)


def _odd(fields: list[str], columns: dict) -> list[str]:
    return sorted({t for f in fields for a in columns[f] if (t := a.strip().upper()) and not any(c.isascii() and c.isalnum() for c in t)})


def _first(fields: list[str], columns: dict) -> Column:
    """The first cell (from 1) of a row with one of the fields' headings, 0 without one."""
    plain, odd = F.array_position(F.transform("plain", _is(fields, columns)), True), _odd(fields, columns)
    if not odd:
        return plain
    marks = F.array_position(F.transform("cells", lambda c: F.upper(F.trim(c)).isin(odd)), True)
    return F.when((plain == 0) | (marks == 0), F.greatest(plain, marks)).otherwise(F.least(plain, marks))


def _placed(rows: DataFrame, columns: dict) -> DataFrame:
    """For each field at_field, the first cell (from 1) of a searched row whose heading is one of its own, 0 without one; and how many fields the row names. Most rows name none, so that is asked first. Headings of punctuation alone match themselves only."""
    every, odd = list(columns), _odd(list(columns), columns)
    some = F.exists("plain", _is(every, columns)) | (F.exists("cells", lambda c: F.upper(F.trim(c)).isin(odd)) if odd else F.lit(False))
    named = rows.withColumn("some", (F.col("row") < SEARCHED) & some)
    at = named.withColumns({f"at_{f}": F.when(F.col("some"), _first([f], columns)).otherwise(F.lit(0).cast("long")) for f in columns})
    return at.withColumn("matched", sum((F.when(F.col(f"at_{f}") > 0, 1).otherwise(0) for f in columns), F.lit(0)))


def _best(rows: DataFrame, score: Column, likely: Callable[[Column], Column], columns: dict) -> DataFrame:
    """The row of each sheet with the highest score, the first of equals, among the likely ones.

    Rows are picked within an array of one: a filter would be moved below the columns it reads and work them out twice. Few rows are left to be grouped."""
    kept = F.struct(score.alias("score"), "row", "matched", "filled", "cells", *[f"at_{f}" for f in columns])
    picked = rows.select("sheet_id", F.explode(F.filter(F.array(kept), likely)).alias("k"))
    return picked.groupBy("sheet_id").agg(F.max_by("k", F.struct("k.score", -F.col("k.row"))).alias("best")).select("sheet_id", "best.*")


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(c) != ""))


def with_cells(grid: DataFrame, *more: str) -> DataFrame:
    """Each row's cells, and its cells as headings are compared: upper case without punctuation, made at one stroke for the row."""
    return grid.select("sheet_id", *more, "row", F.split("cells_text", ";").alias("cells"), F.split(F.regexp_replace(F.upper("cells_text"), "[^A-Z0-9;]", ""), ";").alias("plain"))


def header_rows(grid: DataFrame, columns: dict = COLUMNS) -> DataFrame:
    """The row of each sheet that names most fields, at least two, the first of equals; with the place of each field (from 0, null without one)."""
    rows = _placed(with_cells(grid), columns).withColumn("filled", F.lit(0))
    best = _best(rows, F.col("matched"), lambda k: k["score"] >= 2, columns)
    return best.select("sheet_id", F.col("row").alias("header_row"), F.col("matched").cast("long").alias("score"), *[F.when(F.col(f"at_{f}") > 0, F.col(f"at_{f}") - 1).alias(f) for f in columns])


def _headed(rows: DataFrame, columns: dict, **more: Column) -> tuple[DataFrame, Window]:
    """rows(sheet_id, row, cells, ...) with head, what header_rows tells of their sheet (null without one), and the window of a sheet's rows in order.

    One pass by sheet: rows meet their heading row in that window, so they are read once and no table of headings is joined. more are columns of the heading row that head holds too."""
    held = F.struct("matched", (-F.col("row")).alias("order"), "row", *[F.when(F.col(f"at_{f}") > 0, F.col(f"at_{f}") - 1).alias(f) for f in columns], *[c.alias(n) for n, c in more.items()])
    marked = _placed(rows, columns).select(*[c for c in rows.columns if c != "plain"], F.when(F.col("matched") >= 2, held).alias("head"))
    order = Window.partitionBy("sheet_id").orderBy("row")
    return marked.withColumn("head", F.max("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), order


def _ends(rows: DataFrame, order: Window) -> DataFrame:
    """rows with past, whether a total or three blank rows on end came by then, and blank; description and raw_quantity must be there. A window cannot stand in a window: the mark of an end is a column first."""
    rows = rows.withColumn("blank", (F.col("description") == "") & (F.col("raw_quantity") == ""))
    ends = (F.sum(F.col("blank").cast("int")).over(order.rowsBetween(-(BLANKS - 1), 0)) == BLANKS) | (~F.col("blank") & F.col("description").rlike(STOPS))
    return rows.withColumn("ends", ends).withColumn("past", F.max(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _cell(field: str) -> Column:
    return F.coalesce(F.trim(F.get("cells", F.col(f"head.{field}"))), F.lit(""))


def material_lines(grid: DataFrame, columns: dict = COLUMNS) -> DataFrame:
    """Material rows under each sheet's header up to a total or three blank rows on end, normalised, numbered, with their issues. Sheets are apart, so a sheet's order is kept in one window of that sheet."""
    headed, order = _headed(with_cells(grid), columns)
    rows = headed.filter("row > head.row").select("sheet_id", "row", _cell("description").alias("description"), _cell("quantity").alias("raw_quantity"), _cell("size").alias("raw_size"), _cell("uom").alias("raw_uom"), _cell("commodity_code").alias("commodity_code"))
    kept = _ends(rows, order).filter("past = 0 and not blank")
    quantity, size = N.quantity(F.col("raw_quantity")), N.size(F.col("raw_size"))
    unit = N.unit(F.col("description"), F.col("raw_uom"), F.col("raw_quantity"))
    rules = {"BAD_QUANTITY": quantity.isNull(), "ZERO_QUANTITY": quantity == 0, "NO_DESCRIPTION": F.col("description") == "", "ODD_SIZE": (F.col("raw_size") != "") & ~size.rlike(READABLE_SIZE)}
    issues = F.array_join(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()), ",")
    return kept.select("sheet_id", (F.col("row") + 1).alias("source_row"), F.row_number().over(order).cast("long").alias("line_number"), "commodity_code", size.alias("size"), "description", quantity.alias("quantity"), unit["uom"].alias("uom"), issues.alias("issues"))


def fit_report(grid: DataFrame, columns: dict = COLUMNS) -> DataFrame:
    """How a profile fits each sheet: the likeliest heading row (most known headings, then most filled cells, at least two), fields found, headings unknown, essential fields missing."""
    every, odd = list(columns), _odd(list(columns), columns)
    known = lambda c, n: _is(every, columns)(n) | (F.upper(F.trim(c)).isin(odd) if odd else F.lit(False))
    headings = F.when(F.col("some"), F.size(F.filter(F.zip_with("cells", "plain", known), lambda k: k))).otherwise(0)
    rows = _placed(with_cells(grid), columns).withColumns({"filled": F.when(F.col("row") < SEARCHED, _filled(F.col("cells"))), "headings": headings})
    best = _best(rows, F.col("headings") * 100 + F.col("filled"), lambda k: (k["filled"] >= 2) & (k["score"] >= 2), columns)
    found = F.array_join(F.filter(F.array(*[F.when(F.col(f"at_{f}") > 0, F.concat_ws("@", F.lit(f), (F.col(f"at_{f}") - 1).cast("string"))) for f in sorted(columns)]), lambda x: x.isNotNull()), ",")
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(f"at_{f}") == 0, F.lit(f)) for f in ESSENTIAL]), lambda x: x.isNotNull()), ",")
    unknown = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: (c != "") & ~known(c, _squash(c)))
    return best.select("sheet_id", F.col("row").alias("header_row"), found.alias("matched"), F.array_join(unknown, ",").alias("unmatched"), missing.alias("missing"), (missing == "").alias("usable"))


def suggestion(heading: Column) -> Column:
    """The field that words in a heading hint at, the first in order; null for none."""
    text, out = F.upper(F.trim(heading)), None
    for field, hints in HINTS.items():
        held = F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(text, h))
        out = F.when(held, field) if out is None else out.when(held, field)
    return out


def learn_headings(grid: DataFrame, columns: dict = COLUMNS) -> DataFrame:
    """Unknown headings over all sheets, one for each spelling without punctuation, with the field they hint at and the sheets that use them."""
    seen = fit_report(grid, columns).select("sheet_id", F.explode(F.split("unmatched", ",")).alias("heading")).filter("heading <> ''")
    out = seen.withColumn("key", F.coalesce(F.nullif(_squash(F.col("heading")), F.lit("")), F.upper("heading"))).groupBy("key").agg(F.min("heading").alias("heading"), F.countDistinct("sheet_id").alias("sheets"))
    return out.select("heading", suggestion(F.col("heading")).alias("field"), "sheets")


def _label(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text)), r"[:.\s]+$", "")


def _field_of(label: Column, header: dict) -> Column:
    known = {a.upper().rstrip(":. "): field for field, aliases in header.items() for a in aliases}
    return F.get(F.array(*map(F.lit, known.values())), F.array_position(F.array(*map(F.lit, known)), label).cast("int") - 1)


def _is_label(text: Column) -> Column:
    """A cell of which a line ends as labels do is no value."""
    return text.rlike(r"(?m)[:=]\s*$")


def _told(grid: DataFrame, header: dict, columns: dict, *more: str) -> tuple[DataFrame, Window]:
    """The rows of _headed with told: the values that each row holds for header fields, as structs that sort by their claim to a field (those of labels, in reading order, before those of table columns)."""
    squashed = {f: sorted({"".join(c for c in a.upper() if c.isalnum()) for a in aliases}) for f, aliases in header.items()}
    at = lambda f: F.array_position(F.transform("plain", lambda n: n.isin(squashed[f])), True).cast("int")
    named = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), at(f).alias("at")) for f in header]), lambda h: h["at"] > 0)
    headed, order = _headed(with_cells(grid, *more), columns, named=named)
    rows = headed.withColumns({f"down{k}": F.when(F.lead("row", k).over(order) == F.col("row") + k, F.lead("cells", k).over(order)) for k in range(1, BELOW + 1)})
    entry = lambda place, col, rank, k, field, value: F.struct(*[c.cast("int").alias(n) for n, c in (("place", F.lit(place)), ("col", col), ("rank", F.lit(rank)), ("k", k))], field.alias("field"), F.trim(value).alias("value"))
    split = r"^(.+?)\s*[:=]\s*(.+)$"

    def of_cell(raw: Column, col: Column) -> Column:
        pieces = F.filter(F.transform(F.split(raw, r"\r?\n"), lambda t: F.trim(t)), lambda t: t != "")
        inline = F.transform(pieces, lambda t, k: entry(0, col, 0, k, F.when(t.rlike(split), _field_of(_label(F.regexp_extract(t, split, 1)), header)), F.regexp_extract(t, split, 2)))
        stacked = F.transform(pieces, lambda t, k: entry(0, col, 1, k, _field_of(_label(t), header), F.coalesce(F.get(pieces, k + 1), F.lit(""))))
        near = [F.get("cells", col + k) for k in range(1, RIGHT + 1)] + [F.get(f"down{k}", col) for k in range(1, BELOW + 1)]
        value = F.coalesce(*[F.when((F.trim(c) != "") & ~_is_label(F.trim(c)), F.trim(c)) for c in near], F.lit(""))
        own = _field_of(_label(raw), header)
        beside = F.array(entry(0, col, 2, F.lit(0), own, value))
        # Each way is tried only where the cell can hold it; most cells hold none.
        ways = F.array(F.when(F.contains(raw, F.lit(":")) | F.contains(raw, F.lit("=")), inline), F.when(F.contains(raw, F.lit("\n")), stacked), F.when(own.isNotNull(), beside))
        return F.when(raw != "", F.flatten(F.array_compact(ways)))

    above = F.flatten(F.array_compact(F.transform("cells", lambda c, i: of_cell(F.trim(c), i))))
    under = F.transform("head.named", lambda h: entry(1, F.lit(0), 0, F.lit(0), h["field"], F.get("cells", h["at"] - 1)))
    told = F.when(F.col("row") < F.coalesce("head.row", F.lit(HEADER_ROWS)), above).when(F.col("row") > F.col("head.row"), under)
    found = F.filter(told, lambda e: e["field"].isNotNull() & (e["value"] != ""))
    claims = F.transform(found, lambda e: F.struct(e["place"].alias("place"), F.col("row"), *[e[c].alias(c) for c in ("col", "rank", "k", "field", "value")]))
    return rows.select("sheet_id", *more, "row", "cells", "head", claims.alias("told")), order


def labeled_values(grid: DataFrame, header: dict = HEADER, columns: dict = COLUMNS) -> DataFrame:
    """The fields above each sheet's table: sheet_id, field, value, and where it stands.

    The first cell in reading order that yields a value for a field wins. A cell yields one by its own text ("label: value", then a label with its value on the next line), or, if it is a label, by the
    cells to its right (3) and then below (2), empty ones and labels passed over. A field without one takes the first filled cell under a table heading of its name. Cells meet their neighbours as columns of their
    own row and of the two next rows, so nothing is joined."""
    each = _told(grid, header, columns)[0].select("sheet_id", F.explode("told").alias("t"))
    first = each.groupBy("sheet_id", F.col("t.field").alias("field")).agg(F.min("t").alias("t"))
    return first.select("sheet_id", "field", F.col("t.value").alias("value"), F.when(F.col("t.place") == 0, "label").otherwise("column").alias("place"))


def extract_corpus(grid: DataFrame, header: dict = HEADER, columns: dict = COLUMNS) -> DataFrame:
    """Each sheet that is not skipped by its name, with its header fields, the count of its material lines and the codes that keep it from use (field after a colon), in order; none for a sound sheet. One pass by sheet."""
    kept = grid.filter(~F.trim("sheet_name").rlike(SKIPPED))
    told, order = _told(kept, header, columns, "sheet_name")
    under = F.col("row") > F.col("head.row")
    # Rows down to the heading row are no lines: they take neither part in runs of blanks nor end the table.
    cell = lambda f: F.when(under, _cell(f))
    rows = _ends(told.withColumns({"description": cell("description"), "raw_quantity": cell("quantity")}), order)
    claim = lambda f: F.min(F.when(F.size("told") > 0, F.array_min(F.filter("told", lambda e: e["field"] == f))))["value"].alias(f)
    line = under & (F.coalesce("past", F.lit(0)) == 0) & ~F.col("blank")
    sheets = rows.groupBy("sheet_id").agg(F.min("sheet_name").alias("sheet_name"), *[claim(f) for f in header], F.max("head.row").alias("header_row"), *[F.max(F.col(f"head.{c}").isNotNull()).alias(f"has_{c}") for c in ESSENTIAL], F.count_if(line).alias("lines"))
    table, lines = F.col("header_row").isNotNull(), F.col("lines")
    codes = [F.when(F.col(f).isNull(), F.lit(f"MISSING_HEADER:{f}")) for f in MUST_HAVE] + [F.when(~table, F.lit("NO_TABLE"))]
    codes += [F.when(table & ~F.col(f"has_{c}"), F.lit(f"MISSING_COLUMN:{c}")) for c in sorted(ESSENTIAL)] + [F.when(table & (lines == 0), F.lit("NO_LINES"))]
    out = sheets.withColumns({"iso_number": N.drawing(F.col("iso_number")), "iso_sheet": F.coalesce(N.sheet(F.col("iso_sheet")), F.lit(DEFAULT_SHEET)), "rejected_for": F.array_join(F.array_compact(F.array(*codes)), ",")})
    return out.select("sheet_id", "sheet_name", *header, lines.cast("long").alias("lines"), "rejected_for")


def rejects(extracted: DataFrame) -> DataFrame:
    """A row for each reason that keeps a sheet from use."""
    each = extracted.filter("rejected_for <> ''").select("sheet_id", F.explode(F.split("rejected_for", ",")).alias("reason"))
    return each.select("sheet_id", F.split("reason", ":").alias("r")).select("sheet_id", F.col("r")[0].alias("code"), F.coalesce(F.get("r", F.lit(1)), F.lit("")).alias("field"))
