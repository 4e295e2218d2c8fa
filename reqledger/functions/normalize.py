"""Normalisers of material text as column expressions: size, quantity, unit, drawing and sheet; item type and takeoff sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells

# Patterns that decide units, types and sheets.
SUPPORT_CODE = r"(?i)^5(?:UGSP|UG|US|MUGSP|MUG|FSS\d*|FS\d*|MHR\d*|ABS\d*|MS|CH|CC|CI|C|SH|S\d|DA\d*|ISC|BG\d*|MG\d*|G\d*)"
BLIND = r"(?i)\bBLINDS?\b"
BIRDSCREEN = r"(?i)\bBIRD\s*SCREENS?\b"
VALVE = r"(?i)(?:\bVALVES?\b|^\s*(?:BALL|CHECK|GATE|GLOBE|BUTTERFLY|DIAPHRAGM|PLUG|NEEDLE|CONTROL|RELIEF|SAFETY)\b)"
PIPE_FITTING = r"(?i)\b(?:PIPE|ELL|ELBOW|TEE|REDUCER|CAP|COUPLING|SOCKOLET|WELDOLET|THREDOLET|NIPPLE|FLANGE|UNION|SWAGE)\b"
STANDARD_FITTING = r"(?i)^\s*(?:ELL|ELBOW|TEE|RED|REDUCER|CONC\s+RED|ECC\s+RED|CAP|COUPLING|COUP|CPLG|NIPPLE|NIP|FLG|FLANGE|OLET|WELDOLET|SOCKOLET|THREDOLET|UNION|VALVE)(?:\b|[-,])"
STANDALONE_BOLT = r"(?i)^\s*(?:STUD[ -]?BOLT|MACHINE[ -]?BOLT|ANCHOR[ -]?BOLT|HEX[ -]?BOLT|CAP[ -]?SCREW)\b"
STANDALONE_GASKET = r"(?i)^\s*GASKETS?\b"
PIPE = r"(?i)^\s*PIPE\b"
UOM_SUPPORT = r"\b(SUPPORTS?|GUIDES?|CRADLES?|HANGERS?|CLAMPS?|SHOES?|U-BOLTS?|UBOLTS?|BRACKETS?|ANCHORS?|TRUNNIONS?|SADDLES?|STANCHIONS?|BASES?|SPACERS?|SHIELDS?|STRAPS?)\b"
UOM_FITTING = r"\b(ELLS?|ELBOWS?|TEES?|REDUCERS?|COUPLINGS?|UNIONS?|FLANGES?|NIPPLES?|PLUGS?|CAPS?|VALVES?|BOLTS?|NUTS?|GASKETS?|STUDS?|SCREWS?|WASHERS?|ADAPTERS?|CONNECTIONS?|CAMLOCKS?|FITTINGS?)\b"
UOM_LENGTH = r"\b(PIPES?|TUBES?|TUBING|HOSES?|CABLES?|WIRES?|INSULATION)\b"
UOM_LIQUID = r"\b(PAINT|PRIMER|SOLVENT|OIL|GREASE)\b"
UOM_WEIGHT = r"\b(WELD ROD|ELECTRODE|WIRE SPOOL)\b"
EIGHTHS = {1: "1/8", 2: "1/4", 3: "3/8", 4: "1/2", 5: "5/8", 6: "3/4", 7: "7/8"}


def _one_size(raw: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(raw, "[\"'″′]", ""), r"(?i)\b(IN|INCH|INCHES|NPS|DN)\b", ""))
    piece = lambda p, i: F.regexp_extract(plain, p, i).try_cast("int").cast("string")
    mixed, fraction, decimal = r"^(\d+)[-\s.]+(\d+)/(\d+)$", r"^(\d+)/(\d+)$", r"^(\d+)\.(\d+)$"
    value = plain.try_cast("double")
    eighth = (value - F.floor(value)) * 8
    named = F.element_at(F.create_map(*[F.lit(x) for i, t in EIGHTHS.items() for x in (i, t)]), F.round(eighth).cast("int"))
    close = F.abs(eighth - F.round(eighth)) < 0.008
    return (
        F.when(plain == "", F.lit(None).cast("string"))
        .when(plain.rlike(mixed), F.concat(piece(mixed, 1), F.lit("-"), piece(mixed, 2), F.lit("/"), piece(mixed, 3), F.lit('"')))
        .when(plain.rlike(fraction), F.concat(piece(fraction, 1), F.lit("/"), piece(fraction, 2), F.lit('"')))
        .when(plain.rlike(decimal) & close & named.isNotNull(), F.concat(F.when(F.floor(value) > 0, F.concat(F.floor(value).cast("string"), F.lit("-"))).otherwise(""), named, F.lit('"')))
        .when(plain.rlike(decimal), F.concat(plain, F.lit('"')))
        .when(plain.rlike(r"^\d+$"), F.concat(plain.try_cast("int").cast("string"), F.lit('"')))
        .otherwise(plain)
    )


def size(raw: Column) -> Column:
    """6", 1-1/2", 1/2"; each side of a reducer on its own; a fraction that a workbook took for a date is one again. Text that is no size stays."""
    text = F.trim(raw)
    reducer = text.rlike(r"^\d[^xX]*[xX]\s*\d[^xX]*$")
    dated = cells.size_from_date(raw)
    return F.when(dated.isNotNull(), F.concat(dated, F.lit('"'))).when(reducer, F.array_join(F.transform(F.split(text, r"\s*[xX]\s*"), _one_size), "x")).otherwise(_one_size(text))


def quantity(raw: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, ",", ""), r"(?i)\b(EA|FT|LB|GAL|PCS?|EACH)\b", ""), "[\"'″′]", ""))
    value = F.when(plain == "", F.lit(0.0)).otherwise(plain.try_cast("double"))
    return F.when((raw != "") & (value >= 0), value)


def unit(description: Column, stated: Column, raw_quantity: Column) -> Column:
    """struct(uom, rule)."""
    given, text = F.upper(F.trim(F.coalesce(stated, F.lit("")))), F.upper(F.coalesce(description, F.lit("")))
    told = lambda u, r: F.struct(F.lit(u).alias("uom"), F.lit(r).alias("rule"))
    return (
        F.when(given != "", F.struct(given.alias("uom"), F.lit("stated").alias("rule"))).when(F.coalesce(raw_quantity, F.lit("")).rlike(r"\d\s*['′]"), told("FT", "measured quantity"))
        .when(text == "", told("EA", "default")).when(text.rlike(UOM_SUPPORT), told("EA", "pipe support")).when(text.rlike(UOM_FITTING), told("EA", "fitting"))
        .when(text.rlike(UOM_LENGTH), told("FT", "length material")).when(text.rlike(UOM_LIQUID), told("GAL", "liquid")).when(text.rlike(UOM_WEIGHT), told("LB", "weight")).otherwise(told("EA", "countable"))
    )


def drawing(raw: Column) -> Column:
    text = F.upper(F.trim(raw))
    return F.when(text != "", F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", "-"), "-+", "-"), "^-|-$", ""))


def sheet(raw: Column) -> Column:
    """Trailing digits padded to two places, never cut."""
    text = F.upper(F.trim(raw))
    number = F.regexp_extract(text, r"(\d+)\s*$", 1).try_cast("long").cast("string")
    return F.when(text == "", F.lit(None).cast("string")).when(number.isNull(), text).when(F.length(number) >= 2, number).otherwise(F.lpad(number, 2, "0"))


def item_type(description: Column, code: Column) -> Column:
    text = F.coalesce(description, F.lit(""))
    return (
        F.when(F.coalesce(code, F.lit("")).rlike(SUPPORT_CODE), "SUPPORT").when(text.rlike(STANDALONE_BOLT), "BOLT").when(text.rlike(STANDALONE_GASKET), "GASKET")
        .when(text.rlike(PIPE), "PIPE").when(text.rlike(STANDARD_FITTING), "FITTING").otherwise("SPECIALTY")
    )


def takeoff_sheet(kind: Column, description: Column, code: Column) -> Column:
    kind, text = F.upper(F.trim(kind)), F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    return (
        F.when(text.rlike(BLIND), "BLINDS").when(kind.isin("BOLT", "GASKET", "WASHER"), "BOLTS & GASKETS").when((kind == "SUPPORT") | F.trim(F.coalesce(code, F.lit(""))).rlike(SUPPORT_CODE), "SUPPORTS")
        .when(text.rlike(BIRDSCREEN), "BIRDSCREENS").when(text.rlike(VALVE), "VALVES").when(kind.isin("PIPE", "FITTING") | text.rlike(PIPE_FITTING), "PIPE & FITTINGS").otherwise("OTHER MATERIALS")
    )


def normalize_materials(rows: DataFrame) -> DataFrame:
    """raw_size, raw_quantity, description, commodity_code, raw_drawing and raw_sheet to their normal forms, with unit, type and takeoff sheet."""
    typed = rows.withColumn("item_type", item_type(F.col("description"), F.col("commodity_code"))).withColumn("unit", unit(F.col("description"), F.lit(None).cast("string"), F.col("raw_quantity")))
    return typed.select(
        "part_id", size(F.col("raw_size")).alias("size"), quantity(F.col("raw_quantity")).alias("quantity"), F.col("unit.uom").alias("uom"), F.col("unit.rule").alias("uom_rule"),
        drawing(F.col("raw_drawing")).alias("drawing"), sheet(F.col("raw_sheet")).alias("sheet"), "item_type", takeoff_sheet(F.col("item_type"), F.col("description"), F.col("commodity_code")).alias("takeoff_sheet"),
    )
