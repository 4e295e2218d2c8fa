"""Cells of spreadsheets as column expressions: sizes that became dates, dates, numbers, flags, keys, safe names and search patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, the form of a uuid, what file and sheet names may hold.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UNSAFE, SHEET_LENGTH = r"[^A-Za-z0-9._-]+", 31
#: Date forms that are read; any other text gives null.
DATES = ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy")


def text(cell: Column) -> Column:
    """Trimmed, and null where nothing is left."""
    plain = F.trim(cell)
    return F.when(plain != "", plain)


def size_from_date(cell: Column) -> Column:
    """2-Jan and Jan-2 are 1/2: the month over the day, where the day is the larger. Null for all else."""
    plain, first, last = F.trim(cell), r"^(\d{1,2})[-\s]([A-Za-z]{3,})$", r"^([A-Za-z]{3,})[-\s](\d{1,2})$"
    named = F.when(plain.rlike(first), F.regexp_extract(plain, first, 2)).when(plain.rlike(last), F.regexp_extract(plain, last, 1))
    day = F.when(plain.rlike(first), F.regexp_extract(plain, first, 1)).when(plain.rlike(last), F.regexp_extract(plain, last, 2)).cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.left(named, F.lit(3)))).cast("int")
    return F.when((month > 0) & (day > month), F.concat_ws("/", month.cast("string"), day.cast("string")))


def iso_date(cell: Column) -> Column:
    return F.date_format(F.coalesce(*[F.try_to_timestamp(F.trim(cell), F.lit(f)) for f in DATES]), "yyyy-MM-dd")


def number(cell: Column) -> Column:
    """Commas are dropped; what is no number counts as 0."""
    value = F.trim(F.replace(F.coalesce(cell, F.lit("")), F.lit(","), F.lit(""))).try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def yes(cell: Column) -> Column:
    return F.upper(F.trim(F.coalesce(cell, F.lit("")))) == "YES"


def email(cell: Column) -> Column:
    return F.lower(text(cell))


def uuid(cell: Column) -> Column:
    """A uuid without the prefix of its table; a value that holds none stays as it is."""
    plain = F.trim(cell)
    bare = F.regexp_replace(plain, r"^[A-Za-z_]+-", "")
    return F.when(plain == "", F.lit(None).cast("string")).when(plain.rlike(UUID), F.lower(plain)).when(bare.rlike(UUID), F.lower(bare)).otherwise(plain)


def file_name(*parts: Column) -> Column:
    stem = F.concat_ws("-", *map(text, parts))
    return F.concat(F.lit("MTO "), F.regexp_replace(F.when(stem != "", stem).otherwise("package"), UNSAFE, "_"), F.lit(".csv"))


def sheet_name(package: Column, index: Column) -> Column:
    """package(00); null where it is longer than a sheet's name may be or holds a character that a sheet's name may not."""
    name = F.format_string("%s(%02d)", package, index.cast("int"))
    return F.when((F.length(name) <= SHEET_LENGTH) & ~name.rlike(r"[\[\]:*?/\\]"), name)


def holds(value: Column, term: str) -> Column:
    """term anywhere in value, in either case; % and _ in it are wildcards."""
    return value.ilike(f"%{term}%")


def starts(value: Column, term: str) -> Column:
    return value.ilike(f"{term}%")
