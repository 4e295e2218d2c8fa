"""Placed words of drawing pages: visual lines, columns, and the drawing's own number. A page is the unit; pages are apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How far tops of one line lie apart, and where the title block begins as shares of the page.
TOLERANCE, CORNER = 5.0, (0.55, 0.80)


def line_grouping(words: DataFrame, tolerance: float = TOLERANCE, carried: tuple[str, ...] = ()) -> DataFrame:
    """The visual line of each word: from the top, a word joins the line if its top is within tolerance of the line's first word, else it
    begins a line. As the first word counts and not the last, a page is folded in order, as one array of that page's words. Columns that are carried come along in that array, so that no join brings them back."""
    ordered = F.array_sort(F.collect_list(F.struct("top", "x0", "word_id", *carried)))
    none = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(s, w):
        fresh = s["top"].isNull() | (F.abs(w["top"] - s["top"]) > tolerance)
        line = s["line"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, w["top"]).otherwise(s["top"]).alias("top"), line.alias("line"), F.array_append(s["lines"], line).alias("lines"))

    pages = words.groupBy("page_id").agg(ordered.alias("w")).select("page_id", "w", F.aggregate("w", none, step)["lines"].alias("line"))
    return pages.select("page_id", F.explode(F.arrays_zip("w", "line")).alias("z")).select("page_id", F.col("z.w.word_id").alias("word_id"), *[F.col(f"z.w.{c}").alias(c) for c in carried if c not in ("top", "x0")], *[F.col(f"z.w.{c}").alias(c) for c in ("top", "x0") if carried], F.col("z.line").cast("long").alias("line"))


def bucket_words(words: DataFrame, lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Text of each line by column: a word belongs to the column of its page in whose range it starts. Words outside of all columns are left out."""
    placed = words.select("page_id", "word_id", "x0", "text").join(lines, ["page_id", "word_id"])
    held = placed.join(ranges, "page_id").filter((F.col("x0") >= F.col("x_from")) & (F.col("x0") < F.col("x_to")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda w: F.trim(w["text"]))
    return held.groupBy("page_id", "line", F.col("name").alias("column_name")).agg(F.trim(F.array_join(parts, " ")).alias("text"))


def drawing_identity(words: DataFrame, sources: DataFrame, pattern: str = r"^D-\d+(-\d+)?$") -> DataFrame:
    """The number of each page's drawing, as pages name their neighbours too: the match furthest into the title block, else the one most often
    on the page (the earlier of equals), else the name of the file. Two aggregations by page, the first by page and number."""
    x, y = CORNER
    found = words.filter(F.col("text").rlike(f"(?i){pattern}")).withColumn("number", F.upper("text"))
    inside = (F.col("x0") >= F.col("page_width") * x) & (F.col("top") >= F.col("page_height") * y)
    place = F.struct(-(F.col("x0") + F.col("top")), F.col("word_id"))
    each = found.groupBy("page_id", "number").agg(F.min(F.when(inside, place)).alias("deep"), F.count("*").alias("n"), F.min(F.struct("top", "x0", "word_id")).alias("first"))
    best = each.groupBy("page_id").agg(F.min_by("number", "deep").alias("titled"), F.min_by("number", F.struct(-F.col("n"), F.col("first"))).alias("repeated"))
    out = sources.join(best, "page_id", "left")
    rule = F.when(F.col("titled").isNotNull(), "title_block").when(F.col("repeated").isNotNull(), "repeated").otherwise("file_name")
    return out.select("page_id", F.coalesce("titled", "repeated", F.upper("source_name")).alias("drawing"), rule.alias("rule"))
