"""Quality rules: a table of thresholds compiled into one projection.

A rule holds a ratio of two measured numbers between two bounds, in percent, and may be meant for some languages or for texts of so many words only.
All rules become conditions of one column of failed names, so a table of any length costs one pass over the rows and no
shuffle. Column expressions only. Ratios are compared as whole numbers, so no rounding decides.

Words are runs of other characters than space and 0x09-0x0D, lines are cut at line feeds and count if they hold a word.
A text fails at the base with fewer than 10 words, or if more than a fifth of its words lie in five-word windows that occur twice or more in it.
Whether any window repeats is told by hashes (equal windows have equal hashes); only texts where some do are sorted by the windows themselves.

Null and empty texts have no words, so they fail; ratios with nothing below them fail no rule. Every row gives one row, repeated rows and
null ids too; an empty table gives none. A null language is held to the rules for all languages only. Work and memory are linear in a text's length, but for the sort of its
windows. Only the columns doc_id, text and lang are read, so others may have any name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SEPARATORS = " \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Commonest words by language; texts mix languages, so a text's words are counted against all of them.
STOP_WORDS = {
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"],
    "fr": ["au", "aux", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "on", "ou", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
    "de": ["als", "an", "auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "es", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "es": ["al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
}


@dataclass(frozen=True)
class Rule:
    """100 * part must be at least low * whole and at most high * whole; langs limits the rule to some languages, from_words to texts of that many words."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    langs: tuple[str, ...] = ()
    from_words: int = 0


#: The table of production: whole is a measured column, or "one".
RULES = (
    Rule("few_words", "n_words", "one", low=100 * LEAST_WORDS),
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("no_letters", "n_letter_words", "n_words", low=60),
    Rule("stop_words", "n_stop_words", "n_words", low=2, langs=tuple(STOP_WORDS), from_words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullets", "n_bullet_lines", "n_lines", high=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=30),
)


def repeated(words: Column, n: Column) -> Column:
    """How many words lie in windows that occur twice or more; words must hold at least WINDOW of them."""
    window = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(WINDOW)])
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(window(i).alias("t"), i.alias("i"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k - 1)["t"] == x["t"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["t"] == x["t"], F.lit(False))
    starts = F.transform(F.array(order), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: same(s, x, k)), lambda x: x["i"])))[0]
    steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    return F.transform(F.array(starts), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, b: a + b))[0]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the measured numbers of each text."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = lambda c: F.btrim(c, F.lit(SEPARATORS))
    cut = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), whole.alias("text")).withColumns(
        {"words": F.when(bare(F.col("text")) == "", F.array().cast("array<string>")).otherwise(F.split(bare(F.col("text")), r"[\x20\x09-\x0D]+")), "lines": F.filter(F.split("text", "\n"), lambda x: bare(x) != "")}
    )
    n = F.size("words")
    hashes = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(WINDOW)])))
    hashed = cut.withColumn("hashes", hashes)
    listed = sorted({w for words in STOP_WORDS.values() for w in words})
    last, first = lambda x: F.rtrim(x, F.lit(SEPARATORS)), lambda x: F.ltrim(x, F.lit(SEPARATORS))
    return hashed.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), repeated(F.col("words"), n)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*listed))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.substring(first(x), 1, 1).isin("-", "*", "•", "‣"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: last(x).endswith("...") | last(x).endswith("…"))).cast("long").alias("n_cut_lines"),
        F.lit(1).cast("long").alias("one"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a measured row fails, in the table's order."""

    def fails(r: Rule) -> Column:
        part, whole, bad = 100 * F.col(r.part), F.col(r.whole), F.lit(False)
        if r.low is not None:
            bad = bad | (part < r.low * whole)
        if r.high is not None:
            bad = bad | (part > r.high * whole)
        if r.langs:
            bad = bad & F.coalesce(F.col("lang").isin(*r.langs), F.lit(False))
        return bad & (F.col("n_words") >= r.from_words)

    return F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measured rows with base_failed, failed (names of rules) and kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.select("*", base.alias("base_failed"), compiled(rules).alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(measure(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", F.array_join("failed", ",").alias("failed_rules"))


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SPACE = " || ".join(f"chr({ord(c)})" for c in SEPARATORS)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, lang, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_SPACE}) <> '') AS lines FROM d),
each AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS t FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM win WHERE t IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS j) o GROUP BY r),
m AS (SELECT w.r, doc_id, lang, cast(len(words) AS bigint) AS n_words, cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS bigint) AS word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, cast(coalesce(n, 0) AS bigint) AS n_repeat_words,
  len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_letter_words, len(lines) AS n_lines,
  cast(len(list_filter(words, lambda x: lower(x) IN ({_listed([w for v in STOP_WORDS.values() for w in v])}))) AS bigint) AS n_stop_words,
  len(list_filter(lines, lambda x: left(ltrim(x, {_SPACE}), 1) IN ('-', '*', '•', '‣'))) AS n_bullet_lines, len(list_filter(lines, lambda x: rtrim(x, {_SPACE}) LIKE '%...' OR rtrim(x, {_SPACE}) LIKE '%…')) AS n_cut_lines
  FROM w LEFT JOIN rep ON w.r = rep.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', CASE WHEN n_words < 10 THEN 'few_words' END, CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 'word_length' END,
  CASE WHEN 10 * n_symbols > n_words THEN 'symbols' END, CASE WHEN 10 * n_letter_words < 6 * n_words THEN 'no_letters' END, CASE WHEN lang IN ({_listed(list(STOP_WORDS))}) AND n_words >= 50 AND 100 * n_stop_words < 2 * n_words THEN 'stop_words' END,
  CASE WHEN 2 * n_dup_lines > n_lines THEN 'repeated_lines' END, CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 'bullets' END, CASE WHEN 10 * n_cut_lines > 3 * n_lines THEN 'cut_lines' END) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, n_stop_words, cast(n_lines AS bigint) AS n_lines, failed_rules FROM f"""
