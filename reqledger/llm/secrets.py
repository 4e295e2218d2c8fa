"""Secret scan: fixed patterns, and a randomness test battery for tokens that no pattern names.

Column expressions only. A token of 20 or more characters gets an encoding (hex, base32, base64). Three
tests measure how far it is from "drawn at random from that alphabet": chi-squared uniformity over eight equal cells,
Wald-Wolfowitz runs about the middle of the alphabet, and lag-1 serial correlation. Fisher's method joins their p-values.
What must be bounded is the share of ordinary names among the tokens reported, so the null hypothesis of the discovery step is "a structured
name". Its distribution comes from the corpus: every document lends an identifier made of a few of its own consecutive words and a number (at a hashed
place, in one of three styles, once in each encoding), and the battery runs over these too. For each encoding and band of lengths, tokens are reported from
the most random-looking down as long as the share of made identifiers that look as random, times all tokens, is at most FALSE_DISCOVERY of the tokens
reported: Benjamini-Hochberg with p-values from that empirical null. Short tokens so meet only others of like power. A band with fewer made
identifiers than ENOUGH takes in the bands below it, whose identifiers look the more random; with too few of them in all (a corpus of few documents, or
without words of Latin letters) nothing is reported as random.

Null text counts as empty and has no spans; every input row gives one output row, repeated ones and null ids too. An
empty table gives no rows. Work grows with a text's length times the square root of its spans, so texts of megabytes with
tens of thousands of spans take seconds; no text is cut short. Other columns may have any name; one named as the added column, in any case, is replaced."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, packed, table, unpacked

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a length bound in the pattern drops just the short ones.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: A maximal run of token characters; it is tried at its start only.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
CELLS, FALSE_DISCOVERY, BINS = 8, 0.05, 200
ENOUGH = 100
#: Characters of a text from which identifiers are made, words in one by style, and letters that stand for others in an alphabet.
WINDOW, PER_STYLE = 240, (3, 4, 6)
TO_HEX = ("ghijklmnopqrstuvwxyz", "0123456789abcdef0123")
TO_BASE32 = ("0189", "2345")
SPAN = "struct<start:int,end:int,text:string>"
FOUND = "struct<start:int,rank:int,end:int,kind:string,text:string>"
OPEN, SHUT, OTHER = "\u0001", "\u0002", "\u0003"


def marked(text: Column, pattern: str) -> Column:
    """The text cut before each match, with a mark after it. Marks that the text holds itself become another character that no pattern takes."""
    clean = F.when(text.contains(OPEN) | text.contains(SHUT), F.translate(text, OPEN + SHUT, OTHER + OTHER)).otherwise(text)
    return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}")), OPEN)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def blocks(items: Column) -> Column:
    """The array cut into about as many blocks as each has items; none of an empty array."""

    def cut(seen: Column) -> Column:
        xs, size = seen["xs"], seen["size"]
        return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda i: F.slice(xs, i * size + 1, size))).otherwise(F.array())

    return let(let(items, lambda xs: F.struct(xs.alias("xs"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")).alias("size"))), cut)


def running(items: Column, begin: Column, advance, emit, kind: str, state: str = "int") -> Column:
    """emit(state, item) for each item, where the state before it is advance() over those before. First the states at the starts of blocks, then each block by itself: an array of n items costs n * sqrt(n) references."""

    def start(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["state"], advance).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))

    def one(acc: Column, item: Column) -> Column:
        return F.struct(advance(acc["state"], item).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], item))).alias("out"))

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda acc: acc["out"])

    def starts(cut: Column) -> Column:
        return F.aggregate(cut, F.struct(begin.alias("state"), F.array().cast(f"array<{state}>").alias("out")), start, lambda acc: acc["out"])

    return F.flatten(let(blocks(items), lambda cut: F.zip_with(cut, starts(cut), within)))


def spans(parts: Column) -> Column:
    """Start, end (code points, end exclusive) and text of each match in marked() text."""

    def span(pos: Column, part: Column) -> Column:
        found = F.substring_index(part, SHUT, 1)
        return F.struct(pos.alias("start"), (pos + F.length(found)).alias("end"), found.alias("text"))

    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return running(rest, F.length(parts[0]), lambda pos, part: pos + F.length(part) - 1, span, SPAN)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the polynomial of Abramowitz and Stegun 26.2.17."""

    def tail(v: Column) -> Column:
        z, t = v["z"], v["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        above = F.exp(-z * z / 2) * 0.3989422804014327 * poly
        return F.when(z >= 0, above).otherwise(1 - above)

    return let(let(z, lambda x: F.struct(x.alias("z"), (1 / (1 + 0.2316419 * F.abs(x))).alias("t"))), tail)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), F.lit(None).cast("string"))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(token.rlike("^[A-Za-z0-9+/_-]+=*$"), "base64")
    )


def _codes(token: Column) -> Column:
    """Each character's place in the alphabet, scaled to [0, 1)."""
    plain = F.translate(F.rtrim(F.translate(token, "=", " ")), "-_ ", "+/")
    kind = encoding(token)
    body = F.when(kind == "hex", F.lower(plain)).otherwise(plain)
    alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    return F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: (F.position(c, alphabet) - 1).cast("double") / F.length(alphabet))


def _total(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def _sums(x: Column) -> Column:
    return F.struct(x.alias("x"), F.size(x).cast("double").alias("n"), (_total(x) / F.size(x)).alias("mean"), _total(x, lambda v: (v >= 0.5).cast("int")).alias("high"))


def _statistics(s: Column) -> Column:
    """The chi-squared sum, the runs and the two sums of the serial correlation."""
    x, n, mean = s["x"], s["n"], s["mean"]
    counts = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.size(F.filter(x, lambda v: F.floor(v * CELLS) == c)).cast("double"))
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.struct(
        n.alias("n"), s["high"].alias("high"), (n - s["high"]).alias("low"),
        (_total(counts, lambda c: (c - n / CELLS) * (c - n / CELLS)) / (n / CELLS)).alias("chi"),
        (1 + _total(pairs, lambda p: ((p["a"] >= 0.5) != (p["b"] >= 0.5)).cast("int"))).alias("runs"),
        _total(x, lambda v: (v - mean) * (v - mean)).alias("square"),
        _total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)).alias("lag"),
    )


def _joint(s: Column) -> Column:
    n, high, low = s["n"], s["high"], s["low"]
    df = float(CELLS - 1)
    p_chi = upper_tail((F.pow(s["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    expected, spread = 2 * high * low / n + 1, F.sqrt(2 * high * low * (2 * high * low - n) / (n * n * (n - 1)))
    p_runs = F.when((high > 0) & (low > 0) & (2 * high * low > n), two_sided((s["runs"] - expected) / spread)).otherwise(F.lit(1e-9))
    p_lag = F.when(s["square"] > 0, two_sided((s["lag"] / s["square"] + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-9))
    half = -F.aggregate(F.array(p_chi, p_runs, p_lag), F.lit(0.0), lambda a, p: a + F.ln(F.greatest(p, F.lit(1e-15))))
    return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def battery(token: Column) -> Column:
    """Fisher's joint p-value of the three tests; null where no encoding fits."""
    return F.when(encoding(token).isNotNull(), let(let(let(_codes(token), _sums), _statistics), _joint))


def band(token: Column) -> Column:
    """Lengths of like power: steps of half a doubling."""
    return F.floor(2 * F.log2(F.length(token).cast("double"))).cast("int")


def _bin(p: Column) -> Column:
    """p-values on a scale of logarithms, from 0 (p of 1) up."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-15))) * 12), F.lit(BINS)).cast("int")


def identifiers(text: Column) -> Column:
    """Structured tokens made of a text's own words, one for each encoding; none where the words do not suffice."""

    def made(seen: Column) -> Column:
        hashed, words = seen["hash"], seen["words"]
        few = lambda n: F.slice(words, 1, n)
        style = F.pmod(F.shiftright(hashed, 8), F.lit(3))
        name = F.when(style == 0, F.lower(F.array_join(few(PER_STYLE[0]), "-"))).when(style == 1, F.array_join(F.transform(few(PER_STYLE[1]), F.initcap), "")).otherwise(F.lower(F.array_join(few(PER_STYLE[2]), "_")))
        number = F.lpad(F.pmod(F.shiftright(hashed, 16), F.lit(100)).cast("string"), 2, "0")
        return let(F.concat(name, number), lambda t: F.array(t, F.translate(F.lower(F.translate(t, "-_", "")), *TO_HEX), F.upper(F.translate(F.translate(t, "-_", ""), *TO_BASE32))))

    def words(hashed: Column) -> Column:
        at = 1 + F.pmod(hashed, F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1)
        found = F.regexp_extract_all(F.substring(text, at.cast("int"), F.lit(WINDOW)), F.lit("[A-Za-z]{2,}"), F.lit(0))
        return F.struct(hashed.alias("hash"), F.slice(found, 2, F.greatest(F.size(found) - 2, F.lit(0))).alias("words"))

    return F.filter(let(let(F.xxhash64(text), words), made), lambda t: F.length(t) >= 20)


def thresholds(docs: DataFrame, text_col: str = "text", level: float = FALSE_DISCOVERY) -> dict[tuple[str, int], int]:
    """For each encoding and band of lengths, the bin of p-values up to which tokens are reported; from histograms of all tokens of the corpus and of the made identifiers."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    parts = docs.select(text.alias("text"), marked(text, TOKEN).alias("parts"))
    both = F.concat(F.transform(spans(F.col("parts")), lambda s: F.struct(F.lit(True).alias("real"), s["text"].alias("token"))), F.transform(identifiers(F.col("text")), lambda t: F.struct(F.lit(False).alias("real"), t.alias("token"))))
    # Outer, as for an inner one Spark would work out the spans once more in a filter.
    tokens = parts.select(F.explode_outer(both).alias("found")).select("found.real", "found.token")
    tested = tokens.select("real", encoding(F.col("token")).alias("encoding"), band(F.col("token")).alias("band"), battery(F.col("token")).alias("p")).filter("p is not null")
    counts = tested.groupBy("real", "encoding", "band", _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n")).collect()  # 6 x bands x bins rows at most
    out = {}
    for code, b in {(r["encoding"], r["band"]) for r in counts if r["real"]}:
        mine = {r["bin"]: r["n"] for r in counts if r["real"] and (r["encoding"], r["band"]) == (code, b)}
        null: Counter[int] = Counter()
        for k in range(b, 0, -1):
            if sum(null.values()) >= ENOUGH:
                break
            null.update({r["bin"]: r["n"] for r in counts if not r["real"] and (r["encoding"], r["band"]) == (code, k)})
        total, nulls, seen, false = sum(mine.values()), sum(null.values()), 0, 0
        for i in range(BINS + 1):
            seen, false = seen + mine.get(i, 0), false + null.get(i, 0)
            if seen and (1 + false) / (1 + nulls) * total <= level * seen:
                out[code, b] = i
    return out


def scan(docs: DataFrame, limits: dict[tuple[str, int], int], text_col: str = "text", to: str = "spans") -> DataFrame:
    """docs with a column `to` (which replaces one of that name): all spans, by start and then kind, as structs of start, rank, end, kind and text."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    cut = docs.select(packed(docs, to), *[marked(text, p).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)])
    got = cut.select("row", *[spans(F.col(k)).alias(k) for k in KINDS])

    def kind(k: str, keep) -> Column:
        rank = KINDS.index(k)
        return F.transform(F.filter(F.col(k), keep), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind"), s["text"].alias("text")))

    limit = F.create_map(*[F.lit(x) for (code, b), i in sorted(limits.items()) for x in (f"{code}:{b}", i)]) if limits else F.lit(None).cast("map<string,int>")
    base = F.concat(kind("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6), kind("access", lambda s: F.lit(True)), kind("hex", lambda s: F.lit(True)))
    got = got.select("row", base.alias("base"), "random")
    most = lambda token: F.element_at(limit, F.concat_ws(":", encoding(token), band(token).cast("string")))
    # In order of starts, base spans first: a token lies in a base span when one that began by then ends no earlier.
    all_ = F.array_sort(F.concat("base", kind("random", lambda s: F.lit(True))))
    base_end = lambda seen, s: F.when(s["rank"] < KINDS.index("random"), F.greatest(seen, s["end"])).otherwise(seen)
    told = running(all_, F.lit(0), base_end, lambda seen, s: F.struct((seen >= s["end"]).alias("inside"), s.alias("span")), f"struct<inside:boolean,span:{FOUND}>")
    stays = lambda t: (t["span"]["kind"] != "random") | (~t["inside"] & (_bin(battery(t["span"]["text"])) <= most(t["span"]["text"])))
    return got.select(*unpacked(docs, to), F.transform(F.filter(told, stays), lambda t: t["span"]).alias(to))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (overlapping ones as one) replaced by the mark. What lies between is cut out of the text by blocks first, as a place in a string is found by counting."""
    gap = "struct<from:int,to:int>"
    gaps = F.filter(running(found, F.lit(0), lambda pos, s: F.greatest(pos, s["end"]), lambda pos, s: F.struct(pos.alias("from"), s["start"].alias("to")), gap), lambda g: g["to"] >= g["from"])
    gaps = F.concat(gaps, F.array(F.struct(F.array_max(F.transform(found, lambda s: s["end"])).alias("from"), F.length(text).alias("to"))))

    def pieces(block: Column) -> Column:
        begin = block[0]["from"]
        held = F.substring(text, begin + 1, F.element_at(block, -1)["to"] - begin)
        return let(held, lambda t: F.transform(block, lambda g: F.substring(t, g["from"] - begin + 1, g["to"] - g["from"])))

    return F.array_join(F.flatten(F.transform(blocks(gaps), pieces)), mark)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by a mark; the columns stay."""
    held = docs.select(packed(docs), column(text_col).cast("string").alias("text"))
    found = scan(held, thresholds(held), to="spans")
    new = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select(*[new.alias(c) if c.lower() == text_col.lower() else x for c, x in zip(docs.columns, unpacked(docs), strict=True)])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, thresholds(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
