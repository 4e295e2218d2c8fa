"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets become one class first (a grouped aggregate, so thousands of copies cost one row each),
and only classes go on. Each class has a signature of TREES x DEPTH hashes. A tree is a sorted order of the classes by the
signature rotated to start at the tree's own hashes. Spark range-partitions and sorts the orders of all trees; the key ends
in the class's own hash, so even a huge group of near copies is dealt evenly. In an order, a class's candidates are its
neighbours by longest common prefix: those next to it that share at least MIN_DEPTH hashes. Where a region is sparse,
neighbours at MIN_DEPTH are met; where it is crowded, the neighbours are those with the longest prefix, so the depth adapts by region.

Candidates whose signatures agree too little for the threshold (by more than SLACK standard deviations) are passed over.
First only direct neighbours in each order are met (TREES pairs a class at most), all that reach the estimate are confirmed, and the links are closed into
components. Then the orders are sorted again, and in sparse regions, up to NEIGHBOURS places on, every candidate pair of two components is confirmed: pairs within a
component could change nothing, so a large group of near copies costs a few pairs for each of its classes. Confirmation intersects full sets, worked
out again from the texts of candidates alone: a bitmap of their ids, of at most BITMAP_BITS, keeps the other texts out of the shuffle.
A region (the classes that share an order's first MIN_DEPTH hashes) with more places than that and more than one component is crowded: there every
pair of two components is compared, block against block. A component that fills a block has blocks of its own, which do not meet each other.
A pair at the threshold shares MIN_DEPTH hashes in at least one of the 16 orders but for one case in 100,000, and every such pair is met.

Odd cases: a text without words (or null) has an empty set and links with nothing; a null id keeps its row, with a null
component and kept true; rows that repeat an id are each judged by their own text; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .shared import batch_rows, column, discard, let_go, listed, materialize, packed, small_batches, table, unpacked
from .textbuf import ASCII_SPACE, LOWER, chunks, mix, span_hashes, word_spans

TREES, DEPTH, MIN_DEPTH, NEIGHBOURS, SLACK = 16, 8, 3, 6, 5.0
#: Hashes of the rotated signature in a sort key, two bytes each.
KEY_HASHES = 16
WORDS, PERCENT = 5, 80
#: Bytes of texts that are cut into words together; a worker holds some dozens of times as much.
CHUNK_BYTES = 1 << 18
#: Rows that hold blocks, in an Arrow batch.
BLOCK_ROWS = 4
#: Classes of a crowded region in a block, and bytes of their shingle sets.
BLOCK, BLOCK_BYTES = 1024, 1 << 23
_SEEDS = np.random.default_rng(11).integers(0, 1 << 32, 2 * TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
MULTIPLIERS, OFFSETS = _SEEDS[: TREES * DEPTH] | np.uint32(1), _SEEDS[TREES * DEPTH :]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; the whole sequence as one where it has fewer words."""
    let_go()
    for _, data, offsets in chunks(column, CHUNK_BYTES):
        data = LOWER[data]
        starts, stops, before = word_spans(data, offsets, ASCII_SPACE)
        word = span_hashes(data, starts, stops)
        for i in range(len(offsets) - 1):
            w = word[before[i] : before[i + 1]]
            if not len(w):
                yield w
                continue
            k = min(words, len(w))
            h = w[: len(w) - k + 1].copy()
            for j in range(1, k):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + w[j : len(w) - k + 1 + j])
            yield np.unique(mix(h + np.uint64(k)))


def signature(shingles: np.ndarray) -> bytes:
    """The least 32-bit hash under each permutation, cut to two bytes; its order within a tree is all that is needed."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        h = low[at : at + 2048, None] * MULTIPLIERS + OFFSETS
        h ^= h >> np.uint32(15)
        np.minimum(least, (h * np.uint32(0x2C1B3C6D)).min(axis=0), out=least)
    return (least >> np.uint32(8)).astype(">u2").tobytes()


def describe(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes) and signature of each row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            n, hashes, signatures = [], [], []
            for s in shingle_sets(got.column(1), words):
                n.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature binary")


def _orders(classes: DataFrame) -> DataFrame:
    """Every class once for each tree, range-partitioned and sorted by tree, rotated signature and own hash."""
    step, width = 2 * DEPTH, 2 * KEY_HASHES
    doubled = F.concat("signature", "signature")
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring(doubled, 1 + t * step, F.lit(width))))
    rows = classes.select("rep", "component", F.explode(trees).alias("key"), F.xxhash64("set_hash").alias("tie"))
    parts = min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + classes.count() * TREES // 1000)
    return rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")


def _neighbours(orders: DataFrame, neighbours: int, min_depth: int, most: int | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of two components, within so many places in an order, that share min_depth hashes there. Rows at the ends of a
    partition leave a copy, and the few copies at each border between partitions are paired in a second, small step. Pairs in a run of more than
    `most` places of one region are left out: such regions are compared whole elsewhere."""
    prefix = 1 + 2 * min_depth
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("place", pa.int64()), ("component", pa.int64()), ("key", pa.binary())])

    def border(at: int, side: int, rep: np.ndarray, component: np.ndarray, keys: list[bytes]) -> pa.RecordBatch:
        n = len(rep)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(n, pa.int64()), pa.array([at] * n, pa.int64()), pa.array(range(side * neighbours, side * neighbours + n), pa.int64()), pa.array(component), pa.array(keys, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, rep, component, keys = TaskContext.get().partitionId(), None, None, None
        for got in batches:
            old = 0
            if rep is None:
                rep, component, keys = got.column(0).to_numpy(), got.column(1).to_numpy(), got.column(2).to_pylist()
                yield border(me, 1, rep[:neighbours], component[:neighbours], keys[:neighbours])
            else:
                old = len(rep)
                rep, component, keys = np.concatenate([rep, got.column(0).to_numpy()]), np.concatenate([component, got.column(1).to_numpy()]), keys + got.column(2).to_pylist()
            region = np.cumsum([0, *[x[:prefix] != y[:prefix] for x, y in pairwise(keys)]])
            near = []
            sparse = np.bincount(region)[region] <= (most or len(rep))
            for step in range(1, min(neighbours, len(rep) - 1) + 1):
                fresh = (region[step:] == region[:-step]) & (component[step:] != component[:-step]) & sparse[step:] & (np.arange(len(rep) - step) >= old - step)
                near.append((rep[:-step][fresh], rep[step:][fresh]))
            x, y = (np.concatenate(side) for side in zip(*near, strict=True)) if near else (rep[:0], rep[:0])
            if len(x):
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), none, none, none, pa.nulls(len(x), pa.binary())], schema=schema)
            rep, component, keys = rep[-neighbours:], component[-neighbours:], keys[-neighbours:]
        if rep is not None:
            yield border(me + 1, 0, rep, component, keys)

    made = materialize(orders.select("rep", "component", "key").mapInArrow(run, "a long, b long, border long, place long, component long, key binary"), "neighbours")
    inner = made.filter("border is null").select("a", "b")
    w = Window.partitionBy("border").orderBy("place")
    later = F.array(*[F.lead(F.struct("a", "component", "key", "place"), s).over(w) for s in range(1, neighbours + 1)])
    across = made.filter("border is not null").select("a", "component", "key", "place", later.alias("later")).select("a", "component", "key", "place", F.explode("later").alias("n")).filter(f"n is not null and place < {neighbours} and n.place >= {neighbours} and n.component <> component")
    across = across.filter(F.substring("key", 1, prefix) == F.substring("n.key", 1, prefix)).select(F.least("a", "n.a").alias("a"), F.greatest("a", "n.a").alias("b"))
    out = materialize(inner.union(across).filter("a <> b").distinct(), "pairs")
    discard(made)
    return out


def _least(percent: int) -> float:
    """The share of equal hashes below which a pair is too far from the threshold for chance."""
    t = percent / 100
    return t - SLACK * (t * (1 - t) / (TREES * DEPTH)) ** 0.5


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs with the similarity that their signatures show, without those too far below the threshold for chance."""
    least = _least(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            x = np.frombuffer(b"".join(got.column(2).to_pylist()), np.uint16).reshape(len(got), -1)
            y = np.frombuffer(b"".join(got.column(3).to_pylist()), np.uint16).reshape(len(got), -1)
            same = (x == y).mean(axis=1) if len(got) else np.zeros(0)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([got.column(0).filter(keep), got.column(1).filter(keep), pa.array(same).filter(keep)], schema=schema)

    sig = classes.select("rep", "signature")
    both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("x")), "a").join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, classes: DataFrame, met: DataFrame) -> DataFrame:
    """(rep, shingles) of the classes in met(rep): the sets worked out again from the texts, so that none but these are ever shuffled."""
    wanted = materialize(classes.select("rep", "doc_id", "set_hash").join(met.distinct(), "rep"), "wanted")
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            sets = [s.tobytes() for s in shingle_sets(got.column(2), words)]
            # Another row may have the id, with another text.
            keep = pa.array([xxhash.xxh3_128_digest(s) == h for s, h in zip(sets, got.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([got.column(0).filter(keep), pa.array(sets, pa.binary()).filter(keep)], schema=schema)

    rows = listed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), wanted).join(wanted, "doc_id")
    out = materialize(rows.select("rep", "set_hash", "text").mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"]), "sets")
    discard(wanted)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold: 100 * intersection >= percent * union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            keep = []
            for x, y in zip(got.column(2), got.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) > len(y) else (y, x)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([got.column(0).filter(keep), got.column(1).filter(keep)], schema=schema)

    both = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _crowded(now: DataFrame, neighbours: int, min_depth: int, percent: int, block: int) -> DataFrame:
    """(task, xs, ys, at): the pairs of two components in crowded regions that reach the estimate, those of two blocks in a row. xs and ys are
    classes, at their places in the two lists by turns. A pair is in the first order whose region it shares."""
    step, width = 2 * DEPTH, 2 * min_depth
    regions = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring("signature", 1 + t * step, F.lit(width))))
    rows = now.select("rep", "component", "n_shingles", F.explode(regions).alias("region"))
    full = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter((F.col("n") > neighbours + 1) & (F.col("lo") != F.col("hi")))
    full = materialize(full.select("region"), "crowded")
    member = materialize(rows.join(full, "region"), "member")
    load = member.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum(8 * F.col("n_shingles")).alias("bytes"))
    load = load.withColumn("own", F.when((F.col("n") > block) | (F.col("bytes") > BLOCK_BYTES), F.col("component")))
    load = materialize(load, "load")
    parts = load.groupBy("region", "own").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = materialize(parts.select("region", "own", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).alias("many")), "parts")
    sided = load.select("region", "component", "own").join(parts.withColumnsRenamed({"region": "r", "own": "o"}), (F.col("region") == F.col("r")) & F.col("own").eqNullSafe(F.col("o"))).select("region", "component", "own", "many")
    sided = materialize(sided, "sided")
    dealt = member.select("rep", "component", "region").join(sided, ["region", "component"]).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("many")))
    dealt = dealt.join(now.select("rep", "signature"), "rep")
    blocks = dealt.groupBy("region", "own", "salt").agg(F.collect_list(F.struct("rep", "component", "signature")).alias("rows"))
    blocks = materialize(blocks.withColumn("name", F.xxhash64("own", "salt")), "blocks")
    names = blocks.select("region", "name", "own")
    met = names.join(names.withColumnsRenamed({"name": "other", "own": "their"}), "region").filter("name <= other and (own is null or their is null or own <> their)").select("region", "name", "other")
    both = met.join(blocks.select("region", "name", F.col("rows").alias("x")), ["region", "name"]).join(blocks.select("region", F.col("name").alias("other"), F.col("rows").alias("y")), ["region", "other"])
    least = _least(percent)
    schema = pa.schema([("task", pa.string()), ("xs", pa.list_(pa.int64())), ("ys", pa.list_(pa.int64())), ("at", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            got = column[row].values
            hashes = np.frombuffer(b"".join(got.field("signature").to_pylist()), ">u2").reshape(len(got), -1).astype(np.uint16)
            heads = [[bytes(h) for h in np.ascontiguousarray(hashes[:, DEPTH * t : DEPTH * t + min_depth])] for t in range(TREES)]
            return got.field("rep").to_numpy(), got.field("component").to_numpy(), hashes, np.array([[hash(h) for h in head] for head in heads])

        for got in batches:
            for row in range(len(got)):
                (x, cx, hx, px), (y, cy, hy, py) = side(got.column("x"), row), side(got.column("y"), row)
                region, name, other = got.column("region")[row].as_py(), got.column("name")[row].as_py(), got.column("other")[row].as_py()
                # An order's first hash-sized prefix decides the region, so a pair that met in an earlier order is left to that.
                for at in range(0, len(x), 256):
                    part = slice(at, at + 256)
                    open_ = cx[part, None] != cy
                    if name == other:
                        open_ &= x[part, None] < y
                    for t in range(region[0]):
                        open_ &= px[t][part, None] != py[t]
                    if not open_.any():
                        continue
                    same = np.zeros(open_.shape, np.uint8)
                    for h in range(hx.shape[1]):
                        same += hx[part, h, None] == hy[:, h]
                    i, j = np.nonzero(open_ & (same >= least * hx.shape[1]))
                    if len(i):
                        ui, i = np.unique(i, return_inverse=True)
                        uj, j = np.unique(j, return_inverse=True)
                        pairs = np.stack([i, j], 1).astype("<u2").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([f"{region.hex()}.{name}.{other}.{at}"]), pa.array([x[part][ui]], schema[1].type), pa.array([y[uj]], schema[2].type), pa.array([pairs], pa.binary())], schema=schema)

    with batch_rows(now.sparkSession, BLOCK_ROWS):
        out = materialize(both.select("region", "name", "other", "x", "y").mapInArrow(run, "task string, xs array<long>, ys array<long>, at binary"), "crowd")
    for t in (full, member, load, parts, sided, blocks):
        discard(t)
    return out


def _crowd_confirmed(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join whatever the pairs of a row of crowd do that meet the threshold; a row leaves fewer links than it has classes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    wanted = crowd.select("task", F.explode(F.array_union("xs", "ys")).alias("rep"))
    held = wanted.join(sets, "rep").groupBy("task").agg(F.collect_list(F.struct("rep", "shingles")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for row in range(len(got)):
                names = got.column("held")[row].values.field("rep").to_pylist()
                of = {n: np.frombuffer(s.as_buffer(), np.uint64) for n, s in zip(names, got.column("held")[row].values.field("shingles"), strict=True)}
                xs, ys = got.column("xs")[row].values.to_pylist(), got.column("ys")[row].values.to_pylist()
                ij = np.frombuffer(got.column("at")[row].as_py(), "<u2").reshape(-1, 2).astype(np.int64)
                x, y = [of[n] for n in xs], [of[n] for n in ys]
                nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
                if len(ij) > 4 * (len(x) + len(y)):
                    # Only shingles of both sides count; ranks in their union address columns of two 0/1 matrices.
                    fx, fy = np.concatenate(x), np.concatenate(y)
                    shared = np.intersect1d(fx, fy)
                    rx, ry, total = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny), np.zeros((len(x), len(y)))
                    inx, iny = np.isin(fx, shared), np.isin(fy, shared)
                    rx, cx, ry, cy = rx[inx], np.searchsorted(shared, fx[inx]), ry[iny], np.searchsorted(shared, fy[iny])
                    for at in range(0, len(shared), 4096):
                        m, k = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
                        here, there = (cx >= at) & (cx < at + 4096), (cy >= at) & (cy < at + 4096)
                        m[rx[here], cx[here] - at] = 1
                        k[ry[there], cy[there] - at] = 1
                        total += m @ k.T
                    both = total[ij[:, 0], ij[:, 1]].astype(np.int64)
                else:
                    both = np.array([len(np.intersect1d(x[i], y[j], assume_unique=True)) for i, j in ij], np.int64)
                good = ij[100 * both >= percent * (nx[ij[:, 0]] + ny[ij[:, 1]] - both)]
                part: dict[int, int] = {}

                def find(n: int) -> int:
                    while part.setdefault(n, n) != n:
                        part[n] = n = part[part[n]]
                    return n

                links = []
                for i, j in good.tolist():
                    a, b = find(xs[i]), find(ys[j])
                    if a != b:
                        part[a] = b
                        links.append((xs[i], ys[j]))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return crowd.join(held, "task").select("xs", "ys", "at", "held").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, neighbours: int = NEIGHBOURS, min_depth: int = MIN_DEPTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs. See the module for the method and the odd cases. Jobs run while the result is built."""
    return _judged(docs, id_col, text_col, words, percent, neighbours, min_depth, block)[0]


def _judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, neighbours: int = NEIGHBOURS, min_depth: int = MIN_DEPTH, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """The result, and the written tables that it reads."""
    rows = materialize(describe(docs, id_col, text_col, words), "signatures")
    known = rows.filter("set_hash is not null and doc_id is not null")
    classes = known.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # Numbered as they are written; the table is the only source of the numbers. In the end a class's smallest id stands for it.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    def candidates(now: DataFrame, places: int, most: int | None = None) -> DataFrame:
        found = _neighbours(_orders(now), places, min_depth, most)
        pairs = materialize(_estimated(found, classes, percent).select("a", "b"), "estimated")
        discard(found)
        return pairs

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))

    pairs = candidates(classes.withColumn("component", F.col("rep")), 1)
    sets = _sets(docs, id_col, text_col, words, classes, ends(pairs))
    sure = materialize(_confirmed(pairs, sets, percent), "sure")
    closed = materialize(components(sure), "closed")
    for t in (pairs, sets, sure):
        discard(t)
    now = materialize(classes.join(closed.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "now")
    pairs = candidates(now, neighbours, neighbours + 1)
    crowd = _crowded(now, neighbours, min_depth, percent, block)
    sets = _sets(docs, id_col, text_col, words, classes, ends(pairs).union(crowd.select(F.explode("xs"))).union(crowd.select(F.explode("ys"))))
    late = materialize(_confirmed(pairs, sets, percent), "late")
    with batch_rows(docs.sparkSession, BLOCK_ROWS):
        dense = materialize(_crowd_confirmed(crowd, sets, percent), "dense")
    for t in (pairs, crowd, sets):
        discard(t)
    written, late = (late, dense), late.union(dense)
    # Links between components: components of the components.
    names = {end: closed.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")) for end in "ab"}
    over = late.join(names["a"], "a", "left").join(names["b"], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(over).select(F.col("id").alias("component"), F.col("component").alias("top"))
    member = now.select("set_hash", "doc_id", "component").join(joined, "component", "left")
    member = materialize(member.select("set_hash", "doc_id", F.coalesce("top", "component").alias("component")), "members")
    least = materialize(member.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    lookup = materialize(member.join(least, "component").select("set_hash", "component_id"), "components")
    for t in (closed, *written, now, member, least, classes):
        discard(t)
    whole = F.coalesce("component_id", "doc_id")
    out = rows.select("doc_id", "n_shingles", "set_hash").join(lookup, "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(whole)).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out, [rows, lookup]


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are kept; of rows that repeat a kept id, one. The columns stay, and rows without an id all stay."""
    found, tables = _judged(docs, id_col, **options)
    judged = materialize(found.select("doc_id", "kept").filter("doc_id is not null"), "judged")
    for t in tables:
        discard(t)
    gone = judged.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    out = docs.select(packed(docs), column(id_col).alias("id")).join(gone, F.col("id") == F.col("gone"), "left_anti").select(*unpacked(docs))
    if judged.filter("kept").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return out
    return out.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(out.filter(F.col(id_col).isNull()))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
