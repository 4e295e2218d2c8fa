"""Near-duplicate embeddings by product quantisation: coarse inverted lists, residual subspace codes, table-lookup distances, exact cosine rerank.

Vectors are scaled to length one, and equal ones become one class first, so copies cost one row. A bounded sample trains the
coarse centroids by k-means (as many as the square root of the number of classes, but at least PER_LIST sampled vectors to each) and, on its residuals, the codebooks of the subspaces; both go to the
executors as small arrays. Every class is stored in its nearest list with its codes and the length of its quantisation error, and probes
its nearest lists. How many suffice is measured, not guessed: vectors of the sample are turned by exactly the threshold's angle towards
others, and of these simulated pairs, the hardest there are, every one must meet, as it does when either side probes the other's list.
In a list, the table-lookup distance to a code differs from the true one by at most the stored error, so discarding what lies beyond
radius + error loses nothing; sums over the first subspaces already discard most. What is left is compared by exact cosines in double precision.

Work is dealt in blocks: a list's members, and the classes that probe it, are packed BLOCK to a row, and every pair of blocks of
a list is a task row, so a list with a third of all rows is many rows. A pair of blocks returns for each vector its number of links, and
a spanning forest of the links for the components, never all pairs. Where both sides probe each other's list a pair meets twice, and either
meeting counts it for its own prober only.

Odd cases: null, zero, non-finite vectors and ones with null components, and rows without an id, have no links (component: the own id); rows that repeat an id
count as vectors of their own; an empty table gives no rows. All vectors must have the commonest length among non-zero ones (of equally common
ones the greatest); others have no links. Jobs run while the result is built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import batch_rows, discard, materialize, table

#: Rows that centroids and codebooks are trained on: so many, or PER_LIST for each list where that is more, and never more than SAMPLE_MOST.
SAMPLE, SAMPLE_MOST, PER_LIST, SUBSPACES, CODES, BLOCK = 16_384, 131_072, 8, 16, 64, 2048
#: Simulated pairs that fix the number of probes, and the fewest probes.
SIMULATED, LEAST_PROBES = 8192, 8
COSINE = 0.9


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin((c * c).sum(1) - 2 * part @ c.T, axis=1) for part in np.array_split(x, 1 + len(x) * k // (1 << 24))])
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def valid(vector: str, size: int):
    """The row's vector can be compared: right length, no null or non-finite component, not zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_size(rows: DataFrame, vector: str) -> int:
    """The commonest length of vectors with a component that is not zero; of equally common ones the greatest."""
    sizes = rows.filter(F.exists(vector, lambda x: x != 0)).groupBy(F.size(vector).alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def as_matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantizer:
    """Coarse centroids and the codebooks of residual subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int, cosine: float):
        lists = max(1, min(lists, len(sample) // PER_LIST))
        self.centroids = kmeans(sample, lists)
        residual = np.concatenate([x - self.centroids[self.nearest(x)] for x in np.array_split(sample, 1 + len(sample) // 2048)])
        self.edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], min(codes, len(sample)), 8) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        self.many = min(lists, self._sufficient(sample, cosine))

    def _sufficient(self, sample: np.ndarray, cosine: float) -> int:
        """Probes by which every simulated pair at the threshold meets from one side or the other."""
        rng, most = np.random.default_rng(9), LEAST_PROBES
        for _ in range(-(-SIMULATED // 1024)):
            x, toward = sample[rng.integers(0, len(sample), 1024)], sample[rng.integers(0, len(sample), 1024)]
            aside = toward - (toward * x).sum(1)[:, None] * x
            length = np.sqrt((aside * aside).sum(1))
            x, aside = x[length > 1e-6], aside[length > 1e-6] / length[length > 1e-6, None]
            if len(x):
                y = cosine * x + (1 - cosine * cosine) ** 0.5 * aside
                dx, dy = self.distances(x), self.distances(y)
                rank = [(d < d[np.arange(len(d)), other.argmin(1)][:, None]).sum(1) for d, other in ((dx, dy), (dy, dx))]
                most = max(most, 1 + int(np.minimum(*rank).max()))
        return most

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less the square of x."""
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(x), axis=1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of each vector's quantisation error."""
        codes, error = np.zeros((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for m, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True)):
            part = residual[:, a:b]
            codes[:, m] = np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """For each subspace, squared distances of each row to each code."""
        return [((residual[:, a:b] ** 2).sum(1)[:, None] - 2 * residual[:, a:b] @ book.T + (book * book).sum(1)) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)]

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The nearest lists of each row, the nearest of all first."""
        d = self.distances(x)
        lists = np.argpartition(d, self.many - 1, axis=1)[:, : self.many]
        own, rows = d.argmin(axis=1), np.arange(len(x))
        at = (lists == own[:, None]).argmax(axis=1)
        lists[rows, at], lists[:, 0] = lists[:, 0].copy(), own
        return lists.astype(np.int32)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of x and y by one order of operations, so that equal pairs give equal values."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


PAIR = "id long, n long, a long, b long"
ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of the links (a, b) to the least node that it reaches through them."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    label, seen = np.arange(len(nodes)), None
    while seen is None or (label != seen).any():
        seen = label.copy()
        np.minimum.at(label, seen[a], seen[b])
        np.minimum.at(label, seen[b], seen[a])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row. See the module for the method and the odd cases."""
    spark = vectors.sparkSession
    # Single-precision vectors travel as they are, at half the bytes; all sums are in double precision.
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    stored = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    size = vector_size(rows, "v")
    rows = rows.withColumn("good", valid("v", size) & F.col("vec_id").isNotNull())
    classes = rows.filter("good").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbered as they are written
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists = max(1, round(n**0.5))
    picked = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(min(SAMPLE_MOST, max(sample, PER_LIST * lists))).select("v").toArrow().column(0).combine_chunks()
    quantizer = Quantizer(unit(as_matrix(picked)), lists, SUBSPACES, CODES, cosine)
    shared = spark.sparkContext.broadcast(quantizer)
    radius = (2 - 2 * cosine) ** 0.5

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                got = whole.slice(at, 1024)
                v = as_matrix(got.column(1))
                lists = q.probes(unit(v))
                k, home = len(v), lists[:, 0]
                source = np.concatenate([np.arange(k), np.repeat(np.arange(k), q.many)])
                sent, told = pa.array([r.tobytes() for r in v.astype(stored)], pa.binary()), pa.array([r.tobytes() for r in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([home, lists.ravel()])), pa.array(np.arange(len(source)) < k), got.column(0).take(pa.array(source)), got.column(2).take(pa.array(source)),
                    pa.array(home[source]), pa.concat_arrays([told, pa.nulls(len(source) - k, pa.binary())]), sent.take(pa.array(source)),
                ], names=["list", "member", "id", "copies", "home", "probes", "v"])

    placed = materialize(classes.select("id", "v", "copies").mapInArrow(place, "list int, member boolean, id long, copies long, home int, probes binary, v binary"), "placed")
    # Blocks: a slice of a list by hash, as many as its size asks for.
    sizes = placed.groupBy("list", "member").agg(F.count("*").alias("size"))
    slices = F.ceil(F.col("size") / block).cast("int")
    dealt = placed.join(F.broadcast(sizes.withColumn("slices", slices).drop("size")), ["list", "member"])  # two rows a list, and lists are at most the sample
    packed = dealt.groupBy("list", "member", "slices", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice")).agg(F.collect_list(F.struct("id", "copies", "home", "probes", "v")).alias("rows"))
    packed = materialize(packed, "blocks")
    discard(placed)
    members = packed.filter("member").select("list", F.col("slice").alias("ms"), F.col("rows").alias("m"))
    probing = packed.filter("not member").select("list", "slice", F.col("rows").alias("p"))
    counts = packed.filter("member").groupBy("list").agg(F.first("slices").alias("n"))
    probing = probing.join(F.broadcast(counts), "list").select("list", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ms"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for got in batches:
            for i in range(len(got)):
                yield pair_of_blocks(q, got.column(0)[i].as_py(), open_block(got.column(1), i), open_block(got.column(2), i))

    def open_block(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = column[i].values
        v = np.frombuffer(b"".join(rows.field("v").to_pylist()), stored).reshape(len(rows), -1).astype(np.float64)
        probes = np.frombuffer(b"".join(p or b"" for p in rows.field("probes").to_pylist()), np.int32)
        return rows.field("id").to_numpy(), rows.field("copies").to_numpy(), v, rows.field("home").to_numpy(), probes.reshape(len(rows), -1) if len(probes) else None

    def pair_of_blocks(q: Quantizer, at: int, p: tuple, m: tuple) -> pa.RecordBatch:
        center = q.centroids[at]
        px, mx = unit(p[2]), unit(m[2])
        codes, error = q.encode(mx - center)
        tables, most = [t.astype(np.float32) for t in q.tables(px - center)], ((radius + error) ** 2 + 1e-4).astype(np.float32)
        links, met, edges = np.zeros(len(px), np.int64), np.zeros(len(mx), np.int64), []
        early = (len(tables) + 1) // 2
        for at in range(0, len(px), 256):
            near = np.zeros((len(px[at : at + 256]), len(mx)), np.float32)
            for j, table_ in enumerate(tables[:early]):
                near += table_[at : at + 256][:, codes[:, j]]
            x, y = np.nonzero(near <= most)
            rest = near[x, y]
            for j in range(early, len(tables)):
                rest += tables[j][at + x, codes[y, j]]
            x, y = x[rest <= most[y]] + at, y[rest <= most[y]]
            for part in range(0, len(x), 100_000):
                a, b = x[part : part + 100_000], y[part : part + 100_000]
                other = p[0][a] != m[0][b]
                a, b = a[other], b[other]
                good = _exact(p[2][a], m[2][b]) >= cosine
                a, b = a[good], b[good]
                np.add.at(links, a, m[1][b])
                alone = ~(m[4][b] == p[3][a][:, None]).any(axis=1)  # the member does not probe the other's list
                np.add.at(met, b[alone], p[1][a[alone]])
                edges += stars(p[0][a], m[0][b])
        if edges:
            edges = stars(np.concatenate(edges[0::2]), np.concatenate(edges[1::2]))
        ids, links = np.concatenate([p[0], m[0]]), np.concatenate([links, met])
        found = np.flatnonzero(links)
        ea, eb = edges if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        none, gap = pa.nulls(len(ea), pa.int64()), pa.nulls(len(found), pa.int64())
        pick = [ids[found], links[found]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(c, pa.int64()), none]) for c in pick] + [pa.concat_arrays([gap, pa.array(c, pa.int64())]) for c in (ea, eb)], schema=ARROW)

    with batch_rows(spark, 4):
        compared = materialize(probing.join(members, ["list", "ms"]).select("list", "p", "m").mapInArrow(compare, PAIR), "compared")
    degree = compared.filter("id is not null").groupBy("id").agg(F.sum("n").alias("others"))
    links = compared.filter("a is not null").select("a", "b")
    closed = materialize(components(links), "closed")
    told = classes.join(degree, "id", "left").join(closed, "id", "left").withColumn("component", F.coalesce("component", "id"))
    told = materialize(told.select("v", "least", "component", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n")), "told")
    first = materialize(told.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = materialize(told.join(first, "component").select("v", "n", "component_id"), "named")
    for t in (classes, packed, compared, closed, told, first):
        discard(t)
    out = rows.select("vec_id", F.when(F.col("good"), F.col("v")).alias("v")).join(named, "v", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
