"""Approximate nearest neighbours by additive quantisation.

A vector, scaled to length one, is approximated by a sum of full-dimensional codewords, one of each codebook. Codebooks are
trained on a bounded sample, each on what its forerunners leave of it. Encoding is a beam search: at every codebook the BEAM best sums so
far are extended by every codeword and the BEAM best of these stay. Codes and the norm of each approximation are stored. A
query turns into one table of products with all codewords; a candidate's score is the sum of its codewords' entries, over its stored norm. The SHORTLIST best by that
score are compared by exact cosine in double precision, from the original vectors.

Every row is indexed. Equal vectors are one entry, that keeps its topk + 1 smallest ids (a query's answer can hold no more of
equal ones). Queries are packed in blocks, and the codes of all entries (books + 16 bytes each) pass each block of queries in one task, block by block,
which keeps a running shortlist for each query: queries and codes are all that it holds, and it emits SHORTLIST rows a query, once.
Nothing but codebooks goes to all executors.

Null, zero and non-finite vectors, ones with null components or another length than the commonest (of equally common ones the greatest), and rows without an id
take no part, neither as queries nor as candidates. Ties go to the smaller id. Rows that repeat an id count as entries of
their own; a query meets none of its own id. An empty table, or one without queries, gives no rows. Jobs run while the result is built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pq import _exact, as_matrix, kmeans, unit, valid, vector_size
from .shared import batch_rows, discard, materialize, table

#: Rows that codebooks are trained on, at most.
SAMPLE, BOOKS, WORDS, BEAM = 16_384, 16, 256, 4
TOPK, SHORTLIST, BLOCK = 5, 400, 4096
#: Queries of a block, at most and at least.
QUERIES = (1024, 64)


class Additive:
    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM):
        self.books, self.beam, rest = [], beam, sample.copy()
        for m in range(books):
            book = kmeans(rest, min(words, len(rest)), 8, seed=m)
            near = np.concatenate([np.argmin((book * book).sum(1) - 2 * rest[a : a + 4096] @ book.T, axis=1) for a in range(0, len(rest), 4096)])
            rest = rest - book[near]
            self.books.append(book)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and norms of the approximations, by beam search over residuals."""
        n = len(x)
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            parent, word = np.divmod(best, len(book))
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        codes, rest = codes[:, 0], rest[:, 0]
        return codes, np.maximum(1e-12, np.sqrt(((x - rest) ** 2).sum(1)))

    def products(self, queries: np.ndarray) -> np.ndarray:
        """The table of each query: its products with all codewords, by book."""
        return np.stack([np.pad((queries @ book.T).astype(np.float32), ((0, 0), (0, WORDS - len(book)))) for book in self.books], axis=1)

    @staticmethod
    def scores(products: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines of every query with every entry, by look-ups in the queries' tables."""
        out = np.zeros((len(products), len(codes)), np.float32)
        for m in range(products.shape[1]):
            out += products[:, m][:, codes[:, m]]
        return out / norms.astype(np.float32)


HITS = pa.schema([("asker", pa.int64()), ("entry", pa.int64())])


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", topk: int = TOPK, shortlist: int = SHORTLIST, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest. is_query is a condition on the rows of vectors."""
    spark = vectors.sparkSession
    stored = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # single-precision vectors travel as they are
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(stored).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(valid("v", vector_size(rows, "v")) & F.col("id").isNotNull())
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= topk + 1)
    # Entries and queries are numbered as they are written.
    entries = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id()), "entries")
    n = entries.count()
    queries = materialize(rows.filter("asks").select(F.col("id").alias("query_id"), "v").withColumn("asker", F.monotonically_increasing_id()), "queries")
    asked = queries.count()
    picked = entries.select("v", F.xxhash64("v", F.lit(1)).alias("h")).orderBy("h").limit(sample).select("v").toArrow().column(0).combine_chunks() if n else None
    model = Additive(unit(as_matrix(picked))) if n else None
    shared = spark.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for at in range(0, len(got), 512):
                part = got.slice(at, 512)
                codes, norms = shared.value.encode(unit(as_matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["entry", "code", "norm"])

    coded = materialize(entries.select("entry", "v").mapInArrow(code, "entry long, code binary, norm double"), "codes")

    def blocks(df: DataFrame, key: str, count: int, rows_as: str, number: str) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64(F.lit(3), key), F.lit(count)).cast("int").alias(number)).agg(F.collect_list(F.struct(*df.columns)).alias(rows_as))

    e_blocks, most, least = max(1, -(-n // block)), *QUERIES
    q_blocks = max(1, -(-asked // most), min(spark.sparkContext.defaultParallelism, asked // least))
    told = materialize(blocks(coded, "entry", e_blocks, "e", "k"), "code-blocks")
    asking = blocks(queries.select("asker", "v"), "asker", q_blocks, "q", "b").select("b", F.lit(-1).alias("k"), "q", F.lit(None).cast(told.schema["e"].dataType).alias("e"))
    # The stated queries against all rows, in blocks: each block of queries comes first in its task, and then every block of codes.
    passing = told.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("b"), "k", F.lit(None).cast(asking.schema["q"].dataType).alias("q"), "e")
    met = asking.union(passing).repartition(q_blocks, "b").sortWithinPartitions("b", "k")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None

        def result() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(names), 64):
                ids = found[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + 64], ids.shape[1])), pa.array(ids.ravel())], schema=HITS)

        for got in batches:
            for i in range(len(got)):
                if got.column(1)[i].as_py() < 0:
                    if names is not None:
                        yield from result()
                    q = got.column(2)[i].values
                    names, tables = q.field("asker").to_numpy(), shared.value.products(unit(as_matrix(q.field("v"))))
                    found, held = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0), np.float32)
                    continue
                if names is None:
                    continue
                e = got.column(3)[i].values
                ids = e.field("entry").to_numpy()
                codes, norms = np.frombuffer(b"".join(e.field("code").to_pylist()), np.uint8).reshape(len(ids), -1), e.field("norm").to_numpy()
                order = np.argsort(ids)
                ids, codes, norms = ids[order], codes[order], norms[order]
                keep = min(shortlist, held.shape[1] + len(ids))
                best, top = np.empty((len(names), keep), np.int64), np.empty((len(names), keep), np.float32)
                for at in range(0, len(names), 64):
                    part = slice(at, at + 64)
                    s = np.concatenate([held[part], shared.value.scores(tables[part], codes, norms)], axis=1)
                    pick = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    old = pick < held.shape[1]
                    best[part] = np.where(old, np.take_along_axis(found[part], np.where(old, pick, 0), 1) if held.shape[1] else 0, ids[np.where(old, 0, pick - held.shape[1])])
                    top[part] = np.take_along_axis(s, pick, 1)
                found, held = best, top
        if names is not None:
            yield from result()

    with batch_rows(spark, 16):
        short = materialize(met.mapInArrow(score, "asker long, entry long"), "shortlists")
    both = short.join(queries.withColumnRenamed("v", "qv"), "asker").join(entries.select("entry", "v", "ids"), "entry")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            s = _exact(as_matrix(got.column(1)), as_matrix(got.column(2))) if len(got) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(3), pa.array(s)], names=["query_id", "ids", "score"])

    scored = both.select("query_id", "qv", "v", "ids").mapInArrow(exact, "query_id long, ids array<long>, score double")
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    ranked = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    out = materialize(ranked.filter(F.col("rank") <= topk).select("query_id", "rank", "vec_id", "score"), "nearest")
    for t in (entries, queries, coded, told, short):
        discard(t)
    return out


def op4_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
