"""What the operators share: the shared working folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: bounds a worker's memory when texts are long.
BATCH_ROWS = "1000"
#: Bytes in an Arrow batch, whatever its rows: a thousand long texts or pairs of sets would take many times as much in the JVM and in the worker.
BATCH_BYTES = 4 << 20
#: What operators keep in a Python worker from task to task, and how it is let go; Spark gives the same worker to the next operator.
KEPT: dict[str, Callable[[], None]] = {}
#: Bits of the broadcast bitmap of wanted ids (32 MB). With more wanted ids than that bears, more texts pass it and are dropped by the join after it.
BITMAP_BITS = 1 << 28


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a new local one, and a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, tag)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.__dict__["written_at"] = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    folder = df.__dict__.get("written_at")
    if folder:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, unless the session sets fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:  # "1m" and the like was set by someone
        spark.conf.set(key, str(BATCH_BYTES))


def let_go() -> None:
    """Free what another operator's earlier tasks keep in this worker."""
    if KEPT:
        while KEPT:
            KEPT.popitem()[1]()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # else the C library keeps the memory
        if trim:
            trim(0)


def listed(rows: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is in wanted (of the same type), and a few of the others, by a bitmap of hashed ids that every task gets."""
    bits = min(BITMAP_BITS, 1 << (16 * wanted.count()).bit_length())
    place = F.pmod(F.xxhash64(id_col), F.lit(bits))
    bitmap = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(bitmap), "bucket")
    return kept.filter(byte.bitwiseAND(F.array(*[F.lit(1 << i) for i in range(8)])[(at % 8).cast("int")]) != 0).select(*rows.columns)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it is open, Arrow batches have at most so many rows; for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *without: str) -> Column:
    """All columns but those named (in any case, as Spark takes names) as one struct "row", so that working columns can have any name."""
    gone = {w.lower() for w in without}
    return F.struct(*[column(c).alias(c) for c in df.columns if c.lower() not in gone]).alias("row")


def unpacked(df: DataFrame, *without: str) -> list[Column]:
    """The columns of packed(df, *without), out of "row"."""
    gone = {w.lower() for w in without}
    return [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in gone]


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))
