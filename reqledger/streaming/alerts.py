"""What a stream of movements must tell by itself: requests, notices and bags that stay open too long, keys that come back with another body, and lines that contradict their history.

Ageing and conflicts keep a few values for each key between micro-batches, as a table that the next batch is grouped with; what event time has passed is left out of it, so it follows what is open and
not the log. No key makes a call of its own: a batch is one grouping. All three give the rows of their batch twins whatever the batches are and wherever a run was stopped and taken up again, as long as rows come within DELAY."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, replay
from .streams import movements, shared_root

#: Days after which something that is still open is told (fixed values, ascending).
LIMITS = {"request": (7,), "notice": (3,), "bag": (14, 30)}
#: How late rows may come (microseconds), and how long a key is held (fixed values).
DELAY, HELD_HOURS = 3_600_000_000, 48
HOUR, DAY = 3_600_000_000, 86_400_000_000


@dataclass
class Kept:
    """A stream's rows (with ts) and their step: rows of a batch, what is held of the batches before (None at first) and the event time that has passed (microseconds) give, for each key, an array told of alerts and a struct held (null for nothing)."""

    rows: DataFrame
    told: str
    step: Callable[[DataFrame, DataFrame | None, int], DataFrame]

    @property
    def sparkSession(self) -> SparkSession:
        return self.rows.sparkSession


def _age(rows: DataFrame, held: DataFrame | None, mark: int) -> DataFrame:
    at = F.unix_micros("ts")
    # An opening that is held comes before one that is new.
    opened = lambda new, ts: F.struct(F.lit(new).alias("new"), ts.alias("ts"), F.col("kind"))
    seen = rows.select("id", F.when(F.col("what") == "open", opened(1, at)).alias("opened"), F.when(F.col("what") == "close", at).alias("closed"), F.lit(0).alias("days"))
    if held is not None:
        seen = seen.unionByName(held.select("held.*").select("id", F.when(F.col("ts").isNotNull(), opened(0, F.col("ts"))).alias("opened"), "closed", "days"))
    each = seen.groupBy("id").agg(F.min("opened").alias("opened"), F.min("closed").alias("closed"), F.max("days").alias("days")).select("id", "opened.kind", "opened.ts", "closed", "days")
    limits = F.create_map(*[x for k, days in LIMITS.items() for x in (F.lit(k), F.array(*map(F.lit, days)))])[F.col("kind")]
    due = lambda d: F.col("ts") + d.cast("long") * DAY
    # A limit is told once it has passed, unless the thing was closed before.
    passed = F.filter(limits, lambda d: (d > F.col("days")) & F.when(F.col("closed").isNotNull(), F.col("closed") > due(d)).otherwise(due(d) < mark))
    each = each.withColumn("limits", limits).withColumn("passed", F.coalesce(passed, F.array().cast("array<int>")))
    waits = F.col("closed").isNull() & (due(F.element_at("limits", -1)) >= mark)
    early = F.col("ts").isNull() & (F.col("closed") >= mark)  # a close whose opening may still come
    keep = F.struct("id", "kind", "ts", "closed", F.greatest("days", F.array_max("passed")).alias("days"))
    return each.select(F.transform("passed", lambda d: F.struct(F.col("id"), F.col("kind"), d.alias("days"))).alias("told"), F.when(waits | early, keep).alias("held"))


def ageing(log: DataFrame) -> Kept:
    """log(id, kind, what, ts): openings and closings of requests, notices and bags. A row for each limit that a thing outlived by event time."""
    return Kept(log.select("id", "kind", "what", "ts"), "id long, kind string, days int", _age)


def _conflict(rows: DataFrame, held: DataFrame | None, mark: int) -> DataFrame:
    first = "struct<ts: bigint, body: string>"
    seen = rows.select("line_id", "id", F.struct(F.unix_micros("ts").alias("ts"), "body").alias("came"), F.lit(None).cast(first).alias("first"))
    if held is not None:
        seen = seen.unionByName(held.select("held.*").select("line_id", "id", F.lit(None).cast(first).alias("came"), F.struct("ts", "body").alias("first")))
    each = seen.groupBy("line_id", "id").agg(F.array_sort(F.collect_list("came")).alias("came"), F.max("first").alias("first"))
    none = F.struct(F.col("first.ts").alias("ts"), F.col("first.body").alias("body"), F.array().cast("array<bigint>").alias("hours"))

    def step(s, r):
        fresh = s["ts"].isNull() | (r["ts"] > s["ts"] + HELD_HOURS * HOUR)
        hours = F.when(~fresh & (r["body"] != s["body"]), F.array_append(s["hours"], F.floor((r["ts"] - s["ts"]) / HOUR).cast("bigint"))).otherwise(s["hours"])
        return F.struct(F.when(fresh, r["ts"]).otherwise(s["ts"]).alias("ts"), F.when(fresh, r["body"]).otherwise(s["body"]).alias("body"), hours.alias("hours"))

    out = each.select("line_id", "id", F.aggregate("came", none, step).alias("s"))
    told = F.transform("s.hours", lambda h: F.struct(F.col("line_id"), F.col("id"), h.alias("hours")))
    return out.select(told.alias("told"), F.when(F.col("s.ts") + HELD_HOURS * HOUR >= mark, F.struct("line_id", "id", "s.ts", "s.body")).alias("held"))


def conflicts(log: DataFrame) -> Kept:
    """Movements that come under a user's key within 48 hours of its first use with another body; log(line_id, id, ts and the body's columns)."""
    body = F.sha2(F.to_json(F.struct(*[c for c in sorted(log.columns) if c not in ("line_id", "id", "ts")])), 256)
    return Kept(log.select("line_id", "id", body.alias("body"), "ts"), "line_id long, id long, hours long", _conflict)


class Balances:
    """Sums of a line's movements, kept as one snapshot for each micro-batch: the snapshot before it and the batch's own sums. A batch that runs again reads the same snapshot and writes over its own, so nothing counts twice; older ones are deleted."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_root(spark)}/balances-{uuid.uuid4().hex}"

    def at(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/snapshot={number}")

    def put(self, batch: DataFrame, number: int) -> None:
        sums = replay.bucket_sums(batch)
        if number:
            sums = self.at(number - 1).unionByName(sums).groupBy("line_id").agg(*[F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in sums.columns if c != "line_id"])
        sums.write.mode("overwrite").parquet(f"{self.folder}/snapshot={number}")
        _delete(self.spark, f"{self.folder}/snapshot={number - 2}")

    def follow(self, log: DataFrame) -> DataFrame:
        """Run to the end of what is there, from where the last run stopped, and give the last snapshot."""
        query = log.writeStream.option("checkpointLocation", f"{self.folder}/state").foreachBatch(self.put).trigger(availableNow=True).start()
        query.awaitTermination()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [str(f.getPath().getName()) for f in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        last = max((int(n.split("=")[1]) for n in names if n.startswith("snapshot=")), default=None)
        return replay.bucket_sums(log.sparkSession.createDataFrame([], log.schema)) if last is None else self.at(last)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gathered(kept: Kept, folder: str | None = None) -> DataFrame:
    """All alerts that a stream has given in the runs over a folder, each batch written once however often it ran. A run goes to the end of what is there, from where the last one stopped.

    A batch reads what the one before it held and the time that had passed by then, and writes its own beside them, so a batch that runs again does the same; older ones are deleted."""
    spark = kept.sparkSession
    folder = folder or f"{shared_root(spark)}/alerts-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        passed = spark.read.parquet(f"{folder}/mark={number - 1}").first()[0] if number else None
        rows = batch if passed is None else batch.filter(F.unix_micros("ts") > passed)
        latest = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        mark = max(x for x in (passed, None if latest is None else latest - DELAY, -(1 << 62)) if x is not None)
        held = spark.read.parquet(f"{folder}/held={number - 1}").filter("held is not null") if number else None
        kept.step(rows, held, mark).filter("size(told) > 0 or held is not null").write.mode("overwrite").parquet(f"{folder}/held={number}")
        told = spark.read.parquet(f"{folder}/held={number}").select(F.explode("told").alias("t")).select("t.*")
        told.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        spark.range(1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{folder}/mark={number}")
        for name in ("held", "mark"):
            _delete(spark, f"{folder}/{name}={number - 2}")

    kept.rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(kept.told).parquet(f"{folder}/out")
    return found.select(*found.columns[: kept.told.count(",") + 1])


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's requests, notices and bags as they open, and three of four as they close."""
    rows = movements(spark, sf_dir)
    kind = F.when(F.col("action") == "BACKORDER_REQUESTED", "request").when(F.col("action") == "DIRECT_ISSUE", "notice").when(F.col("action") == "BAG", "bag")
    known = rows.select("id", kind.alias("kind"), "ts").filter("kind is not null")
    ends = known.filter("id % 4 <> 0").select("id", "kind", (F.col("ts") + F.make_dt_interval((F.col("id") % 34).cast("int"))).alias("ts"))
    return known.select("id", "kind", F.lit("open").alias("what"), "ts").unionByName(ends.select("id", "kind", F.lit("close").alias("what"), "ts"))


def resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with movements that come again: some the same, some with another quantity, some of these when their key is free again."""
    rows = movements(spark, sf_dir)
    again = lambda every, hours, more: rows.filter(f"id % {every} = 0").withColumns({"ts": F.col("ts") + F.expr(f"interval {hours} hours"), "quantity": F.col("quantity") + more})
    return rows.unionByName(again(7, 2, 0)).unionByName(again(11, 5, 1)).unionByName(again(13, 72, 2)).unionByName(again(17, 100, 3))


def stream_ageing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(ageing(openings(spark, sf_dir)))


def stream_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(conflicts(resent(spark, sf_dir)))


def stream_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.told_sums(Balances(spark).follow(_exact(movements(spark, sf_dir))))


def stream_integrity(lines: DataFrame, log: DataFrame) -> DataFrame:
    """Lines whose issued quantity is not what the stream's last snapshot says."""
    return integrity.issued_difference(lines, Balances(lines.sparkSession).follow(_exact(log)).select("line_id", F.col("issued").alias("told")))


def _exact(log: DataFrame) -> DataFrame:
    return log.withColumn("quantity", F.col("quantity").cast(replay.Q))


