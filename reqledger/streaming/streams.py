"""The movement log as a stream: deduplication, windows of activity, sessions, and a stateful ledger. Each query runs over what is there (availableNow) into a table in the shared folder, so it equals its batch twin."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIONS = {"view": "CONFIRM_AVAILABLE", "click": "BAG", "purchase": "ISSUE_FROM_AVAILABLE", "error": "DIRECT_ISSUE"}
#: The log is ordered within files but not between them; later rows than this are dropped.
LATENESS = "3650 days"
#: A movement that is sent again comes within this time of the first (fixed value).
RESENT = "48 hours"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local run (tests) gets a new folder that is then set; a cluster must name one that all its machines share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, so that one file and a folder of files both serve as the source.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    action = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("event_type")], F.lit("BACKORDER_REQUESTED"))
    return rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("line_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), F.ceil(F.col("value") / 10).cast("double").alias("quantity"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of what is there and return the written table. Each batch is its own folder, written over on a retry, so a restart repeats nothing."""
    spark = stream.sparkSession
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def dedup(log: DataFrame) -> DataFrame:
    """Whole movements, each once however often it is sent again within 48 hours; the state of older ones is given up."""
    return log.withWatermark("ts", RESENT).dropDuplicatesWithinWatermark(["line_id", "id"]).select("id", "line_id", "action", "quantity")


def activity(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Movements and quantities by window and action; complete mode, as the log has an end."""
    out = log.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "action", "n", "quantity")


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = log.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap).alias("w"), "line_id").agg(F.count("*").alias("n"))
    return out.select("line_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def ledger(log: DataFrame, requested: float = 1000.0) -> DataFrame:
    """Final state of each line with ceilings, kept in the state store and folded batch by batch in order of time. Update mode: a line's last row holds."""

    def fold(key: tuple, batches, state: GroupState):
        s = list(state.get) if state.exists else [0.0] * 5 + [0, 0]
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for action, q in zip(rows["action"], rows["quantity"], strict=True):
            located, available, bagged, issued, pending, accepted, refused = s
            left = max(0.0, requested - issued)
            free = max(0.0, min(max(0.0, requested - located), left) - pending)
            fresh = max(0.0, q - available)
            limit, change = {
                "CONFIRM_AVAILABLE": (free, (q, q, 0, 0, 0)), "BAG": (max(0.0, available + free), (fresh, fresh - q, q, 0, 0)), "DIRECT_ISSUE": (min(free, left), (q, 0, 0, q, 0)),
                "ISSUE_FROM_AVAILABLE": (min(available, left), (0, -q, 0, q, 0)), "BACKORDER_REQUESTED": (max(0.0, left - available - bagged - pending), (0, 0, 0, 0, q)),
            }[action]
            if 0 < q <= limit:
                s = [a + b for a, b in zip(s[:5], change, strict=True)] + [accepted + 1, refused]
            else:
                s[6] += 1
        state.update(tuple(s))
        yield pd.DataFrame([[key[0], *s]], columns=["line_id", "located", "available", "bagged", "issued", "pending", "accepted", "refused"])

    fields = "located double, available double, bagged double, issued double, pending double, accepted long, refused long"
    return log.groupBy("line_id").applyInPandasWithState(fold, f"line_id long, {fields}", fields, "update", GroupStateTimeout.NoTimeout)
