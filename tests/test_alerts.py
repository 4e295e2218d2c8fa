"""Streams that are stopped and taken up again give the rows of their batch twins, and a batch that runs twice counts once."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reqledger.operators import replay
from reqledger.streaming import alerts

START = datetime(2024, 1, 1)


def files(spark, tmp_path, rows, schema, parts):
    """The rows in order of time as so many files, and a function that makes the first n of them visible as a stream of one file a batch."""
    rows = sorted(rows, key=lambda r: r[-1])
    size = -(-len(rows) // parts)

    def stream(n):
        for i in range(n):
            target = tmp_path / "log" / f"part={i}"
            if not target.exists():
                spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(str(target))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "*"))

    return stream, rows


def test_ageing_over_a_restart(spark, tmp_path):
    pick = random.Random(5)
    rows = []
    for i in range(120):
        kind, opened = ("request", "notice", "bag")[i % 3], START + timedelta(minutes=pick.randrange(60 * 24 * 30))
        rows.append((i, kind, "open", opened))
        if i % 4:
            rows.append((i, kind, "close", opened + timedelta(minutes=pick.randrange(1, 60 * 24 * 35))))
    stream, rows = files(spark, tmp_path, rows, "id long, kind string, what string, ts timestamp", 5)
    folder = f"file://{tmp_path}/run"
    before = alerts.gathered(alerts.ageing(stream(3)), folder).count()
    got = sorted(tuple(r) for r in alerts.gathered(alerts.ageing(stream(5)), folder).collect())
    seen = max(r[3] for r in rows) - timedelta(hours=1)
    closed = {r[0]: r[3] for r in rows if r[2] == "close"}
    due = [(r[0], r[1], d, r[3] + timedelta(days=d)) for r in rows if r[2] == "open" for d in alerts.LIMITS[r[1]]]
    want = sorted((i, kind, d) for i, kind, d, at in due if (closed[i] > at if i in closed else at < seen))
    assert got == want and 0 < before < len(got)


def test_conflicts_over_a_restart(spark, tmp_path):
    hours = {1: [(0, "a"), (5, "b"), (47, "a"), (60, "b"), (70, "c")], 2: [(0, "a"), (1, "a")], 3: [(10, "x"), (58, "y"), (59, "y")], 4: [(0, "a"), (49, "b"), (50, "a")]}
    rows = [(7, k, b, START + timedelta(hours=h, minutes=k)) for k, told in hours.items() for h, b in told] + [(8, 1, "z", START + timedelta(hours=2)), (9, 9, "end", START + timedelta(hours=400))]
    stream, _ = files(spark, tmp_path, rows, "line_id long, id long, action string, ts timestamp", 4)
    folder = f"file://{tmp_path}/run"
    alerts.gathered(alerts.conflicts(stream(2)), folder)
    got = sorted(tuple(r) for r in alerts.gathered(alerts.conflicts(stream(4)), folder).collect())
    # A key of another user is another key; after 48 hours the key is free, and what then comes first holds it. At 48 hours to the minute it is still held.
    assert got == [(7, 1, 5), (7, 1, 10), (7, 3, 48), (7, 4, 1)]


def test_balances_count_a_batch_once(spark, tmp_path):
    pick = random.Random(2)
    rows = [(i, pick.randrange(6), pick.choice(list(replay.DELTAS) + ["BAG"]), float(pick.randrange(1, 9)), START + timedelta(minutes=i)) for i in range(200)]
    schema = "id long, line_id long, action string, quantity double, ts timestamp"
    stream, _ = files(spark, tmp_path, rows, schema, 4)
    kept = alerts.Balances(spark, f"file://{tmp_path}/kept")
    exact = lambda df: df.withColumn("quantity", F.col("quantity").cast(replay.Q))
    kept.follow(exact(stream(2)))
    kept.put(exact(spark.createDataFrame(rows[50:100], schema)), 1)
    got = replay.told_sums(kept.follow(exact(stream(4))))
    want = replay.ledger_balance(exact(spark.createDataFrame(rows, schema)))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_is_one_grouping_and_holds_what_is_open(spark, tmp_path):
    """No key calls Python, and keys whose time has passed are not held on."""
    rows = [(1, k, "a", START + timedelta(hours=k)) for k in range(100)]
    stream, rows = files(spark, tmp_path, rows, "line_id long, id long, action string, ts timestamp", 2)
    folder = f"file://{tmp_path}/run"
    kept = alerts.conflicts(stream(2))
    assert alerts.gathered(kept, folder).count() == 0
    held = spark.read.parquet(f"{folder}/held=1").select("held.*")
    assert sorted(r.id for r in held.collect()) == [k for k in range(100) if k + 48 >= 98]
    batch = spark.createDataFrame(rows[:1], "line_id long, id long, action string, ts timestamp").withColumnRenamed("action", "body")
    assert "Python" not in kept.step(batch, held.select(F.struct("*").alias("held")), 0)._jdf.queryExecution().optimizedPlan().toString()
