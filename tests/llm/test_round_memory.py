"""What bounds the disk of the toxicity network and the memory of executors in the corpus pipeline."""

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from reqledger.llm import minhash, packing, shared, toxicity


def test_a_replica_is_the_rows_of_one_task(spark, monkeypatch, request):
    """However many partitions the join has: pieces of replicas would each send all that they changed."""
    written, real = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, tag: written.append(real(df, tag)) or written[-1])
    monkeypatch.setattr(toxicity, "discard", lambda df: None)
    for key, value in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before = spark.conf.get(key)
        request.addfinalizer(lambda key=key, before=before: spark.conf.set(key, before))
        spark.conf.set(key, value)
    rows = spark.range(900).selectExpr("id as doc_id", "concat('word', id % 7, ' text') as text", "cast(id % 3 = 0 as int) as toxic")
    with_others = rows.select("doc_id", "text").union(spark.range(5000, 8000).selectExpr("id", "'no label'"))
    assert toxicity.train(with_others, rows.select("doc_id", "toxic"), replica=300) is not None
    dealt = written[0].withColumn("file", F.input_file_name())
    assert dealt.count() == 900
    assert dealt.select("file", "replica").distinct().count() == dealt.select("replica").distinct().count() <= 3
    assert dealt.groupBy("replica").count().filter("count > 600").isEmpty()


def test_batches_are_bounded_by_bytes(spark):
    """Rows of 100 KB: a thousand of them in one batch would be 100 MB, on both sides of the pipe."""
    shared.small_batches(spark)
    rows = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) as text")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 2 * shared.BATCH_BYTES


def test_a_reused_worker_lets_the_tokenizer_go():
    file = public_tokenizers.path("byte_bpe_50k.json")
    ids = [x.tolist() for x in packing.encoder(file).encode(pa.array(["some words"]))]
    assert packing._encoders and len(list(minhash.shingle_sets(pa.array(["a b c"]), 2))) == 1
    assert not packing._encoders
    assert [x.tolist() for x in packing.encoder(file).encode(pa.array(["some words"]))] == ids
