"""Words packed by page, and lists told by a page's columns, on odd inputs; no query shuffles its words twice."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqledger.operators import bom, pages

WORDS = "page_id long, word_id long, x0 double, top double, text string"
LIST = [("BILL", 10, 10), ("OF", 40, 10), ("MATERIALS", 60, 10), ("PT", 10, 30), ("NO", 24, 30), ("DESC", 100, 30), ("QTY", 300, 30), ("1", 12, 60), ("PIPE", 104, 60), ("2", 296, 60), ("3", 301, 61), ("long", 106, 70)]


def page(n):
    return [(n, i, float(x), float(top), text) for i, (text, x, top) in enumerate(LIST)]


def test_words_come_back_from_their_packs():
    """Whatever the numbers and texts, and however the packs of a bucket are cut, words are as they were; words without a number for an id are last."""
    rows = [(p, w, x, t, s) for p in (-(2**63), -5, 7, 2**63 - 1) for w, x, t, s in [(3, 1.5, -0.0, "é漢"), (None, None, 2.0, None), (-9, math.inf, -math.inf, ""), (2**62, 1e-300, math.nan, " a b ")]]
    table = pa.table(dict(zip(("page_id", "word_id", "x0", "top", "text"), map(list, zip(*rows, strict=True)), strict=True)), schema=pa.schema([("page_id", pa.int64()), ("word_id", pa.int64()), ("x0", pa.float64()), ("top", pa.float64()), ("text", pa.string())]))
    packs = {}
    for cut in table.to_batches(max_chunksize=5):
        for batch in pages._packs(iter([cut]), 3):
            for bucket, *pack in zip(*(batch[c].to_pylist() for c in range(4)), strict=True):
                packs.setdefault(bucket, []).append(pack)
    got = [pages._unpacked(v) for v in packs.values()]
    told = lambda w: sorted(zip(w.page.tolist(), w.word.tolist(), map(repr, w.x0.tolist()), map(repr, w.top.tolist()), map(repr, w.text.to_pylist()), strict=True))
    assert sorted(x for w in got for x in told(w)) == told(pages.columns(table))
    assert all(len(set(w.page.tolist()) & set(v.page.tolist())) == 0 for w in got for v in got if w is not v)
    assert [len(r.page) for w in got for r in pages.runs(w.ordered())] == [len(w.page) for w in got]


def one_shuffle(told, n):
    """One exchange, of packs, and neither a join nor a table in between; and so many rows."""
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "FileScan" not in plan and "packed" in plan
    assert told.count() == n


def test_column_edges_in_one_shuffle(spark):
    words = spark.createDataFrame([w for n in range(40) for w in page(n)], WORDS).repartition(5, "word_id")
    one_shuffle(bom.column_edges(spark.createDataFrame([w for n in range(40) for w in page(n)], WORDS)), 120)
    assert {(r.name, r.x, r.x_from, r.x_to) for r in bom.column_edges(words).collect()} == {("item_no", 10.0, 0.0, 62.0), ("description", 100.0, 62.0, 201.0), ("qty", 300.0, 201.0, math.inf)}


def test_odd_words_of_a_page(spark):
    """Nulls neither match nor stop a page: a word without text takes its place, one without top is a line of its own, one without x0 is in no column, and words without a page are left out."""
    odd = [(1, 100, 15.0, 60.0, None), (1, None, 500.0, 60.0, "x"), (1, 101, 105.0, None, "lost"), (1, 102, None, 60.0, "4"), (1, 103, 107.0, 70.0, " \t"), (None, 1, 1.0, 1.0, "BILL")]
    words = spark.createDataFrame([*page(1), *odd, *page(-2), (3, 1, 1.0, 1.0, "alone"), (4, 1, None, None, None)], WORDS)
    assert sorted((r.page_id, r.name) for r in bom.column_edges(words).collect()) == [(n, c) for n in (-2, 1) for c in ("description", "item_no", "qty")]
    empty = words.filter("page_id > 99")
    assert [f(empty).count() for f in (bom.column_edges, bom.row_spans, bom.material_rows, bom.pick_quantities)] == [0, 0, 0, 0]
    assert [(r.page_id, r.quantity) for r in bom.pick_quantities(words).orderBy("page_id").collect()] == [(-2, "3"), (1, "3")]


def test_material_rows_in_one_shuffle(spark):
    words = spark.createDataFrame([w for n in range(40) for w in page(n)], WORDS)
    told = bom.material_rows(words)
    one_shuffle(told, 40)
    assert {(r.item_no, r.description, r.qty, r.lines, r.category) for r in told.collect()} == {("1", "PIPE long", "3", 2, "")}


def test_columns_given_take_the_place_of_a_pages_own(spark):
    """A page without given columns gives no rows; given ranges may leave gaps."""
    words = spark.createDataFrame([*page(1), *page(2)], WORDS)
    given = bom.column_edges(words).filter("page_id = 2").withColumn("x_to", F.when(F.col("name") == "qty", 300.0).otherwise(F.col("x_to")))
    assert [(r.page_id, r.item_no, r.qty) for r in bom.material_rows(words, given).collect()] == [(2, "1", "2")]


def test_quantities_in_one_shuffle(spark):
    """The nearest number wins, the next one is a doubt, or an annotation where it is far behind."""
    far = [(7, i, float(x), float(top), {"2": "9"}.get(text, text)) for i, (text, x, top) in enumerate((t, 280 if t == "2" else x, y) for t, x, y in LIST)]
    words = spark.createDataFrame([*[w for n in range(5) for w in page(n)], *far], WORDS)
    told = bom.pick_quantities(words)
    one_shuffle(told, 6)
    assert {(r.page_id, r.quantity, r.note) for r in told.collect()} == {*((n, "3", "multiple_quantity_candidates") for n in range(5)), (7, "3", "ignored_numeric_annotation")}


def test_row_spans_in_one_shuffle(spark):
    words = spark.createDataFrame([w for n in range(40) for w in page(n)], WORDS)
    one_shuffle(bom.row_spans(words), 80)
    assert {(r.line, r.row_no, r.kind, r.text) for r in bom.row_spans(words).collect()} == {(3, 1, "row", "1 PIPE 2 3"), (4, 1, "rest", "long")}
