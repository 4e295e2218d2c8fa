"""Placed words brought together by page with one small shuffle, and worked on by runs of whole pages.

A task packs its words by buckets of pages: numbers as differences and by planes of their bytes, texts end to end, and all compressed, as the words of many pages compress well and those of
one do not. Only packs travel, a few bytes for each word; a bucket is unpacked and sorted in its task. Nothing is written and no words are joined, so a word is shuffled once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words, and bytes of them, that a task packs together; bytes of input files for a bucket, and most buckets; words of a run.
PACKED, PACKED_BYTES, SHARE, MOST, RUN = 1 << 20, 1 << 27, 1 << 21, 8192, 1 << 17
PACK = "bucket int, words int, bytes long, packed binary"
PACK_SCHEMA = pa.schema([("bucket", pa.int32()), ("words", pa.int32()), ("bytes", pa.int64()), ("packed", pa.binary())])


class Words(NamedTuple):
    """Words by column; x0 and top that are null are NaN, a word_id that is null is the last."""

    page: np.ndarray
    word: np.ndarray
    x0: np.ndarray
    top: np.ndarray
    text: pa.Array

    def taken(self, at: np.ndarray) -> Words:
        return Words(self.page[at], self.word[at], self.x0[at], self.top[at], self.text.take(pa.array(at)))

    def ordered(self) -> Words:
        return self.taken(np.lexsort((self.word, self.x0, self.top, self.page)))


def columns(table: pa.Table) -> Words:
    """The words of a table without null pages."""
    held = {n: table[n].combine_chunks() for n in ("page_id", "word_id", "x0", "top", "text")}
    word = held["word_id"].fill_null(np.iinfo(np.int64).max)
    x0, top = (held[n].fill_null(float("nan")).to_numpy(zero_copy_only=False) for n in ("x0", "top"))
    return Words(held["page_id"].to_numpy(zero_copy_only=False), word.to_numpy(zero_copy_only=False), x0, top, held["text"].cast(pa.large_string()))


def buckets(words: DataFrame) -> int:
    """A bucket for each SHARE bytes of the files that the words come from, or as many as Spark's partitions where these are not known."""
    leaves = words._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    least = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(1, min(MOST, max(least, size // SHARE)))


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _column(data: memoryview, n: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()


def _packs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held, count, size = [], 0, 0
    for batch in batches:
        held, count, size = [*held, batch], count + batch.num_rows, size + batch.nbytes
        if count >= PACKED or size >= PACKED_BYTES:
            yield from _packed(held, n)
            held, count, size = [], 0, 0
    if count:
        yield from _packed(held, n)


def _packed(held: list[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    w, codec = columns(pa.Table.from_batches(held)), pa.Codec("zstd")
    bucket = ((w.page.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
    order = np.lexsort((w.word, w.page, bucket))
    w, bucket = w.taken(order), bucket[order]
    at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    offsets, letters = np.frombuffer(w.text.buffers()[1], np.int64)[w.text.offset : w.text.offset + len(w.text) + 1], memoryview(w.text.buffers()[2] or b"")
    lengths = np.where(w.text.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1).astype(np.int32)
    rows: tuple[list, ...] = ([], [], [], [])
    for a, b in zip(at[:-1], at[1:], strict=True):
        parts = [np.diff(w.page[a:b], prepend=0), np.diff(w.word[a:b], prepend=0), w.x0[a:b], w.top[a:b], lengths[a:b]]
        data = b"".join([*map(_planes, parts), letters[offsets[a] : offsets[b]]])
        for column, value in zip(rows, (bucket[a], b - a, len(data), codec.compress(data, asbytes=True)), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, PACK_SCHEMA.types, strict=True)], schema=PACK_SCHEMA)


def _unpacked(packs: list[tuple[int, int, bytes]]) -> Words:
    codec, parts = pa.Codec("zstd"), ([], [], [], [], [], [])
    for n, size, data in packs:
        raw = memoryview(codec.decompress(data, size))
        page, word, x0, top = (_column(raw[8 * n * k : 8 * n * (k + 1)], n, kind) for k, kind in enumerate((np.int64, np.int64, np.float64, np.float64)))
        for column, value in zip(parts, (np.cumsum(page), np.cumsum(word), x0, top, _column(raw[32 * n : 36 * n], n, np.int32), raw[36 * n :]), strict=True):
            column.append(value)
    page, word, x0, top, lengths = map(np.concatenate, parts[:5])
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0), dtype=np.int64)])
    valid = pa.py_buffer(np.packbits(lengths >= 0, bitorder="little").tobytes())
    return Words(page, word, x0, top, pa.Array.from_buffers(pa.large_string(), len(lengths), [valid, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts[5]))]))


def runs(w: Words) -> Iterator[Words]:
    """Runs of whole pages, of RUN words or one page at least, of words in order."""
    ends, a = np.append(np.flatnonzero(np.diff(w.page)) + 1, len(w.page)), 0
    while a < len(w.page):
        b = int(ends[min(np.searchsorted(ends, a + RUN), len(ends) - 1)])
        yield Words(*(c[a:b] for c in w[:4]), w.text.slice(a, b - a).cast(pa.string()))
        a = b


def by_page(words: DataFrame, work: Callable[[Words], pa.Table], out: StructType) -> DataFrame:
    """work for runs of whole pages, their words ordered by page, top, x0 and word_id. Words without a page are left out."""
    n, schema = buckets(words), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *pack in zip(*(batch[c].to_pylist() for c in range(4)), strict=True):
                if held and bucket != now:
                    yield from done(held)
                    held = []
                now = bucket
                held.append(pack)
        if held:
            yield from done(held)

    def done(held: list) -> Iterator[pa.RecordBatch]:
        for w in runs(_unpacked(held).ordered()):
            yield from work(w).cast(schema).to_batches(max_chunksize=20_000)

    typed = words.filter("page_id is not null").select(F.col("page_id").cast("long"), F.col("word_id").cast("long"), F.col("x0").cast("double"), F.col("top").cast("double"), F.trim("text").alias("text"))
    return typed.mapInArrow(lambda batches: _packs(batches, n), PACK).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, out)
