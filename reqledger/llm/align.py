"""Alignment of two tokenizers over the same texts by lockstep merging.

Both tokenizers cut the bytes of a text; byte offsets where a token of A and one of B end together cut the text into groups, and the tokens of a
group are linked, each of A with each of B. One NumPy state holds a pointer into A's tokens and one into B's for every document of a batch; each step compares the ends under
all pointers at once, moves the pointer that lags (both where the ends meet), emits the groups that close, and drops the documents that are done. A long document takes several places of
the state: it is entered at several common ends, found by binary search, so that a batch takes no more steps than LANE tokens need.

A pair of ids counts the documents that hold it linked, over the whole table. Texts and links stay in their tasks: a task writes its documents in blocks, each with the
dictionary of its id pairs, and only dictionaries travel, once to be summed by pair and once back to their block. Nothing grows with the corpus in one task: a block holds
at most BLOCK_PAIRS pairs (or one document), and what is known of every id of A has at most as many rows as A has ids.

Texts that are null or empty, or that either tokenizer does not give back byte for byte (U+2581 in a text, say), have no tokens: zeros and ''. Every row gives one row, repeated rows
and null ids too, and each repeated row counts as a document. An empty table gives no rows. Special tokens' strings are plain text. Only the columns doc_id and text are read, so others may have any name."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import UNCUT, Encoder
from .shared import batch_rows, discard, materialize, small_batches, table
from .textbuf import ASCII_SPACE, chunks, same_spans, span_hashes

#: Tokens of A between two entries into a long document, and (document, pair) entries of a block.
LANE, BLOCK_PAIRS = 1024, 1_000_000
#: Pieces whose ids a worker remembers, and bytes of text in one state (a longer text has one of its own): both bound a worker's memory.
CACHE_WORDS, STATE_BYTES = 150_000, 1 << 20
#: Groups with more links than this are counted by their distinct ids.
WIDE = 1 << 16
#: Rows of a dictionary that a batch of the exploded table holds.
SLICE = 50_000
BLOCK_MARK = "▁"

_pairs: dict[tuple[str, str], "Pair"] = {}


def given_back(lists: list[bytes], tokens: list[bytes], pieces: list[bytes]) -> np.ndarray:
    """Whether each list of ids gives its piece back, byte for byte."""
    made = [tokens[i] for i in np.frombuffer(b"".join(lists), "<u4").tolist()]
    size = np.append(0, np.cumsum(np.fromiter(map(len, made), np.int64, len(made))))
    ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))) // 4
    if (np.diff(np.append(0, size[ends])) == np.fromiter(map(len, pieces), np.int64, len(pieces))).all() and b"".join(made) == b"".join(pieces):
        return np.ones(len(pieces), bool)
    return np.array([b"".join(made[x:y]) == p for x, y, p in zip([0, *ends[:-1].tolist()], ends.tolist(), pieces, strict=True)])


class Pair:
    """Both tokenizers. A text is cut at single spaces between two other characters, over which neither merges; the ids of recurring pieces are remembered."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.a = Encoder(a_file)
        self.a.added = None
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        words = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in word) if all(c in byte_of for c in word) else word.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(BLOCK_MARK, " ").encode() for i, n in enumerate(names)]
        #: No piece of B goes on past a space after another character, so B never merges over a cut.
        self.cuts = not any(BLOCK_MARK in n.lstrip(BLOCK_MARK) for n in names)
        self.begins = np.array([n.startswith(BLOCK_MARK) for n in names])
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.b_bits = (len(names) - 1).bit_length()
        #: Ids of A, ids of B, and whether both give the piece back.
        self.known: dict[bytes, tuple[bytes, bytes, bool]] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        self.a._learn(pieces)
        ones = [self.a.known.pop(p) for p in pieces]
        whole = [p for p in pieces if b" " not in p[1:] and b"\xe2\x96\x81" not in p]
        found: dict[bytes, bytes] = {}
        if whole:
            ids = np.array(self.b.encode(b" ".join([p[1:] for p in whole]).decode()), "<u4")
            starts = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(starts) == len(whole):
                raw = ids.tobytes()
                found = dict(zip(whole, [raw[x:y] for x, y in pairwise([*starts, len(raw)])], strict=True))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, [np.array(x, "<u4").tobytes() for x in self.b.encode([p[1:].decode() for p in rest])], strict=True))
        twos = [found[p] for p in pieces]
        same = given_back(ones, self.a_bytes, pieces) & given_back(twos, self.b_bytes, pieces)
        self.known.update(zip(pieces, zip(ones, twos, same.tolist(), strict=True), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B of all rows, the number before each row, and which rows both give back. Rows begin with a space."""
        space = ASCII_SPACE[data]
        cut = data == 0x20
        cut[-1:] = False
        cut[1:-1] &= ~space[:-2] & ~space[2:]
        if not self.cuts:
            cut[:] = False
        raw = data.tobytes()
        for m in UNCUT.finditer(raw):
            row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
            cut[offsets[row] : offsets[row + 1]] = False
        cut[offsets[1:] - 1] = False
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(data))
        _, first, which = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        names = [raw[x:y] for x, y in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        odd = np.flatnonzero(~same_spans(data, starts, stops, first[which]))
        which[odd] = len(names) + np.arange(len(odd))
        names += [raw[starts[i] : stops[i]] for i in odd]
        new = list(dict.fromkeys(n for n in names if n not in self.known))
        if new:
            self._learn(new)
        told = [self.known[n] for n in names]
        rows = np.searchsorted(starts, offsets)
        out = []
        for side in (0, 1):
            ids = [t[side] for t in told]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, lengths = np.frombuffer(b"".join(ids), "<u4").astype(np.int64), size[which]
            end = np.cumsum(lengths)
            out += [flat[np.arange(end[-1]) + np.repeat((np.cumsum(size) - size)[which] - (end - lengths), lengths)], np.concatenate([[0], end])[rows]]
        good = np.logical_and.reduceat(np.array([t[2] for t in told])[which], rows[:-1])
        return out[0], out[1], out[2], out[3], good


def pair(a_file: str, b_file: str) -> Pair:
    if (a_file, b_file) not in _pairs:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _pairs[a_file, b_file] = Pair(a_file, b_file)
    return _pairs[a_file, b_file]


def lanes(ends_a: np.ndarray, edges_a: np.ndarray, ends_b: np.ndarray, edges_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Where the state enters: the first tokens of each document, and tokens behind common ends about lane tokens apart in long ones."""
    first_a, first_b = [edges_a[:-1]], [edges_b[:-1]]
    size = np.diff(edges_a)
    more = np.maximum(size // lane - 1, 0)
    at = np.repeat(edges_a[:-1], more) + lane * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    last = np.minimum(at + lane, np.repeat(edges_a[1:], more) - 1)
    while len(at):
        there = np.searchsorted(ends_b, ends_a[at])
        met = ends_b[there] == ends_a[at]
        first_a.append(at[met] + 1)
        first_b.append(there[met] + 1)
        at, last = at[~met] + 1, last[~met]
        at, last = at[at < last], last[at < last]
    a, b = np.concatenate(first_a), np.concatenate(first_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def lockstep(ends_a: np.ndarray, edges_a: np.ndarray, ends_b: np.ndarray, edges_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """The index behind each group's last token, in A and in B, in order. Ends are offsets in the joined texts; every document has tokens, and its last ends meet."""
    a, b = lanes(ends_a, edges_a, ends_b, edges_b, lane)
    stop = np.append(a[1:], edges_a[-1])
    cuts_a, cuts_b = [], []
    while len(a):
        here, there = ends_a[a], ends_b[b]
        a, b = a + (here <= there), b + (there <= here)
        met = here == there
        cuts_a.append(a[met])
        cuts_b.append(b[met])
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    cut = np.concatenate(cuts_a) if cuts_a else np.zeros(0, np.int64)
    order = np.argsort(cut, kind="stable")
    return cut[order], (np.concatenate(cuts_b) if cuts_b else cut)[order]


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(times, head) if len(head) else times


def links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, doc: np.ndarray, b_bits: int, a_bits: int, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, id of A, id of B) of all links as one key, and the number of links of each."""
    from_a, from_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    n_a, n_b = cut_a - from_a, cut_b - from_b
    size = n_a * n_b
    keys, times = [], []
    plain = np.flatnonzero(size <= WIDE)
    edges = np.searchsorted(np.cumsum(size[plain]), np.arange(0, size[plain].sum() + at_once, at_once))
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        g = plain[x:y]
        each = np.repeat(np.arange(len(g)), size[g])
        within = np.arange(len(each)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        i, j = np.divmod(within, n_b[g][each])
        k, t = counted(((doc[g] << (a_bits + b_bits))[each]) | (a[from_a[g][each] + i] << b_bits) | b[from_b[g][each] + j])
        keys.append(k)
        times.append(t)
    for g in np.flatnonzero(size > WIDE):
        (x, m), (y, n) = np.unique(a[from_a[g] : cut_a[g]], return_counts=True), np.unique(b[from_b[g] : cut_b[g]], return_counts=True)
        keys.append(((doc[g] << (a_bits + b_bits)) | (x << b_bits)[:, None] | y[None, :]).ravel())
        times.append(np.outer(m, n).ravel())
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return counted(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0])


@lru_cache(maxsize=4)
def _digits(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of all numbers below ids, right-aligned with a place for a mark behind, and which places are used."""
    width = len(str(ids))
    tens = 10 ** np.arange(width - 1, -1, -1)
    number = np.arange(ids)[:, None]
    shown = number >= tens
    shown[:, -1] = True
    return np.concatenate([number // tens % 10 + 48, number * 0], axis=1).astype(np.uint8), np.concatenate([shown, number >= 0], axis=1)


def spelled(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ids: int) -> tuple[bytes, np.ndarray]:
    """All groups as a1,a2|b1;... text, and the end of each group's text (its ";" included). All ids are below ids."""
    from_a, from_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    mixed, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    mixed[np.arange(len(a)) + np.repeat(from_b, cut_a - from_a)] = a
    mixed[np.arange(len(b)) + np.repeat(cut_a, cut_b - from_b)] = b
    mark[cut_a + from_b - 1], mark[cut_a + cut_b - 1] = ord("|"), ord(";")
    digits, shown = _digits(ids)
    wide, used = digits[mixed], shown[mixed]
    wide[:, -1] = mark
    return wide[used].tobytes(), np.cumsum(shown.sum(axis=1)[mixed])[cut_a + cut_b - 1]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")
BLOCK = "block long, pairs binary, held binary, place binary, times binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_pairs array<long>, groups_sha256 array<string>"


def aligned(docs: DataFrame, a_file: str, b_file: str, block_pairs: int = BLOCK_PAIRS, lane: int = LANE) -> DataFrame:
    """Blocks of documents: their numbers, the dictionary of their id pairs (with the documents that hold each), and each document's pairs by their places in it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, base, made = pair(a_file, b_file), TaskContext.get().partitionId() << 32, 0
        a_bits = (len(both.a_bytes) - 1).bit_length()
        waiting: list[tuple] = []  # (ids of documents, columns, hashes, pair codes, times) by chunk
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, held, made
            codes, times = (np.concatenate([w[i] for w in waiting]) for i in (3, 4))
            known, place, n = np.unique(codes, return_inverse=True, return_counts=True)
            raw = [known.astype("<i8"), n.astype("<u4"), place.astype("<u4"), times.astype("<u4")]
            lists = [[d for w in waiting for d in w[0]], *[np.concatenate([w[1][c] for w in waiting]).tolist() for c in COLUMNS], [h for w in waiting for h in w[2]]]
            arrays = [pa.array([base + made], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in raw], *[pa.array([x], pa.list_(pa.int64())) for x in lists[:-1]], pa.array([lists[-1]], pa.list_(pa.string()))]
            waiting, held, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCK.split(", ")])

        for got in batches:
            text = got.column(1).cast(pa.large_binary()).fill_null(b"")
            full = pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            names, n = got.column(0).to_pylist(), np.flatnonzero(full)
            if not full.all():
                none = np.flatnonzero(~full)
                zeros = np.zeros(0, np.int64)
                waiting.append(([names[i] for i in none], dict.fromkeys(COLUMNS, np.zeros(len(none), np.int64)), [""] * len(none), zeros, zeros))
            if not len(n):
                continue
            spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), text.filter(pa.array(full)), pa.scalar(b"", pa.large_binary()))
            for at, data, offsets in chunks(spaced, STATE_BYTES):
                rows = n[at : at + len(offsets) - 1]
                a, edge_a, b, edge_b, good = both.encode(data, offsets)
                size_a, size_b = np.where(good, np.diff(edge_a), 0), np.where(good, np.diff(edge_b), 0)
                a, b = a[np.repeat(good, np.diff(edge_a))], b[np.repeat(good, np.diff(edge_b))]
                edge_a, edge_b = np.append(0, np.cumsum(size_a[good])), np.append(0, np.cumsum(size_b[good]))
                cut_a, cut_b = lockstep(np.cumsum(both.a_size[a]), edge_a, np.cumsum(both.b_size[b]), edge_b, lane)
                doc = np.searchsorted(edge_a, cut_a) - 1
                counts = {"n_a": size_a, "n_b": size_b}
                links_of = np.diff(np.append(0, cut_a)) * np.diff(np.append(0, cut_b))
                keys, times = links(a, b, cut_a, cut_b, doc, both.b_bits, a_bits)
                of = keys >> (a_bits + both.b_bits)
                whole = len(edge_a) - 1
                told = {"n_groups": np.bincount(doc, minlength=whole), "n_links": np.add.reduceat(links_of, np.searchsorted(doc, np.arange(whole))) if whole else links_of, "n_pairs": np.bincount(of, minlength=whole)}
                for c, v in told.items():
                    counts[c] = np.zeros(len(rows), np.int64)
                    counts[c][good] = v
                hashes = np.full(len(rows), "", object)
                if whole:
                    text_of, end = spelled(a, b, cut_a, cut_b, max(len(both.a_bytes), len(both.b_bytes)))
                    stop = end[np.append(np.searchsorted(doc, np.arange(1, whole)), len(doc)) - 1].tolist()
                    hashes[good] = [hashlib.sha256(memoryview(text_of)[x : y - 1]).hexdigest() for x, y in zip([0, *stop[:-1]], stop, strict=True)]
                waiting.append(([names[i] for i in rows], counts, hashes.tolist(), keys & ((1 << (a_bits + both.b_bits)) - 1), times))
                held += len(keys)
                if held >= block_pairs:
                    yield flush()
        if waiting:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, BLOCK), "aligned")


def entries(blocks: DataFrame) -> DataFrame:
    """The dictionaries as rows: block, place, pair, and the block's documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known, n = np.frombuffer(batch.column(1)[i].as_py(), "<i8"), np.frombuffer(batch.column(2)[i].as_py(), "<u4").astype(np.int64)
                for at in range(0, len(known), SLICE):
                    some = known[at : at + SLICE]
                    place = np.arange(at, at + len(some), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column(0)[i].as_py(), np.int64)), pa.array(place), pa.array(some), pa.array(n[at : at + SLICE])], names=["block", "place", "pair", "n"])

    return blocks.select("block", "pairs", "held").mapInArrow(run, "block long, place int, pair long, n long")


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c, i=i: batch.column(c)[i].values
            place, times = (np.frombuffer(batch.column(c)[i].as_py(), "<u4").astype(np.int64) for c in ("place", "times"))
            value = np.asarray(get("values"), np.int64) if batch.column("values")[i].is_valid else np.zeros(0, np.int64)
            value = value[place]
            sums = lambda x, ends=np.cumsum(np.asarray(get("n_pairs"))): np.diff(np.append(0, np.append(0, np.cumsum(x))[ends]))
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("n_a"), get("n_b"), get("n_groups"), get("n_links"), pa.array(sums(times * (value & 1))), pa.array(sums(times * (value >> 1))), get("groups_sha256")], names=[c.split()[0] for c in OUT.split(", ")])


def alignments(docs: DataFrame, a_file: str, b_file: str, block_pairs: int = BLOCK_PAIRS, lane: int = LANE) -> DataFrame:
    """One row for each document: its tokens, groups and links, and how common its links are in the whole table."""
    import sentencepiece

    spark = docs.sparkSession
    b_bits = (sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size() - 1).bit_length()
    blocks = aligned(docs, a_file, b_file, block_pairs, lane)
    with batch_rows(spark, 2):
        told = entries(blocks)
        count = told.groupBy("pair").agg(F.sum("n").alias("count"))
        count = materialize(count, "pairs")
        # At most one row for each id of A.
        best = count.groupBy(F.shiftright("pair", b_bits).alias("a")).agg(F.max("count").alias("most"))
        value = count.withColumn("a", F.shiftright("pair", b_bits)).join(F.broadcast(best), "a").select("pair", (F.col("count") * 2 + (F.col("count") == F.col("most")).cast("int")).alias("value"))
        back = told.select("block", "place", "pair").join(value, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
        joined = blocks.drop("pairs", "held").join(back.select("block", F.col("v.value").alias("values")), "block", "left")
        out = materialize(joined.mapInArrow(_scored, OUT), "alignments")
    for t in (blocks, count):
        discard(t)
    return out


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
