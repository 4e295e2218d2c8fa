"""Cost-balanced packing of documents into token sequences.

A sequence's cost is linear * tokens + quadratic * sum of squared piece lengths (attention stays within a piece). Each
task works through its own rows in windows of bounded size, so nothing is shuffled and a hot source costs nothing extra:
a document's full-length pieces are sequences of their own and leave at once; the remainders of a window are assigned in
descending length to the lowest-cost sequence with room, over the least number of sequences that can hold them. A piece
that fits nowhere whole is cut at the room of the lowest-cost open sequence, so a window leaves less than one sequence of padding.

Null text counts as empty (one end token). Repeated rows and null ids are packed like any other row; an empty table
gives no pieces. Only the id and text columns are read, so other columns may have any name."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import KEPT, small_batches, table
from .textbuf import ASCII_SPACE, chunks, same_spans, span_hashes

CAPACITY, END_ID = 2048, 1
#: Tokens of remainders that are packed together.
WINDOW_TOKENS = 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Pieces in an Arrow batch: at full length 4 MB of ids.
BATCH_PIECES = 500
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 700_000

#: White space beyond ASCII (and separators that may count as such): a text with any is not cut.
UNCUT = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of texts, as tokenizers gives them for the file, in little-endian 32-bit bytes.

    Byte-level BPE never merges across a single space between two other characters, so a text is cut there and the ids
    of recurring words are remembered. New words go through tiktoken over the file's own vocabulary where that
    vocabulary is ranked by its merges (checked here); otherwise through tokenizers. A text that holds an added token
    is not cut and goes through tokenizers whole."""

    def __init__(self, file: str):
        import json

        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(file)
        added = sorted({t["content"] for t in spec.get("added_tokens", [])} - {""})
        #: Starts of added tokens, which tokenizers takes out of a text first.
        self.added = re.compile(b"(?=" + b"|".join(re.escape(t.encode()) for t in added) + b")") if added else None
        self.known: dict[bytes, bytes] = {}
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [vocab["".join(m)] for m in parts]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        unicode_of = dict(zip(printable, map(chr, printable), strict=True)) | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        byte_of = {c: b for b, c in unicode_of.items()}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        plain = {w: i for w, i in vocab.items() if w not in special}
        level = spec.get("pre_tokenizer") or {}
        if made != sorted(made) or spec.get("normalizer") or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not all(c in byte_of for w in plain for c in w):
            return None
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for w, i in plain.items():
            self.token_bytes[i] = len(w)
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={bytes(byte_of[c] for c in w): i for w, i in plain.items()}, special_tokens={})

    def _holds_added(self, piece: bytes) -> bool:
        return self.added is not None and self.added.search(piece) is not None

    def _ids(self, piece: bytes) -> bytes:
        text = piece.decode()
        ids = self.fast.encode_ordinary(text) if self.fast and not self._holds_added(piece) else self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, pieces: list[bytes]) -> None:
        """Remember the ids of new pieces. Those between two cuts are encoded as one text: no token crosses a cut, so the tokens' lengths tell where each piece ends."""
        joint = [i for i, p in enumerate(pieces) if p[:1] == b" " and not p[-1:].isspace() and not self._holds_added(p)] if self.fast else []
        if joint:
            ids = np.array(self.fast.encode_ordinary(b"".join([pieces[i] for i in joint]).decode()), "<u4")
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(pieces[i]) for i in joint])) + 1
            raw, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update(zip([pieces[i] for i in joint], [raw[x:y] for x, y in pairwise(ends)], strict=True))
        for i in sorted({*range(len(pieces))} - {*joint}):
            self.known[pieces[i]] = self._ids(pieces[i])

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        for _, data, offsets in chunks(column):
            space = ASCII_SPACE[data]
            cut = data == 0x20
            cut[:1] = cut[-1:] = False
            cut[1:-1] &= ~space[:-2] & ~space[2:]
            raw = data.tobytes()
            for m in chain(UNCUT.finditer(raw), self.added.finditer(raw) if self.added else ()):
                row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
                cut[offsets[row] : offsets[row + 1]] = False
            cut = np.append(cut, False)
            # A space at either end of a text stands beside another text's character, not its own.
            cut[offsets[1:][offsets[1:] > 0] - 1] = False
            cut[offsets] = True
            starts = np.flatnonzero(cut)[:-1] if cut[-1] else np.flatnonzero(cut)
            stops = np.append(starts[1:], len(data))
            _, first, which = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
            known = self.known
            if len(known) > CACHE_WORDS:
                known.clear()
            names = [raw[x:y] for x, y in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
            # Spans of one hash may differ; those that do stand for themselves.
            odd = np.flatnonzero(~same_spans(data, starts, stops, first[which]))
            which[odd] = len(names) + np.arange(len(odd))
            names += [raw[starts[i] : stops[i]] for i in odd]
            new = list(dict.fromkeys(n for n in names if n not in known))
            if new:
                self._learn(new)
            ids = [known[h] for h in names]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), "<u4")
            lengths = size[which]
            end = np.cumsum(lengths)
            total = int(end[-1]) if len(end) else 0
            out = flat[np.arange(total) + np.repeat((np.cumsum(size) - size)[which] - (end - lengths), lengths)] if total else flat
            edges = np.concatenate([[0], end])[np.searchsorted(starts, offsets)]
            for i in range(len(offsets) - 1):
                yield out[edges[i] : edges[i + 1]]


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[file] = Encoder(file)
        KEPT["packing"] = _encoders.clear
    return _encoders[file]


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """[(item, start within it, length, sequence, offset)] and each sequence's cost, for items shorter than capacity."""
    n = -(-sum(lengths) // capacity)
    room, cost, placed = np.full(n, capacity), np.zeros(n), []
    heap = [(-size, i, 0) for i, size in enumerate(lengths)]
    heapq.heapify(heap)
    while heap:
        size, item, start = heapq.heappop(heap)
        size = -size
        open_ = room >= size
        if not open_.any():
            open_ = room > 0
        s = int(np.argmin(np.where(open_, cost, np.inf)))
        take = min(size, int(room[s]))
        placed.append((item, start, take, s, capacity - int(room[s])))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if take < size:
            heapq.heappush(heap, (take - size, item, start + take))
    return placed, cost


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_cost double"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_cost", pa.float64())])


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row for each piece, with its ids as little-endian 32-bit bytes. See the module for the method and the odd cases."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, made = encoder(tokenizer_file), TaskContext.get().partitionId() << 32, 0
        rest: list[tuple] = []  # (id, start, bytes, document's tokens)
        waiting = 0
        full_cost = linear * capacity + quadratic * capacity * capacity

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rest, waiting, made
            rest.sort(key=lambda r: (-len(r[2]), r[0] is None, r[0] or 0, r[1]))
            placed, cost = assign([len(r[2]) // 4 for r in rest], capacity, linear, quadratic)
            # Pieces are cut out batch by batch, so a window's ids are held once.
            for at in range(0, len(placed), BATCH_PIECES):
                rows = []
                for item, start, length, s, offset in placed[at : at + BATCH_PIECES]:
                    doc, first, ids, total = rest[item]
                    rows.append((doc, first + start, length, ids[4 * start : 4 * (start + length)], total, base + made + s, offset, float(cost[s])))
                yield batch(rows)
            made += len(cost)
            rest, waiting = [], 0

        for got in batches:
            rows = []
            for doc, ids in zip(got.column(0).to_pylist(), enc.encode(got.column(1)), strict=True):
                ids = ids.tobytes() + end
                total, whole = len(ids) // 4, len(ids) // (4 * capacity) * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, ids[4 * start : 4 * (start + capacity)], total, base + made, 0, full_cost))
                    made += 1
                if whole < total:
                    rest.append((doc, whole, ids[4 * whole :], total))
                    waiting += total - whole
                while len(rows) >= BATCH_PIECES:
                    yield batch(rows[:BATCH_PIECES])
                    rows = rows[BATCH_PIECES:]
                if waiting >= window_tokens:
                    yield from flush()
            if rows:
                yield batch(rows)
        if rest:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_cost")
