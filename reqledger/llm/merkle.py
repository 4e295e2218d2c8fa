"""Merkle manifest of a dataset, its trees stored as aligned subtrees in van Emde Boas order.

A leaf is the SHA-256 of a row's fields. Leaves of one group (a language) ascend by id; every 8 consecutive nodes (fewer in the last run) become
the hash of their hexadecimal digests, until one is left: the group's subroot. Subroots in order of their groups (null first, then by bytes) give the root alike.

A tree is cut into blocks: aligned subtrees of 8 ** HEIGHT places. Within a block the nodes lie in one array in van Emde Boas
order: the upper half of the levels first, then each subtree below it, each again split at half its height. address() is that arithmetic; both the
construction and the retrieval of siblings go through it. The roots of a table's blocks are the leaves of the next, until a group has one block.

Places are global ranks without a window over a group: rows are dealt by ranges of (group, id, hash), each range numbers its own rows,
and what lies before a range is a sum over counts by range. A block holds at most 4096 leaves, so a group of any size is many tasks' work, and a block's
proofs need only its own array and the path of its root, which comes down from the table above, one row for each block.

A null field is "-" in its leaf. Equal ids are ordered by their hashes; wholly equal rows take places of their own, in any order, with the same leaf. Null ids come first and are never tampered with.
An empty table gives no rows. Texts of any length are hashed where they are read and never shuffled. Only the named fields are read, so other columns may have any name."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import batch_rows, discard, materialize, table

ARITY, HEIGHT = 8, 4
#: Blocks of a batch that a worker holds.
BLOCKS = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def nodes_of(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes of a depth (0 is the root) stand in the van Emde Boas array of a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    return nodes_of(top) + index // width * nodes_of(levels - top) + address(levels - top, depth - top, index % width)


@lru_cache(maxsize=64)
def _addresses(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(ARITY**depth))


def levels_of(leaves: int) -> int:
    """Levels of the lowest tree over so many leaves."""
    levels = 1
    while ARITY ** (levels - 1) < leaves:
        levels += 1
    return levels


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


class Block:
    """One subtree: levels, number of leaves, and its nodes in van Emde Boas order, 32 bytes each; absent nodes are zero."""

    def __init__(self, leaves: int, levels: int, nodes: np.ndarray):
        self.leaves, self.levels, self.nodes = leaves, levels, nodes

    @classmethod
    def build(cls, leaves: np.ndarray, levels: int) -> "Block":
        """From the leaves' digests (one row of 32 bytes each), up to the root even where a level has one node."""
        block = cls(len(leaves), levels, np.zeros((nodes_of(levels), 32), np.uint8))
        block.nodes[_addresses(levels, levels - 1)[: len(leaves)]] = leaves
        for depth in range(levels - 1, 0, -1):
            up = _addresses(levels, depth - 1)
            for i in range(block.count(depth - 1)):
                block.nodes[up[i]] = np.frombuffer(digest(block.run(depth, i).tobytes().hex()), np.uint8)
        return block

    def count(self, depth: int) -> int:
        """Nodes that are there at a depth."""
        return -(-self.leaves // ARITY ** (self.levels - 1 - depth))

    def run(self, depth: int, number: int) -> np.ndarray:
        """The digests of one run of brothers."""
        return self.nodes[_addresses(self.levels, depth)[number * ARITY : min(number * ARITY + ARITY, self.count(depth))]]

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def paths(self) -> Iterator[bytes]:
        """For each leaf, level by level upwards: its place in its run, the number of its siblings, their digests."""
        runs = [[self.run(d, i).tobytes() for i in range(self.count(d - 1))] for d in range(self.levels - 1, 0, -1)]
        for leaf in range(self.leaves):
            out = bytearray()
            for level in runs:
                leaf, at = divmod(leaf, ARITY)
                run = level[leaf]
                out += bytes((at, len(run) // 32 - 1)) + run[: 32 * at] + run[32 * at + 32 :]
            yield bytes(out)


def climb(leaf: bytes, path: bytes) -> tuple[str, str]:
    """All siblings of a path as text, and the root that a leaf and its path give."""
    told, at, now = [], 0, leaf.hex()
    while at < len(path):
        place, n = path[at], path[at + 1]
        siblings = path[at + 2 : at + 2 + 32 * n].hex()
        told.append(siblings)
        now = hashlib.sha256((siblings[: 64 * place] + now + siblings[64 * place :]).encode()).hexdigest()
        at += 2 + 32 * n
    return "".join(told), now


def leaf_of(text: Column) -> Column:
    """The digest of a row's fields, with another text in the place of its own."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(text if n == "text" else F.col(n).cast("string")) for n in FIELDS]).cast("binary"), 256))


def ranked(df: DataFrame, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """df with each row's place in its group (pos, from 0) and the group's rows (total); and the written table to discard later."""
    keyed = df.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "tie")]
    written = materialize(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("mark", F.monotonically_increasing_id()), "ranges")
    split = written.withColumn("range", F.shiftright("mark", 33))
    counts = split.groupBy(group, "range").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    mine = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(mine.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "range", "first", before.alias("before"), F.sum("n").over(mine).alias("total"))
    return split.join(counts, [group, "range"]).withColumn("pos", F.col("mark") - F.col("first") + F.col("before")).drop("mark", "range", "first", "before"), written


def _levels(height: int, items: int, total: int) -> int:
    return height + 1 if total > ARITY**height else levels_of(items)


def _digests(items: pa.StructArray) -> np.ndarray:
    return np.frombuffer(b"".join(items.field("digest").to_pylist()), np.uint8).reshape(-1, 32)


def _built(height: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, totals = batch.column("items"), batch.column("total").to_pylist()
        blocks = []
        for i in range(batch.num_rows):
            leaves = _digests(items[i].values)
            blocks.append(Block.build(leaves, _levels(height, len(leaves), totals[i])))
        arrays = [*batch.columns, pa.array([b.nodes.tobytes() for b in blocks], pa.binary()), pa.array([b.root() for b in blocks], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "nodes", "root"])


def _block(height: int, batch: pa.RecordBatch, i: int) -> Block:
    items = batch.column("items")[i].values
    return Block(len(items), _levels(height, len(items), batch.column("total")[i].as_py()), np.frombuffer(batch.column("nodes")[i].as_py(), np.uint8).reshape(-1, 32))


def blocks(height: int, placed: DataFrame, *payload: str) -> DataFrame:
    """The written blocks of a table of (grp, pos, total, digest, payload): grp, block, total, items, nodes, root."""
    rows = placed.groupBy("grp", F.expr(f"pos div {ARITY**height}").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "digest", *payload))).alias("items"))
    schema = T.StructType([*rows.schema.fields, T.StructField("nodes", T.BinaryType()), T.StructField("root", T.BinaryType())])
    with batch_rows(placed.sparkSession, BLOCKS):
        return materialize(rows.mapInArrow(partial(_built, height), schema), "blocks")


def forest(height: int, placed: DataFrame, *payload: str) -> list[DataFrame]:
    """Block tables from the leaves' up to the one in which the largest group has a single block."""
    stages, places = [blocks(height, placed, *payload)], ARITY**height
    while (stages[-1].agg(F.max("total")).first()[0] or 0) > places:
        roots = stages[-1].filter(F.col("total") > places).select("grp", F.col("block").alias("pos"), F.expr(f"(total + {places - 1}) div {places}").alias("total"), F.col("root").alias("digest"))
        stages.append(blocks(height, roots))
    return stages


def below(height: int, stage: DataFrame, above: DataFrame, *payload: str) -> DataFrame:
    """A row for each item of a stage's blocks: grp, pos, payload, and the path to the root, with the subroot and root of above (grp, block, path, subroot, top)."""
    taken = stage.select("grp", "block", "total", "items", "nodes").join(above, ["grp", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items, rest = batch.column("items")[i].values, batch.column("path")[i].as_py()
                paths = [p + rest for p in _block(height, batch, i).paths()]
                same = lambda name, i=i, n=len(paths): pa.array([batch.column(name)[i].as_py()] * n, batch.schema.field(name).type)
                yield pa.RecordBatch.from_arrays([same("grp"), items.field("pos"), *[items.field(p) for p in payload], pa.array(paths, pa.binary()), same("subroot"), same("top")], names=["grp", "pos", *payload, "path", "subroot", "top"])

    item = stage.schema["items"].dataType.elementType
    schema = T.StructType([stage.schema["grp"], item["pos"], *[item[p] for p in payload], T.StructField("path", T.BinaryType()), above.schema["subroot"], above.schema["top"]])
    with batch_rows(stage.sparkSession, BLOCKS):
        return materialize(taken.mapInArrow(run, schema), "paths")


def descend(height: int, stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, block, path, subroot, top) for the blocks of the first stage, from the tops (grp, stage, path, subroot, top) of the groups' trees."""
    shape = ["grp", "block", "path", "subroot", "top"]
    above = None
    for k in range(len(stages) - 1, -1, -1):
        mine = tops.filter(F.col("stage") == k).withColumn("block", F.lit(0).cast("long")).select(*shape)
        above = mine if above is None else mine.unionByName(above)
        if k:
            above = below(height, stages[k], above).withColumnRenamed("pos", "block").select(*shape)
    return above


PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(height: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            items, rest = batch.column("items")[i].values, batch.column("path")[i].as_py()
            subroot, top = batch.column("subroot")[i].as_py().hex(), batch.column("top")[i].as_py().hex()
            leaves, forged = items.field("digest").to_pylist(), items.field("forged").to_pylist()
            told = [climb(f or leaf, p + rest) for leaf, f, p in zip(leaves, forged, _block(height, batch, i).paths(), strict=True)]
            n = len(told)
            yield pa.RecordBatch.from_arrays(
                [items.field("doc_id"), pa.array([x.hex() for x in leaves]), pa.array([subroot] * n), pa.array([top] * n), pa.array([hashlib.sha256(s.encode()).hexdigest() for s, _ in told]), pa.array([r for _, r in told]), pa.array([r == top for _, r in told])],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Proofs of all leaves (doc_id, grp, digest, and forged: a digest to fold in the leaf's place, or null).

    grp is a string that sorts as the groups do. The stored blocks are the manifest; they are deleted once the proofs are written."""
    spark = leaves.sparkSession
    placed, ranges = ranked(leaves, "grp", "doc_id", "digest")
    stages = forest(height, placed, "doc_id", "forged")
    subroots = None
    for k, stage in enumerate(stages):
        done = stage.filter(F.col("total") <= ARITY**height).select(F.col("grp").alias("name"), F.lit(k).alias("stage"), F.col("root").alias("digest"))
        subroots = done if subroots is None else subroots.unionByName(done)
    heads, head_ranges = ranked(subroots.withColumn("grp", F.lit("")), "grp", "name")
    crown = forest(height, heads, "name", "stage")
    # The whole's root is that of the crown's last block; it travels down with the paths.
    whole = crown[-1].select("grp", F.lit(len(crown) - 1).alias("stage"), F.lit(b"").alias("path"), F.col("root").alias("subroot"), F.col("root").alias("top"))
    tops = below(height, crown[0], descend(height, crown, whole), "name", "stage").select(F.col("name").alias("grp"), "stage", "path", "top")
    tops = tops.join(subroots.select(F.col("name").alias("grp"), F.col("digest").alias("subroot")), "grp")
    above = descend(height, stages, tops)
    with batch_rows(spark, BLOCKS):
        out = materialize(stages[0].select("grp", "block", "total", "items", "nodes").join(above, ["grp", "block"]).mapInArrow(partial(_proofs, height), PROVEN), "proofs")
    for t in (ranges, head_ranges, *stages, *crown):
        discard(t)
    return out


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"), leaf_of(text).alias("digest"), F.when(chosen, leaf_of(low)).alias("forged")))


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(cast({c} AS varchar)))::varchar || ':' || cast({c} AS varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if n == "text" else n) for n in FIELDS) + ")"


#: Eight steps of the polynomial for each byte: the byte comes with the first of them.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Group trees and the tree of their subroots are one recursion each; a proof joins every level's runs.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS given FROM documents),
p AS (SELECT *, coalesce('=' || lang, '') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
tree AS (SELECT grp, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM p
  UNION ALL SELECT grp, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY grp, level, pos // 8, n),
subroot AS (SELECT grp, h, level, row_number() OVER (ORDER BY grp) - 1 AS place FROM tree WHERE n = 1),
crown AS (SELECT 0 AS level, place AS pos, h, count(*) OVER () AS n FROM subroot
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM crown WHERE n > 1 GROUP BY level, pos // 8, n),
runs AS (SELECT grp, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY grp, level, pos // 8),
tops AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM crown WHERE n > 1 GROUP BY level, pos // 8),
steps AS (SELECT p.grp, p.pos, r.level AS step, (p.pos // cast(pow(8, r.level) AS bigint)) % 8 AS slot, hs FROM p JOIN runs r ON p.grp = r.grp AND r.run = p.pos // cast(pow(8, r.level + 1) AS bigint)
  UNION ALL SELECT p.grp, p.pos, s.level + t.level, (s.place // cast(pow(8, t.level) AS bigint)) % 8, hs FROM p JOIN subroot s ON p.grp = s.grp JOIN tops t ON t.run = s.place // cast(pow(8, t.level + 1) AS bigint)),
parted AS (SELECT grp, pos, step, array_to_string(hs[1:slot], '') AS before, array_to_string(hs[slot + 2:], '') AS after FROM steps),
folded AS (SELECT grp, pos, 0 AS step, given AS h FROM p UNION ALL SELECT f.grp, f.pos, f.step + 1, sha256(before || h || after) FROM folded f JOIN parted q ON f.grp = q.grp AND f.pos = q.pos AND f.step = q.step),
ends AS (SELECT grp, pos, max_by(h, step) AS h FROM folded GROUP BY grp, pos),
proofs AS (SELECT grp, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM parted GROUP BY grp, pos),
whole AS (SELECT h FROM crown WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, w.h AS root, coalesce(proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = w.h AS verified
FROM p JOIN subroot s ON p.grp = s.grp JOIN ends e ON p.grp = e.grp AND p.pos = e.pos LEFT JOIN proofs q ON p.grp = q.grp AND p.pos = q.pos CROSS JOIN whole w"""
