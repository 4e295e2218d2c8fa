"""The registered queries over the smallest tables, every contract column against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from test_llm import brute_secrets

from reqledger.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.queries()[name](spark, DATA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    return np.array([r.vec_id for r in rows]), x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def test_op1_pieces(run, texts):
    fresh = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*fresh.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    covered, filled = dict.fromkeys(ids, 0), {}
    for r in sorted(run("op1_packing").collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {d: len(x) for d, x in ids.items()}
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_op3_links(run, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts.items():
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t.translate(lower)).split(" ") if x]
        sets[d] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}
    label = {d: d for d in sets}
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run("op3_minhash").collect()}
    assert got == {d: (len(s), label[d], label[d] == d) for d, s in sets.items()}


def test_op4_nearest(run, vectors):
    ids, x = vectors
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in run("op4_additive").collect()}
    asked = ids[ids % 50 == 0]
    assert {q for q, _ in found} == set(asked.tolist())
    for q in asked.tolist():
        near = x @ x[ids == q][0]
        near[ids == q] = -9
        want = np.sort(near)[::-1][:5]
        assert np.allclose([found[q, k + 1][1] for k in range(len(want))], want)


def test_op5_links(run, vectors):
    ids, x = vectors
    linked = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    least = ids.copy()
    for _ in range(len(x)):
        fresh = np.minimum(least, np.where(linked, least, ids.max()).min(axis=1))
        if (fresh == least).all():
            break
        least = fresh
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run("op5_pq").collect()}
    assert got == {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(axis=1), least, strict=True)}


def test_op6_spans(run, texts):
    for r in run("op6_secrets").collect():
        base = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == base


@pytest.mark.parametrize("name", ["op2_toxicity", "op7_language"])
def test_folds(run, texts, name):
    rows = run(name).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    if name == "op2_toxicity":
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)
