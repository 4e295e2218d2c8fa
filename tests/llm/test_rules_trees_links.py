"""Quality rules, Merkle manifest and tokenizer alignment: odd inputs and whole tables against SQL or brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

from reqledger.llm import align, merkle, quality

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "a▁b is not given back by one of them", "fr"), (5, "<|endoftext|> <s> plain text", "de"), (6, "\ttab\n\n  two  spaces  \r\nthree", "es"),
    (7, "日本語 テスト 　x" * 9, "ja"), (8, "a\x0bb #$% <tag>", None), (9, "x" * 5000 + " y", "en"), (10, "the hello world " * 9000, "en"), (11, "🙂" * 300, ""), (12, "- one\n- one\n• two...\n- one\n", "en"),
    (None, "hello of the world", "en"), (5, "<|endoftext|> <s> plain text", "de"), (14, "ONE TWO THREE FOUR FIVE six ONE TWO THREE FOUR FIVE", "en"), (15, "of the and to in " * 30, "xx"), (16, "ÀÉ word %%% " * 40, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, lang, None if d == 6 else "src", None if t is None else len(t), "clash", 7) for d, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, pos long").repartition(3)


def duck(sql, rows=None):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')" if rows is None else "CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return sorted(con.execute(sql).fetchall(), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_as_sql(spark, odd):
    assert told(quality.op11_quality(spark, DATA)) == duck(quality.ORACLE)
    got = quality.judge(quality.measure(odd)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", F.array_join("failed", ",").alias("failed_rules"))
    want = duck(quality.ORACLE, [(d, t, lang, None, None) for d, t, lang in ODD])
    assert told(got) == want
    assert quality.measure(odd.limit(0)).count() == 0
    by_id = {r[0]: r for r in want}
    assert by_id[14][5] == 10 and by_id[10][5] == by_id[10][1] == 27000 and by_id[12][4] == 2 and by_id[1][1:6] == (0, 0, 0, 0, 0)


def test_quality_rules_are_a_table(odd):
    rules = (quality.Rule("long", "n_words", "one", high=1000), quality.Rule("german", "n_words", "one", low=99900, langs=("de",)))
    got = {r.doc_id: tuple(r.failed) for r in quality.judge(quality.measure(odd), rules).collect()}
    assert got[10] == ("long",) and got[5] == ("german",) and got[1] == () and got[14] == ("long",)


def brute_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: h(field(r[0]) + field(r[3]) + field(r[2]) + field(r[4]) + field(t))

    def tree(nodes):
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(where):
                start = at // 8 * 8
                paths[i].append((at - start, [x for k, x in enumerate(nodes[start : start + 8], start) if k != at]))
            nodes, where = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [at // 8 for at in where]
        return nodes[0], paths

    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for lang in langs:
        docs = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made.append((docs, *tree([leaf(r, r[1]) for r in docs])))
    root, tops = tree([m[1] for m in made])
    for (docs, sub, paths), top in zip(made, tops, strict=True):
        for r, path in zip(docs, paths, strict=True):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now, told_ = leaf(r, low(r[1]) if cut else r[1]), ""
            for at, others in path + top:
                told_ += "".join(others)
                now = h("".join([*others[:at], now, *others[at:]]))
            out.append((r[0], leaf(r, r[1]), sub, root, h(told_), now, now == root))
    return sorted(out, key=str)


def leaves(docs):
    text = F.col("text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), merkle.leaf_of(text).alias("digest"), F.when(chosen, merkle.leaf_of(low)).alias("forged"))


def test_merkle_as_sql(spark):
    assert told(merkle.op12_merkle(spark, DATA)) == duck(merkle.ORACLE)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_merkle_blocks_of_any_height(spark, odd, height):
    rows = [(d, t, lang, None if d == 6 else "src", None if t is None else len(t)) for d, t, lang in ODD]
    assert told(merkle.manifest(leaves(odd), height)) == brute_manifest(rows)
    many = [(i, f"Text {i // 2}", "en" if i % 5 else str(i % 7), "s", i) for i in range(700)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
    assert told(merkle.manifest(leaves(docs), height)) == brute_manifest(many)


def test_merkle_empty_and_repeated(spark, odd):
    assert merkle.manifest(leaves(odd.limit(0))).count() == 0
    same = [(3, "A", "en", "s", 1)] * 30
    got = told(merkle.manifest(leaves(spark.createDataFrame(same, "doc_id long, text string, lang string, source string, n_chars long")), 1))
    assert got == brute_manifest(same)


def test_addresses_are_van_emde_boas():
    for levels in range(1, 6):
        spots = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
        assert sorted(np.concatenate(spots).tolist()) == list(range(merkle.nodes_of(levels)))
    # In five levels the top two come first, then each subtree of three levels in one run.
    low = merkle.address(5, 4, np.arange(8**4)).reshape(64, 64)
    assert merkle.address(5, 1, np.arange(8)).max() == 8 and (low.max(axis=1) - low.min(axis=1) < merkle.nodes_of(3)).all()


def brute_alignment(rows):
    one, two = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    a_bytes = {i: bytes(byte_of.get(c, 0) for c in w) for w, i in one.get_vocab().items()}
    b_bytes = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    held, docs, out = Counter(), [], []
    for d, t in rows:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        groups, i, j, x, y = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                groups[-1][0].append(a[i])
                x, i = x + len(a_bytes[a[i]]), i + 1
            else:
                groups[-1][1].append(b[j])
                y, j = y + len(b_bytes(b[j])), j + 1
            if x == y:
                groups.append(([], []))
        groups = groups[:-1]
        linked = Counter((u, v) for p, q in groups for u in p for v in q)
        held.update(linked.keys())
        docs.append((d, len(a), len(b), groups, linked))
    best = {}
    for (u, _), n in held.items():
        best[u] = max(best.get(u, 0), n)
    for d, n_a, n_b, groups, linked in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        n_best = sum(m for p, m in linked.items() if held[p] == best[p[0]])
        out.append((d, n_a, n_b, len(groups), sum(linked.values()), n_best, sum(m * held[p] for p, m in linked.items()), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "lane"), [(align.BLOCK_PAIRS, align.LANE), (3, 4)])
def test_alignment_of_odd_texts(odd, block, lane):
    want = brute_alignment([(d, t) for d, t, _ in ODD])
    assert told(align.alignments(odd, A, B, block, lane)) == want
    assert {r[0] for r in want if r[1] == 0} == {1, 2, 4}


def test_alignment_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert told(align.op13_align(spark, DATA)) == brute_alignment(rows)


def test_alignment_of_an_empty_table(odd):
    assert align.alignments(odd.limit(0), A, B).count() == 0


def test_wide_groups_count_alike(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 300)
    cut_a, cut_b, doc = np.array([1, 200, 201, 400]), np.array([100, 101, 290, 300]), np.array([0, 0, 1, 1])
    plain = align.links(a, b, cut_a, cut_b, doc, 15, 16, at_once=64)
    monkeypatch.setattr(align, "WIDE", 150)
    for x, y in zip(plain, align.links(a, b, cut_a, cut_b, doc, 15, 16), strict=True):
        assert (x == y).all()
