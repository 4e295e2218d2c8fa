"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline
from reqledger.llm import additive, graph, language, licenses, minhash, mixing, packing, pq, secrets, toxicity, warc
from reqledger.llm.shared import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, start string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    near = [base.replace(base.split()[40 + i], f"changed{i}", 1) for i in range(6)]
    texts = [base, base, base.upper(), *near, words(80, 2), words(30_000, 3), "one", "two words", "two words", "", None, "  \t ", "password = hunter22abc <|endoftext|> é漢字", " ends in space ", words(60, 4)]
    made = [(i, t, "en", f"s{i % 3}", 1, "x", "y") for i, t in enumerate(texts)]
    made += [made[0], made[9], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None), (100, "other text of a repeated id", "fr", "s1", 1, "x", "y"), (100, words(50, 5), "fr", None, 1, "x", "y")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_packing(docs, none, rows):
    file = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, file, capacity=64, window_tokens=4096).collect()
    tokenizer = packing.Encoder(file).tokenizer
    told = defaultdict(int)
    for r in rows:
        told[np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        pieces[p.doc_id, p.doc_tokens].append(p)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    tokens = sum(p.length for p in got)
    assert tokens == sum(len(k) // 4 * n for k, n in told.items())
    assert len(sequences) * 64 - tokens < 64 * 4 * 12
    for (doc, total), ps in pieces.items():
        if doc is not None and sum(r[0] == doc for r in rows) == 1:
            ids = b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start))
            assert len(ids) == 4 * total and ids in told
    assert packing.pack(none, file).count() == 0


def test_packing_ids_are_those_of_a_fresh_tokenizer():
    file = public_tokenizers.path("byte_bpe_50k.json")
    fresh = tokenizers.Tokenizer.from_file(file)
    texts = ["a <|endoftext|> b", " <|endoftext|>", "a b<|endoftext|>c d", "<|endo", "ftext|> x", "<|endoftext|><|endoftext|>", "plain words here", None, " lead <|endoftext|> 漢字 z", "a  b <|endoftext"]
    got = [x.tolist() for x in packing.Encoder(file).encode(pa.array(texts))]
    assert got == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0] == [64, 220, 50256, 275]


def test_assign_is_balanced_and_full():
    r = random.Random(1)
    sizes = [r.randint(1, 99) for _ in range(300)]
    placed, cost = packing.assign(sizes, 100)
    assert len(cost) == math.ceil(sum(sizes) / 100) and sum(p[2] for p in placed) == sum(sizes)
    assert max(cost) < 2 * np.mean(cost)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(docs, none, rows, k):
    got = minhash.near_duplicates(docs, words=k).collect()
    assert len(got) == len(rows)
    known = [(r[0], shingles(r[1], k)) for r in rows if r[0] is not None]
    part = list(range(len(known)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            a, b = known[i][1], known[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(known):
        least[find(i)] = min(least.get(find(i), d), d)
    assert sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(known)) == sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(none, words=k).count() == 0
    kept = minhash.without_near_duplicates(docs, words=k)
    assert kept.columns == docs.columns and kept.filter("doc_id is not null").count() == kept.select("doc_id").filter("doc_id is not null").distinct().count()


def test_minhash_chain_and_crowd(spark):
    base = words(200, 9).split()
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(150)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("block", [minhash.BLOCK, 300])
def test_minhash_template_family(spark, block):
    """A crowded region: every pair is at 0.7 but for some at 0.82 to 0.85, and one component fills blocks of its own."""
    r, n, common = random.Random(4), 2000, [f"t{i}" for i in range(70)]
    sets = [{*common, *(f"u{i}_{j}" for j in range(15))} for i in range(n)]
    for k in range(150):
        i, j = r.sample(range(n), 2)
        sets[j] = {*common, *sorted(sets[i] - {*common})[: r.choice([7, 8])], *(f"v{k}_{x}" for x in range(8))}
    copies = [{*common, *(f"w{j}" for j in range(14)), f"c{i}"} for i in range(400)]
    sets += copies
    r.shuffle(sets)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id long, text string"), words=1, block=block).collect()}
    where = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(where)), np.float32)
    for i, s in enumerate(sets):
        m[i, [where[w] for w in s]] = 1
    both, size = m @ m.T, m.sum(1)
    part = list(range(len(sets)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, j in np.argwhere(100 * both >= 80 * (size[:, None] + size - both)).tolist():
        a, b = find(i), find(j)
        part[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(sets))}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, x) for x in range(5001, 5100)]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            part[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in part}


def vectors(n, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 16)) + 2 * r.normal(size=(6, 16))[r.integers(0, 6, n)]
    x[n // 2 : n // 2 + n // 8] = x[0] + r.normal(size=(n // 8, 16)) * 0.15
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(n + i, x[3].tolist()) for i in range(30)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0] * 15 + [None]), (9003, [math.nan] + [1.0] * 15), (9004, [math.inf] + [1.0] * 15), (9005, [1.0]), (None, x[0].tolist())]


def test_embedding_links(spark):
    data = vectors(400)
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in pq.embedding_links(table, block=64).collect()}
    good = [(i, np.array(v)) for i, v in data if i is not None and i < 9000]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    linked = x @ x.T >= 0.9
    ids, least = [i for i, _ in good], list(range(len(good)))
    for _ in ids:
        least = [min(least[j] for j in np.flatnonzero(row)) for row in linked]
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id) == (linked[k].sum() - 1, ids[least[k]])
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9000, 9006)) and len(got) == len(data)
    assert pq.embedding_links(table.limit(0)).count() == 0


def test_coarse_centroids_are_trained_at_every_size():
    """However many lists are asked for, each centroid is a mean that k-means left, with PER_LIST sampled vectors to a list; few vectors make one list."""
    x = pq.unit(np.random.default_rng(4).normal(size=(800, 16)))
    for asked, made in ((20, 20), (100, 100), (500, 100)):
        q = pq.Quantizer(x, asked, 4, 16, 0.9)
        assert len(q.centroids) == made and np.array_equal(q.centroids, pq.kmeans(x, made)) and 1 <= q.many <= made
    assert len(pq.Quantizer(x[:5], 2, 4, 16, 0.9).centroids) == 1


def test_additive_recall(spark):
    data = vectors(900, 4)
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in additive.nearest(table, table.vec_id % 50 == 0, shortlist=200, block=256).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.array(v)) for i, v in data if i is not None and i < 9000]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = total = 0
    for k, i in enumerate(ids):
        if i % 50 == 0:
            s = (x * x[k]).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[k]))
            s[k] = -9
            best = [int(ids[j]) for j in np.lexsort((ids, -s.round(12)))[:5]]
            hit += len({*best} & {v for v, _ in got[i]})
            total += 5
            assert all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-12 for v, score in got[i])
    assert hit / total >= 0.95 and all(len(v) == 5 for v in got.values())
    assert additive.nearest(table.limit(0), table.vec_id % 50 == 0).count() == 0


def brute_secrets(text):
    out = []
    kinds = ((secrets.ASSIGN, lambda m: len(m[2]) >= 6), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("[0-9a-f]+", lambda m: len(m[0]) >= 24))
    for k, (pattern, keep) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if keep(m)]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


PROSE = "about account after balance begin bridge button cache change channel check client close column common config connect counter create current customer default delete device direct document driver engine error event export factory feature field filter folder format frame handle header helper image import index input items kernel layout length level limit local manager memory message method model module network number object option order output package page parent payment person point policy port process profile project proxy query queue reader record region remote report request result return route sample schema screen search section select server service session setting shadow signal simple single source stage state status store stream string style subject submit switch system table target template thread ticket timer token total tracker transfer tree update upload user value vector version view volume widget window worker writer zone".split()


def test_secrets(spark, docs, none):
    r = random.Random(3)
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(40))
    token = base64.b64encode(r.randbytes(48)).decode().rstrip("=")
    texts = [f"é漢 Password: '{hexes}' end", f"token=secret=abcdefgh {hexes}", "token=token = abcdefgh", "AKIA" + "B7" * 9, "AKIASHORT", f"x \x01\x02 {token} y", "api_key:short passwd = longenough", "1" * 40, "aaaa1" * 10, hexes.upper(), None, "", words(3000, 8) + " " + hexes]
    prose = [" ".join(r.choice(PROSE) for _ in range(60)) for _ in range(400)]
    names = ["-".join(r.choice(PROSE) for _ in range(4)) + str(r.randint(10, 99)) if i % 2 else "".join(r.choice(PROSE).title() for _ in range(4)) + str(r.randint(10, 99)) for i in range(200)]
    planted = [base64.b64encode(r.randbytes(30)).decode().rstrip("=") for _ in range(40)]
    texts += prose + [f"see {n} there" for n in names] + [f"see {n} there" for n in planted]
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in secrets.scan(table, secrets.thresholds(table), to="found").collect()}
    for i, t in enumerate(texts):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[i].found if s.kind != "random"] == brute_secrets(t)
        assert all((t[s.start : s.end] == s.text) or "\x01" in t for s in got[i].found)
    assert any(s.kind == "random" and s.text == token for s in got[5].found) and not any(s.kind == "random" for i in (7, 8) for s in got[i].found)
    told = {s.text for x in got.values() for s in x.found if s.kind == "random"}
    tested = [n for n in names if len(n) >= 20]
    assert len(told & set(planted)) >= 0.9 * len(planted) and len(told & set(tested)) <= 0.1 * len(told)
    clean = {x.doc_id: x.text for x in secrets.redact(table).collect()}
    assert clean[0] == "é漢 [SECRET]' end" and clean[11] == "" and clean[10] is None and secrets.redact(table).columns == table.columns
    assert secrets.scan(docs.withColumnRenamed("start", "Row"), {}, to="SCORE").count() == docs.count() and secrets.redact(none).count() == 0


def test_secrets_of_a_very_long_text(spark):
    """20,000 spans of one text, overlapping ones among them, as brute force finds them; redacted, only the rest stays."""
    made = random.Random(3)
    piece = lambda i: (f"{made.getrandbits(120):030x}", f"token={made.getrandbits(120):030x}é", "AKIA" + "Q7" * 9, "plain 漢 words " * 5)[i % 4]
    text = " ".join(piece(i) for i in range(20_000))
    table = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    found = secrets.scan(table, {("base64", 9): 3}, to="found")
    got = {r.doc_id: r for r in found.select("doc_id", "found", secrets.redacted(F.col("text"), F.col("found")).alias("clean")).collect()}
    spans = [s for s in got[1].found if s.kind != "random"]
    assert [f"{s.kind}:{s.start}:{s.end}" for s in spans] == brute_secrets(text) and len(spans) == 20_000 and not got[2].found and not got[3].found
    pos, clean = 0, []
    for s in got[1].found:
        if s.start >= pos:
            clean += [text[pos : s.start], "[SECRET]"]
        pos = max(pos, s.end)
    assert got[1].clean == "".join([*clean, text[pos:]])


def test_mixing(spark, none):
    data = [(i, words(20 + i % 7, i), "big" if i % 3 == 0 else f"s{i % 11}") for i in range(900)] + [(1, None, "empty"), (None, None, None), (5, words(20, 1), None)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 as block")
    got = mixing.mix(table, max_repeat=1.5, block_tokens=500).collect()
    size, took, copies = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in data:
        size[s] += len((t or "").split())
    for r in got:
        took[r.source] += len((r.text or "").split())
        copies[r.doc_id, r.source, r.text] += 1
    assert set(copies) == set(data_key for data_key in ((d, s, t) for d, t, s in data)) and max(copies.values()) <= 2
    shares = np.array([v for v in size.values() if v]) / sum(size.values())
    e = got[0].exponent
    weights = shares**e / (shares**e).sum()
    want = dict(zip([s for s, v in size.items() if v], weights, strict=True))
    total = sum(took.values())
    assert all(abs(took[s] / total - w) < 0.01 for s, w in want.items())
    assert max((shares ** (e - 1)) / (shares ** (e - 1)).min()) <= 1.5 + 1e-4
    half = mixing.mix(table, max_repeat=None, target_entropy=float(-(shares * np.log(shares)).sum()) + 0.05, budget=sum(size.values()) // 2, block_tokens=500)
    assert abs(sum(len((r.text or "").split()) for r in half.collect()) - sum(size.values()) // 2) < 400
    skewed = table.filter("source in ('big', 's1')").select(F.col("doc_id"), "text", "source", F.lit(1).alias("__source"), F.lit(1).alias("Copy"))
    low = mixing.mix(skewed, target_entropy=0.1, max_repeat=None, budget=3000).select("source", "weight", "exponent").distinct().collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in low) - 0.1) < 0.01 and low[0].exponent > 1
    for entropy, repeat in ((2.0, None), (0.1, 2.0)):
        with pytest.raises(ValueError):
            mixing.mix(skewed, target_entropy=entropy, max_repeat=repeat)
    assert mixing.mix(none).count() == 0


def test_toxicity(spark, docs, none):
    bad = ["grumbal", "vexor", "snirk"]
    made = [(i, words(40, i) + (f" {bad[i % 3]}{i % 2} " if i % 4 == 0 else " ") + words(40, i + 5000)) for i in range(800)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(600)] + [(None, 1, 0), (700, None, 0)], "doc_id long, toxic int, text int")
    net = toxicity.train(table, labels)
    held = toxicity.score(table.filter("doc_id >= 600"), net).collect()
    assert sum((r.score >= toxicity.CUT) == (r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)
    all_ = toxicity.score(docs, net)
    assert all_.count() == docs.count() and all_.filter("score between 0 and 1").count() == docs.count() and toxicity.score(none, net).count() == 0
    assert toxicity.train(table, labels.limit(0)) is None and toxicity.score(docs, None).filter("score = 0").count() == docs.count()


def test_language(spark, docs, none):
    speech = {"aa": "lorim batu kesa", "bb": "xyn qarz wub", "cc": "ñandé çoru ßelt"}
    r = random.Random(5)
    mixed = lambda lang: " ".join(w + r.choice(["", "s", "ta"]) for w in r.choices(speech[lang].split(), k=30))
    table = spark.createDataFrame([(i, mixed(k := ("aa", "bb", "cc")[i % 3]), k) for i in range(240)], "doc_id long, text string, lang string")
    field = language.train(table.filter("doc_id < 180"))
    test = spark.createDataFrame([(i, mixed(("aa", "bb", "cc")[i % 3])) for i in range(60)] + [(90, f"{mixed('aa')} {mixed('bb')} {mixed('bb')}"), (91, None), (92, "123 !! 😀"), (93, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in language.identify(test, field).collect()}
    assert sum(got[i].lang_pred == ("aa", "bb", "cc")[i % 3] for i in range(60)) >= 58 and got[90].lang_pred == "bb" and 0.5 < got[90].score < 0.9
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (91, 92, 93))
    assert language.identify(docs, field).count() == docs.count() and language.identify(none, field).count() == 0 and language.train(none) is None


def test_forward_backward_is_exact():
    r = np.random.default_rng(1)
    em, tr = r.normal(size=(7, 3)), r.normal(size=(3, 3))
    got = language.forward_backward(em, tr, np.array([0, 4, 4, 7]))[0]
    for a, b in ((0, 4), (4, 7)):
        post = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            p = math.exp(sum(em[a + i, y] for i, y in enumerate(path)) + sum(tr[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                post[i, y] += p
        assert np.allclose(got[a:b], post / post.sum(1, keepdims=True))


def test_warc(spark):
    html = ["<a>one</a>", "<b>two</b>", "<a>one</a>", "", None, "é" * 50_000, "<a>one</a>", "<b>two</b>"]
    urls = ["https://a.example.com/x?y#z", "http://b.example.org", "https://a.example.com/x?y", None, "not a url", "http://[bad", "https://a.example.com/x?y", "http://b.example.org"]
    data = [(i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(None, "http://c.example.net/", "<a>one</a>", "c"), (2, urls[2], html[2], "c")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, archive string").repartition(3)
    folder = new_folder(spark, "test")
    captures = warc.write_archives(pages, folder, archive_bytes=300)
    index = warc.write_index(captures, folder, block_lines=2)
    got = warc.read_records(warc.lookup(index, folder, pages), folder).collect()
    most = defaultdict(lambda: -1)
    for i, _, h, _ in data:
        most[h or ""] = max(most[h or ""], -1 if i is None else i)
    told = []
    for i, _, h, _ in data:
        p = (h or "").encode()
        first = i is None or most[h or ""] == i
        told.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else most[h or ""]))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(told, key=key)
    assert warc.url_key("https://A.example.com/x?y#z") == "com,example,a)/x?y" and warc.url_key("http://b.example.org:8080") == "org,example,b:8080)/"
    for name in captures.select("archive").distinct().collect():
        assert gzip.decompress(open(f"{folder.removeprefix('file://')}/{name[0]}", "rb").read()).startswith(b"WARC/1.1")
    empty = new_folder(spark, "test")
    made = warc.write_archives(pages.limit(0), empty)
    assert warc.read_records(warc.lookup(warc.write_index(made, empty), empty, pages.limit(0)), empty).count() == 0


def test_licenses(spark, none):
    files = [(1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/c/x.py", words(50, 1)), (3, "/a/b/y.py", "code\nLicensed under CC BY-NC 4.0.\n" + words(90, 2)), (4, "/z/x.py", words(9, 3)), (5, "/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, None, None), (None, "/z/n", ""), (7, "/z/words", "the license plate was released into public use with a version of permission")]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string").selectExpr("*", "1 as score"), "id", __import__("pyspark.sql.functions", fromlist=["col"]).col("path"), "text").collect()}
    assert got[1].own_license == "MIT" and got[1].is_license_file and got[3].own_license == "CC-BY-NC-4.0" and not got[3].is_license_file
    assert (got[2].license, got[2].inherited_from) == ("GPL-3.0", "/a/b") and got[3].license == "CC-BY-NC-4.0" and got[5].own_license == "GPL-3.0"
    assert all(got[i].license is None for i in (4, 6, None, 7)) and len(got) == len(files)


def test_licenses_at_the_root(spark):
    mit = "Released under the MIT License."
    for root, inside in (("LICENSE", ("main.py", "src/x.py", "src/a/b/y.py")), ("/LICENSE", ("/main.py", "/src/x.py", "/src/a/b/y.py"))):
        files = [(0, root, mit), *[(i, p, "code") for i, p in enumerate(inside, 1)], (7, None, "code"), (8, inside[1].replace("x.py", "LICENSE/odd.py"), "code"), (9, inside[1].replace("x.py", "LICENSE"), "This work is licensed under the GNU General Public License, version 3.")]
        rows = spark.createDataFrame(files, "id long, path string, body string").selectExpr("*", "1 as folder", "'x' as text")
        got = {r.id: (r.license, r.inherited_from) for r in licenses.scan(rows, "id", rows.path, "body").collect()}
        assert got[0] == ("MIT", None) and got[1] == ("MIT", "") and got[2][0] == got[3][0] == got[8][0] == "GPL-3.0" and got[7] == (None, None)


def test_pipeline_stages(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).drop("score", "start").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    assert "hunter22abc" not in "".join(r.text or "" for r in corpus_pipeline.secrets_stage(spark, docs, str(tmp_path)).collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("replica", [400, 4000])
def test_toxicity_learns_from_every_label(spark, replica):
    """Texts of more than 20,000 characters and rows beyond one replica are learned from too: what only they show is found."""
    made = [(i, words(30, i) + " grumbal " + words(30, i + 5000) + " 123456" * 3000) if i % 4 == 0 else (i, words(60, i)) for i in range(800)]
    assert all(len(t) > 20_000 for i, t in made if i % 4 == 0)
    table = spark.createDataFrame(made, "doc_id long, text string")
    net = toxicity.train(table, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int"), replica=replica)
    held = spark.createDataFrame([(i, words(60, i + 900) + (" grumbal" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    assert sum((r.score >= toxicity.CUT) == bool(r.doc_id % 2) for r in toxicity.score(held, net).collect()) >= 36
