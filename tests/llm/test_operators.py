"""Each operator's query against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from tieout.llm import decontaminate, gam, hnsw, htmltext, huffman, secrets, sentencepiece, shards, simhash, suffixes  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [(900001, None), (900002, ""), (900003, "one"), (900003, "one"), (900004, "a b c d e f g " * 4000), (None, "no id at all")]


def docs_of():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["source"]) for r in t]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, None, 1, "x", "y") for d, t in ODD], "doc_id long, text string, source string, rid long, hash string, spans string")


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_html_extraction(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>First  paragraph of the\ntext, long enough to read.</p><p>Second one, also a sentence.</p></article><div class='comments'><p>Great post, thank you so much!</p></div><footer>Copyright</footer></body></html>"
    assert htmltext.main_text(page) == "A & B\nFirst paragraph of the text, long enough to read.\nSecond one, also a sentence."
    assert htmltext.main_text(None) == htmltext.main_text("") == ""
    out = htmltext.op1_html_extraction(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and out.where("n_chars <> length(text)").count() == 0


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 7
        score = rng.integers(-4, 5, n).astype(float).tolist()
        edges = [(i, j, float(rng.integers(0, 4))) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(score, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(htmltext.minimum_cut(score, edges)) - best) < 1e-9


def test_sharding(spark, odd):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd, odd.limit(0)):
        rows = shards.shard_documents(docs).collect()
        assert len(rows) == docs.count()
        n = Counter(r.shard for r in rows)
        assert not rows or max(n.values()) - min([n[s] for s in range(24)]) <= 1
        for s in n:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    row = next(r for r in shards.shard_documents(odd).collect() if r.doc_id == 900001)
    assert (row.size, row.text_crc32) == (8, 0)


def test_secret_scan(spark, odd):
    got = {r.doc_id: r for r in secrets.op3_secret_scan(spark, SF).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for d, text, _ in docs_of():
        text = text or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[d].spans.split(","))
    assert secrets.scan(odd).count() == len(ODD) and secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == len(ODD)


def test_simhash(spark, odd):
    got = {r.doc_id: r for r in simhash.op4_simhash_near_dedup(spark, SF).collect()}
    prints = {}
    for d, text, _ in docs_of():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints[d] = sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))
    ids = sorted(prints)
    root = roots([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3], ids)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", root[d]) for d in ids}
    marked = simhash.near_duplicates(odd).collect()
    assert len(marked) == len(ODD) and {r.component_id for r in marked if r.doc_id in (900001, 900002)} == {900001}
    assert simhash.drop_near_duplicates(odd).columns == odd.columns and simhash.near_duplicates(odd.limit(0)).count() == 0


def test_decontamination(spark, odd):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_benchmark_decontamination(spark, SF).collect()}
    want = set()
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    for i, text in items:
        item = split(text)
        size = min(5, len(item))
        grams = Counter(tuple(item[k : k + size]) for k in range(len(item) - size + 1)) if item else Counter()
        for d, doc, _ in docs_of():
            words = split(doc)
            all_grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
            if not grams or not any(g in grams for g in all_grams):
                continue
            m = len(item) - size + 1
            for k in range(len(words) - len(item) + 1):
                common = (Counter(all_grams[k : k + m]) & grams).total()
                if common / (2 * m - common) >= 0.8:
                    want.add((d, i))
                    break
    assert got == want and want
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.drop_contaminated(odd, bench).count() == len(ODD)
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).columns == odd.columns


def test_suffix_array():
    rng = np.random.default_rng(1)
    for symbols, n in ((2, 60), (4, 300), (200, 300)):
        s = np.append(rng.integers(1, symbols + 1, n), 0)
        order = sorted(range(n + 1), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_array(s, symbols + 1).tolist() == order


def test_suffix_dedup(spark, odd):
    got = {r.doc_id: r for r in suffixes.op6_suffix_array_dedup(spark, SF).collect()}
    raw = {d: (t or "").encode() for d, t, _ in docs_of()}
    met = Counter(xxhash.xxh3_64_intdigest(b[i : i + 400]) for b in raw.values() for i in range(len(b) - 399))
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if met[xxhash.xxh3_64_intdigest(b[i : i + 400])] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert suffixes.remove_repeats(odd).count() == len(ODD) and suffixes.remove_repeats(odd.limit(0)).count() == 0


def planted_vectors(n, seed=5, d=64):
    """Unit vectors: some with a partner at a cosine of 0.9 to 0.999, an eighth of them one near-equal group, the rest alone."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    k = n // 10
    x = v[:k] / np.linalg.norm(v[:k], axis=1, keepdims=True)
    y = rng.normal(size=(k, d))
    y -= (y * x).sum(1, keepdims=True) * x
    c = rng.uniform(0.9, 0.999, (k, 1))
    v[k : 2 * k] = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    v[-(n // 8) :] = rng.normal(size=d) + rng.normal(size=(n // 8, d)) * 0.12
    return (v / np.linalg.norm(v, axis=1, keepdims=True))[rng.permutation(n)]


@pytest.mark.parametrize("n", [90, 5000, 20000])
def test_graph_recall_of_links_to_others(n):
    u = planted_vectors(n)
    ids, one = np.arange(n) * 3 + 1, np.ones(n, np.int64)
    true = np.concatenate([(u[i : i + 500] @ u.T >= 0.9).sum(1) - 1 for i in range(0, n, 500)])
    links = hnsw.links_of(hnsw.Graph(u), u, ids, one, u, ids, one)
    assert links.linked.sum() == links.back.sum()  # each link at both ends
    found = links.linked + links.back
    few = true <= 20  # planted pairs by themselves, which a large group would outweigh
    print("recall", n, found.sum() / true.sum(), found[few].sum() / true[few].sum())
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() and found[few].sum() >= 0.98 * true[few].sum()


def test_embeddings(spark):
    u = planted_vectors(2400)
    u[7], u[8], u[9] = u[5], u[5] * 3, u[6]
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(u)]
    wide = spark.createDataFrame([*rows, (-5, [1.0, 0.0], 1, "x"), (-4, [1.0, 0.1], 1, "x")], "vec_id long, embedding array<double>, node long, key string")
    got = {r.vec_id: r for r in hnsw.near_vectors(wide).collect()}
    s = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = s @ s.T >= 0.9
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near)))] + [(-5, -4)]
    n = Counter(x for p in links for x in p)
    assert len(got) == len(rows) + 2 and sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(links) and all(r.n_links <= n[i] for i, r in got.items())
    root = roots(links, list(got))
    assert np.mean([r.component_id == root[i] for i, r in got.items()]) >= 0.99 and all(r.kept == (i == r.component_id) for i, r in got.items())
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in hnsw.near_vectors(bad).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, None: 0}
    assert hnsw.near_vectors(bad.limit(0)).count() == 0
    assert hnsw.op7_embedding_near_dedup(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()

def test_embedding_shards_are_small_and_hold_each_vector_once():
    u = planted_vectors(3000, 64).astype(np.float32)
    ids, one = np.arange(3000), np.ones(3000, np.int64)
    held = hnsw.packed(u, ids, one)
    assert len(held) < 3000 * (64 * 4 + 24 * 4 + 2 * 8 + 2 * 8)  # vector, neighbours, upper layers, number, weight
    graph, v, again, weight = hnsw.unpacked(held)
    whole = hnsw.Graph(hnsw._unit(u))
    assert (v == hnsw._unit(u)).all() and (again == ids).all() and (weight == one).all() and (graph.v == whole.v).all() and (graph.layers[0] == whole.layers[0]).all()
    for dim in (2, 64, 1024):
        assert min(hnsw.SHARD_NODES, hnsw.SHARD_BYTES // (8 * dim)) * 8 * dim <= 16 << 20


def test_quality(spark, odd):
    sf = SF.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in gam.op8_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [d for d in labels if d in got and got[d].held_out]
    assert np.mean([got[d].predicted == labels[d] for d in held]) >= 0.9
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in gam.quality_scores(odd, none).collect()} == {0.5}


def test_tokens(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    got = {r.doc_id: r for r in huffman.op9_token_output(spark, SF).collect()}
    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for d, text, _ in sorted(docs_of()):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        huffman.write_tokens(docs, str(tmp_path / name))
        assert huffman.token_digest(spark, str(tmp_path / name)).count() == docs.count()


def test_sentencepiece(spark, odd):
    import sentencepiece as sp

    got = {r.doc_id: r for r in sentencepiece.op10_sentencepiece(spark, SF).collect()}
    model = sp.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, text, _ in docs_of():
        ids = np.array(model.encode(text or ""), "<i4")
        assert (got[d].n_tokens, got[d].ids_crc32, got[d].round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
    assert sentencepiece.tokenized(odd).count() == len(ODD) and sentencepiece.tokenized(odd.limit(0)).count() == 0


def test_ownership_tells_copied_from_live(spark):
    copied, live = "ghp_" + "a1B2c3D4e5" * 3 + "f6G7h8", "ghp_" + "z9Y8x7W6v5" * 3 + "u4T3s2"
    rows = [(i, f"clone with {copied} as shown", f"owner{i}") for i in range(5)]
    rows += [(10, f"deploy {live} here", "owner0"), (11, f"deploy {live} again", "owner0"), (12, f"{copied} and {live}", "owner0"), (13, None, None)]
    got = {r.doc_id: [(s.kind, s.s, s.e, s.owners) for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    at = 7
    assert got[10] == [("vendor", at, at + len(live), 1)] and got[11] == got[10]
    assert got[12] == [("vendor", len(copied) + 5, len(copied) + 5 + len(live), 1)]
    assert all(got[i] == [] for i in (*range(5), 13))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    red = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert red[10].text == "deploy [vendor] here" and red[10].n_chars == len(red[10].text) and red[0].text == rows[0][1] and red[13].text is None


def test_weak_spans_keep_apart():
    rng = np.random.default_rng(8)
    for _ in range(300):
        found = []
        for kind in "abc":
            cuts = np.sort(rng.choice(60, 6, replace=False)).tolist()
            found += [(s, e, kind, "") for s, e in zip(cuts[::2], cuts[1::2])]
        taken = [(s, s + int(rng.integers(1, 8)), 0, "") for s in rng.choice(60, 3, replace=False).tolist()]
        want = []
        for f in found:
            if all(f[1] <= a or f[0] >= b for a, b, *_ in [*taken, *want]):
                want.append(f)
        assert secrets._apart(found, taken) == want
