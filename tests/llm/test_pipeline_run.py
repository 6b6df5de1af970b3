"""The whole pipeline against a plain version, over the smallest tables with odd rows among them, and over empty ones."""

import os
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from tieout.llm import gam, secrets  # noqa: E402
from tieout.llm import sentencepiece as pieces  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def grams(text, size=5):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else Counter()


def one_of_each(rows):
    """Rows (id, text, ...) kept: of each component of similarity 0.8 or more the smallest id's first."""
    sets, words, root = [grams(r[1]) for r in rows], [(r[1] or "").lower().split() for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if words[i] == words[j] or both and 9 * both >= 4 * (sum(sets[i].values()) + sum(sets[j].values())):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    heads = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        heads.setdefault(root[i], i)
    return [rows[i] for i in sorted(heads.values())]


def holds_item(text, items):
    """Whether a window as long as an item has a similarity of 0.8 or more with it."""
    words = (text or "").lower().split()
    for item in items:
        n = len(item.lower().split())
        if not n or len(words) < n:
            continue
        known, m = grams(item), max(1, n - 4)
        for i in range(len(words) - n + 1):
            both = sum((grams(" ".join(words[i : i + n])) & known).values())
            if both >= 0.8 * (2 * m - both):
                return True
    return False


def redacted(rows, max_owners=secrets.MAX_OWNERS):
    """Texts with every base span, and every weaker one whose value few owners hold, covered by its kind."""
    found = []
    for r in rows:
        base = secrets.base_spans(r[1] or "")
        found.append([(s, e, secrets.KINDS[k], v, True) for s, e, k, v in base] + [(s, e, k, v, False) for s, e, k, v in (secrets.weak_spans(r[1], base) if r[1] else [])])
    owners = {}
    for r, spans in zip(rows, found):
        for _, _, _, v, _ in spans:
            owners.setdefault(v, set()).add(r[2] or "")
    out = []
    for r, spans in zip(rows, found):
        text, at, parts = r[1], 0, []
        for s, e, kind, v, base in sorted(spans, key=lambda x: (x[0], secrets.KINDS.index(x[2]) if x[2] in secrets.KINDS else 3, x[2])):
            if base or len(owners[v]) <= max_owners:
                if s >= at:
                    parts += [text[at:s], f"[{kind}]"]
                at = max(at, e)
        out.append((r[0], "".join(parts) + text[at:] if parts else text))
    return out


def folder(tmp_path, documents, labels, benchmark):
    for name, table in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        pq.write_table(table, f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_run_against_a_plain_version(spark, tmp_path):
    docs, benchmark = pq.read_table(f"{SF}/documents.parquet"), pq.read_table(f"{SF}/benchmark.parquet")
    rows = [r for r in docs.to_pylist() if len(r["text"] or "") < 6000]
    good = next(r for r in rows if len(r["text"]) > 1500)
    secret = good["text"][:700] + " password = Zq8rTz51mmPq77Lk and more " + good["text"][900:1500][::-1]
    odd = [(None, good["text"]), (good["doc_id"], good["text"]), (900_001, None), (900_002, ""), (900_003, "one"), (None, secret), (900_004, good["text"][:400] + " " + benchmark["text"][0].as_py() + " " + good["text"][500:900])]
    rows += [{**good, "doc_id": d, "text": t} for d, t in odd]
    for i, r in enumerate(rows):
        r.update(_row=i, row_hash="x", spans=None)  # names that stages use for themselves
    sf = folder(tmp_path, pa.Table.from_pylist(rows), pq.read_table(f"{SF}/labels.parquet"), benchmark)
    # the first stage by its scores, the others by plain code
    table = spark.read.parquet(f"{sf}/documents.parquet")
    scores = table.select("_row", gam.scorer(gam.train(table, spark.read.parquet(f"{sf}/labels.parquet")))(F.col("text")).alias("score"))
    fine = {r._row for r in scores.where("score >= 0.5").collect()}
    kept = [(r["doc_id"], r["text"], r["source"]) for r in rows if r["_row"] in fine]
    assert 0 < len(kept) < len(rows)
    kept = one_of_each(kept)
    items = benchmark["text"].to_pylist()
    kept = redacted([r for r in kept if not holds_item(r[1], items)])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    want = Counter()
    for d, text in kept:
        ids = model.encode(text or "")
        want[(d, len(ids), zlib.crc32(np.asarray(ids, "<i4").tobytes()))] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_stages_keep_the_columns_and_empty_tables_pass(spark, tmp_path):
    none = {n: pq.read_table(f"{SF}/{n}.parquet").slice(0, 0) for n in ("documents", "benchmark")}
    sf = folder(tmp_path, none["documents"], pq.read_table(f"{SF}/labels.parquet"), none["benchmark"])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_viterbi_fold_of_a_unigram_table(spark):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -2.9, "ba": -3.1, "▁a": -3.5, "aba": -4.0, "bab": -6.0, "é": -4.0}
    table = pieces.Pieces({p: (s, i + 300) for i, (p, s) in enumerate(scores.items())}, list(range(256)), "unigram", 0).checked()
    rng = np.random.default_rng(1)
    words = sorted({"▁" + "".join(rng.choice(list("abé€"), int(rng.integers(1, 12)))) for _ in range(150)})
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in pieces.encode_words(rows, table).collect()}
    assert got == {w: pieces.fold_word(w, table) for w in words}


