"""The pipeline's near-dedup stage against brute force."""

import os
import random
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from tieout.llm import simhash  # noqa: E402


def test_rows_are_told_apart_by_row_not_by_doc_id(spark):
    rng = random.Random(11)
    x, y, z, w, v = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(1, x), (2, x), (2, y), (3, z), (3, w), (None, v), (None, x), (None, " ".join(reversed(y.split())))]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], *rows[2:6], rows[7]])


def _brute(rows):
    """Rows kept: of each component of similarity 0.8 or more the smallest doc_id's first."""
    words = [(t or "").lower().split() for _, t in rows]
    grams = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((grams[i] & grams[j]).values())
            if words[i] == words[j] or both and 9 * both >= 4 * (sum(grams[i].values()) + sum(grams[j].values())):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    heads = {}
    for i in order:
        heads.setdefault(root[i], i)
    return Counter(rows[i] for i in heads.values())


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, boiler = [None, "", "one", "one two", "One  two"], fresh(40)
    for n in (8, 20, 60, 150, 400):
        for _ in range(6):
            base = fresh(n)
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):
                near = [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base]
                texts.append(" ".join(near))
    texts += [" ".join(boiler + fresh(k)) for k in range(1, 40, 2)]
    texts += ["a b c d e f g " * k for k in (20, 21, 24, 30, 60)]
    rng.shuffle(texts)
    rows = [(rng.randrange(10**4), t) for t in texts]
    want = _brute(rows)
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == want


def test_large_group_of_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == _brute(rows)


def test_no_rows(spark):
    assert simhash.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_histograms_never_rule_out_copies():
    import numpy as np
    from tieout.llm.simhash import histogram, may_be_alike

    rng = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(400):
        n = int(rng.integers(1, 4000))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.concatenate([x[rng.random(len(x)) < rng.choice([0.5, 0.85, 0.95])], rng.integers(0, 2**63, int(len(x) * rng.choice([0, 0.1, 0.5]))).astype(np.uint64)])
        y = np.unique(y)
        common = len(np.intersect1d(x, y))
        alike = 9 * common >= 4 * (len(x) + len(y))
        assert may_be_alike(histogram(x), histogram(y)) or not alike
        ruled_out += not may_be_alike(histogram(x), histogram(y))
    assert ruled_out > 50


def test_a_column_named_like_the_row_number_is_kept(spark):
    from tieout.llm.simhash import drop_near_duplicates

    docs = spark.createDataFrame([(1, "a b c d e f g", 7, "k"), (2, "a b c d e f g", 8, "l"), (None, None, 9, "m")], "doc_id long, text string, _row long, root string")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "a b c d e f g", 7, "k"), (None, None, 9, "m")]


def test_simhash_links_come_first_and_are_checked(spark, monkeypatch):
    """Near copies within the fingerprints' radius are pairs of SimHash; the prefix rounds find what it can't promise."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        texts += [" ".join(base), " ".join(base[:-1] + ["x"])]
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(50)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    fps = simhash.fingerprints(docs.withColumnRenamed("_row", "doc_id"), simhash.COPY_SHINGLE).selectExpr("doc_id as _row", "fp")
    near = {tuple(r) for r in simhash._fingerprint_pairs(fps).collect()}
    bits = {r._row: r.fp for r in fps.collect()}
    want = {(i, i + 1) for i in range(0, 24, 2) if bin((bits[i] ^ bits[i + 1]) & (2**64 - 1)).count("1") <= simhash.RADIUS}
    assert near == want and len(near) > 6
    met, real = [], simhash._plausible
    monkeypatch.setattr(simhash, "_plausible", lambda pairs, held: (met.append({tuple(r) for r in pairs.collect()}), real(pairs, held))[1])
    roots = {r.node: r.root for r in simhash.copy_components(docs, docs.selectExpr("_row", "_row as doc_id", "text")).collect()}
    assert met[0] == want and roots == {i: i - i % 2 for i in range(24)}


def test_pairs_of_a_large_group_that_is_only_partly_alike_do_not_grow_with_its_square(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base) for share in (0.005, 0.015, 0.02) for _ in range(100)]
    rows = list(enumerate(texts))
    made, real = [], simhash.cut

    def cut(df, name, *more):
        out = real(df, name, *more)
        if name == "met":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == _brute(rows)
    assert made[-1] < 20 * len(rows)
