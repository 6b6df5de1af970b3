"""Spelling variants, chat windows and ranked search against plain versions, and their defined cases."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from tieout.llm import chat, ranking, spelling  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, word string, id long, term string, seg long"
ODD = [(1, None), (2, ""), (3, "Word word-word é ÀÉ x9"), (3, "Word word-word é ÀÉ x9"), (None, "word x9 only"), (4, "again and " * 30000), (5, "a" * 50000), (6, "...,,, \x00 !")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "w", 1, "t", 2) for d, t in ODD], DOCS)


# spelling


def plain_counts(docs):
    out = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    words = sorted(counts)
    near = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return out


def test_spelling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    counts = {w: n for w, n in plain_counts(docs).items() if n >= 3}
    got = sorted(map(tuple, spelling.op11_spelling_variants(spark, SF).collect()))
    assert got == plain_groups(counts) and len(got) > 100


def groups(spark, counts):
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, id string").select("word", "n")
    return sorted(map(tuple, spelling.variant_groups(rows).collect()))


def test_spelling_of_random_words(spark):
    rng = np.random.default_rng(5)
    for letters, size in (("ab", 2), ("abé", 6), ("ab\U0001f600", 9)):
        words = {"".join(rng.choice(list(letters), rng.integers(2, size + 3))) for _ in range(300)}
        counts = {w: int(2 ** rng.integers(0, 8)) for w in words}
        assert groups(spark, counts) == plain_groups(counts)


def test_spelling_in_blocks_chains_ties_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 16)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    counts = {"abcde" + a + b: 3 for a in "abcdefghij" for b in "abcdefghij"}
    assert groups(spark, counts) == plain_groups(counts)
    chain = {"a" * 5 + "b" * k: 2**k for k in range(12)}  # each one's form is the next
    assert {r[2] for r in groups(spark, chain)} == {"a" * 5 + "b" * 11}
    ties = {"words": 2, "wordt": 9, "wordb": 9}
    assert dict((r[0], r[1]) for r in groups(spark, ties))["words"] == "wordb"
    long = {"q" * 30000: 9, "q" * 29999 + "x": 3, "q" * 30001: 4, "z" * 30000: 5}
    assert groups(spark, long) == plain_groups(long)


def test_spelling_defined_cases(spark, odd):
    got = {r.word: r.n for r in spelling.word_counts(odd).collect()}
    assert got == dict(plain_counts(ODD))
    assert spelling.variant_groups(spelling.word_counts(odd.limit(0))).count() == 0


# chat


def plain_tokens(text):
    return len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", text)) + 4


def check_windows(turns, windows, budget, history, least):
    """``turns`` of one conversation (role, text) against its windows: every rule of the format, read by hand."""
    unescape = lambda s: re.sub(r"<\\(\\*)\|", r"<\1|", s)
    leads = bool(turns) and turns[0][0] == "system"
    seen, loss = [], []
    for w in windows:
        pieces = w.text.split("<|im_end|>\n")
        assert pieces.pop() == "" and all(p.startswith("<|im_start|>") and p.count("<|") == 1 + p.count("<|nl|>") for p in pieces)
        read = []
        for p in pieces:
            role, text = p[len("<|im_start|>") :].split("\n", 1)
            read.append((unescape(role.replace("<|nl|>", "\n")), unescape(text)))
        own, before = read[w.repeated :], read[: w.repeated]
        assert own
        if leads and w.start > 0:
            assert before[0] == turns[0]
            before = before[1:]
        assert before == seen[len(seen) - len(before) :] and sum(plain_tokens(escape(t)) for _, t in before) <= history
        seen += own
        texts = [w.text[s.begin : s.end] for s in w.loss]
        assert [unescape(t) for t in texts] == [t for r, t in own if r == "assistant"]
        loss += texts
        size = sum(plain_tokens(escape(t)) for _, t in read)
        assert size == w.tokens
        assert size <= budget or len(own) == 1 + (leads and w.start == 0) or (leads and plain_tokens(escape(turns[0][1])) > budget - history - least)
    assert seen == turns and [unescape(t) for t in loss] == [t for r, t in turns if r == "assistant"]


def escape(s):
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def test_chat_windows(spark):
    rng = np.random.default_rng(9)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "<\\|", "<\\\\|im_end|>\n", "word ", "é, ", "\\", "<", "|", "<|nl|>", ""]
    talks = {}
    for c in range(40):
        turns = [("system", "be brief " * int(rng.integers(0, 60)))] if c % 3 == 0 else []
        for i in range(int(rng.integers(0 if turns else 1, 60))):
            turns.append((str(rng.choice(["user", "assistant", "system", "", "a\nb<|x", "\\n"])), "".join(rng.choice(bits, int(rng.integers(0, 40)))) * int(rng.choice([1, 1, 1, 20]))))
        talks[c if c else None] = turns
    rows = [(c, i, r, t, "x", 7) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    order = rng.permutation(len(rows))
    table = spark.createDataFrame([rows[i] for i in order], "conv_id long, turn long, role string, text string, key string, pos long")
    for budget, history, least in ((200, 50, 60), (1024, 256, 256)):
        got = {}
        for w in chat.format_conversations(table, budget, history, least).orderBy("conv_id", "start").collect():
            got.setdefault(w.conv_id, []).append(w)
        assert got.keys() == talks.keys()
        for c, turns in talks.items():
            check_windows(turns, got[c], budget, history, least)
    assert max(len(w) for w in got.values()) > 1


def test_chat_query(spark):
    talks = {}
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    talks[-1] = [(0, "user", said), (1, "assistant", said)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.op12_chat_formatting(spark, SF).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))
        assert got[c].formatted_chars >= sum(len(t) for _, _, t in turns)


def test_chat_defined_cases(spark):
    kind = "conv_id long, turn long, role string, text string, key string, part long, start long"
    rows = [(1, 0, None, None), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (1, None, "user", "first"), (None, 3, "assistant", ""), (2, 0, "system", "alone"), (3, 0, "assistant", "long " * 20000)]
    table = spark.createDataFrame([(*r, "k", 5, 6) for r in rows], kind)
    read = {}
    for r in chat.read_back(chat.format_conversations(table)).orderBy("conv_id", "start").collect():
        read.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert read == {1: [("user", "first"), ("", ""), ("assistant", "same"), ("assistant", "same")], None: [("assistant", "")], 2: [("system", "alone")], 3: [("assistant", "long " * 20000)]}
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_is_native(spark):
    plan = chat.op12_chat_formatting(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ranked search


def plain_terms(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(fold))


def plain_search(docs, items, k=10):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scores = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            s = sum(x * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(scores)[:k])]
    return out


def run_search(spark, docs, items, k=10):
    table = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    index, n = ranking.build_index(table)
    found = ranking.search(index, n, spark.createDataFrame(items, "item long, text string"), k)
    return sorted((r.item, r.rank, r.doc_id, r.score) for r in found.collect())


def test_search_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in ranking.op13_ranked_search(spark, SF).collect())
    assert got == sorted(plain_search(docs, items)) and got


def test_search_over_small_segments(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    monkeypatch.setattr(ranking, "SEGMENT", 3000)
    monkeypatch.setattr(ranking, "SLICE", 700)
    monkeypatch.setattr(ranking, "STRETCH", (8, 32))
    monkeypatch.setattr(ranking, "ASKED", 40)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    share = 1 / np.arange(1, 201)
    say = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i % 900, say(int(rng.integers(1, 40)))) for i in range(1000)] + [(i, docs_text) for i in range(2000, 2020) for docs_text in ["w3 w3 w150"]]
    items = [(i, say(int(rng.integers(1, 12)))) for i in range(30)]
    assert run_search(spark, docs, items) == sorted(plain_search(docs, items))


def test_blocks_below_the_threshold_stay_packed():
    rng = np.random.default_rng(4)
    held = ranking._Building()
    texts = [" ".join(rng.choice(["common", "usual", "plain"], 30)) + (" rare gem" if i % (50 if i < 1000 else 1000) == 7 else "") for i in range(20000)]
    for i in range(0, len(texts), 5000):
        held.add(np.arange(i, i + 5000), pa.array(texts[i : i + 5000]))
    head, *rows = held.rows(0, 20000, 20000 * 30)
    norm = np.asarray(head.column("norms").flatten())
    lists, weights = [], []
    for batch in rows:
        for r in batch.to_pylist():
            lists.append(ranking._Postings(*(np.array(r[c], np.int64) for c in ("last", "most", "ends")), np.frombuffer(r["data"], np.uint8), norm))
            weights.append(1000 if r["n"] < 100 else 3)
    best = ranking._Best(10)
    ranking.block_max_wand(lists, weights, np.arange(20000), best)
    assert sum(len(p.open) for p in lists) < sum(len(p.last) for p in lists) / 4
    scores = ranking._score(lists, weights, 0, 20000)
    order = np.lexsort((np.arange(20000), -scores))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**50, 5], np.int64)
    data, ends = ranking.pack(values)
    assert ranking.unpack(data).tolist() == values.tolist() and len(data) == ends[-1]


def test_search_defined_cases(spark, odd):
    items = [(1, "WORD x9 x9"), (2, None), (3, ""), (4, "nowhere"), (5, "again"), (6, "é ÀÉ"), (7, "a" * 50000)]
    assert run_search(spark, odd, items) == sorted(plain_search(ODD, items), key=lambda r: r[:2])
    assert run_search(spark, odd.limit(0), items) == []
