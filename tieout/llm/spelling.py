"""Spelling variants by a positional q-gram index under a count filter.

A word of L letters has L + 2 grams of three letters, two pads before and behind counted in. One edit
spoils at most three of them, so words that are one edit apart share max(L) - 1 grams at places that
differ by no more than the edit's shift. Each word is posted under its four rarest grams, of which at
least one is unspoilt in both words, with its length and the gram's place: a list holds only words that
length and position limits let meet. Tasks merge the lists, count the grams that pairs share, keep
pairs at the bound or above it, and verify those letter by letter.

The lists of a whole partition are merged at once by sorting, where a heap would take them one row at a
time; the pairs are the same. Lists of more than TILE words are compared block by block, in several tasks.

Defined cases: null or empty texts have no words; a null doc_id reads as empty text before the colon;
repeated rows count each; equal partners take the first in code-point order; an empty table gives an
empty result; extra columns are ignored. Words may be of any length and any letters; words of one letter
have no variants.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_run, cut, discard, longs

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters of a word at least, its occurrences at least, and how many times as frequent its form is.
LETTERS = 5
OCCURRENCES = 3
RATIO = 2
#: One run in so many loses a letter.
SLIP = 97
#: Rarest grams that a word is posted under: one more than an edit spoils.
PREFIX = 4
#: Words of one list that are compared in one piece, and pairs compared at a time.
TILE = 4096
PAIRS = 1 << 18
#: Grams whose frequency is told to all tasks (others count as rare), and words that a task counts before it passes them on.
COMMON = 65536
HELD = 400_000
#: Stands before and behind a word; no code point.
PAD = 0x1FFFFF


def slipped(run: str, prefix: int) -> str:
    """``run``, without one letter where its CRC, after that of what stands before it, says so."""
    h = zlib.crc32(run.encode("utf-8"), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of all texts and their occurrences; each task adds up before the shuffle."""

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), longs(list(counts.values()))], ["word", "n"])

    def each(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{doc}:".encode())
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
                for run, n in Counter(RUN.findall(lower)).items():
                    word = slipped(run, prefix)
                    if len(word) >= LETTERS:
                        held[word] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    text = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return text.where("text <> ''").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words with two pads at both ends, where each word's begin and, last, where they end)."""
    strings = words.to_pylist()
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 4
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.full(ends[-1], PAD, np.int64)
    inner = np.ones(ends[-1], bool)
    for k in (0, 1):
        inner[ends[:-1] + k] = False
        inner[ends[1:] - 1 - k] = False
    flat[inner] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, ends


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, word's number, gram's place, word's length) of all grams, words in order."""
    flat, ends = _letters(words)
    sizes = np.diff(ends) - 2
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = ends[word] + place
    return (flat[at] << 42) | (flat[at + 1] << 21) | flat[at + 2], word, place, sizes[word] - 2


def _common_grams(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams (sorted), and how often each occurs. They only set the order of grams, thus the cost."""

    def each(batches):
        for batch in batches:
            gram, n = np.unique(_grams(batch.column("word"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(gram), longs(n)], ["gram", "n"])

    counts = words.select("word").mapInArrow(each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "gram").limit(COMMON).toPandas().sort_values("gram")
    return top["gram"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def postings(words: DataFrame) -> DataFrame:
    """(key, longer, id, word): each word under its rarest grams.

    A list's key is (gram, length L, place). Words of L letters stand in it with ``longer`` 0; those of
    L + 1 letters with 1, whose gram is at the same place or, past the letter they have more, at the next.
    """
    common, often = _common_grams(words)

    def each(batches):
        for batch in batches:
            gram, word, place, size = _grams(batch.column("word"))
            rank = np.zeros(len(gram), np.int64)
            if len(common) and len(gram):
                at = np.minimum(np.searchsorted(common, gram), len(common) - 1)
                rank = np.where(common[at] == gram, often[at], 0)
            order = np.lexsort((place, gram, rank, word))
            first = np.searchsorted(word, np.arange(batch.num_rows))
            order = order[np.arange(len(order)) - first[word] < PREFIX]  # words stay in order, so ``word`` fits the sorted rows too
            g, w, p, s = gram[order].view(np.uint64), word[order], place[order], size[order]
            keys, longer, who = [], [], []
            for more, back in ((0, 0), (1, 0), (1, 1)):
                # wraps around; lists whose keys fall together only bring more pairs to verify
                mixed = g * np.uint64(0x9E3779B97F4A7C15) ^ (s - more).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (p - back).view(np.uint64) * np.uint64(0x165667B19E3779F9)
                keys.append(mixed.view(np.int64))
                longer.append(np.full(len(w), more, np.int8))
                who.append(w)
            take = pa.array(np.concatenate(who))
            yield pa.RecordBatch.from_arrays([longs(np.concatenate(keys)), pa.array(np.concatenate(longer)), batch.column("id").take(take), batch.column("word").take(take)], ["key", "longer", "id", "word"])

    return words.select("id", "word").mapInArrow(each, "key long, longer byte, id long, word string")


def _compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b``, letters with pads, ``b`` as long or one longer, are one edit apart."""
    shift = b.shape[1] - a.shape[1]
    same = a == b[:, : a.shape[1]]
    grams = same[:, :-2] & same[:, 1:-1] & same[:, 2:]
    if shift:
        after = a == b[:, 1:]
        grams |= after[:, :-2] & after[:, 1:-1] & after[:, 2:]
    ok = grams.sum(axis=1) >= b.shape[1] - 4 - 1  # the count filter: the longer word's letters less one
    left = np.flatnonzero(ok)
    if not shift:
        ok[left] = same[left].sum(axis=1) == a.shape[1] - 1
        return ok
    head = np.logical_and.accumulate(same[left, 2:-2], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate(after[left, 2:-2][:, ::-1], axis=1).sum(axis=1)
    ok[left] = head + tail >= a.shape[1] - 4
    return ok


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``table``, whole lists, that are one edit apart, the shorter or first one before the other."""
    flat, ends = _letters(table.column("word").combine_chunks())
    codes = np.minimum(flat, 255).astype(np.uint8) if flat[flat != PAD].max(initial=0) < 255 else flat.astype(np.uint32)
    longer, sizes = table.column("longer").to_numpy(), np.diff(ends)
    # lists of words of one length together; lists of several lengths, whose keys fell together, come apart
    order = np.argsort(sizes - longer, kind="stable")
    longer, sizes, starts = longer[order], sizes[order], ends[order]
    key, i, j, part = (table.column(k).to_numpy()[order] for k in ("key", "i", "j", "part"))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in (sizes - longer, key, i, j)], axis=0)
    stop = np.append(np.flatnonzero(new), len(new))[np.cumsum(new)]  # where each row's list ends
    # rows of a list are sorted by ``longer``: a row meets those after it, unless it is a longer one itself
    meets = np.where(longer == 0, stop - np.arange(len(stop)) - 1, 0)
    whole = np.concatenate(([0], np.cumsum(meets)))
    left, right, begin = [], [], 0
    while begin < len(meets):
        end = max(begin + 1, int(np.searchsorted(whole, whole[begin] + PAIRS, "right")) - 1)
        n = meets[begin:end]
        a = np.repeat(np.arange(begin, end), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(whole[begin:end] - whole[begin], n)
        begin = end
        met = (i[a] == j[a]) | (part[a] != part[b])  # of a list in blocks, pairs within a block are left to the piece of that block alone
        a, b = a[met], b[met]
        for size in np.unique(sizes[a]).tolist():
            for more in (0, 1):
                rows = np.flatnonzero((sizes[a] == size) & (longer[b] == more))
                for k in range(0, len(rows), step := max(1, PAIRS * 16 // size)):
                    x, y = a[rows[k : k + step]], b[rows[k : k + step]]
                    ok = _compare(sliding_window_view(codes, size)[starts[x]], sliding_window_view(codes, size + more)[starts[y]])
                    left.append(order[x[ok]])
                    right.append(order[y[ok]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): ids of all pairs of ``words`` (id, word), distinct words, that are one edit apart, each once."""
    lists = cut(postings(words), "postings")
    sizes = lists.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    rows = lists.join(sizes, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "longer", "id", "word")

    def each(batches):
        for table in by_run(batches, ["key", "i", "j"]):
            a, b = _merge(table)
            who = table.column("id").to_numpy()
            pairs = np.unique(np.column_stack((np.minimum(who[a], who[b]), np.maximum(who[a], who[b]))), axis=0)
            yield pa.RecordBatch.from_arrays([longs(pairs[:, 0]), longs(pairs[:, 1])], ["a", "b"])

    found = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "longer").mapInArrow(each, "a long, b long")
    out = cut(found.distinct(), "pairs")
    discard(lists)
    return out


def _last(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms`` (id, up): the end of each chain. A step at least doubles a count, so chains are short; each round halves them."""
    state = cut(forms, "forms")
    while True:
        up = state.select(F.col("id").alias("up"), F.col("up").alias("further"))
        new = cut(state.join(up, "up", "left").select("id", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "forms")
        moved = new.where("moved").limit(1).count()
        discard(state)
        state = new.drop("moved")
        if not moved:
            return state.withColumnRenamed("up", "root")


def variant_groups(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``counts`` (word, n), distinct words.

    ``form`` is the most frequent word one edit away, if it occurs ``ratio`` times as often at least; ``root`` follows forms to the last.
    """
    # ids follow (falling n, word), so the best of some words is the one of the smallest id
    words = cut(counts.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("b").alias("best"))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = words.join(near, "id", "left").join(best, "best", "left")
    fits = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    known = cut(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(fits, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "known")
    roots = _last(known.where("best is not null").select("id", F.col("best").alias("up")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("end")), "root").select("id", "end")
    return known.join(named, "id", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` with the words they are variants of."""
    counts = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return variant_groups(counts.where(F.col("n") >= OCCURRENCES))


#: CRCs byte by byte, and words that are one edit apart by what is left of them without a letter.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY doc_id, run),
coded AS (SELECT run, times, hex(encode(doc_id || ':' || run)) AS code FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(code), 2), lambda i: CAST('0x' || substr(code, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS best_n FROM pairs JOIN words w ON w.word = b GROUP BY a),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
chains AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""
