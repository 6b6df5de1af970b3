"""Benchmark decontamination: SimHash over windows of an item's size, found by multi-index Hamming blocks.

An item matches a document where some window of as many words as the item has a multiplicity-weighted
Jaccard similarity of at least ``SIMILARITY`` on five-word shingles (fewer words: the whole item).
A window can only reach that if it holds at least SIMILARITY x (its shingles) item shingles, so
others are passed over without loss. The fingerprint of each window left is looked up in the eight
8-bit blocks of the items' fingerprints: within RADIUS bits, one block differs in RADIUS // 8 bits at
most, so every item within the radius is met. Exact similarity then decides.

The items travel to the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the documents a block.

Defined cases: null or empty texts and items match nothing; repeated items and documents keep their
rows; an empty table gives an empty result; extra columns are ignored. Words are what white space
(space, tab to carriage return) separates, A-Z in lower case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which a window at SIMILARITY may differ: the mean there is 64 x arccos(8/9) / pi = 9.7 with a deviation of 2.9.
RADIUS = 23
BLOCK_BYTES = 16 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word numbers."""
    h = np.zeros(max(len(ids) - size + 1, 0), np.uint64)
    for k in range(size):
        h = (h ^ ids[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _pack(ones: np.ndarray, total: int) -> np.ndarray:
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """One block of benchmark items, as tasks look them up."""

    def __init__(self, rows: list[tuple[int, str]], size: int = SHINGLE, radius: int = RADIUS):
        self.size, self.radius = size, radius
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int, int, Counter]] = []  # item_id, words, shingle counts
        held: dict[int, list[int]] = {}
        fps = []
        for item, text in rows:
            ws = words_of(text)
            if not ws:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws])
            h = _shingles(ids, min(size, len(ws)))
            held.setdefault(len(ws), []).append(len(self.items))
            self.items.append((item, len(ws), Counter(h.tolist())))
            fps.append(_pack(_bits(h).sum(0, keepdims=True), len(h))[0])
        self.fps = np.array(fps, np.uint64)
        self.by_length = held
        self.known = {k: np.unique(np.array([x for _, n, c in self.items if min(size, n) == k for x in c], np.uint64)) for k in range(1, size + 1)}
        self.blocks: dict[tuple[int, int, int], list[int]] = {}  # words, block, value: items within RADIUS // 8 bits there
        flips = [sum(1 << b for b in out) for r in range(radius // 8 + 1) for out in combinations(range(8), r)]
        for i, (_, n, _) in enumerate(self.items):
            for block in range(8):
                value = int(self.fps[i]) >> 8 * block & 255
                for f in flips:
                    self.blocks.setdefault((n, block, value ^ f), []).append(i)

    def near(self, length: int, fp: int) -> list[int]:
        """All items of ``length`` words within the radius of a fingerprint."""
        met = {i for block in range(8) for i in self.blocks.get((length, block, fp >> 8 * block & 255), ())}
        return [i for i in met if (int(self.fps[i]) ^ fp).bit_count() <= self.radius]


def matches(text: str | None, items: Items, similarity: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
    """(item_id, first word, words, similarity) of each item's best window in a text, of ties the first."""
    words = words_of(text)
    ids = np.fromiter(map(items.numbers.get, words, repeat(0)), np.int64, len(words))
    best: dict[int, tuple[float, int]] = {}
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sorted({min(items.size, n) for n in items.by_length}):
        if len(ids) < size:
            continue
        inside = np.concatenate(([0], np.cumsum(ids > 0)))
        run = inside[size:] - inside[:-size] == size
        if not run.any():
            continue
        h = _shingles(ids, size)
        some, known = h[run], items.known[size]
        run[run] = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
        if run.any():
            hits[size] = (h, np.concatenate(([0], np.cumsum(run))))
    for n, members in items.by_length.items():
        size = min(items.size, n)
        if size not in hits or len(ids) < n:
            continue
        h, held = hits[size]
        m = n - size + 1
        if held[-1] < similarity * m - 1e-9:
            continue
        starts = np.flatnonzero(held[m:] - held[:-m] >= np.ceil(similarity * m - 1e-9))
        if not len(starts):
            continue
        lo, hi = int(starts[0]), int(starts[-1]) + m
        if hi - lo > 4 * len(starts) + 4 * m:  # windows far apart: each by itself
            fps = np.concatenate([_pack(_bits(h[s : s + m]).sum(0, keepdims=True), m) for s in starts])
        else:
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(h[lo:hi]), axis=0)))
            fps = _pack(sums[starts - lo + m] - sums[starts - lo], m)
        for s, fp in zip(starts.tolist(), fps.tolist()):
            found = items.near(n, fp)
            if found:
                window = Counter(h[s : s + m].tolist())
                for i in found:
                    common = (window & items.items[i][2]).total()
                    sim = common / (2 * m - common)
                    if sim >= similarity and sim > best.get(i, (0.0, 0))[0]:
                        best[i] = (sim, s)
    return [(items.items[i][0], s, items.items[i][1], sim) for i, (sim, s) in sorted(best.items())]


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    for k in range(n):
        yield [tuple(r) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, matches): the items that each document holds; documents without any are absent."""
    out = []
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<item_id:long,first_word:long,words:long,similarity:double>>"
    for rows in _item_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(Items(rows))

        def each(batches, sent=sent):
            for batch in batches:
                found = [matches(t, sent.value, similarity) for t in batch.column("text").to_pylist()]
                at = [i for i, f in enumerate(found) if f]
                value = pa.array([[dict(zip(("item_id", "first_word", "words", "similarity"), m)) for m in found[i]] for i in at], pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), value], ["doc_id", "matches"])

        out.append(slim.mapInArrow(each, f"doc_id long, matches {kind}"))
    every = reduce(DataFrame.unionByName, out)
    return every if len(out) == 1 else every.groupBy("doc_id").agg(F.flatten(F.collect_list("matches")).alias("matches"))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row a document and benchmark item that it holds: where its best window is and how similar."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item, decided where each text is read."""
    def free_of(sent):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not matches(t, sent.value) for t in texts], dtype=bool)

        return clean(F.col("text").cast("string"))

    for rows in _item_blocks(benchmark, BLOCK_BYTES):
        docs = docs.where(free_of(docs.sparkSession.sparkContext.broadcast(Items(rows))))
    return docs
