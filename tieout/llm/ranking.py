"""Ranked lexical search by Block-Max WAND over posting blocks.

Each task turns the documents it reads into segments of bounded size: a row a term with its postings in
blocks of BLOCK, packed as byte-sized varints, and each block's last document and largest impact left
unpacked. An impact depends on a term's count in a document and on the document's length, and is exact,
so a block's largest impact times the term's weight bounds what the term adds to any document of the block.

A query meets a segment in order of documents: its pivot is the next document where the blocks' largest
impacts together reach the threshold, the score of its tenth best so far, and block pointers move to the
pivot without unpacking what they pass. Only blocks at pivots are unpacked and scored. Thresholds go on
from segment to segment within a task; tasks' best are merged by rank.

Defined cases: null or empty texts have no terms and are in no result; items without a term that occurs
have no row; repeated documents rank each, equal scores by doc_id, a null doc_id last; repeated items have
rows each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_run, cut, discard, longs

BLOCK = 128
TOP = 10
#: Bytes of text in a segment, and of what is split into terms at a time.
SEGMENT = 12 << 20
SLICE = 2 << 20
#: Term rows of the queries that are asked together, and up to which they are broadcast.
ASKED = 1 << 16
BROADCAST = 1 << 19
#: Documents of a stretch that is scored in one go: at first few, so that thresholds rise early, then twice as many each time.
STRETCH = (512, 8192)
#: Stands for a null doc_id: no document ranks behind it.
NO_ID = (1 << 63) - 1
NONE = np.zeros(0, np.int64)

_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, term) of each term of ``texts``, in order: maximal runs of letters, digits and all beyond ASCII, only A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low = _FOLD[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(low)]
    begins[firsts] = inside[firsts]
    at = np.flatnonzero(begins)
    places = np.append(np.cumsum(inside, dtype=np.int64)[at] - 1, np.count_nonzero(inside))
    out = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    return np.searchsorted(offsets, at, "right") - 1, out


def _slices(texts: pa.Array):
    """(begin, end) of runs of ``texts`` of about SLICE bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
        yield begin, end
        begin = end


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value begins and, last, where all end): seven bits a byte, the top bit set on all but a value's last byte."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >> (7 * k) > 0
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(ends[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[ends[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """Values that :func:`pack` wrote."""
    last = data < 128
    low = (data & 127).astype(np.int64)
    if last.all():
        return low
    begins = np.flatnonzero(np.concatenate(([True], last[:-1])))
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    return np.add.reduceat(low << (7 * place), begins)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 8 * norm)


def norms(lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A document's length against the mean one, in hundredths, three quarters of it counted."""
    if int(lengths.max(initial=0)) * 75 * docs >= 1 << 63:
        return np.array([25 + 75 * int(n) * docs // total for n in lengths], np.int64)
    return 25 + (75 * lengths * docs) // total


INDEX = "seg long, term binary, n long, last array<int>, most array<long>, ends array<int>, data binary, ids array<long>, norms array<long>"


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _segment(seg: int, ids: np.ndarray, norm: np.ndarray, vocabulary: pa.Array, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> list[pa.RecordBatch]:
    """Rows of one segment: its documents (term empty), and each term's postings. ``term``, ``doc``, ``tf``: postings sorted by term, then document."""
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    counts = np.diff(np.append(starts, len(term)))
    place = np.arange(len(term)) - np.repeat(starts, counts)
    heads = np.flatnonzero(place % BLOCK == 0)
    sizes = np.diff(np.append(heads, len(term)))
    blocks = (counts + BLOCK - 1) // BLOCK
    most = np.maximum.reduceat(impact(tf, norm[doc]), heads)
    last = doc[heads + sizes - 1]
    gap = doc.copy()
    gap[1:] -= doc[:-1]
    gap[starts] = doc[starts] + 1
    # within a block all gaps, then all counts
    block = np.repeat(np.arange(len(heads)), sizes)
    to = np.arange(len(term)) + heads[block]
    stream = np.zeros(2 * len(term), np.int64)
    stream[to] = gap - 1
    stream[to + sizes[block]] = tf - 1
    data, ends = pack(stream)
    stops = ends[2 * (heads + sizes)]
    begin = ends[2 * starts]
    inner = stops - np.repeat(begin, blocks)
    per = np.concatenate(([0], np.cumsum(blocks)))
    none, names = len(starts), [f.split()[0] for f in INDEX.split(", ")]
    table = [
        longs(np.full(none, seg)), vocabulary.cast(pa.binary()), longs(counts), _lists(last, per, pa.int32()), _lists(most, per, pa.int64()), _lists(inner, per, pa.int32()),
        pa.Array.from_buffers(pa.large_binary(), none, [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()),
        pa.nulls(none, pa.list_(pa.int64())), pa.nulls(none, pa.list_(pa.int64())),
    ]
    whole = pa.RecordBatch.from_arrays(table, names)
    one = np.array([0, len(ids)])
    table = [longs([seg]), pa.array([b""], pa.binary()), longs([0]), *(pa.nulls(1, t) for t in (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())), _lists(ids, one, pa.int64()), _lists(norm, one, pa.int64())]
    step = 20_000
    return [pa.RecordBatch.from_arrays(table, names), *(whole.slice(i, step) for i in range(0, none, step))]


class _Building:
    """Postings of the segment that a task is at."""

    def __init__(self) -> None:
        self.bytes = self.docs = 0
        self.ids, self.sizes, self.words, self.term, self.doc, self.tf = [], [], [], [], [], []

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        owner, found = terms(texts)
        coded = found.dictionary_encode()
        lengths = np.bincount(owner, minlength=len(texts))
        held = np.cumsum(lengths > 0) - 1  # documents without a term are left out
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(texts)) + held[owner], return_counts=True)
        self.words.append(coded.dictionary)
        self.term.append(key // max(1, len(texts)))
        self.doc.append(key % max(1, len(texts)) + self.docs)
        self.tf.append(tf)
        self.ids.append(ids[lengths > 0])
        self.sizes.append(lengths[lengths > 0])
        self.docs += int((lengths > 0).sum())
        self.bytes += texts.nbytes

    def rows(self, seg: int, docs: int, total: int) -> list[pa.RecordBatch]:
        if not self.docs:
            return []
        coded = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        to = coded.indices.to_numpy()
        bases = np.cumsum([0, *map(len, self.words)])
        term = np.concatenate([to[t + b] for t, b in zip(self.term, bases)])
        order = np.argsort(term, kind="stable")  # documents of a term come in order already
        return _segment(seg, np.concatenate(self.ids), norms(np.concatenate(self.sizes), docs, total), coded.dictionary, term[order], np.concatenate(self.doc)[order], np.concatenate(self.tf)[order])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all of them)."""

    def each(batches):
        n = total = 0
        for batch in batches:
            texts = batch.column("text")
            for i, j in _slices(texts):
                found = np.bincount(terms(texts.slice(i, j - i))[0])
                n, total = n + np.count_nonzero(found), total + int(found.sum())
        yield pa.RecordBatch.from_arrays([longs([n]), longs([total])], ["docs", "total"])

    n, total = docs.select(F.col("text").cast("string")).mapInArrow(each, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return n or 0, total or 0


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """(index of all ``docs``, documents with a term). The index is a written table of segments; documents aren't shuffled."""
    n, total = corpus_size(docs)

    def each(batches):
        part, number, held = TaskContext.get().partitionId(), 0, _Building()
        for batch in batches:
            texts, ids = batch.column("text"), pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            for i, j in _slices(texts):
                held.add(ids[i:j], texts.slice(i, j - i))
                if held.bytes >= SEGMENT:
                    yield from held.rows((part << 24) + number, n, total)
                    number, held = number + 1, _Building()
        yield from held.rows((part << 24) + number, n, total)

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(table.mapInArrow(each, INDEX), "index"), n


def _asked(queries: DataFrame) -> DataFrame:
    """(item, term, times) of ``queries`` (item, text)."""

    def each(batches):
        for batch in batches:
            owner, found = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), found.cast(pa.binary())], ["item", "term"])

    rows = queries.select("item", F.col("text").cast("string").alias("text")).mapInArrow(each, "item long, term binary")
    return rows.groupBy("item", "term").agg(F.count("*").alias("times"))


class _Postings:
    """A term's blocks in a segment; a block is unpacked when a query first needs it, and kept for the next."""

    def __init__(self, last, most, ends, data, norm) -> None:
        self.last, self.most, self.ends, self.data, self.norm = last, most, np.concatenate(([0], ends)), data, norm
        self.first = np.concatenate(([0], last[:-1] + 1))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of block ``b``."""
        if b not in self.open:
            values = unpack(self.data[self.ends[b] : self.ends[b + 1]])
            half = len(values) // 2
            docs = np.cumsum(values[:half] + 1) + (self.last[b - 1] if b else -1)
            self.open[b] = docs, impact(values[half:] + 1, self.norm[docs])
            if len(self.open) == len(self.last):
                self.whole = tuple(np.concatenate([self.open[i][k] for i in range(len(self.last))]) for k in (0, 1))
        return self.open[b]

    def between(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) from ``begin`` to ``end``, end not included."""
        blocks = () if self.whole else range(int(self.last.searchsorted(begin)), int(self.first.searchsorted(end)))
        parts = [self.block(b) for b in blocks]
        docs, impacts = self.whole or (parts[0] if len(parts) == 1 else [np.concatenate([np.zeros(0, np.int64), *p]) for p in zip(*parts)] or (NONE, NONE))
        i, j = docs.searchsorted((begin, end))
        return docs[i:j], impacts[i:j]


class _Best:
    """The best documents of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """Score that a document needs to be looked at; one of equal score may win by its doc_id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            good = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[good], ids[good]
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _score(lists: list[_Postings], weights: list[int], begin: int, end: int) -> np.ndarray:
    """Scores of the documents from ``begin`` to ``end``, end not included."""
    out = np.zeros(end - begin, np.int64)
    for postings, weight in zip(lists, weights):
        docs, impacts = postings.between(begin, end)
        out[docs - begin] += weight * impacts
    return out


def _joined(lists: list[_Postings], weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of lists of one block, unpacked and added up."""
    if not lists:
        return NONE, NONE
    docs = np.concatenate([p.block(0)[0] for p in lists])
    scores = np.concatenate([w * p.block(0)[1] for p, w in zip(lists, weights)])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    return docs[first], np.add.reduceat(scores, first)


def block_max_wand(lists: list[_Postings], weights: list[int], ids: np.ndarray, best: _Best) -> None:
    """Offer ``best`` all documents of a segment that may be among the best for terms of ``lists``.

    Blocks' borders cut the documents into stretches, in each of which the same blocks lie; the running sum
    of their largest impacts bounds every document there. The pivot is the first document whose bound
    reaches the threshold: pointers move there past all blocks before it, packed as they are. Lists of one
    block are unpacked first, and stand at their documents.
    """
    rare, common = ([(p, w) for p, w in zip(lists, weights) if (len(p.last) == 1) == one] for one in (True, False))
    docs, scores = _joined([p for p, _ in rare], [w for _, w in rare])
    lists, weights = [p for p, _ in common], [w for _, w in common]
    most = np.concatenate([scores, *(p.most * w for p, w in common)])
    borders = np.concatenate([docs, *(p.first for p in lists), docs + 1, *(p.last + 1 for p in lists)])
    order = np.argsort(borders, kind="stable")
    borders, bound = borders[order], np.cumsum(np.concatenate((most, -most))[order])
    ends = np.flatnonzero(np.append(borders[1:] != borders[:-1], True))
    borders, bound = borders[ends], bound[ends]
    at, room = 0, STRETCH[0]
    while at < len(borders):
        open_ = np.flatnonzero(bound[at:] >= best.least) + at
        if not len(open_):
            break
        # stretches that follow each other and are open are scored in one go
        run = int(np.argmax(np.append(open_[1:] != open_[:-1] + 1, True))) + 1
        run = max(1, min(run, int(borders[open_[:run]].searchsorted(borders[open_[0]] + room))))
        begin, at = int(borders[open_[0]]), int(open_[run - 1]) + 1
        end = int(borders[at])
        found = _score(lists, weights, begin, end)
        i, j = docs.searchsorted((begin, end))
        found[docs[i:j] - begin] += scores[i:j]
        room = min(2 * room, STRETCH[1])
        good = np.flatnonzero(found >= best.least)
        if len(good):
            best.offer(found[good], ids[begin + good])


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each of ``queries`` (item long and distinct, text)."""
    asked = cut(_asked(queries), "asked")
    size = asked.count()
    blocks = -(-size // ASKED) or 1
    postings = index.where("term <> x''")
    frequency = postings.join(_small(asked.select("term").distinct(), size), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(frequency, "term").select("item", "term", (weight * F.col("times")).alias("weight")).where("weight > 0")
    weighted = weighted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    wanted = cut(weighted.groupBy("block", "term").agg(F.collect_list(F.struct("item", "weight")).alias("asks")), "wanted")
    none = F.expr("cast(array() as array<struct<item bigint, weight bigint>>)")
    columns = [f.split()[0] for f in INDEX.split(", ")]
    rows = postings.join(_small(wanted, size), "term").select(*columns, "block", "asks")
    segments = index.where("term = x''").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*columns, F.col("block").cast("int").alias("block"), none.alias("asks"))

    def each(batches):
        now, best = None, {}

        def told():
            kept = [(i, b) for i, b in best.items() if len(b.ids)]
            if kept:
                item = np.repeat([i for i, _ in kept], [len(b.ids) for _, b in kept])
                yield pa.RecordBatch.from_arrays([longs(item), longs(np.concatenate([b.ids for _, b in kept])), longs(np.concatenate([b.scores for _, b in kept]))], ["item", "doc_id", "score"])

        for table in _segments(batches):
            if table.column("block")[0].as_py() != now:
                yield from told()
                now, best = table.column("block")[0].as_py(), {}
            _ask(table, best, k)
        yield from told()

    dealt = rows.unionByName(segments).repartition("block", "seg").sortWithinPartitions("block", "seg", "term")
    found = cut(dealt.mapInArrow(each, "item long, doc_id long, score long"), "found")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, to be broadcast if it comes from few rows; else Spark joins by shuffle."""
    return F.broadcast(table) if rows <= BROADCAST else table


def _segments(batches):
    """Tables of whole segments, one each."""
    for table in by_run(batches, ["block", "seg"]):
        block, seg = table.column("block").to_numpy(), table.column("seg").to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (seg[1:] != seg[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(seg)]):
            yield table.slice(i, j - i)


def _ask(table: pa.Table, best: dict[int, _Best], k: int) -> None:
    """Run all queries that ask for a term of this segment; its first row is the documents'."""
    head = table.slice(0, 1)
    ids, norm = (np.asarray(head.column(c).combine_chunks().flatten()) for c in ("ids", "norms"))
    by_item: dict[int, list[tuple[_Postings, int]]] = {}
    for i in range(1, table.num_rows):
        values = {c: table.column(c)[i] for c in ("last", "most", "ends", "data", "asks")}
        last, most, ends = (np.asarray(values[c].values).astype(np.int64) for c in ("last", "most", "ends"))
        postings = _Postings(last, most, ends, np.frombuffer(values["data"].as_buffer(), np.uint8), norm)
        for ask in values["asks"].as_py():
            by_item.setdefault(ask["item"], []).append((postings, ask["weight"]))
    for item, pairs in by_item.items():
        block_max_wand([p for p, _ in pairs], [w for _, w in pairs], ids, best.setdefault(item, _Best(k)))


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each ``benchmark`` item."""
    index, n = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    items = cut(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    found = cut(search(index, n, items.select("item", "text")), "ranked")
    discard(index)
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: Every document's score for every item.
ORACLE = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents, letters),
counts AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
scaled AS (SELECT doc_id, 25 + (75 * n * n_docs) // total AS m FROM lengths, corpus),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY term, n_docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark, letters),
times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM times JOIN weights USING (term) JOIN counts USING (term) JOIN scaled USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
