"""SentencePiece encoding and decoding by a relational lattice.

The distinct words of the corpus are counted; those of at least the count that lets ``DICTIONARY``
words through are encoded relationally: their substrings (bounded by the longest piece) are exploded
and equi-joined to the piece table, the edges found are grouped by word, and one Spark ``aggregate``
folds each word's lattice. For a unigram model the fold is Viterbi over the piece scores. The public
model here is BPE, for which the best-scoring path is not what the model means (its scores are merge
ranks), so for BPE the fold takes, step by step, the best edge that spans two neighbouring segments;
ids then equal the sentencepiece library's. The bounded dictionary goes to the tasks, which look
words up and run the same fold on the rare rest. Nothing but words is shuffled.

A word is a run of spaces and what follows up to the next space; no piece crosses that border (checked
when the table is read). Characters without a piece become byte pieces.

Defined cases: null or empty text gives no ids and decodes to an empty text; repeated rows keep a row
each; an empty table gives an empty result; extra columns are ignored by ``encode``. U+2581 in a text
is a space to the model and decodes as one.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
#: Words that the tasks get ready encoded, at most; about 10 MB.
DICTIONARY = 1 << 17
#: Longer words are folded where they occur.
WORD_CHARS = 32
#: Words that a task remembers beside the dictionary.
MEMO = 200_000
SPACE = "▁"


@dataclass
class Pieces:
    """A model's piece table: normal pieces with scores, byte pieces, and the kind of fold."""

    scores: dict[str, tuple[float, int]]
    byte_ids: list[int]
    kind: str = "bpe"
    unknown: int = 0
    longest: int = 0
    loose: str = field(default="", repr=False)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, byte_ids = {}, [m.unk_id()] * 256
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                scores[p] = (m.get_score(i), i)
        return cls(scores, byte_ids, "bpe", m.unk_id()).checked()

    def checked(self) -> Pieces:
        crossing = [p for p in self.scores if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        self.longest = max(map(len, self.scores), default=1)
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        self.loose = "".join(c for c in "\n\t\r\v\f" if c not in joined)  # such a character is always a segment of its own
        return self

    def pattern(self) -> str:
        stop = SPACE + self.loose
        return f"[{re.escape(self.loose)}]|{SPACE}*[^{stop}]+|{SPACE}+" if self.loose else f"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def segment_ids(self, segment: str) -> list[int]:
        known = self.scores.get(segment)
        return [known[1]] if known else [self.byte_ids[b] for b in segment.encode("utf-8", "surrogatepass")]

    def decode_table(self) -> list[bytes]:
        size = 1 + max([*self.byte_ids, *(i for _, i in self.scores.values())])
        table = [b""] * size
        for b, i in enumerate(self.byte_ids):
            table[i] = bytes([b])
        for p, (_, i) in self.scores.items():
            table[i] = p.replace(SPACE, " ").encode()
        return table


def fold_word(word: str, pieces: Pieces) -> list[int]:
    """The ids of one word: for BPE merge the best neighbouring pair, of ties the first, until none is a piece."""
    if pieces.kind == "unigram":
        return _viterbi(word, pieces)
    known, n = pieces.scores, len(word)
    if word in known and n < 2:
        return [known[word][1]]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the segment that starts here: its end, the one before
    heap = []
    for s in range(n - 1):
        hit = known.get(word[s : s + 2])
        if hit:
            heap.append((-hit[0], s, s + 1, s + 2))
    heapq.heapify(heap)
    while heap:
        _, s, mid, e = heapq.heappop(heap)
        if end[s] != mid or (mid < n and end[mid] != e):
            continue
        end[s], end[mid] = e, -1
        if e < n:
            before[e] = s
            hit = known.get(word[s : end[e]])
            if hit:
                heapq.heappush(heap, (-hit[0], s, e, end[e]))
        b = before[s]
        if b >= 0:
            hit = known.get(word[b:e])
            if hit:
                heapq.heappush(heap, (-hit[0], b, s, e))
    out, s = [], 0
    while s < n:
        out += pieces.segment_ids(word[s : end[s]])
        s = end[s]
    return out


def _viterbi(word: str, pieces: Pieces) -> list[int]:
    low = min((s for s, _ in pieces.scores.values()), default=0.0) - 10.0
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + pieces.scores[word[s:e]][0], s) for s in range(max(0, e - pieces.longest), e) if word[s:e] in pieces.scores]
        if word[e - 1 : e] not in pieces.scores:
            options.append((best[e - 1][0] + low, e - 1))
        best.append(max(options, key=lambda o: (o[0], o[1])))
    cuts, e = [], len(word)
    while e:
        cuts.append((best[e][1], e))
        e = best[e][1]
    return [i for s, e in reversed(cuts) for i in pieces.segment_ids(word[s:e])]


def word_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n) over the whole corpus; each task adds its own words up before the shuffle."""
    text = F.concat(F.lit(SPACE), F.replace(F.col("text").cast("string"), F.lit(" "), F.lit(SPACE)))
    words = F.regexp_extract_all(text, F.lit(pieces.pattern().replace("\\\n", "\\n").replace("\\\t", "\\t")), F.lit(0))
    return docs.where("text <> ''").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Words of at least the count that at most ``limit`` words reach, by a histogram of at most 1,000 steps."""
    step = F.floor(F.log2("n") * 16)
    total, at_least = 0, 0
    for k, n in sorted(counts.groupBy(step.alias("k")).count().collect(), reverse=True):
        if total + n > limit:
            at_least = k + 1
            break
        total += n
    return counts.where(step >= at_least)


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges): every piece that a word holds, as edges from character to character."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (s, i) in pieces.scores.items()], "piece string, id int, score double")
    n = F.char_length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - s + 1)), lambda k: F.struct((s - 1).alias("s"), (s + k - 1).alias("e"), F.substr(F.col("word"), s, k).alias("piece")))))
    edges = words.select("word", F.explode(spans).alias("x")).select("word", "x.s", "x.e", "x.piece")
    found = edges.join(F.broadcast(table), "piece", "left")  # the piece table is the model's, of fixed size
    edge = F.when(F.col("id").isNotNull(), F.struct("s", "e", "score", "id"))
    return found.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _merge_fold(edges: Column, n: Column) -> Column:
    """Segment borders of a word (of at most 62 characters) after all merges; the folded state is a bit a border."""
    edge = lambda e: F.struct((-e.score).alias("o"), e.s.alias("s"), _bit(e.s).bitwiseOR(_bit(e.e)).alias("ends"), (_bit(e.e) - _bit(e.s + 1)).alias("inner"))
    ranked = F.array_sort(F.transform(F.filter(edges, lambda e: e.e > e.s + 1), edge))

    def step(state, _):
        fits = lambda e: (state.borders.bitwiseAND(e.ends) == e.ends) & (F.bit_count(state.borders.bitwiseAND(e.inner)) == 1)
        best = F.get(F.filter(state.ranked, fits), F.lit(0))
        borders = F.coalesce(state.borders - state.borders.bitwiseAND(best["inner"]), state.borders)
        return F.struct(borders.alias("borders"), state.ranked.alias("ranked"))

    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    first = F.struct((_bit(n + 1) - 1).alias("borders"), ranked.alias("ranked"))
    return F.aggregate(steps, first, step, lambda state: F.filter(F.sequence(F.lit(0), n), lambda b: state.borders.bitwiseAND(_bit(b)) != 0))


def _viterbi_fold(edges: Column, n: Column, low: float) -> Column:
    """Segment borders of a word's best-scoring path: best[e] = (score, start) for each end, then traced back."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

    def step(best, e):
        into = F.transform(F.filter(edges, lambda x: x.e == e), lambda x: F.struct((x.score + F.element_at(best, x.s + 1)["score"]).alias("score"), x.s.alias("s")))
        alone = F.array(F.struct((F.lit(low) + F.element_at(best, e)["score"]).alias("score"), (e - 1).alias("s")))
        short = F.exists(edges, lambda x: (x.e == e) & (x.s == e - 1))
        return F.array_append(best, F.array_max(F.when(short, into).otherwise(F.concat(into, alone))))

    best = F.aggregate(F.sequence(F.lit(1), n), first, step)
    back = F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda cuts, _: F.when(F.element_at(cuts, 1) > 0, F.concat(F.array(F.element_at(best, F.element_at(cuts, 1) + 1)["s"]), cuts)).otherwise(cuts))
    return back


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words by the relational lattice and one fold a word."""
    n = F.char_length("word")
    low = min((s for s, _ in pieces.scores.values()), default=0.0) - 10.0
    borders = _merge_fold(F.col("edges"), n) if pieces.kind == "bpe" else _viterbi_fold(F.col("edges"), n, low)
    cutup = lattice(words, pieces).select("word", "edges", borders.alias("borders"))
    starts = F.slice("borders", F.lit(1), F.size("borders") - 1)
    spans = F.transform(starts, lambda s, k: F.struct(s.alias("s"), F.element_at("borders", k + 2).alias("e")))
    byte_ids = F.array(*map(F.lit, pieces.byte_ids))

    def ids(span):
        known = F.filter("edges", lambda e: (e.s == span.s) & (e.e == span.e))
        code = F.hex(F.encode(F.substr(F.col("word"), span.s + 1, span.e - span.s), "utf-8"))
        raw = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.element_at(byte_ids, F.conv(F.substr(code, k, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(F.size(known) > 0, F.array(F.element_at(known, 1)["id"])).otherwise(raw)

    return cutup.select("word", F.flatten(F.transform(spans, ids)).alias("ids"))


def dictionary(docs: DataFrame, pieces: Pieces, limit: int = DICTIONARY) -> dict[str, bytes]:
    """Encoded frequent words, at most ``limit``, as little-endian 32-bit ids."""
    counts = word_counts(docs, pieces).where(F.char_length("word") <= WORD_CHARS)
    from .common import cut, discard

    counts = cut(counts, "words")
    rows = encode_words(frequent(counts, limit).select("word"), pieces).toArrow()  # at most ``limit`` rows
    discard(counts)
    return {w: np.asarray(i, "<i4").tobytes() for w, i in zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist())}


def encode(docs: DataFrame, model: str | Pieces | None = None, limit: int = DICTIONARY, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids (null unless asked for) and ``decoded``: the text that the ids give back."""
    pieces = model if isinstance(model, Pieces) else Pieces.load(model or public_tokenizers.path(MODEL))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((pieces, dictionary(docs, pieces, limit)))
    pattern = pieces.pattern()

    def each(batches):
        table, words = sent.value
        find, memo, back = re.compile(pattern).findall, {}, table.decode_table()

        def ids_of(word: str) -> bytes:
            known = words.get(word)
            if known is None:
                known = memo.get(word)
                if known is None:
                    known = np.asarray(fold_word(word, table), "<i4").tobytes()
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = known
            return known

        for batch in batches:
            n, crc, ids, texts = [], [], [], []
            for t in batch.column("text").to_pylist():
                raw = b"".join(map(ids_of, find(SPACE + t.replace(" ", SPACE)))) if t else b""
                row = np.frombuffer(raw, "<i4")
                n.append(len(row))
                crc.append(zlib.crc32(raw))
                text = b"".join(map(back.__getitem__, row.tolist())).decode("utf-8", "replace")
                texts.append(text[1:])  # without the space put before the first word
                ids.append(row)
            held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))) if with_ids else pa.nulls(len(n), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), held, pa.array(texts, pa.string()), batch.column("text")], ["doc_id", "n_tokens", "ids_crc32", "ids", "decoded", "text"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(each, "doc_id long, n_tokens long, ids_crc32 long, ids array<int>, decoded string, text string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document (count and CRC of the 32-bit little-endian ids) and whether they decode to its text."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
    same = F.col("decoded") == F.coalesce(F.replace(F.col("text"), F.lit(SPACE), F.lit(" ")), F.lit(""))
    return out.select("doc_id", "n_tokens", "ids_crc32", same.alias("round_trip"))


def tokenized(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: doc_id and the ids of each document."""
    return encode(docs).select("doc_id", "n_tokens", "ids_crc32", "ids")
