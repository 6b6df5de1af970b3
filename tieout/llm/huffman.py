"""Token ids in files of canonical, length-limited Huffman codes.

Ids are made with the tokenizers library, counted over the whole corpus, and given code lengths of at
most ``MAX_BITS`` by package-merge. Code lengths alone fix the canonical codes. A file is a table of
blocks that decode by themselves: ascending (part, block) is ascending doc_id order, each with its documents'
ids and token counts, the bit payload, and the bit offset of every ``STEP``-th token, so a table-driven
decoder works on all checkpoints of a block side by side or starts at any of them.

Defined cases: null or empty text is the end id alone; repeated doc_ids stay in (doc_id, text hash)
order, null ids first; an empty table writes no block and reads back empty; extra columns are ignored.
A single distinct id gets a code of one bit.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, shared_dir

TOKENIZER = "byte_bpe_50k.json"
END = 2
MAX_BITS = 20
STEP = 256
#: Tokens after which a block is closed, at the next document's end.
BLOCK = 1 << 18
#: Words that a task remembers encoded: those met last, in two generations of this size (some 110 MB each at most).
MEMO = 600_000
#: Characters of words that enter the memory.
MEMO_CHARS = 64
#: Documents that a task holds encoded at once.
SLICE = 256

_SPLITS_AT_SPACE = re.compile(r"\s \s|\s \Z")
_ODD_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: What every text has that _SPLITS_AT_SPACE finds something in.
_NEAR_SPACES = ("  ", " \n", " \t", " \r", " \v", " \f")
#: The ByteLevel pre-tokenizer's pattern (fixed value), and the same for ASCII.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_PIECES = re.compile(_PIECES.replace("\\p{L}", "A-Za-z").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace("\\p{N}", "0-9").replace(" ?0-9+", " ?[0-9]+"), re.A)


def _byte_characters() -> dict[int, str]:
    """The character by which a ByteLevel tokenizer writes each byte: visible Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(others)) for b in range(256)}


class Encoder:
    """The ids that ``Tokenizer.encode_batch`` gives, with the words between spaces remembered.

    For a byte-level tokenizer (its pre-tokens never reach over a space that follows a non-space) the
    ids of a text are those of its words, each with the space before it, and a word's are those that
    the tokenizer's model gives for its pre-tokens. Texts where that rule doesn't hold as it stands
    (runs of spaces, characters that count as spaces, strings of added tokens), and all texts of other
    tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core; threads of the library would only add memory
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        known = json.loads(self.tokenizer.to_str())
        before = known.get("pre_tokenizer") or {}
        self.by_word = known.get("normalizer") is None and known["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        self.added = [t["content"] for t in known["added_tokens"]]
        self.pieces = regex.compile(_PIECES).findall
        self.characters = _byte_characters()
        self.model = self.tokenizer.model
        self.code = "H" if self.dtype == "<u2" else "I"
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if word[0] == " " and word[1:].isalpha():
            return self._piece(word)
        pieces = _ASCII_PIECES.findall(word) if word.isascii() else self.pieces(word)
        return self._piece(word) if len(pieces) == 1 else b"".join([self._known(p[1:] if p[0] == " " else "\x1f" + p, p, self._piece) for p in pieces])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[0] == " " and piece[1:].isalnum():
            written = "Ġ" + piece[1:]
        else:
            written = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.characters)
        return array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids (``dtype``) of each text."""
        return [self._text(t) if t else b"" for t in texts]

    def _text(self, text: str) -> bytes:
        if not self.by_word or any(t in text for t in self.added) or _ODD_SPACES.search(text):
            return self._whole(text)
        if (text[-1] == " " or any(t in text for t in _NEAR_SPACES)) and _SPLITS_AT_SPACE.search(text):
            return self._whole(text)
        first, *words = text.split(" ")
        out = list(map(self.memo.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._known(words[i], " " + words[i], self._word)
        return (self._word(first) if first else b"") + b"".join(out)

    def _known(self, key: str, text: str, encode) -> bytes:
        """Ids of ``text`` from the memory; keys are what follows a space, or U+001F and a text without one (no word holds U+001F)."""
        ids = self.memo.get(key)
        if ids is None:
            ids = self.older.get(key) or encode(text)
            if len(key) <= MEMO_CHARS:
                self.memo[key] = ids
                if len(self.memo) >= MEMO:
                    self.older, self.memo = self.memo, {}
        return ids


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker: tasks that run in it one after the other share what it remembers."""
    return Encoder(path)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols of these counts (0: no code), by package-merge."""
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    if len(symbols) > 1 << limit:
        raise ValueError("too many symbols for this length limit")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[symbols].astype(np.int64)
    n = len(symbols)
    levels, packed = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((weights, packed))
        order = np.argsort(merged, kind="stable")
        levels.append(order < n)  # which of the sorted entries are symbols rather than packages
        merged = merged[order]
        packed = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for single in reversed(levels):
        used = int(single[:take].sum())
        depth[:used] += 1
        take = 2 * (take - used)
    out[symbols] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that lengths alone fix: by length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[np.searchsorted(lengths[order], 1) :].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` on end, most significant bit first, and the bit offset of every STEP-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, at = starts >> 5, starts & 31
    wide = codes[ids] << (64 - size - at).astype(np.uint64)  # a code reaches over two 32-bit words at most
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STEP]


class Decoder:
    """A table from the next MAX_BITS bits to (id, code length)."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(int(lengths.max(initial=1)), 1)
        codes = canonical_codes(lengths)
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.size = np.zeros(1 << self.bits, np.int64)
        order = np.flatnonzero(lengths)
        order = order[np.argsort(codes[order] << (self.bits - lengths[order]).astype(np.uint64))]
        span = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        used = int(span.sum())
        self.ids[:used] = np.repeat(order, span)
        self.size[:used] = np.repeat(lengths[order], span)

    def unpack(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block, all its checkpoints decoded in step."""
        if not n:
            return np.zeros(0, np.uint32)
        data = np.frombuffer(payload + bytes(8), np.uint8)
        windows = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        pos = np.asarray(offsets, np.int64).copy()
        out = np.zeros((len(pos), STEP), np.uint32)
        shift, mask = 64 - self.bits, (1 << self.bits) - 1
        last = len(windows) - 1
        for k in range(STEP):
            if k == n - (len(pos) - 1) * STEP and len(pos):  # the last checkpoint's ids have run out
                rest, out_rest = pos[:-1], out[:-1]
                if not len(rest):
                    break
                pos, held = rest, out_rest
            else:
                held = out[: len(pos)]
            key = (windows[np.minimum(pos >> 3, last)].astype(np.uint64) >> (shift - (pos & 7)).astype(np.uint64)).astype(np.int64) & mask
            held[:, k] = self.ids[key]
            pos += self.size[key]
        return out.ravel()[:n]


def token_rows(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(part, at, doc_id, width, ids): ids of ``width`` bytes with the end id, parts and rows in ascending doc_id order."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # input splits set the number of parts, so that a part stays of a split's size
    parts = max(1, slim.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # texts of one doc_id, or of none, may go to several parts
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def each(batches):
        held, at = encoder(path), 0
        last, width = np.asarray([end], held.dtype).tobytes(), int(held.dtype[-1])
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                ids = [r + last for r in held.encode(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(ids))), batch.column("doc_id"), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["at", "doc_id", "width", "ids"])
                at += len(ids)

    rows = ranged.select("doc_id", "text").mapInArrow(each, "at long, doc_id long, width int, ids binary")
    return rows.select(F.spark_partition_id().alias("part"), "*")


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus: sums of each task, then of all; a row an id at most."""

    def each(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                ids = np.frombuffer(b"".join(batch.column("ids").slice(i, SLICE).to_pylist()), f"<u{batch.column('width')[i].as_py()}")
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = rows.select("width", "ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = found.column("id").to_numpy()
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    out[ids] = found.column("n").to_numpy()
    return out


_BLOCKS = "part int, block long, doc_ids array<long>, n_tokens array<int>, tokens long, checkpoints array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write the blocks of ``docs`` to ``path``/blocks and the code lengths to ``path``/codes."""
    spark = docs.sparkSession
    staged = cut(token_rows(docs, tokenizer or public_tokenizers.path(TOKENIZER), end), "tokens")
    lengths = code_lengths(id_counts(staged))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def each(batches):
        bits, codes = sent.value
        held: dict[int, list] = {}  # by part: place of the first row, doc_ids, ids, tokens so far

        def close(part):
            at, doc_ids, raws, tokens = held.pop(part)
            payload, marks = pack(np.concatenate(raws), codes, bits)
            row = [part, at, doc_ids, list(map(len, raws)), tokens, marks.tolist(), payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            for part, at, doc, width, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "width", "ids"))):
                block = held.setdefault(part, [at, [], [], 0])
                block[1].append(doc)
                block[2].append(np.frombuffer(raw, f"<u{width}"))
                block[3] += len(raw) // width
                if block[3] >= BLOCK:
                    yield close(part)
        for part in sorted(held):
            yield close(part)

    names = ["part", "block", "doc_ids", "n_tokens", "tokens", "checkpoints", "payload"]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    # a split of the staged table is a stretch of rows in order, and a block is named by its first row's place
    staged.select("part", "at", "doc_id", "width", "ids").mapInArrow(each, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(staged)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, doc_id, at, ids): the documents of the files, ids as little-endian bytes."""
    codes = spark.read.parquet(f"{path}/codes").toArrow()  # a row an id of the vocabulary
    ids = codes.column("id").to_numpy()
    lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint8)
    lengths[ids] = codes.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(lengths)

    def each(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tokens = decoder.unpack(r["payload"], np.asarray(r["checkpoints"], np.int64), r["tokens"]).astype("<u4")
                ends = np.cumsum(r["n_tokens"])
                raws = [tokens[e - k : e].tobytes() for e, k in zip(ends.tolist(), r["n_tokens"])]
                n = len(raws)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array((ends - r["n_tokens"]).astype(np.int64)), pa.array(raws, pa.binary())], ["part", "block", "doc_id", "at", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(each, "part int, block long, doc_id long, at long, ids binary")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    A block's first token number is the sum over the blocks before it, of which there is one row a
    2^18 tokens: parts are summed first, then blocks within their part.
    """
    from pyspark.sql import Window

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "tokens")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p0"))  # one row a part
    inside = blocks.select("part", "block", (F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")).alias("b0"))
    offsets = inside.join(F.broadcast(before), "part").select("part", "block", (F.col("p0") + F.col("b0")).alias("first"))
    crc = F.crc32("ids")
    rows = read_tokens(spark, path).select("part", "block", "doc_id", "at", (F.length("ids") / 4).cast("long").alias("n_tokens"), crc.alias("ids_crc32"))
    return rows.join(offsets, ["part", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    """Encode ``documents``, write the files in doc_id order, and report each document as read back from them."""
    path = f"{shared_dir(spark)}/tieout-token-files-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digest(spark, path)
