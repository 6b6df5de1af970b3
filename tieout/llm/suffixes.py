"""Suffix-array deduplication: remove bytes that a repeated string of ``LENGTH`` bytes covers.

1. Every window of LENGTH bytes belongs to the smallest hash among its GRAM-byte strings. Equal windows
   have equal smallest hashes, so stretches of windows with one hash (pieces) are dealt by it, and pieces
   whose hash is met once in the corpus, and once in the piece, can hold no repeat.
2. The other pieces, each distinct text once with its number of occurrences, go to shards by hash. (Hashes
   that more bytes of distinct pieces share than a shard may hold go another way, by smaller stretches and
   then by 128-bit digests of their windows, so that no shard outgrows a task.) A
   shard's suffix array is made by induced sorting (suffix classes, recursively sorted leftmost-smaller
   substrings, linear induction), and its permuted common prefixes tell where LENGTH bytes recur.
3. Repeated windows go back to the documents as intervals; a document's are merged and cut out.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; a repeat within one document
counts; repeated rows and doc_ids are documents of their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, for_each_salt, hot_parts, longs, salted

LENGTH = 400
GRAM = 32
#: Bytes of distinct pieces that a shard's suffix array covers, about.
SHARD_BYTES = 2 << 20


# ---- suffix arrays ------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last symbol is the sentinel, which is S."""
    n = len(s)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    up[-1] = 1
    at = np.where(up != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # a run of equal symbols has the class of its end
    return up[following] > 0


def _induce_bytes(s: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order of all suffixes from sorted leftmost-smaller ones, a bucket of first symbols at a time."""
    k = len(bounds) - 1
    ends = bounds[1:]
    # larger suffixes, from the front: bucket by bucket, each in waves of suffixes that its own entries induce
    large_of: list[list[np.ndarray]] = [[] for _ in range(k)]
    first = s[lms]
    lms_of = np.split(lms, np.searchsorted(first, np.arange(1, k)))
    for c in range(k):
        wave = np.concatenate(large_of[c]) if large_of[c] else np.zeros(0, np.int64)
        done = [wave]
        while len(wave):  # e.g. "aaa": entries of this bucket that induce into it
            before = wave[wave > 0] - 1
            wave = before[(s[before] == c) & ~small[before]]
            if len(wave):
                done.append(wave)
        large_of[c] = done
        source = np.concatenate([*done, lms_of[c]])
        before = source[source > 0] - 1
        before = before[~small[before] & (s[before] > c)]
        if len(before):
            symbol = s[before]
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part, d in zip(np.split(before, cuts), symbol[np.concatenate(([0], cuts))]):
                large_of[d].append(part)
    large = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in large_of]
    # smaller suffixes, from the back, in descending order
    small_of: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k - 1, -1, -1):
        wave = np.concatenate(small_of[c]) if small_of[c] else np.zeros(0, np.int64)
        done = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(s[before] == c) & small[before]]
            if len(wave):
                done.append(wave)
        small_of[c] = done
        source = np.concatenate([*done, large[c][::-1]])
        before = source[source > 0] - 1
        before = before[small[before] & (s[before] < c)]
        if len(before):
            symbol = s[before]
            order = np.argsort(-symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part, d in zip(np.split(before, cuts), symbol[np.concatenate(([0], cuts))]):
                small_of[d].append(part)
    out = []
    for c in range(k):
        # the sentinel has no suffix after it that could induce it
        out += [large[c], np.concatenate([np.zeros(0, np.int64), *small_of[c]])[::-1] if c else lms_of[0][-1:]]
    sa = np.concatenate(out)
    assert len(sa) == int(ends[-1])
    return sa


def _induce_wide(s: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The same for many symbols, an entry at a time."""
    n = len(s)
    text, is_small = s.tolist(), small.tolist()
    sa = [-1] * n
    tail = bounds[1:].tolist()
    for j in reversed(lms.tolist()):
        c = text[j]
        tail[c] -= 1
        sa[tail[c]] = j
    head = bounds[:-1].tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = bounds[1:].tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of integers 0 to symbols-1 whose last one is a single 0, smaller than all others."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    bounds = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
    induce = _induce_bytes if symbols <= 512 else _induce_wide
    if not len(lms):
        lms = np.array([n - 1])
    start = lms[np.argsort(s[lms], kind="stable")]
    rough = induce(s, small, start, bounds)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rank = np.full(n, -1)
    rank[lms] = np.arange(len(lms))
    ordered = rough[is_lms[rough]]
    # names of leftmost-smaller substrings: neighbours in order that are equal share one
    end = np.append(lms[1:], n - 1)
    length = end[rank[ordered]] - ordered + 1
    same = np.zeros(len(ordered), bool)
    same[1:] = length[1:] == length[:-1]
    live, offset = np.flatnonzero(same), 0
    while len(live):
        a, b = ordered[live], ordered[live - 1]
        differ = s[a + offset] != s[b + offset]
        same[live[differ]] = False
        offset += 1
        live = live[~differ]
        live = live[length[live] > offset]
    same[0] = False
    if len(ordered) > 1 and ordered[0] == n - 1:
        same[1] = False
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(lms):
        reduced = np.zeros(len(lms), np.int64)
        reduced[rank[ordered]] = names
        ordered = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(s, small, ordered, bounds)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the length of the prefix it shares with its predecessor in ``sa``, in text order.

    Where the symbols before both are equal, that is one less than at the place before; only the other
    places are compared, four symbols at a step.
    """
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.flatnonzero(before > 0)
    i = i[i > 0]
    carry = np.zeros(n, bool)
    carry[i] = s[i - 1] == s[before[i] - 1]
    live = np.flatnonzero(~carry & (before >= 0))
    padded = np.concatenate((s.astype(np.uint16), np.zeros(8, np.uint16)))
    wide = np.ndarray((n + 4,), np.uint64, padded.tobytes(), strides=(2,))
    got = np.zeros(n, np.int64)
    while len(live):  # four symbols of 16 bits at a step
        a, b = live + got[live], before[live] + got[live]
        inside = (a < n) & (b < n)
        x = wide[np.minimum(a, n)] ^ wide[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 4, np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48], np.uint64), low, side="right"))
        got[live] += np.where(inside, equal, 0)
        live = live[inside & (x == 0)]
    base = np.where(carry, -1, np.minimum(got, np.minimum(n - np.arange(n), n - np.maximum(before, 0))))
    at = np.maximum.accumulate(np.where(carry, -1, np.arange(n)))
    out = np.maximum(base[at] - (np.arange(n) - at), 0)
    out[before < 0] = 0
    return out


def repeated_starts(texts: list[bytes], times: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct text, where strings of ``length`` bytes start that occur elsewhere in these texts."""
    sizes = np.array([len(t) + 1 for t in texts])
    n = int(sizes.sum()) + 1
    s = np.zeros(n, np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    for t, at in zip(texts, first):
        s[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 2
    s[first[1:] - 1] = 1  # between texts
    room = np.zeros(n, np.int64)  # bytes from here to the text's end
    for k, t in enumerate(texts):
        room[first[k] : first[k] + len(t)] = np.arange(len(t), 0, -1)
    sa = suffix_array(s, 258)
    # a prefix counts within both texts only; 1 stands between texts, so one that is shorter than both rooms doesn't cross
    prefix = common_prefixes(s, sa)
    long = prefix >= length
    ok = room >= length
    hit = np.zeros(n, bool)
    order_ok = ok[sa]
    pair = long[sa[1:]] & order_ok[1:] & order_ok[:-1]
    hit[sa[1:][pair]] = True
    hit[sa[:-1][pair]] = True
    for k, m in enumerate(times):
        if m > 1:
            hit[first[k] : first[k + 1]] |= ok[first[k] : first[k + 1]]
    return [np.flatnonzero(hit[first[k] : first[k + 1]]) for k in range(len(texts))]


# ---- pieces -------------------------------------------------------------------------------------


def _gram_hashes(data: bytes) -> np.ndarray:
    """A hash of each GRAM-byte string."""
    n = len(data) - GRAM + 1
    w = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= w[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of ``width``: running minima from both sides of blocks of that width."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def pieces_of(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, bool]]:
    """(hash, start, bytes, hash met twice in it) of each stretch of windows with one smallest hash."""
    if len(data) < length:
        return []
    h = _gram_hashes(data)
    low = _sliding_min(h, length - GRAM + 1)
    starts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    ends = np.append(starts[1:], len(low))
    values = low[starts]
    out = []
    span = length - GRAM
    for v, a, e in zip(values.view(np.int64).tolist(), starts.tolist(), ends.tolist()):
        twice = int(np.count_nonzero(h[a : e + span] == np.int64(v).view(np.uint64))) > 1
        out.append((v, a, e - a + length - 1, twice))
    return out


_PIECE = "rid long, hash long, start int, size int, twice boolean, body binary"


def _pieces(base: DataFrame, length: int) -> DataFrame:
    """(rid, hash, start, size, twice, body): body is a 128-bit digest of the piece's bytes."""

    def each(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                for v, a, size, twice in pieces_of(data, length):
                    for c, x in zip(cols, (rid, v, a, size, twice, xxhash.xxh3_128_digest(data[a : a + size]))):
                        c.append(x)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["rid", "hash", "start", "size", "twice", "body"])

    return base.mapInArrow(each, _PIECE)


def _cut_bodies(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, body, times, hot, data): the bytes of each wanted piece (rid, spots)."""

    def each(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spots in zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                for p in spots:
                    for c, x in zip(out, (p["hash"], p["body"], p["times"], p["hot"], data[p["start"] : p["start"] + p["size"]])):
                        c.append(x)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["hash", "body", "times", "hot", "data"])

    return base.join(wanted, "rid").select("text", "spots").mapInArrow(each, "hash long, body binary, times long, hot boolean, data binary")


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("e", pa.int32())]))


def _runs(starts: np.ndarray, length: int) -> list[dict]:
    """Stretches of bytes that windows at ascending ``starts`` cover, windows next to each other as one."""
    if not len(starts):
        return []
    return [{"a": int(r[0]), "e": int(r[-1]) + length} for r in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)]


def _end_stretches(data: bytes, length: int) -> list[tuple[int, int, int, bool]]:
    """(key, start, windows, may repeat in itself): stretches of windows by the smallest hashes near both their ends."""
    h = _gram_hashes(data)
    near = min(33, length - GRAM + 1)
    low = _sliding_min(h, near)
    n = len(data) - length + 1
    left, right = low[:n], low[length - GRAM + 1 - near :][:n]
    key = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x85EBCA6B)) * np.uint64(0xC2B2AE3D27D4EB4F)
    starts = np.concatenate(([0], np.flatnonzero((left[1:] != left[:-1]) | (right[1:] != right[:-1])) + 1))
    ends = np.append(starts[1:], n)
    return [(int(key[a].view(np.int64)), a, e - a, len(np.unique(h[a:e])) < e - a) for a, e in zip(starts.tolist(), ends.tolist())]


def _hot_runs(bodies: DataFrame, length: int) -> DataFrame:
    """(hash, body, runs) of pieces (hash, body, times, data) whose hash too many share for one suffix array."""
    rows = cut(bodies.withColumn("uid", F.monotonically_increasing_id()), "hot")

    def split(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for uid, data, times in zip(*(batch.column(c).to_pylist() for c in ("uid", "data", "times"))):
                for key, a, n, again in _end_stretches(data, length):
                    for c, x in zip(cols, (key, xxhash.xxh3_128_digest(data[a : a + n - 1 + length]), uid, a, n, times, again)):
                        c.append(x)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "sub", "uid", "off", "n", "times", "again"])

    subs = cut(rows.select("uid", "data", "times").mapInArrow(split, "key long, sub binary, uid long, off int, n int, times long, again boolean"), "stretches")
    distinct = subs.groupBy("key", "sub").agg(F.sum("times").alias("times"), F.min(F.struct("uid", "off")).alias("at"), F.max("n").alias("n"), F.max("again").alias("again"))
    distinct = cut(distinct, "stretches")
    shared = distinct.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key", "texts")
    whole = distinct.where("times > 1").select("key", "sub", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1 + length).alias("e"))).alias("runs"))
    open_ = distinct.join(shared, "key", "left").where("texts > 1 or again")
    spot = F.struct("key", "sub", F.col("at.off").alias("off"), "n", "times")
    wanted = open_.groupBy(F.col("at.uid").alias("uid")).agg(F.collect_list(spot).alias("spots"))

    def digests(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for data, spots in zip(batch.column("data").to_pylist(), batch.column("spots").to_pylist()):
                for p in spots:
                    for k in range(p["n"]):
                        at = p["off"] + k
                        for c, x in zip(cols, (xxhash.xxh3_128_digest(data[at : at + length]), p["key"], p["sub"], k, p["times"])):
                            c.append(x)
            types = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["digest", "key", "sub", "k", "times"])

    windows = rows.select("uid", "data").join(wanted, "uid").select("data", "spots").mapInArrow(digests, "digest binary, key long, sub binary, k int, times long")
    windows = cut(windows, "windows")
    again = cut(windows.groupBy("digest").agg(F.sum("times").alias("m"), F.count("*").alias("n")).where("m > 1").select("digest", "n"), "again")
    hot = cut(hot_parts(again, windows.count()), "hot")
    once = salted(windows.where("times = 1"), hot, "digest", ["key", "sub", "k"])
    hit = once.join(for_each_salt(again.select("digest"), hot, "digest"), ["digest", "salt"]).groupBy("key", "sub").agg(F.array_sort(F.collect_set("k")).alias("k"))
    hit = hit.select("key", "sub", F.transform("k", lambda k: F.struct(k.alias("a"), (k + length).alias("e"))).alias("runs"))
    found = subs.join(hit.unionByName(whole), ["key", "sub"]).select("uid", F.transform("runs", lambda r: F.struct((F.col("off") + r.a).alias("a"), (F.col("off") + r.e).alias("e"))).alias("runs"))
    found = found.groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return rows.select("uid", "hash", "body").join(found, "uid").select("hash", "body", "runs")


def repeated_intervals(base: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(rid, spans): starts and ends of stretches of ``rid``'s text that repeated strings cover."""
    pieces = cut(_pieces(base.select("rid", "text"), length), "pieces")
    distinct = pieces.groupBy("hash", "body").agg(F.count("*").alias("times"), F.min(F.struct("rid", "start")).alias("at"), F.max("size").alias("size"), F.max("twice").alias("twice"))
    distinct = cut(distinct, "distinct")
    texts = distinct.groupBy("hash").agg(F.count("*").alias("texts"), F.sum("times").alias("met"), F.max("twice").alias("inside"), F.sum("size").alias("bytes"))
    texts = texts.where("met > 1 or inside").select("hash", "texts", "inside", (F.col("bytes") > shard_bytes // 2).alias("hot"))
    distinct = distinct.join(texts, "hash")
    # a piece that is all there is of its hash and doesn't hold it twice needs no sorting: its copies repeat it whole
    whole = distinct.where("not (texts > 1 or inside)").select("hash", "body", F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("e"))).alias("runs"))
    spot = F.struct("hash", "body", "times", "hot", F.col("at.start").alias("start"), "size")
    wanted = distinct.where("texts > 1 or inside").groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(spot).alias("spots"))
    bodies = cut(_cut_bodies(base.select("rid", "text"), wanted), "bodies")
    sizes = {hot: total for hot, total in bodies.groupBy("hot").agg(F.sum(F.length("data"))).collect()}  # two rows
    shards = int(max(1, -(-sizes.get(False, 0) // shard_bytes)))
    dealt = bodies.where("not hot").select("hash", "body", "times", "data", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int").alias("shard"))

    def sort(group: pa.Table) -> pa.Table:
        found = repeated_starts(group.column("data").to_pylist(), group.column("times").to_pylist(), length)
        return pa.table({"hash": group.column("hash"), "body": group.column("body"), "runs": pa.array([_runs(f, length) for f in found], _RUNS)})

    repeated = dealt.groupBy("shard").applyInArrow(sort, "hash long, body binary, runs array<struct<a:int,e:int>>").where("size(runs) > 0").unionByName(whole)
    if sizes.get(True):
        repeated = repeated.unionByName(_hot_runs(bodies.where("hot").select("hash", "body", "times", "data"), length))
    spans = pieces.join(cut(repeated, "repeated"), ["hash", "body"]).select("rid", F.transform("runs", lambda r: F.struct((F.col("start") + r.a).alias("a"), (F.col("start") + r.e).alias("e"))).alias("spans"))
    return spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _kept(text: str | None, spans) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, stretches removed, and what is left of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    merged: list[list[int]] = []
    for a, e in sorted((s["a"], s["e"]) for s in spans) if spans is not None else []:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e])
    left, at = [], 0
    for a, e in merged:
        left.append(data[at:a])
        at = e
    left.append(data[at:])
    return len(data), sum(e - a for a, e in merged), len(merged), b"".join(left)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and on request the bytes kept."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(base.withColumn("rid", F.monotonically_increasing_id()), "texts")
    spans = repeated_intervals(base, length)

    def each(batches):
        for batch in batches:
            rows = [_kept(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            digests = [hashlib.sha256(r[3]).hexdigest() for r in rows]
            kept = pa.array([r[3] for r in rows], pa.binary()) if with_bytes else pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(longs([r[k] for r in rows]) for k in range(3)), pa.array(digests, pa.string()), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = base.join(spans, "rid", "left").select("doc_id", "text", "spans")
    out = out.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_bytes else out.drop("kept")


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document of ``documents`` when repeated 400-byte strings are removed."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
