"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``RADIUS`` bits of each other are linked, all of them: bits are grouped into
partitions of correlated bits, and partition i gets a threshold t_i with sum(t_i + 1) = RADIUS + 1,
so any linked pair differs in at most t_i bits of some partition i. A threshold of t is probed by
one signature for each way to leave t bits of the partition out. Thresholds and the number of
partitions are those of the lowest estimated cost, found by dynamic programming.

Defined cases: null or empty text has no words and fingerprint zero, which links like any other;
repeated rows and repeated doc_ids each get a row; a null doc_id is kept and never a component_id
unless its component has no other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_run, connected_components, cut, discard, local_roots, longs

RADIUS = 3
SHINGLE = 3
#: Fingerprints that one comparison block holds; a larger bucket is compared block by block, in several tasks.
TILE = 2048
#: Cost of shuffling one signature, in comparisons.
PROBE_COST = 300.0
#: The pipeline's stage: words of a shingle.
COPY_SHINGLE = 5
#: Rounds in which each text is compared with one text of each of its shingles, before all that are left.
STARS = 2
#: Documents of the sample that tells common shingles, and how many of these are told.
SAMPLE = 32_768
#: Bits of a text's number of shingles, and of a shingle's place, where they share a column.
BITS = 29
COMMON = 200_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle, repeats included; fewer words: of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist()
    return np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint's bits in a long."""

    def each(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()]
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set: 64 x 64 sums from each task, added up by Spark."""

    def each(batches):
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            v = np.asarray(batch.column("fp")).astype(np.int64, copy=False)
            for i in range(0, len(v), 65536):
                bits = np.unpackbits(np.ascontiguousarray(v[i : i + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([longs(np.arange(4096)), longs(total.ravel())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(each, "cell long, n long")
    out = np.zeros(4096)
    for cell, n in rows.groupBy("cell").agg(F.sum("n")).collect():  # 4,096 rows at most
        out[cell] = n
    return fps.count(), out.reshape(64, 64)


def bit_groups(both: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, strongly correlated bits together."""
    p = np.diag(both) / max(rows, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        inside = corr[np.ix_(left, left)]
        group = [left[int(inside.sum(1).argmax())]]
        left.remove(group[0])
        while len(group) < size:
            nearest = left[int(corr[np.ix_(left, group)].sum(1).argmax())]
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i, with sum(t_i + 1) = total, of the lowest summed cost; costs[i][t + 1] is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, picks) in best.items():
            for step in range(min(total - used, len(cost) - 1) + 1):
                if used + step not in new or c + cost[step] < new[used + step][0]:
                    new[used + step] = (c + cost[step], [*picks, step - 1])
        best = new
    return best[total][1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def plan_probes(fps: DataFrame, radius: int = RADIUS) -> list[int]:
    """Masks (unsigned) under which a linked pair must agree at least once, as cheap as estimated."""
    rows, both = bit_counts(fps)
    options = {m: bit_groups(both, rows, m) for m in range(2, radius + 2)}
    whole = [sum(1 << b for b in g) for groups in options.values() for g in groups]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(w))).alias("v")) for i, w in enumerate(whole)]))
    counted = fps.select(cells.alias("c")).groupBy("c.i", "c.v").count().groupBy("i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s"))
    same = {i: max(0.0, s - rows) / 2 for i, s in counted.collect()}
    p = np.diag(both) / max(rows, 1)
    agree = p * p + (1 - p) ** 2
    best, i = (float("inf"), [], []), 0
    for groups in options.values():
        costs = []
        for g in groups:
            # leaving bits out adds the pairs that differ there: the exact count at threshold 0, scaled by 1 / agreement
            sums = np.zeros(radius + 1)
            sums[0] = 1
            for b in g:
                sums[1:] += sums[:-1] / agree[b]
            costs.append([0.0] + [max(rows, 1) * comb(len(g), t) * PROBE_COST + same.get(i, 0.0) * sums[t] for t in range(radius + 1)])
            i += 1
        picks = allocate(costs, radius + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, picks))
        if cost < best[0]:
            best = (cost, groups, picks)
    masks = []
    for g, t in zip(*best[1:]):
        full = sum(1 << b for b in g)
        if t >= 0:
            masks += [full & ~sum(1 << b for b in out) for out in combinations(g, t)]
    return masks


def _links(v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that isn't its component's first: it, and a fingerprint joined to it by links within ``v``."""
    n = len(v)
    root = np.arange(n)
    while True:
        was = root.copy()
        for i in range(0, n, 256):
            near = np.bitwise_count(v[i : i + 256, None] ^ v[None, :]) <= radius
            np.minimum.at(root, root[i : i + 256], np.where(near, root[None, :], n).min(axis=1))
        root = root[root]
        if (root == was).all():
            break
    child = np.flatnonzero(root != np.arange(n))
    return v[child], v[root[child]]


def _bucket_links(table: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a table of whole buckets, as spanning edges of each bucket; small buckets all at once by shifts."""
    v = table.column("fp").to_numpy().astype(np.int64, copy=False).view(np.uint64)
    key = [table.column(k).to_numpy() for k in ("sid", "sig", "i", "j")]
    new = np.ones(len(v), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(v)))
    group = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= 48
    a, b = [], []
    at = np.flatnonzero(small[group])
    gs, vs = group[at], v[at]
    for d in range(1, int(sizes[small].max()) if small.any() else 0):
        hit = np.flatnonzero((gs[d:] == gs[:-d]) & (np.bitwise_count(vs[d:] ^ vs[:-d]) <= radius))
        a.append(hit + d)
        b.append(hit)
    left, right = [], []
    if a:
        root = local_roots(np.concatenate(a), np.concatenate(b), len(vs))
        child = np.flatnonzero(root != np.arange(len(vs)))
        left.append(vs[child])
        right.append(vs[root[child]])
    for g in np.flatnonzero(~small):
        x, y = _links(v[starts[g] : starts[g] + sizes[g]], radius)
        left.append(x)
        right.append(y)
    e = np.zeros(0, np.uint64)
    return np.concatenate([e, *left]), np.concatenate([e, *right])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect whatever lies within ``radius`` bits.

    Buckets of more than TILE fingerprints become pairs of blocks, each pair its own bucket. Each
    bucket gives the edges of a spanning forest, so output stays in proportion to the fingerprints.
    """
    masks = plan_probes(fps, radius)
    probes = F.explode(F.array(*[F.struct(F.lit(k).alias("sid"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("sig")) for k, m in enumerate(masks)]))
    rows = fps.select("fp", probes.alias("p")).select("fp", "p.sid", "p.sig")
    full = rows.groupBy("sid", "sig").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(full, ["sid", "sig"])
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("r", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("o", other).select("fp", "sid", "sig", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"))

    def each(batches):
        for table in by_run(batches, ["sid", "sig", "i", "j"]):
            x, y = _bucket_links(table, radius)
            yield pa.RecordBatch.from_arrays([longs(x.view(np.int64)), longs(y.view(np.int64))], ["a", "b"])

    keys = ["sid", "sig", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and its component's smallest doc_id."""
    marked = cut(fingerprints(docs, size), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint (16 hex digits) and component over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def weighted_set(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes with repeats, as a sorted set: the k-th occurrence of a shingle has a hash of its own."""
    h = np.sort(hashes)
    at = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    turn = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.sort(h + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("_row", F.col("text").cast("string").alias("text"))


def _digests(rows: DataFrame) -> DataFrame:
    """(_row, id, d1, d2): a 128-bit hash of each text's words."""

    def each(batches):
        for batch in batches:
            joined = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) if t else b"" for t in batch.column("text").to_pylist()]
            d = np.frombuffer(b"".join(map(xxhash.xxh128_digest, joined)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("id"), longs(d[:, 0]), longs(d[:, 1])], ["_row", "id", "d1", "d2"])

    table = rows.select("_row", F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return table.mapInArrow(each, "_row long, id long, d1 long, d2 long")


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample holds often (sorted), and how often. They only set the order of shingles, thus the cost."""

    def each(batches):
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([longs(weighted_set(shingle_hashes(t, COPY_SHINGLE)).view(np.int64))], ["t"])

    share = max(1, docs.count() // SAMPLE)
    part = _texts(docs).where(F.pmod(F.xxhash64("_row"), F.lit(share)) == 0)
    top = part.mapInArrow(each, "t long").groupBy("t").count().where("count > 2").orderBy(F.desc("count"), "t").limit(COMMON).toPandas()
    t, n = top["t"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(t)
    return t[order], n[order]


def histogram(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes fall into each of 2^k cells, an eighth as many cells as hashes or more, 16 at least."""
    cells = 16
    while cells * 8 < len(hashes):
        cells *= 2
    return np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells)


def may_be_alike(x: np.ndarray, y: np.ndarray) -> bool:
    """False only if sets with these histograms have a similarity below 0.8: cells' counts differ by as much as the sets do at most."""
    while len(x) > len(y):  # cells are the low bits, so halves add up
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return 9 * int(np.abs(x - y).sum()) <= int(x.sum() + y.sum())


def _prefixes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(_row, n, fp, central, cells, prefix): size of the shingle set, fingerprint, how common its shingles are, histogram, and the set's first shingles, common ones last.

    Sets of similarity 0.8 share 0.8 of the larger one at least, so they meet in their first
    n - ceil(0.8 n) + 1 shingles by whatever order all sets follow.
    """
    common, often = _common_shingles(rows)

    def each(batches):
        for batch in batches:
            sizes, fps, central, cells, kept = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                h = shingle_hashes(t, COPY_SHINGLE)
                s, rank = weighted_set(h), np.zeros(len(h), np.int64)
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, often[at], 0)
                first = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
                sizes.append(len(s))
                fps.append(majority(h))
                central.append((100 * int(rank.sum()) // max(1, len(s))).bit_length() & 31)
                cells.append(histogram(s).astype("<u2" if len(s) < 65536 else "<u4").tobytes())
                kept.append(s[np.lexsort((s, rank))[:first]].view(np.int64))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *kept]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), flat)
            fps = longs(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), longs(sizes), fps, pa.array(central, pa.int32()), pa.array(cells, pa.binary()), lists], ["_row", "n", "fp", "central", "cells", "prefix"])

    return _texts(docs).mapInArrow(each, "_row long, n long, fp long, central int, cells binary, prefix array<long>")


def _plausible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose histograms let their sets be alike: decided without texts, and no pair of similarity 0.8 is lost."""

    def cells(column, n) -> list[np.ndarray]:
        return [np.frombuffer(c, "<u2" if k < 65536 else "<u4").astype(np.int64) for c, k in zip(column.to_pylist(), n.to_pylist())]

    def each(batches):
        for batch in batches:
            both = zip(cells(batch.column("x"), batch.column("xn")), cells(batch.column("y"), batch.column("yn")))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_alike(x, y) for x, y in both], pa.bool_()))

    of = lambda p, c: marked.select(F.col("_row").alias(p), F.col("cells").alias(c), F.col("n").alias(f"{c}n"))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").mapInArrow(each, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a similarity of at least 0.8."""

    def each(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            last, u = None, None
            for i, (a, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "x", "y")))):
                if a != last:
                    last, u = a, weighted_set(shingle_hashes(x, COPY_SHINGLE))
                v = weighted_set(shingle_hashes(y, COPY_SHINGLE))
                ok[i] = 9 * len(np.intersect1d(u, v, assume_unique=True)) >= 4 * (len(u) + len(v))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    named = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    held = cut(_texts(docs).join(named, "_row", "left_semi"), "texts")
    both = pairs.join(held.select(F.col("_row").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("_row").alias("b"), F.col("text").alias("y")), "b")
    edges = cut(both.select("a", "b", "x", "y").mapInArrow(each, "a long, b long"), "verified")
    discard(held)
    return edges


def _fingerprint_pairs(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that SimHash links, RADIUS bits or fewer apart: a spanning forest of each bucket, and equal fingerprints with their first text."""
    nodes = cut(held.groupBy("fp").agg(F.min("_row").alias("first")), "nodes")
    same = held.join(nodes, "fp").where("_row <> first").select(F.col("first").alias("a"), F.col("_row").alias("b"))
    of = lambda fp, c: nodes.select(F.col("fp").alias(fp), F.col("first").alias(c))
    near = links(nodes.select("fp"), RADIUS).withColumnsRenamed({"a": "fa", "b": "fb"}).distinct()
    near = near.join(of("fa", "x"), "fa").join(of("fb", "y"), "fb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near).distinct()


def copy_components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) for each ``_row`` of ``docs``, those of ``rows`` with distinct texts, that some other one is like: similarity 0.8 or more, in one or more steps.

    Texts whose fingerprints SimHash links come first, each link checked exactly. What a radius of
    fingerprints can't promise follows: texts that share a prefix shingle are compared, if their histograms
    allow it, at first each with one text of each of its shingles, the one of the most common shingles (what
    copies were made of, rather than one of them) and then ones by hash, another for each shingle; then with
    all that lie in other components by then, a pair in the first of a run of shingles only. So no pair is
    lost, and a large group of copies has joined up before pairs of it are made.
    """
    marked = cut(_prefixes(docs, rows), "prefixes")
    held = cut(marked.select("_row", "n", "fp", "cells"), "histograms")
    edges, roots = None, None

    def join_up(candidates: DataFrame) -> None:
        nonlocal edges, roots
        met = cut(candidates, "met")
        pairs = cut(_plausible(met, held), "pairs")
        discard(met)
        found = _verified(pairs, rows)
        discard(pairs)
        edges = found if edges is None else edges.unionByName(found)
        roots = cut(connected_components(edges), "roots")
        rows.sparkSession._jvm.System.gc()  # Spark then deletes shuffle files that no plan uses

    join_up(_fingerprint_pairs(held))
    # 22 rows and more a text are shuffled, so three small numbers share a column
    packed = F.shiftleft(F.col("central").cast("long"), 2 * BITS) + F.shiftleft("n", BITS)
    entry = F.transform("prefix", lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get("prefix", i - 1), F.lit(0)).alias("prev")))
    probes = marked.select("_row", packed.alias("a"), F.posexplode(entry).alias("pos", "e")).select("_row", (F.col("a") + F.col("pos")).alias("a"), "e.t", "e.prev")
    full = probes.groupBy("t").agg(F.count("*").alias("size")).where("size > 1").select("t")
    buckets = cut(probes.join(full, "t"), "buckets")
    discard(marked)
    del probes, full, marked, docs
    rows.sparkSession._jvm.System.gc()
    low = F.lit((1 << BITS) - 1)
    spread = buckets.select("t", "prev", "_row", F.shiftright("a", 2 * BITS).alias("central"), F.shiftright("a", BITS).bitwiseAND(low).alias("n"), F.col("a").bitwiseAND(low).alias("pos"))
    # a pair's first common shingle leaves as many in both sets, itself included, as the overlap of similarity 0.8
    alike = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) and 9 * least(x.n - x.pos, y.n - y.pos) >= 4 * (x.n + y.n)"
    for salt in range(STARS + 1):
        now = spread.join(roots.withColumnRenamed("node", "_row"), "_row", "left").withColumn("comp", F.coalesce("root", "_row")).drop("root")
        mixed = now.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("t", "size")
        now = now.join(mixed, "t")
        if salt < STARS:
            # few shingles of its own before a common one: near to what the copies were made of, and alike to most of them if to any
            rank = [-F.col("central"), F.call_function("div", 64 * F.col("pos"), F.col("n")), (18 * F.col("pos") > F.col("n")).cast("long")][min(salt, 2)]
            first = F.struct(rank.alias("c"), (F.xxhash64("_row", F.lit(salt)) if salt < 2 else F.xxhash64("_row", "t", F.lit(salt))).alias("h"))
            head = now.groupBy("t").agg(F.min(F.struct(first.alias("first"), "_row", "n", "pos", "comp")).alias("y")).select("t", "y.*")
            pairs = now.alias("x").join(head.alias("y"), "t").where(f"x.comp <> y.comp and {alike}")
        else:
            tiled = now.withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int")).withColumn("r", F.pmod(F.xxhash64("_row", F.lit(7)), F.col("blocks")).cast("int"))
            tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("r", "o"), "j": F.greatest("r", "o")})
            tiled = tiled.select("t", "i", "j", "r", "prev", "_row", "n", "pos", "comp")
            # where the shingle before is the same in both, the pair has met there
            new = "(x.pos = 0 or y.pos = 0 or x.prev <> y.prev)"
            pairs = tiled.alias("x").join(tiled.alias("y"), ["t", "i", "j"]).where(f"x.r = i and y.r = j and (i < j or x._row < y._row) and x.comp <> y.comp and {new} and {alike}")
        join_up(pairs.select(F.least("x._row", "y._row").alias("a"), F.greatest("x._row", "y._row").alias("b")).distinct())
    discard(buckets)
    discard(held)
    return roots


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of copies, five-word similarity 0.8 or more: that of the smallest doc_id, a null only where all are null, and of its rows the first.

    Similarity is Jaccard's over shingles with their multiplicity. Texts of the same words are
    copies, thus all texts without words.
    """
    own = "_row"
    while own in docs.columns:
        own += "_"
    kept = cut(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    rows = kept.select(F.col(own).alias("_row"), "doc_id", "text")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("least")
    firsts = cut(_digests(rows).groupBy("d1", "d2").agg(least).select("least"), "firsts")
    roots = copy_components(rows.join(firsts.select("least._row"), "_row", "left_semi"), rows)
    named = firsts.select("least", F.col("least._row").alias("node")).join(roots, "node", "left")
    keep = cut(named.groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least")).select(F.col("least._row").alias(own)), "keep")
    discard(firsts)
    return kept.join(keep, own, "left_semi").drop(own)
