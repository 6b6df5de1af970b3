"""Helpers that several operators share: tables cut from their lineage, components, row streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.operators.graph import connected_components  # noqa: F401
from tieout.tables import discard, shared_dir  # noqa: F401
from tieout.tables import written as cut  # noqa: F401

#: A key is hot from this share of all rows on, one in PARTS.
PARTS = 4096


def hot_parts(counts: DataFrame, total: int) -> DataFrame:
    """(key, parts) of the keys (key, n) that hold more than one in PARTS of ``total`` rows.

    There are fewer than PARTS such keys whatever the data, and their parts add up to less than twice
    PARTS, so the table may be broadcast.
    """
    hot = counts.where(F.col("n") * PARTS > total)
    return hot.withColumn("parts", F.ceil(F.col("n") * PARTS / F.lit(max(1, total))).cast("int")).drop("n")


def salted(rows: DataFrame, hot: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``rows`` with ``salt``: one of a hot key's parts, by hash of ``by``; 0 for other keys."""
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")).cast("int"), F.lit(0))
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("parts")


def for_each_salt(side: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``side``, which has a row a key, with a row for each ``salt`` that :func:`salted` deals to the key."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    return side.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(salts)).drop("parts")


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component, for edges between nodes 0 to n-1 held in arrays."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == was).all():
            break
    return root


def by_run(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition sorted by ``keys``: a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            c = batch.column(k)
            same &= c.is_null().to_numpy(zero_copy_only=False) if v is None else np.asarray(c) == v
        start = int(np.argmax(same))  # sorted: the rows of the last group end the batch
        if start:
            held.append(batch.slice(0, start))
            yield pa.Table.from_batches(held)
            held = [batch.slice(start)]
        else:
            if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != v for k, v in zip(keys, last)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on one batch."""

    def each(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(each, schema)


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))
