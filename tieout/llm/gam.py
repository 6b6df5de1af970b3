"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts over the whole text. Each feature is cut into bins at quantiles of the training
rows; cyclic boosting adds one shallow tree a feature and round to that feature's lookup table, then
the same over pairs of features that explain most of what is left. A score is the logistic of summed
table entries, looked up for a whole batch at once.

Training rows: labelled documents outside the held-out third, at most ``TRAIN_ROWS`` of them (those
of the smallest hash of doc_id), a documented bound. Scoring covers every document.

Defined cases: null and empty texts have all-zero features and get a score like any other; null or
repeated doc_ids keep their rows (a null id is not held out and never trains); labels other than 0
and 1 are ignored; with no usable label, or one class only, every score is that class's share (0.5
if none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "space_share", "newline_share",
    "stop_share", "pipe_share", "bang_share", "symbol_share", "comma_share", "quote_share", "markup_share",
    "other_ascii_share", "high_share", "distinct_words", "distinct_bytes", "line_bytes", "repeated_lines",
    "long_words", "short_words", "ended_words", "capital_words",
]

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "newline": b"\n\r", "stop": b".?",
    "pipe": b"|", "bang": b"!", "symbol": b"#$%&*@^~=+_", "comma": b",;:", "quote": b"'\"`", "markup": b"<>{}[]()/\\",
}


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 2))
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars), k] = 1
    plain = set(b"abcdefghijklmnopqrstuvwxyz").union(*_CLASSES.values())
    table[[c for c in range(128) if c not in plain], len(_CLASSES)] = 1
    table[128:, len(_CLASSES) + 1] = 1
    return table


_TABLE = _class_table()


def text_features(text: str | None) -> list[float]:
    """The values of FEATURES for one text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _TABLE / n).tolist()
    words = raw.split()
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    lines = raw.split(b"\n")
    ends = sum(x[-1] in b".?!,;:" for x in words)
    capitals = int((np.frombuffer(b"".join(x[:1] for x in words), np.uint8) - 65 < 26).sum()) if words else 0
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), n / w, *shares,
        len(set(words)) / w, float((counts > 0).sum()), n / len(lines), 1 - len(set(lines)) / len(lines),
        float((sizes > 12).sum()) / w, float((sizes < 3).sum()) / w, ends / w, capitals / w,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of each text as an array."""

    def each(batches):
        for batch in batches:
            rows = [text_features(t) for t in batch.column("text").to_pylist()]
            x = np.array(rows, np.float64).reshape(-1, len(FEATURES))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, x array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shallow(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, ridge: float = 5.0) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins, as one value a bin."""
    cg, ch = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    cuts = [(0, len(grad))]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) < leaves:
        best = (1e-9, None, 0)
        for a, b in cuts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                g = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(g.argmax())
                if g[k] > best[0]:
                    best = (g[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        cuts.remove(best[1])
        cuts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in cuts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


class Gam:
    """Bin edges, an intercept, a table a feature and a table a pair; ``score`` adds them up."""

    def __init__(self, base: float):
        self.base, self.edges, self.tables, self.pair_edges, self.pairs = base, [], [], [], []

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(np.nan_to_num(x)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boost the tables on rows ``x`` with labels ``y`` (0 or 1)."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Gam(float(np.log(p / (1 - p))) if 0 < p < 1 else (30.0 if p else -30.0))
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = _sigmoid(z)
            size = len(model.tables[k])
            step = RATE * _shallow(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size))
            model.tables[k] += step
            z += step[b]
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    p = _sigmoid(z)
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell, size = coarse[i] * PAIR_BINS + coarse[j], PAIR_BINS * PAIR_BINS
            g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
            found.append((float((g * g / (h + 5)).sum()), i, j))
    for _, i, j in sorted(found, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = _sigmoid(z)
            cell = coarse[i] * PAIR_BINS + coarse[j]
            g = np.bincount(cell, y - p, PAIR_BINS**2).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(table.shape)
            rows = _shallow(g.sum(1), h.sum(1), 2)
            step = np.zeros(table.shape)
            for value in np.unique(rows):  # depth two: a split of the first feature, then one of the second on each side
                side = rows == value
                step[side] = RATE * _shallow(g[side].sum(0), h[side].sum(0), 2)
            table += step
            z += step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Gam:
    """Fit on labelled documents outside the held-out third, ``limit`` at most; no other text is looked at."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    y = y.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y.select("doc_id")), "doc_id", "left_semi")
    rows = features(texts).join(F.broadcast(y), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(limit).toArrow()  # bounded by ``limit``
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(np.nan_to_num(x), rows.column("y").to_numpy().astype(np.float64))


def scorer(model: Gam):
    """A function of a text column: the model's score, a batch at a time where the text is read."""

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return lambda text: quality(text.cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= 0.5) for every document."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(train(docs, labels))(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document of ``documents``, learnt from ``labels.quality``."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return docs.where(scorer(train(docs, labels))(F.col("text")) >= 0.5)
