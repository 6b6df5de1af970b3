"""Secret scan with corpus-wide ownership frequency.

Base spans (assign, access, hex) are always reported. Weaker candidates (token prefixes of vendors,
credentials in URLs, JSON web tokens, long mixed strings) are reported only if their value looks live:
the hash of each candidate value is counted by distinct repositories and distinct documents over the
whole corpus, and a value that more than ``MAX_OWNERS`` repositories hold is a copied example. The
``source`` column stands for the repository and owner where a table has no better one.

Defined cases: null text is empty; a null owner counts as one owner of its own; repeated rows and ids
keep a row each; an empty table gives an empty result; extra columns are ignored. A span is
``kind:start:end`` in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ["assign", "access", "hex"]
MAX_OWNERS = 3

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")

#: Weaker candidates, by kind; the value is the group where there is one.
WEAK = {
    "vendor": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    "url": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]{4,64})@"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])"),
}
_HINT = re.compile(r"gh[pousr]_|xox[abprs]-|sk_live_|AIza|://|eyJ")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{24}")
_KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)", re.A)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, order of the kind, value) of the three base kinds."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX_LONG.finditer(text)]  # runs are maximal, so short ones drop out alike
    return sorted(out, key=lambda s: (s[0], s[2]))


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def weak_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of weaker candidates that no base span overlaps."""
    out: list[tuple[int, int, str, str]] = []
    kinds = ["vendor", "url", "jwt"] if _HINT.search(text) else []
    if _LONG.search(text):
        kinds.append("mixed")
    for kind in kinds:
        for m in WEAK[kind].finditer(text):
            s, e = m.span()
            value = m[1] if m.re.groups else m[0]
            if kind == "mixed" and (_entropy(value) < 3.5 or value.lower() == value or value.upper() == value):
                continue
            out.append((s, e, kind, value))
    return _apart(out, taken)


def _apart(found: list[tuple[int, int, str, str]], taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` without what overlaps a base span or something found earlier; spans of one kind come in order and don't overlap."""
    held = _union([t[:2] for t in taken])
    kept: list[tuple[int, int, str, str]] = []
    for _, spans in groupby(found, key=lambda f: f[2]):
        starts = [a for a, _ in held]
        free = []
        for f in spans:
            i = bisect_right(starts, f[0])
            if not (i and held[i - 1][1] > f[0] or i < len(held) and held[i][0] < f[1]):
                free.append(f)
        kept += free
        held = _union(held + [f[:2] for f in free])
    return kept


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


_FOUND = "array<struct<s:long,e:long,kind:string,base:boolean,hash:string>>"


def _scan(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        base = base_spans(t) if t else []
        spans = [{"s": s, "e": e, "kind": KINDS[k], "base": True, "hash": _digest(v)} for s, e, k, v in base]
        spans += [{"s": s, "e": e, "kind": k, "base": False, "hash": _digest(v)} for s, e, k, v in (weak_spans(t, base) if t else [])]
        out.append(spans)
    return pd.Series(out)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, owner, row_hash, found): all candidate spans of each document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.xxhash64("text").alias("row_hash"), F.pandas_udf(_scan, _FOUND)(F.col("text").cast("string")).alias("found"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, documents, owners): how widely each candidate value is held; a hot value is summed a task at a time."""
    rows = found.select("doc_id", "owner", F.explode("found").alias("f"))
    pairs = rows.groupBy(F.col("f.hash").alias("hash"), "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count("*").alias("owners"))


def scan(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, row_hash and ``spans``: base spans and live weaker ones, each with its value's owners and ``live``."""
    found = cut(candidates(docs, owner), "candidates")
    spans = found.where("size(found) > 0").select("doc_id", "row_hash", F.explode("found").alias("f")).select("doc_id", "row_hash", "f.*")
    held = spans.join(ownership(found), "hash").where(F.col("base") | (F.col("owners") <= max_owners))
    span = F.struct("s", F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3).alias("k"), "kind", "e", "base", "owners", (F.col("owners") <= max_owners).alias("live"))
    # repeated rows have the same spans, so a set holds each once
    held = held.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    left = found.select("doc_id", "row_hash", "owner")
    return left.join(held, left.doc_id.eqNullSafe(held.doc_id) & left.row_hash.eqNullSafe(held.row_hash), "left").select(
        left.doc_id, left.row_hash, F.coalesce(held.spans, F.array().cast(held.schema["spans"].dataType)).alias("spans")
    )


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.s, s.e)), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document of ``documents``: counts, base digest and all spans."""
    spans, base = F.col("spans"), F.filter("spans", lambda s: s.base)
    count = lambda kind: F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s.live)).cast("long").alias("n_live"), F.size(F.filter(spans, lambda s: ~s.live)).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Documents with every reported span replaced by ``[kind]``; all columns stay, ``n_chars`` follows the new text, nothing else changes."""
    found = scan(docs, owner).where("size(spans) > 0").select("doc_id", F.col("row_hash").alias("__scan_hash"), F.col("spans").alias("__scan_spans")).dropDuplicates(["doc_id", "__scan_hash"])
    found = found.withColumnRenamed("doc_id", "__scan_doc")

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans):
            if t is not None and ss is not None:
                parts, at = [], 0
                for s in ss:
                    if s["s"] >= at:
                        parts += [t[at : s["s"]], f"[{s['kind']}]"]
                    at = max(at, s["e"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    d = docs.withColumn("__scan_key", F.xxhash64("text"))
    joined = d.join(found, d.doc_id.cast("long").eqNullSafe(found["__scan_doc"]) & d["__scan_key"].eqNullSafe(found["__scan_hash"]), "left")
    text = F.when(F.col("__scan_spans").isNull(), F.col("text")).otherwise(cover(F.col("text"), F.col("__scan_spans")))
    # a text without secrets keeps the count it came with
    changed = {"text": text, "n_chars": F.when(F.col("__scan_spans").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long"))}
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])
