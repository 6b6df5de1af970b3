"""The corpus pipeline: five operators in order, each on all that the one before it kept."""

from __future__ import annotations

from tieout.llm.common import cut
from tieout.llm.decontaminate import drop_contaminated
from tieout.llm.gam import keep_quality
from tieout.llm.secrets import redact
from tieout.llm.sentencepiece import tokenized
from tieout.llm.simhash import drop_near_duplicates


def quality(spark, docs, sf_dir):
    """Documents that the classifier, learnt from ``labels``, accepts."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark, docs, sf_dir):
    """All documents, their secrets replaced."""
    return redact(docs)


def sentencepiece(spark, docs, sf_dir):
    """Ids of each document's text."""
    return tokenized(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the classifier nor the fingerprints; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply STAGES to the documents table; between stages the rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
