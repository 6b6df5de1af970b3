"""Keys that hold a great share of the rows: dealt over parts, with the same results."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tieout.llm import shards, suffixes
from tieout.llm.common import PARTS, for_each_salt, hot_parts, salted


def test_salted_join_loses_and_repeats_nothing(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_parts(counts, 20_000)
    assert hot.count() < PARTS and hot.agg(F.sum("parts")).first()[0] < 2 * PARTS
    dealt = salted(rows, hot, "key", ["id"])
    assert dealt.where("key = 0").groupBy("salt").count().agg(F.max("count")).first()[0] < 40
    joined = dealt.join(for_each_salt(counts, hot, "key"), ["key", "salt"])
    n = {r.key: r.n for r in counts.collect()}
    got = joined.select("id", "key", "n").collect()
    assert len(got) == 20_000 and len({r.id for r in got}) == 20_000 and all(n[r.key] == r.n for r in got)


def test_copies_stay_together_under_quotas(spark):
    texts = ["one text that fills a third of all rows"] * 400 + [f"pair {k // 2}" for k in range(200)] + [f"alone {k}" for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards.shard_documents(docs).collect()
    n, held = Counter(r.shard for r in rows), defaultdict(list)
    assert len(rows) == 1200 and set(n.values()) == {50}
    for r in rows:
        held[texts[r.doc_id]].append(r.shard)
    assert sum(len(set(held[f"pair {k}"])) > 1 for k in range(100)) <= 10  # by hash alone 96 of 100 would be split
    assert len(set(held[texts[0]])) <= 24


def test_window_digests_equal_suffix_arrays(spark):
    """A passage in all documents, beside others in few: the way of hot hashes removes what the arrays remove."""
    passage = " ".join(f"common{k}" for k in range(70))
    rows = [(k, f"start {k} " + passage + f" and {k} " + " ".join(f"w{(k // 2) * 1000 + j}" for j in range(90))) for k in range(60)]
    base = spark.createDataFrame(rows, "rid long, text string")

    def covered(shard_bytes):
        out = {}
        for r in suffixes.repeated_intervals(base, shard_bytes=shard_bytes).collect():
            out[r.rid] = frozenset(i for s in r.spans for i in range(s["a"], s["e"]))
        return out

    arrays, digests = covered(suffixes.SHARD_BYTES), covered(64)
    assert len(arrays) == 60 and arrays == digests
