"""Tables cut from their lineage: written to the folder that a cluster shares, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); where that is unset, a new local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tieout-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Compressed bytes of a written table up to which Spark may broadcast it.
SMALL = 1 << 19


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that shuffle: it grows with the input, and a broadcast is built whole on the driver."""
    return df.hint("merge")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors don't lose it, and its plan ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tieout-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tieout_path = path
    return out


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as :func:`written`, and no side of a broadcast unless it is small.

    Spark takes a table's size from its compressed files and what is selected of them, many times less
    than its rows need in memory, so only tables of up to ``SMALL`` bytes are left to be broadcast.
    """
    out = written(df, name)
    files, where = _at(df.sparkSession, out._tieout_path)
    if files.getContentSummary(where).getLength() <= SMALL:
        return out
    large = by_shuffle(out)
    large._tieout_path = out._tieout_path
    return large


def _at(spark: SparkSession, path: str) -> tuple:
    """The path's file system and the path, as Hadoop knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def discard(df: DataFrame | None) -> None:
    """Delete a table that :func:`cut` wrote and that nothing reads any more."""
    path = getattr(df, "_tieout_path", None)
    if path:
        files, where = _at(df.sparkSession, path)
        files.delete(where, True)
