"""What the operators share: the checkpoint folder, written tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of one word and of what parts words: words are runs outside {0x20, 0x09-0x0D}.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset a temporary one, on one machine only (tests): executors
    elsewhere would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if context.getCheckpointDir():
            return context.getCheckpointDir()
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="motley-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/motley/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reachable.

    Each round takes the least label among neighbours, then jumps to that
    label's own label, so long chains shorten by half or better.  Every round
    is a written table; only the count of changed labels reaches the driver.
    Self-loops are allowed, null ends are dropped.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        told = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(told, labels.node == told.a).select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = written(near.join(jump, near.near == jump["at"], "left").select("node", F.least("near", "further").alias("new"), (F.col("label") != F.least("near", "further")).alias("changed")), "labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("changed").limit(1).count() == 0:
            return labels
