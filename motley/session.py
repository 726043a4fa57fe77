"""Session builder and the folder for checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 1000


def builder(name: str = "motley", master: str | None = None) -> SparkSession.Builder:
    """A session with adaptive execution, UTC times and Arrow; a cluster's own settings win over these."""
    made = SparkSession.builder.appName(name)
    if master:
        made = made.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    if memory := os.environ.get("MOTLEY_DRIVER_MEMORY"):
        settings["spark.driver.memory"] = memory
    return made.config(map=settings)


def checkpoints(spark: SparkSession) -> str:
    """Makes sure that checkpoint() has a folder: the cluster's spark.checkpoint.dir, or on one machine a temporary one where it is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="motley-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the checkpoint folder: the next pass does not make it again, and neither lineage
    nor what the optimizer has inferred about the columns grows with the passes (checkpoint() keeps the latter)."""
    spark = df.sparkSession
    path = f"{checkpoints(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per context, for clusters where only the driver can import it.

    Where the size of Arrow batches stands at its default it is lowered as well: a row may be a text of megabytes,
    and each running task holds a batch on both sides of the pipe.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_motley_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="motley-code-")) / "motley.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("motley") / path.relative_to(root))
    context.addPyFile(str(target))
    context._motley_shipped = True
