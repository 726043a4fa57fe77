"""Registration of queries and readers of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries (spark, sf_dir) -> DataFrame by name, and their SQL where there is one."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(query):
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = query
            if sql:
                self.oracles[name] = sql
            return query

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Tables up to this size may be one row group, hence one task's; they are dealt out to all cores.
SMALL_BYTES = 256 << 20


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df
