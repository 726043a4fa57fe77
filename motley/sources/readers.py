"""Readers that end in (group, text) rows, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of text and group columns, in the order they are looked for.
TEXT_COLUMNS = ("text", "output", "response", "content", "generation", "completion", "sentence")
GROUP_COLUMNS = ("group", "config", "model")


def _pick(columns: list[str], wanted: str | None, names: tuple[str, ...], strict: bool) -> str | None:
    """``wanted`` if it is there; else, unless ``strict``, the first known name."""
    if wanted and wanted in columns:
        return wanted
    if wanted and strict:
        raise ValueError(f"no column {wanted!r} among {columns}")
    return next((n for n in names if n in columns), None)


def _group(column: str | None) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("default")) if column else F.lit("default")


def as_texts(df: DataFrame, text: str | None = None, group: str | None = None, strict: bool = False) -> DataFrame:
    column = _pick(df.columns, text, TEXT_COLUMNS, strict)
    if column is None:
        raise ValueError(f"no text column among {df.columns}")
    by = _pick(df.columns, group, GROUP_COLUMNS, strict)
    key = _group(by)
    return df.select(key.alias("g"), F.col(f"`{column}`").cast("string").alias("text")).where(F.trim("text") != "")


def read_csv(spark: SparkSession, path: str, text: str | None = None, group: str | None = None, delimiter: str = ",") -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", delimiter).csv(path)
    return as_texts(df, text, group)


def read_parquet(spark: SparkSession, path: str, text: str | None = None, group: str | None = None) -> DataFrame:
    return as_texts(spark.read.parquet(path), text, group)


def read_orc(spark: SparkSession, path: str, text: str | None = None, group: str | None = None) -> DataFrame:
    return as_texts(spark.read.orc(path), text, group)


def read_jsonl(spark: SparkSession, path: str, field: str | None = None, group: str | None = None) -> DataFrame:
    """Each row's first known field that is not null; a row with none raises."""
    df = spark.read.json(path)
    if field:
        return as_texts(df, field, group, strict=True)
    fields = [F.col(f"`{n}`").cast("string") for n in TEXT_COLUMNS if n in df.columns]
    if not fields:
        raise ValueError(f"no text field among {df.columns}")
    by = _pick(df.columns, group, GROUP_COLUMNS, False)
    value = F.coalesce(*fields, F.raise_error(F.lit("a row without a text field")).cast("string"))
    return df.select(_group(by).alias("g"), value.alias("text"))


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of strings or objects, or an object with such a list in ``data``."""
    raw = spark.read.option("wholetext", True).text(path)
    listed = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    items = raw.select(F.explode(F.from_json(listed, "array<string>")).alias("item"))
    fields = [F.get_json_object("item", f"$.{n}") for n in TEXT_COLUMNS]
    return items.select(F.lit("default").alias("g"), F.coalesce(*fields, F.col("item")).alias("text"))


def read_grouped_json(spark: SparkSession, path: str) -> DataFrame:
    """One object {group: [texts]}."""
    raw = spark.read.option("wholetext", True).text(path)
    groups = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("g", "texts"))
    return groups.select("g", F.explode("texts").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text: one stripped text per line that is not blank."""
    return spark.read.text(path).select(F.lit("default").alias("g"), F.trim("value").alias("text")).where("text <> ''")


def read_texts(spark: SparkSession, path: str, **options) -> DataFrame:
    """By file extension: csv, tsv, parquet, orc, jsonl, json; anything else as lines."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "tsv":
        return read_csv(spark, path, delimiter="\t", **options)
    reader = {"csv": read_csv, "parquet": read_parquet, "orc": read_orc, "jsonl": read_jsonl, "ndjson": read_jsonl, "json": read_json_list}.get(kind, read_lines)
    return reader(spark, path, **options) if options else reader(spark, path)


def validate_groups(texts: DataFrame, least: int = 2) -> DataFrame:
    """Raises while running if a group has fewer texts than a diversity metric needs."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("g"))
    return texts.withColumn("_n", n).where(F.when(F.col("_n") < least, F.raise_error(F.concat(F.lit("too few texts in group "), F.col("g"))).cast("boolean")).otherwise(True)).drop("_n")


def validate_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to the schema, in its order; a missing or superfluous column raises, and so does a bad value."""
    missing = [f.name for f in schema if f.name not in df.columns]
    extra = [c for c in df.columns if c not in schema.names]
    if missing or extra:
        raise ValueError(f"missing {missing}, superfluous {extra}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, compression: str = "gzip", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).json(path)


def write_pivot(df: DataFrame, rows: str, columns: str, value: str, names: list[str], path: str) -> None:
    write_csv(df.groupBy(rows).pivot(columns, names).agg(F.avg(value)), path)


def dump_experiments(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per run with its metrics nested, for a JSON round trip."""
    nested = metrics.groupBy("run_id").agg(F.collect_list(F.struct(*[c for c in metrics.columns if c != "run_id"])).alias("metrics"))
    return runs.join(nested, "run_id", "left")


def load_experiments(dump: DataFrame) -> tuple[DataFrame, DataFrame]:
    return dump.drop("metrics"), dump.select("run_id", F.inline("metrics"))
