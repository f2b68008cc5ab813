"""Reading labelled corpora and writing job results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.functions.fixed_values import FEATURE_NAMES

CORPUS_COLUMNS = ["URL", "label"]


def read_corpus(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Labelled URLs as (url, label) text columns.

    CSV files may carry further columns; the header is checked, then only the two
    columns are read, both as strings (no inference pass over the data).
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        missing = [c for c in CORPUS_COLUMNS if c not in header]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        schema = ", ".join(f"`{c}` string" for c in header)
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", False).schema(schema).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
        missing = [c for c in CORPUS_COLUMNS if c not in raw.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
    return raw.select(F.col("URL").alias("url"), F.col("label").cast("string").alias("label"))


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split") -> None:
    """One folder per split; together they are the full table."""
    writer = df.write.mode("overwrite").partitionBy(split_col).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet", split_col: str = "split") -> DataFrame:
    """Rows of one split; the filter prunes to its folder."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    return reader.load(path).where(F.col(split_col) == split)


def append_scans(rows: DataFrame, path: str) -> None:
    """Append history rows, one folder per scan date.

    Rows of a date are spread over the write tasks as they come; adaptive execution
    joins small ones, so one busy date is never written by one task.
    """
    dated = rows.withColumn("scan_date", F.to_date("scanned_at"))
    dated.hint("rebalance", "scan_date").write.mode("append").partitionBy("scan_date").parquet(path)


def append_scan_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch to its own folder; a replay replaces it instead of repeating it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A result table as CSV (with header) or JSON lines."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def feature_schema_table(spark: SparkSession, model_name: str, features: list[str] | None = None) -> DataFrame:
    """The one-row description of a model's inputs."""
    names = features or FEATURE_NAMES
    return spark.range(1).select(
        F.lit(model_name).alias("model_name"),
        F.lit(len(names)).alias("feature_count"),
        F.array(*[F.lit(n) for n in names]).alias("features"),
        F.lit("Phishing").alias("positive_class"),
        F.lit("Legitimate").alias("negative_class"),
    )
