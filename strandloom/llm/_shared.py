"""Small helpers that every corpus operator uses: table access, shared storage, keyed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.storage import discard, fresh_path, settled, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): ``text_key`` tells rows that share an id but not a text apart; null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


__all__ = ["discard", "fresh_path", "keyed_text", "settled", "shared_dir", "table"]
