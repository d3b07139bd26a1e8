"""The audit log as a table in folders of operation and day, with Bloom filters on the items in its files: what
happened to an item, and what an operation did, without reading the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: the unit that a look-up of an item skips, and distinct items that its filter expects.
ROW_GROUP, DISTINCT = 16 << 20, 1 << 20


def append_log(audit: DataFrame, path: str, row_group: int = ROW_GROUP, distinct: int = DISTINCT) -> None:
    """Adds audit rows (op, day, item_id, ...). Rows of one operation and day lie together, in order of items, in
    files of bounded size: a day with very many is several files."""
    rows = audit.hint("rebalance", "op", "day").sortWithinPartitions("op", "day", "item_id")
    writer = rows.write.mode("append").partitionBy("op", "day").option("parquet.block.size", row_group)
    writer.option("parquet.bloom.filter.enabled#item_id", "true").option("parquet.bloom.filter.expected.ndv#item_id", distinct).parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def for_item(spark: SparkSession, path: str, item_id: str) -> DataFrame:
    """All entries of an item. Row groups whose range of items or Bloom filter rules it out aren't read."""
    return log(spark, path).where(F.col("item_id") == item_id)


def by_op(spark: SparkSession, path: str, op: str, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """All entries of an operation, on some days. Other folders aren't listed among the files to read."""
    found = log(spark, path).where(F.col("op") == op)
    found = found if first_day is None else found.where(F.col("day") >= first_day)
    return found if last_day is None else found.where(F.col("day") <= last_day)
