"""Tables that cut lineage, in the folder every executor shares, and sizes that follow the input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged as staged


#: Bytes of texts up to which chunks and parts have a fixed size.
GROWN = 32 << 30


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def grain(spark: SparkSession, n_bytes: int, chunk_bytes: int = 4 << 20, part_bytes: int = 8 << 20) -> tuple[int, int]:
    """(chunks, parts): groups of documents, and hash ranges. Each chunk sends each part a row; beyond GROWN bytes both
    grow with the square root of the input, so that rows and bytes sent stay in proportion to it."""
    grown = max(1.0, math.sqrt(n_bytes / GROWN))
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / (chunk_bytes * grown))), max(12, math.ceil(n_bytes / (part_bytes * grown)))


#: A key with more rows than this, or than this share of all rows, is joined by broadcast; there can't be more of them
#: than the share's inverse.
HOT_ROWS, HOT_SHARE = 1000, 1e-6


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left joined with right, which is written and has a row for each key with the number of left's rows that have it.

    Keys with many rows are broadcast, so that their rows stay where they are: by their least number, there are fewer
    than 1 / HOT_SHARE of them.
    """
    total, most = right.agg(F.sum(count), F.max(count)).first()
    least = max(HOT_ROWS, math.ceil((total or 0) * HOT_SHARE))
    if (most or 0) <= least:
        return left.join(right.drop(count), key)
    hot, rest = right.where(F.col(count) > least).drop(count), right.where(F.col(count) <= least).drop(count)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return left.join(F.broadcast(hot), key).unionByName(others)
