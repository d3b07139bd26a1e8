"""Operator 1, sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard levels. At each node every child draws -ln(u) / weight with a u hashed from
the key and the child's name, and the least draw wins, so a child gets rows in proportion to its weight, and a
changed weight moves rows only into or out of the subtrees whose weight changed. Law `key`: the key and the tree
decide. A new shard is added as a region of its own, so all other draws stay as they were and rows move into it only.

Cases: a null key hashes as the text "null"; a null text has size 1 and checksum 0; equal rows get one shard and
different slots; a shard of weight 0 gets none; an empty table gives an empty result; other columns are left alone by
`place` and not carried by `slots`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A leaf is (name, weight, shard number); a node is (name, [children]).
Node = tuple

#: Equal rows that are dealt at once.
EQUAL = 1 << 16


def tree(n_regions: int = 2, n_racks: int = 2, n_shards: int = 2) -> list[Node]:
    """Regions, racks and shards of equal weight, shards numbered from 0."""
    number = iter(range(n_regions * n_racks * n_shards))
    return [(f"region{r}", [(f"rack{k}", [(f"shard{s}", 1.0, next(number)) for s in range(n_shards)]) for k in range(n_racks)]) for r in range(n_regions)]


def weight(node: Node) -> float:
    return sum(map(weight, node[1])) if isinstance(node[1], list) else float(node[1])


def leaves(nodes: Sequence[Node]) -> list[int]:
    return [x for n in nodes for x in (leaves(n[1]) if isinstance(n[1], list) else [n[2]])]


def grown(nodes: Sequence[Node], shard_weight: float = 1.0) -> list[Node]:
    """The tree with one more shard, in a region of its own."""
    shard = max(leaves(nodes)) + 1
    return [*nodes, (f"region-of-{shard}", [("rack0", [("shard0", shard_weight, shard)])])]


def place(key: Column, nodes: Sequence[Node], path: str = "") -> Column:
    """The shard of a key."""
    nodes = [n for n in nodes if weight(n) > 0]

    def below(node: Node) -> Column:
        return place(key, node[1], f"{path}/{node[0]}") if isinstance(node[1], list) else F.lit(int(node[2])).cast("int")

    if len(nodes) == 1:
        return below(nodes[0])
    text = F.coalesce(key.cast("string"), F.lit("null"))
    # 52 bits of the hash, from the middle of their step: never 0 or 1.
    draws = [F.struct((-F.ln((F.conv(F.substring(F.md5(F.concat(text, F.lit(f"|{path}/{n[0]}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)) / weight(n)).alias("draw"), F.lit(i).alias("i")) for i, n in enumerate(nodes)]
    won = F.array_min(F.array(*draws))["i"]
    out = below(nodes[-1])
    for i in range(len(nodes) - 2, -1, -1):
        out = F.when(won == i, below(nodes[i])).otherwise(out)
    return out


def slots(docs: DataFrame, nodes: Sequence[Node], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row; slots of a shard are gapless from 0.

    Equal rows are counted before they are dealt, and given their slots after. A shard's rows are numbered in 4,096
    buckets by three digits of an MD5 of the row, so no task sorts a shard, nor all rows of one key.
    """
    rows = docs.select(F.col(key).alias(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    same = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("bucket", F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("null")), "size", "text_crc32").cast("binary")), 1, 3), 16, 10).cast("int"))
    same = same.withColumn("shard", place(F.col(key), nodes)).withColumn("grown_shard", place(F.col(key), grown(nodes)))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy(key, "size", "text_crc32")
    numbered = same.withColumn("before", F.sum("n").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)))
    # At most 4,096 rows a shard.
    starts = same.groupBy("shard", "bucket").agg(F.sum("n").alias("in_bucket"))
    starts = starts.select("shard", "bucket", (F.sum("in_bucket").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("in_bucket")).alias("start"))
    placed = numbered.join(starts, ["shard", "bucket"]).withColumn("slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL).cast("long"))))
    placed = placed.withColumn("slot", F.explode(F.sequence("slots", F.least(F.col("slots") + EQUAL, "n") - 1)))
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.coalesce("before", F.lit(0)) + F.col("slot")).cast("long").alias("slot"), "grown_shard")
