"""A table in buckets and versions: a write replaces the buckets it touches, a reader sees one version whole.

    path/data/<version>/bucket=<b>/...   the rows of buckets that the version wrote
    path/manifest/<version>.json         for each bucket, the version that holds its rows

A version becomes visible by the rename of its manifest, which is small (a number for each bucket), so a write that is
broken off leaves the table as it was, and one that is done again replaces itself. Files of a version that no kept
manifest names are deleted. A hot bucket is written as several files: rows are rebalanced, not dealt by bucket alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Buckets:
    """by: the columns whose hash is the bucket; rows that are read or replaced together share them. n: their number,
    fixed when the table is first written; choose it so that a bucket has some hundred megabytes."""

    spark: SparkSession
    path: str
    by: Sequence[str]
    schema: T.StructType | None = None
    n: int = 64
    keep: int = 2
    _known: dict[int, dict] = field(default_factory=dict, repr=False)

    def _at(self, *parts: object):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: object) -> list[str]:
        fs, path = self._at(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        """{n, schema, buckets: {bucket: version}}"""
        if version not in self._known:
            fs, path = self._at("manifest", f"{version}.json")
            stream = fs.open(path)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            found = json.loads(text)
            self._known[version] = found | {"buckets": {int(b): v for b, v in found["buckets"].items()}}
        return self._known[version]

    def latest(self, before: int | None = None) -> int | None:
        return max((v for v in self.versions() if before is None or v < before), default=None)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.by]), F.lit(self.n)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: at most n numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def paths(self, buckets: Sequence[int] | None = None, before: int | None = None) -> list[str]:
        version = self.latest(before)
        if version is None:
            return []
        held = self.manifest(version)
        if held["n"] != self.n:
            raise ValueError(f"{self.path} has {held['n']} buckets, not {self.n}")
        wanted = held["buckets"] if buckets is None else {b: held["buckets"][b] for b in buckets if b in held["buckets"]}
        return [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(wanted.items())]

    def read(self, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the latest version (before another), of all buckets or of some."""
        paths, schema = self.paths(buckets, before), self.schema
        if schema is None:
            version = self.latest()
            if version is None:
                raise ValueError(f"{self.path} has no version yet, and no schema was given")
            schema = T.StructType.fromJson(self.manifest(version)["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, version: int, touched: Sequence[int] | None = None) -> None:
        """rows are all rows of the buckets touched (all there are, if none are named); other buckets stay."""
        last = self.latest(version)
        held = self.manifest(last)["buckets"] if last is not None else {}
        if last is not None and self.manifest(last)["n"] != self.n:
            raise ValueError(f"{self.path} has {self.manifest(last)['n']} buckets, not {self.n}")
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        made = {int(n.removeprefix("bucket=")) for n in self._names("data", version) if n.startswith("bucket=")}
        stay = {b: v for b, v in held.items() if touched is not None and b not in set(touched)}
        if made & set(stay):
            raise ValueError(f"rows of buckets that aren't touched: {sorted(made & set(stay))[:5]}")
        self._publish(version, {"n": self.n, "schema": json.loads(rows.schema.json()), "buckets": stay | dict.fromkeys(sorted(made), version)})
        self._clear()

    def upsert(self, rows: DataFrame, version: int, key: Sequence[str], order: Sequence[str] = ()) -> None:
        """Of the rows of one key, old and new, the last by order stays; where that is equal, a new one. Reads and
        writes the touched buckets only. The key has to hold the columns of the buckets."""
        if missing := set(self.by) - set(key):
            raise ValueError(f"rows of one key could be in several buckets: {sorted(missing)}")
        touched = self.touched(rows)
        old = self.read(touched, version) if self.latest(version) is not None else self.spark.createDataFrame([], rows.schema)
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        row = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order], F.col("_new")))
        self.write(both.groupBy(*[F.col(c) for c in key]).agg(row.alias("_row")).select("_row.*"), version, touched)

    def _publish(self, version: int, manifest: dict) -> None:
        fs, path = self._at("manifest", f"{version}.json")
        _, draft = self._at("manifest", f"_{version}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        fs.delete(path, False)
        if not fs.rename(draft, path):
            raise OSError(f"{path} can't be written")
        self._known.pop(version, None)

    def _clear(self) -> None:
        """Files that only dropped manifests name go, and these manifests."""
        versions = self.versions()
        kept = {(b, v) for version in versions[-self.keep :] for b, v in self.manifest(version)["buckets"].items()}
        for version in versions[: -self.keep]:
            for b, v in self.manifest(version)["buckets"].items():
                if (b, v) not in kept:
                    fs, path = self._at("data", v, f"bucket={b}")
                    fs.delete(path, True)
            fs, path = self._at("manifest", f"{version}.json")
            fs.delete(path, False)
            self._known.pop(version, None)
