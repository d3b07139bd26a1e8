"""The same jobs on streams.

Each job runs over what has arrived and stops. With a `checkpoint` (a folder in storage that all executors share) it can
be called again, by this session or another one after a restart: it goes on behind the last file it has read, with its
state, and gives the whole result so far. Without one it runs once, in a folder of its own.

What a job keeps: Spark's offsets and state in checkpoint/progress; rows that only grow in checkpoint/<name>, by batch,
so that a batch that is run again replaces itself; rows that change in tables of buckets (sources/buckets.py), of which
a batch reads and writes the buckets it touches. A micro-batch is as large as the stream's files for each trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.window import Window

from ..operators import chain
from ..operators.lifecycle import KEY, ingest, write_audit
from ..session import shared_dir
from ..sources.buckets import Buckets
from ..sources.records import statements

#: State of typed processors is kept by RocksDB.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of the tables that a job keeps, where the caller gives no number.
BUCKETS = 16


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The event table's files as a stream of statements, some files a micro-batch."""
    schema = spark.read.parquet(path).schema
    return statements(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path[:-1] + "[" + path[-1] + "]"))


def _folder(spark: SparkSession, checkpoint: str | None) -> str:
    return checkpoint or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def _typed_state(spark: SparkSession) -> Iterator[None]:
    """The state store of typed processors, for queries that start meanwhile."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def drain(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """Runs the stream over all that is there and not read yet. each gets the batches with their numbers, else the rows
    of all runs so far are returned."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").outputMode(mode).trigger(availableNow=True)
    if each:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.format("parquet").start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that batches have written below path."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if there else spark.createDataFrame([], schema)


def _written(rows: DataFrame, path: str, number: int) -> DataFrame:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={number}")


def continuous_ingest(stream: DataFrame, checkpoint: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(episodic memories, write-audit rows). Of rows with one id the last ingested counts, over all batches; the audit
    log only grows: it has a row for each batch that wrote the id."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, checkpoint)
    schema = ingest(spark.createDataFrame([], stream.schema)).schema
    table = Buckets(spark, f"{folder}/memories", ["agent_id", "id"], schema, buckets)

    def each(batch: DataFrame, number: int) -> None:
        memories = _written(ingest(batch), f"{folder}/arrived", 0)
        _written(write_audit(memories), f"{folder}/audit", number)
        table.upsert(memories, number, ["agent_id", "id"], ["seq"])

    drain(stream, folder, each)
    return table.read(), _appended(spark, f"{folder}/audit", write_audit(spark.createDataFrame([], schema)).schema)


def current_facts(stream: DataFrame, checkpoint: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The value of each key by day and seq, whatever order statements arrive in: one row of state a key."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, checkpoint)
    order = F.struct(F.col("ts_day").alias("created_day"), F.col("seq"))
    keyed = stream.where("attribute is not null and attribute <> ''").groupBy(*KEY).agg(F.max_by("value", order).alias("value"), F.max(order).alias("last"), F.count("*").alias("statements"))
    keyed = keyed.select(*KEY, "value", F.col("last.created_day").alias("created_day"), "statements")
    table = Buckets(spark, f"{folder}/current", KEY, keyed.schema, buckets)

    def each(batch: DataFrame, number: int) -> None:
        # A batch has the whole state of the keys it touches; reading it twice would run the aggregation twice.
        table.upsert(_written(batch, f"{folder}/arrived", 0), number, KEY)

    drain(keyed, folder, each, "update")
    return table.read()


def change_log(stream: DataFrame, checkpoint: str | None = None, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A row whenever the active value of a key changes. known (KEY, value, day, seq) is what held before the stream
    began; it counts at the first run of a checkpoint.

    The last value of each key is a table of buckets; a batch is put behind it by a window, rows that come too late
    for it (by day and seq) are left out."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, checkpoint)
    facts = stream.where("attribute is not null and attribute <> ''").select(*KEY, "value", F.col("ts_day").cast("int").alias("day"), F.col("seq").cast("long").alias("seq")).where("day is not null and seq is not null")
    table = Buckets(spark, f"{folder}/last", KEY, facts.schema, buckets)
    if known is not None and table.latest() is None:
        # Version 0 is what was given.
        table.write(known.select(*KEY, "value", F.col("day").cast("int").alias("day"), F.col("seq").cast("long").alias("seq")), 0)
    order, key = F.struct("day", "seq"), Window.partitionBy(*KEY)
    in_turn = key.orderBy("day", "seq")

    def each(batch: DataFrame, number: int) -> None:
        rows = _written(batch, f"{folder}/arrived", 0)
        touched = table.touched(rows)
        both = table.read(touched, number + 1).withColumn("_old", F.lit(True)).unionByName(rows.withColumn("_old", F.lit(False)))
        held = both.withColumn("_last", F.max(F.when(F.col("_old"), order)).over(key)).where(F.col("_old") | F.col("_last").isNull() | (order > F.col("_last")))
        # Of rows of one day and seq one counts.
        held = held.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "day", "seq").orderBy(F.desc("_old"), "value"))).where("_n = 1")
        told = held.select(*KEY, F.lag("value").over(in_turn).alias("old_value"), F.col("value").alias("new_value"), "day", "seq", "_old", F.lag("seq").over(in_turn).alias("_before"))
        told = told.where(~F.col("_old") & F.col("_before").isNotNull() & ~F.col("old_value").eqNullSafe(F.col("new_value")))
        _written(told.drop("_old", "_before"), f"{folder}/changes", number)
        table.write(held.groupBy(*KEY).agg(F.max_by(F.struct("value", "day", "seq"), order).alias("_row")).select(*KEY, "_row.*"), number + 1, touched)

    drain(facts, folder, each)
    return _appended(spark, f"{folder}/changes", T._parse_datatype_string("agent_id int, subject string, attribute string, old_value string, new_value string, day int, seq long"))


class _Bounded(StatefulProcessor):
    """At most capacity rows of an agent."""

    NAMES = ["agent_id", "id", "importance", "day", "seq"]

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "importance double, age int, seq long, id string")

    def handleInputRows(self, key, rows, timerValues):
        held, out = list(self.held.get()) if self.held.exists() else [], []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            held.append((float(r.importance), -int(r.ts_day), int(r.seq), r.id))
            if len(held) > self.capacity:
                victim = min(held, key=lambda h: h[:3])
                held.remove(victim)
                out.append((key[0], victim[3], victim[0], -victim[1], victim[2]))
        self.held.put([tuple(h) for h in held])
        yield pd.DataFrame(out, columns=self.NAMES)

    def close(self) -> None:
        pass


def bounded_memory(stream: DataFrame, capacity: int = 8, checkpoint: str | None = None) -> DataFrame:
    """A row for each eviction; what isn't evicted is in memory. State: at most capacity rows an agent."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, checkpoint)
    rows = stream.select("agent_id", "id", F.coalesce("importance", F.lit(0.5)).alias("importance"), F.coalesce("ts_day", F.lit(0)).alias("ts_day"), "seq")
    with _typed_state(spark):
        return drain(rows.groupBy("agent_id").transformWithStateInPandas(_Bounded(capacity), "agent_id int, id string, importance double, day int, seq long", "append", "none"), folder)


def expiry(stream: DataFrame, now: int, checkpoint: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Forget rows of items whose time to live has passed by day now, as event time gets there: rows of all items move
    the clock, which is the last day seen. Of the rows of one id in a batch the one with the last seq counts, and a
    later batch's counts instead of an earlier one's that isn't forgotten yet.

    A batch reads and writes what waits: items whose day hasn't come, however many have gone before."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, checkpoint)
    lived = stream.select("agent_id", "id", "ts_day", (F.col("ts_day") + F.col("ttl_days") + 1).cast("int").alias("day"), "seq")
    schema = T._parse_datatype_string("agent_id int, id string, day int")
    waiting = Buckets(spark, f"{folder}/waiting", ["agent_id", "id"], schema, buckets)
    clock = Buckets(spark, f"{folder}/clock", ["name"], T._parse_datatype_string("name string, day int"), 1)

    def each(batch: DataFrame, number: int) -> None:
        rows = _written(batch, f"{folder}/arrived", 0)
        clock.upsert(rows.groupBy(F.lit("day").alias("name")).agg(F.max("ts_day").cast("int").alias("day")).where("day is not null"), number, ["name"], ["day"])
        day = (clock.read(before=number + 1).first() or {"day": None})["day"]
        said = rows.where("day is not null").groupBy("agent_id", "id").agg(F.max_by("day", F.struct("seq", "day")).alias("day"))
        both = waiting.read(before=number).withColumn("_new", F.lit(0)).unionByName(said.withColumn("_new", F.lit(1)))
        held = _written(both.groupBy("agent_id", "id").agg(F.max_by("day", "_new").alias("day")), f"{folder}/held", 0)
        come = F.coalesce(F.col("day") <= F.lit(day).cast("int"), F.lit(False))
        _written(held.where(come), f"{folder}/forgotten", number)
        waiting.write(held.where(~come), number)

    drain(lived, folder, each)
    return _appended(spark, f"{folder}/forgotten", schema).where(F.col("day") <= now)


def append_chain(stream: DataFrame, key: bytes | None = None, checkpoint: str | None = None, heads: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Chain entries of audit rows in order of arrival, and of seq within a micro-batch. heads (chain_id, last_seq, head)
    are those of chains that exist already: the stream continues them; they count at the first run of a checkpoint.

    A batch joins the heads of its chains from a table of buckets, is sorted and folded as a stream of rows by
    `chain.build`, so a task holds no chain, and leaves new heads."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, checkpoint)
    schema = T._parse_datatype_string("chain_id int, last_seq long, head string")
    table = Buckets(spark, f"{folder}/heads", ["chain_id"], schema, buckets)
    if heads is not None and table.latest() is None:
        table.write(heads.select("chain_id", "last_seq", "head"), 0)

    def each(batch: DataFrame, number: int) -> None:
        # Version 0 is what was given.
        known = table.read(table.touched(batch), number + 1)
        made = _written(chain.build(batch, key, known), f"{folder}/entries", number)
        table.upsert(chain.heads(made).select("chain_id", "last_seq", "head"), number + 1, ["chain_id"], ["last_seq"])

    drain(stream, folder, each)
    return _appended(spark, f"{folder}/entries", T._parse_datatype_string(chain.ENTRY))


def refresh(stream: DataFrame, rebuild: Callable[[DataFrame], DataFrame], checkpoint: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The searchable set after each batch: only agents in buckets with new statements are rebuilt, from all of theirs.
    Statements and searchable rows are tables of the same buckets; of rows with one id the last ingested counts."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, checkpoint)
    said = Buckets(spark, f"{folder}/statements", ["agent_id"], stream.schema, buckets)
    shown = Buckets(spark, f"{folder}/searchable", ["agent_id"], rebuild(spark.createDataFrame([], stream.schema)).schema, buckets)

    def each(batch: DataFrame, number: int) -> None:
        said.upsert(batch, number, ["agent_id", "id"], ["seq"])
        touched = said.touched(batch)
        shown.write(rebuild(said.read(touched, number + 1)), number, touched)

    drain(stream, folder, each)
    return shown.read()
