"""Streaming jobs that stop and go on, in another process too, and tables of buckets."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chain, lifecycle
from palimpsest.plans import registry
from palimpsest.sources import records
from palimpsest.sources.buckets import Buckets
from palimpsest.streaming import jobs

NOW = 28


def rebuild(rows):
    m = lifecycle.ingest(rows)
    return lifecycle.candidates(m, lifecycle.consolidate(m, lineage=False), NOW)


def run_all(spark, folder):
    """Every job over what is in folder/events, a file a micro-batch, going on from folder/<job>."""
    stream = jobs.event_stream(spark, f"{folder}/events")
    at = lambda name: f"{folder}/{name}"
    memories, log = jobs.continuous_ingest(stream, at("ingest"))
    return {
        "memories": memories, "audit": log, "current": jobs.current_facts(stream, at("current")), "changes": jobs.change_log(stream, at("changes")),
        "evicted": jobs.bounded_memory(stream, 5, at("bounded")), "forgotten": jobs.expiry(stream, NOW, at("expiry")), "chain": jobs.append_chain(registry._log_of(stream), registry.KEY, at("chain")), "shown": jobs.refresh(stream, rebuild, at("refresh")),
    }


FIRST_RUN = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
import test_streams
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", {folder!r} + "/warehouse").getOrCreate()
test_streams.run_all(spark, {folder!r})
"""


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_jobs_go_on_after_a_restart(spark, small, tmp_path):
    """Two files are read by a process of its own, which ends; another file arrives, and this session goes on."""
    folder, tests = str(tmp_path), Path(__file__).resolve().parent
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("_day", F.expr("datediff(ts, date '2024-01-01')"))
    parts = [events.where(c).drop("_day").coalesce(1) for c in ("_day < 9", "_day between 9 and 20", "_day > 20")]
    for part in parts[:2]:
        part.write.mode("append").parquet(f"{folder}/events")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tests.parent), str(tests), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", FIRST_RUN.format(root=str(tests.parent), tests=str(tests), folder=folder)], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    parts[2].write.mode("append").parquet(f"{folder}/events")
    got = run_all(spark, folder)
    stated = records.statements(events.drop("_day"))
    memories = lifecycle.ingest(stated)
    assert rows(got["memories"]) == rows(memories)
    assert rows(got["audit"]) == rows(lifecycle.write_audit(memories))
    active = lifecycle.active(lifecycle.consolidate(memories))
    assert rows(got["current"].drop("statements")) == rows(active.select(*lifecycle.KEY, "value", "created_day"))
    assert got["current"].agg(F.sum("statements")).first()[0] == lifecycle.facts(memories).count()
    kept = {(r.agent_id, r.id) for r in lifecycle.working_memory(memories, 5).collect()}
    assert {(r.agent_id, r.id) for r in got["evicted"].collect()} == {(r.agent_id, r.id) for r in memories.collect()} - kept
    expired = memories.where(F.col("created_day") + F.col("ttl_days") + 1 <= NOW)
    assert rows(got["forgotten"]) == rows(expired.select("agent_id", "id", (F.col("created_day") + F.col("ttl_days") + 1).alias("day")))
    assert rows(got["shown"]) == rows(rebuild(stated))
    report = chain.verify(got["chain"], registry.KEY).collect()
    assert all(r.ok and r.content_ok for r in report) and sum(r.length for r in report) == events.count()
    # Changes: the last one of each key leads to its current value.
    last = got["changes"].groupBy(*lifecycle.KEY).agg(F.max_by("new_value", F.struct("day", "seq")).alias("value"))
    changed = active.join(last.withColumnRenamed("value", "said"), lifecycle.KEY)
    assert changed.count() == last.count() > 0 and changed.where("value <> said").count() == 0


SAID = "agent_id int, seq long, id string, ts_day int, text string, subject string, attribute string, value string, importance double, ttl_days int"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SAID).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SAID).parquet(f"{folder}/in")


def said(agent, seq, id_, value, day=1, ttl=None):
    return agent, seq, id_, day, f"city is {value}", "user", "city", value, 0.5, ttl


def test_last_one_of_an_id_wins_over_batches(spark, tmp_path):
    jobs.continuous_ingest(arrive(spark, tmp_path, [said(0, 1, "A", "Rome"), said(0, 2, "B", "Oslo"), said(1, 9, "A", "Bern")]), f"{tmp_path}/job")
    jobs.continuous_ingest(arrive(spark, tmp_path, [said(0, 3, "A", "Wien"), said(1, 4, "A", "late"), said(2, 1, "C", "Nice")]), f"{tmp_path}/job")
    memories, audit = jobs.continuous_ingest(arrive(spark, tmp_path, [said(0, 3, "A", "Graz")]), f"{tmp_path}/job")
    assert {(r.agent_id, r.id): r.value for r in memories.collect()} == {(0, "A"): "Graz", (0, "B"): "Oslo", (1, "A"): "Bern", (2, "C"): "Nice"} and memories.count() == 4
    assert audit.count() == 7


def test_what_held_before_counts_at_the_first_run(spark, tmp_path):
    known = spark.createDataFrame([(0, "user", "city", "Rome", 3, 7)], "agent_id int, subject string, attribute string, value string, day int, seq long")
    log = jobs.change_log(arrive(spark, tmp_path, [said(0, 8, "A", "Rome", 4), said(0, 9, "B", "Oslo", 5), said(1, 1, "C", "Bern", 1)]), f"{tmp_path}/log", known)
    assert [(r.old_value, r.new_value, r.day) for r in log.collect()] == [("Rome", "Oslo", 5)]
    first = chain.build(spark.createDataFrame([(0, 0, 1, "write", "M0", "x"), (0, 1, 1, "write", "M1", "x")], "chain_id int, seq long, day int, op string, item_id string, detail string"))
    for _ in range(2):
        stream = arrive(spark, tmp_path, [said(0, 20, "D", "Wien"), said(5, 21, "E", "Graz")]).select(F.col("agent_id").alias("chain_id"), "seq", F.col("ts_day").alias("day"), F.lit("write").alias("op"), F.col("id").alias("item_id"), F.col("text").alias("detail"))
        made = jobs.append_chain(stream, checkpoint=f"{tmp_path}/chain", heads=chain.heads(first))
    # Two entries stood; the three rows of the log above are read too.
    assert {(r.chain_id, r.ok, r.length) for r in chain.verify(first.unionByName(made)).collect()} == {(0, True, 6), (5, True, 2), (1, True, 1)}


def test_expiry_of_an_item_that_is_said_again(spark, tmp_path):
    got = jobs.expiry(arrive(spark, tmp_path, [said(0, 1, "A", "Rome", 1, 5), said(0, 2, "B", "Oslo", 1, 5), said(0, 3, "Z", "x", 2)]), 30, f"{tmp_path}/job")
    got = jobs.expiry(arrive(spark, tmp_path, [said(0, 4, "A", "Rome", 4, 5), said(0, 5, "Z", "x", 20)]), 30, f"{tmp_path}/job")
    assert {(r.id, r.day) for r in got.collect()} == {("A", 10), ("B", 7)}


def test_files_read_a_batch_do_not_grow_with_history(spark, tmp_path):
    seen = []
    for i in range(6):
        stream = arrive(spark, tmp_path, [said(i % 2, 10 * i + k, f"M{i}-{k}", f"v{k}") for k in range(3)])
        shown = jobs.refresh(stream, rebuild, f"{tmp_path}/job", buckets=8)
        table = Buckets(spark, f"{tmp_path}/job/statements", ["agent_id"], n=8)
        touched = table.touched(spark.createDataFrame([(i % 2,)], "agent_id int"))
        seen.append(len(table.read(touched).inputFiles()))
    assert seen == [1] * 6
    assert sorted((r.agent_id, r.id, r.created_day) for r in shown.collect()) == sorted((r.agent_id, r.id, r.created_day) for r in rebuild(spark.read.schema(SAID).parquet(f"{tmp_path}/in")).collect())
    # Old versions are cleared: those of the last two manifests stay.
    assert len(table.versions()) == 2 and len({p.parts[-3] for p in Path(tmp_path / "job/statements/data").glob("*/bucket=*/*.parquet")}) <= 3


def test_table_of_buckets(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, n long")
    table = Buckets(spark, str(tmp_path / "t"), ["k"], n=4)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    table.write(frame([(i, "a", i) for i in range(20)]), 0)
    table.upsert(frame([(3, "b", 99), (3, "old", 1), (40, "c", 0)]), 1, ["k"], ["n"])
    held = {r.k: r.v for r in table.read().collect()}
    assert held == {**{i: "a" for i in range(20)}, 3: "b", 40: "c"} and table.read().count() == 21
    table.upsert(frame([(3, "older", 5)]), 2, ["k"], ["n"])
    assert table.read(table.touched(frame([(3, "", 0)]))).where("k = 3").first().v == "b"
    # A version that is written again replaces itself; one without a manifest isn't seen.
    table.upsert(frame([(5, "x", 50)]), 2, ["k"], ["n"])
    assert table.read().where("k = 5").first().v == "x" and table.versions() == [1, 2]
    frame([(6, "lost", 6)]).write.parquet(str(tmp_path / "t/data/3/bucket=1"))
    assert table.read().where("v = 'lost'").count() == 0
    with pytest.raises(ValueError, match="buckets, not"):
        Buckets(spark, str(tmp_path / "t"), ["k"], n=8).read()
    with pytest.raises(ValueError, match="several buckets"):
        table.upsert(frame([]), 4, ["v"])
    with pytest.raises(ValueError, match="aren't touched"):
        table.write(frame([(i, "a", i) for i in range(20)]), 5, [0])
    table.write(frame([]), 6, table.touched(frame([(5, "", 0)])))
    assert table.read().where("k = 5").count() == 0 and table.read().count() > 0


def test_expiry_keeps_no_python_state(spark, tmp_path):
    """An item's state isn't handed to Python one by one. A is said again before its day comes."""
    job = f"{tmp_path}/gone"
    assert jobs.expiry(arrive(spark, tmp_path, [said(0, 5, "A", "Rome", 4, 3), said(0, 6, "B", "Rome", 4, 9), said(0, 8, "D", None, 6), said(3, 1, "E", "Bern", 2)]), 30, job).count() == 0
    second = arrive(spark, tmp_path, [said(0, 9, "A", "Oslo", 7, 2), said(0, 10, "H", "Oslo", 12), said(3, 2, "I", "Bern", 9)])
    assert {(r.id, r.day) for r in jobs.expiry(second, 30, job).collect()} == {("A", 10)}
    assert {(r.id, r.day) for r in jobs.expiry(arrive(spark, tmp_path, [said(0, 11, "K", "x", 40, 1)]), 30, job).collect()} == {("A", 10), ("B", 14)}
    assert not (tmp_path / "gone" / "progress" / "state").exists()


def test_changes_keep_no_python_state(spark, tmp_path):
    """A key's state isn't handed to Python one by one; late rows, equal rows and null values count as before."""
    job = f"{tmp_path}/log"
    log = jobs.change_log(arrive(spark, tmp_path, [said(0, 5, "A", "Rome", 4), said(0, 6, "B", "Rome", 4), said(0, 7, "C", None, 5), said(0, 8, "D", None, 6), said(3, 1, "E", "Bern", 2)]), job)
    assert [(r.old_value, r.new_value, r.seq) for r in log.collect()] == [("Rome", None, 7)]
    # A late row, one of the same day and seq, and a change behind them.
    second = arrive(spark, tmp_path, [said(0, 4, "F", "late", 3), said(0, 8, "G", "twin", 6), said(0, 9, "A", "Oslo", 7), said(0, 10, "H", "Oslo", 12), said(3, 2, "I", "Bern", 9)])
    assert {(r.agent_id, r.old_value, r.new_value, r.seq) for r in jobs.change_log(second, job).collect()} == {(0, "Rome", None, 7), (0, None, "Oslo", 9)}
    assert not (tmp_path / "log" / "progress" / "state").exists()
