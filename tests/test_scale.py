"""Block joins, the kept index, hot keys, segments of chains and the audit log's folders: against plain ways."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import chain, lifecycle, quantised, search
from palimpsest.session import staged
from palimpsest.sources import audit

KEY = b"test-signing-key"


def vectors(spark, n, dim=16, agents=1, seed=0, spread=0.9, name="vec_id"):
    """Unit vectors around 200 centres, the same in every run."""

    def make(batches):
        centres = np.random.default_rng(1).normal(size=(200, dim))
        for batch in batches:
            i = batch.column("id").to_numpy()
            v = centres[i % 200] + spread * np.stack([np.random.default_rng(int(x) * 7 + seed).normal(size=dim) for x in i])
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            yield pa.record_batch([pa.array(i), pa.array(((i // 200) % agents).astype(np.int32)), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], names=[name, "agent_id", "embedding"])

    return spark.range(n).repartition(4).mapInArrow(make, f"{name} long, agent_id int, embedding array<float>")


def test_block_join_equals_the_scan(spark, monkeypatch):
    v = vectors(spark, 600, agents=3).withColumn("agent_id", F.when(F.col("vec_id") % 5 == 0, F.col("agent_id")).otherwise(9)).withColumn("until", F.when(F.col("vec_id") % 3 == 0, 4))
    # Copies: equal similarities go by id.
    v = v.unionByName(v.where("vec_id < 60").withColumn("vec_id", F.col("vec_id") + 5000)).cache()
    q = v.where("vec_id < 400").select(F.col("vec_id").alias("query_id"), "agent_id", "embedding", (F.col("vec_id") % 9).cast("int").alias("day"))
    q = q.unionByName(q.limit(2).withColumns({"agent_id": F.lit(77), "query_id": F.col("query_id") + 9000}))
    rows = lambda: sorted((r.query_id, r.rank, r.vec_id, round(r.sim, 9)) for r in search.exact_top(v, q, 7).collect())
    whole = rows()
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    assert rows() == whole
    # The agent of most rows is cut into blocks; a task holds few queries at once.
    monkeypatch.setattr(search, "BLOCK", 64)
    monkeypatch.setattr(search, "AT_ONCE", 5)
    assert rows() == whole and len(whole) == 400 * 7
    monkeypatch.setattr(search, "BROADCAST_AGENTS", 0)
    assert rows() == whole


def test_ties_at_the_edge_go_by_id():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sim, ids = rng.integers(0, 4, (6, 40)).astype(float), np.sort(rng.choice(1000, 40, replace=False))
        a, b = search._top(sim, ids, 5)
        for row, s, i in zip(sim, a, b):
            order = np.lexsort((ids, -row))[:5]
            assert (s == row[order]).all() and (i == ids[order]).all()


def test_index_of_100_000_vectors_reaches_its_recall(spark, tmp_path):
    v = vectors(spark, 100_000, dim=32).cache()
    q = vectors(spark, 300, dim=32, seed=99, name="query_id").cache()
    path = str(tmp_path / "index")
    quantised.build(v, path)
    model = quantised.load(spark, path)
    assert len(model.centres) > 1000 and model.probe < 100
    exact = {(r.query_id, r.vec_id): r.sim for r in search.exact_top(v, q, 10).collect()}
    near = {(r.query_id, r.vec_id): r.sim for r in quantised.search(spark, path, q, 10).collect()}
    both = exact.keys() & near.keys()
    assert len(near) == len(exact) and len(both) >= 0.9 * len(exact) and all(abs(exact[k] - near[k]) < 1e-6 for k in both)
    # The scan of codes reads no vectors.
    plan = quantised.members(spark, path).select("cell", "codes")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<cell:int,codes:binary>" in plan


def test_index_grows_and_knows_days(spark, tmp_path, monkeypatch):
    v = vectors(spark, 3000, agents=3).withColumn("until", F.when(F.col("vec_id") % 2 == 0, 5)).cache()
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "agent_id", "embedding", F.lit(9).alias("day")).cache()
    path = str(tmp_path / "index")
    quantised.build(v.where("vec_id < 2000"), path, cells=40)
    model = quantised.load(spark, path)
    quantised.append(v.where("vec_id >= 2000"), path)
    assert (quantised.load(spark, path).centres == model.centres).all() and quantised.members(spark, path).count() == 3000
    monkeypatch.setattr(quantised, "QUERIES", 7)
    exact = {(r.query_id, r.vec_id) for r in search.exact_top(v, q, 5).collect()}
    near = {(r.query_id, r.vec_id) for r in quantised.search(spark, path, q, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and all(vec % 2 for _, vec in near)
    # All cells and all members scored again: the exact search.
    assert {(r.query_id, r.vec_id) for r in quantised.search(spark, path, q, 5, probe=999, again=3000).collect()} == exact
    gone = v.withColumn("until", F.lit(1))
    assert search.approximate_top(gone, q, 5).count() == search.exact_top(gone, q, 5).count() == 0
    quantised.build(v.limit(0), str(tmp_path / "none"))
    assert quantised.search(spark, str(tmp_path / "none"), q, 5).count() == 0
    quantised.append(v, str(tmp_path / "none"))
    assert quantised.members(spark, str(tmp_path / "none")).count() == 3000


def test_recall_by_the_kept_index(spark, tmp_path):
    v = vectors(spark, 2000).withColumns({"created_day": (F.col("vec_id") % 30).cast("int"), "importance": F.lit(0.5), "superseded_by": F.when(F.col("vec_id") % 4 == 0, "x")}).cache()
    q = v.where("vec_id % 100 = 1").select(F.col("vec_id").alias("query_id"), "agent_id", "embedding")
    quantised.build(v, str(tmp_path / "index"))
    exact = {(r.query_id, r.vec_id) for r in search.recall(v, q, 5, 30).collect()}
    near = {(r.query_id, r.vec_id) for r in search.recall(v, q, 5, 30, index=str(tmp_path / "index")).collect()}
    assert len(exact & near) >= 0.9 * len(exact) == 0.9 * 100 and all(vec % 4 for _, vec in near)


def memories(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, 1]), i, f"M{i}", rng.randint(0, 9), "t", rng.choice(["u", None]), rng.choice(["city", "city", "job"]), rng.choice([None, *(f"v{k}" for k in range(40))])) for i in range(n)]
    return lifecycle.ingest(spark.createDataFrame(rows, "agent_id int, seq long, id string, ts_day int, text string, subject string, attribute string, value string")).cache()


def test_keys_of_many_values(spark, monkeypatch):
    m = memories(spark)
    rows = lambda: sorted(map(str, lifecycle.consolidate(m).collect()))
    whole = rows()
    active = [r for r in lifecycle.consolidate(m).where("superseded_by is null").collect()]
    last = {}
    for r in m.orderBy("created_day", "seq").collect():
        last[r.agent_id, r.subject or "", r.attribute] = r.value
    assert {(r.agent_id, r.subject, r.attribute): r.value for r in active} == last and len(active) == len(last)
    monkeypatch.setattr(lifecycle, "HOT_VALUES", 30)
    assert rows() == whole
    monkeypatch.setattr(lifecycle, "BROADCAST_KEYS", 0)
    assert rows() == whole
    plan = lifecycle.consolidate(m, lineage=False)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_lineage_without_lists(spark):
    m = memories(spark)
    semantic = lifecycle.consolidate(m, lineage=False)
    assert "provenance" not in semantic.columns
    expected = Counter((r.id, i, s) for r in lifecycle.consolidate(m).collect() for i, s in enumerate(r.provenance))
    for parts in (1, 7):
        assert Counter((r.fact_id, r.place, r.id) for r in lifecycle.lineage_links(semantic, m, parts).collect()) == expected
    one = lifecycle.lineage_links(semantic.where("value = 'v3'"), m)
    assert {r.id for r in one.collect()} == {r.id for r in m.where("value = 'v3'").collect()}
    # A statement that is one of very many: its fact lies in several parts, its places have no gap.
    hot = m.withColumns({"agent_id": F.lit(0), "subject": F.lit("u"), "attribute": F.lit("city"), "value": F.lit("x")})
    links = lifecycle.lineage_links(lifecycle.consolidate(hot, lineage=False), hot, 8)
    assert sorted(r.place for r in links.collect()) == list(range(400))


LOG = "chain_id int, seq long, day int, op string, item_id string, detail string"


def plain_verify(rows):
    """Of a chain's rows: the first number that doesn't continue the one before."""
    at = defaultdict(list)
    for r in rows:
        at[r.seq].append(r)
    for seq in sorted(at):
        for r in at[seq]:
            before = chain.GENESIS if seq == 0 else at[seq - 1][0].entry_hash if len(at.get(seq - 1, [])) == 1 else None
            made = chain.entry_of(r.prev_hash, r.seq, r.day, r.op, r.item_id, r.detail, r.payload, None, {a: r[a] for a in chain.ACTOR})
            if r.prev_hash != before or r.entry_hash != made["entry_hash"]:
                return seq
    return None


@pytest.mark.parametrize("segment", [4096, 3])
def test_verification_by_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(chain, "SEGMENT", segment)
    rng = random.Random(segment)
    built = chain.build(spark.createDataFrame([(c, n, n, "write", f"M{n}", rng.choice(["x", "é", "end "])) for c in range(30) for n in range(rng.randint(1, 14))], LOG), KEY).collect()
    rows = []
    for r in built:
        d = r.asDict()
        draw = rng.random()
        if draw < 0.03:
            continue
        rows += [d, dict(d)] if draw < 0.06 else [{**d, "detail": "changed"}] if draw < 0.09 else [{**d, "prev_hash": "0"}] if draw < 0.11 else [{**d, "sig": "bad"}] if draw < 0.2 else [d]
    table = spark.createDataFrame([tuple(d[c.split(" ")[0]] for c in chain.ENTRY.split(", ")) for d in rows], chain.ENTRY).repartition(5)
    by = defaultdict(list)
    for r in table.collect():
        by[r.chain_id].append(r)
    for ordered in (False, True):
        log = table.withColumn("_s", F.floor(F.col("seq") / segment)).repartition(4, "chain_id", "_s").sortWithinPartitions("chain_id", "seq").drop("_s") if ordered else table
        found = {r.chain_id: r for r in chain.verify(log, KEY, ordered).collect()}
        assert set(found) == set(by)
        for c, own in by.items():
            broken = plain_verify(own)
            failures = sorted(r.seq for r in own if r.sig == "bad" and (broken is None or r.seq < broken))
            assert (found[c].broken_at, found[c].length, found[c].sig_failures, found[c].n_sig_failures) == (broken, len(own), failures, len(failures)), c
            assert found[c].ok == (broken is None and not failures) and found[c].content_ok == all(r.detail != "changed" for r in own)
    assert {r.broken_at is None for r in found.values()} == {True, False}


def test_segmented_chain_and_its_proofs(spark):
    log = spark.createDataFrame([(c, n, n // 4, "write", f"M{n}", "x") for c in (1, 2) for n in range(18)], LOG)
    entries, summary = (df.cache() for df in chain.segments(log, KEY))
    good = {r.chain_id: r for r in chain.verify_segments(entries, summary, KEY).collect()}
    assert all(r.ok and r.days == 5 and r.length == 18 and r.summary_ok for r in good.values()) and len(good) == 2
    # A chain's days are dealt apart.
    assert "hashpartitioning(chain_id" in (plan := chain.build(log, by=("chain_id", "day"))._jdf.queryExecution().executedPlan().toString()) and "day#" in plan.split("hashpartitioning(")[1].split(")")[0]
    head = {r.chain_id: r["head"] for r in chain.heads(summary).collect()}
    shown = chain.proof(entries, summary, 1, 2, 1)
    assert [r["item_id"] for r in shown["segment"]] == ["M9", "M10", "M11"] and len(shown["summary"]) == 3
    assert chain.proven(shown, head[1], KEY) and head[1] != head[2] and not chain.proven(shown, head[2], KEY) and not chain.proven(shown, head[1], b"another")
    changed = {**shown, "segment": [{**shown["segment"][0], "detail": "y"}, *shown["segment"][1:]]}
    assert not chain.proven(changed, head[1], KEY) and not chain.proven({**shown, "segment": shown["segment"][:-1]}, head[1], KEY)
    one = (F.col("chain_id") == 1) & (F.col("day") == 3)
    at = lambda e, s: {r.chain_id: (r.ok, r.broken_day) for r in chain.verify_segments(e, s, KEY).collect()}
    assert at(entries.where(~(one & (F.col("seq") == 3))), summary) == {1: (False, 3), 2: (True, None)}
    assert at(entries.where(~one), summary) == {1: (False, 3), 2: (True, None)}
    assert at(entries, summary.where(~one)) == {1: (False, 3), 2: (True, None)}
    assert at(entries.withColumn("item_id", F.when(one & (F.col("seq") == 1), "Z").otherwise(F.col("item_id"))), summary) == {1: (False, 3), 2: (True, None)}


def test_a_wrong_key_names_the_first_failures_only(spark, monkeypatch):
    monkeypatch.setattr(chain, "SEGMENT", 10)
    monkeypatch.setattr(chain, "NAMED", 12)
    built = chain.build(spark.createDataFrame([(0, n, 1, "write", f"M{n}", "x") for n in range(60)], LOG), KEY)
    got = chain.verify(built, b"another").first()
    assert not got.ok and got.broken_at is None and got.sig_failures == list(range(12)) and got.n_sig_failures == 60


def test_fields_that_end_in_odd_line_ends(spark):
    for end in (" ", "\u0085", "\n", "\r", ""):
        log = spark.createDataFrame([(0, 0, 1, "write", "M0", "x")], LOG).withColumn("model_id", F.lit("m" + end))
        assert chain.verify(chain.build(log)).first().ok, repr(end)


def test_audit_log_reads_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(60_000).select(F.lit(0).alias("agent_id"), (F.col("id") % 5).cast("int").alias("day"), F.when(F.col("id") % 3 == 0, "recall").otherwise("write").alias("op"), F.format_string("I%09d", F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("item_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("detail"))
    audit.append_log(rows.where("day < 4").coalesce(1), path, row_group=1 << 18, distinct=2000)
    audit.append_log(rows.where("day = 4").coalesce(1), path, row_group=1 << 18, distinct=2000)
    assert audit.log(spark, path).count() == 60_000
    found = audit.by_op(spark, path, "recall", 1, 2)
    assert found.count() == rows.where("op = 'recall' and day in (1, 2)").count()
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "(op#" in plan.split("PartitionFilters: [")[1].split("\n")[0] and found.select(F.input_file_name()).distinct().count() == 2
    some = rows.where("id = 12345").first()
    hit = audit.for_item(spark, path, some.item_id)
    assert [r.detail for r in hit.collect()] == [some.detail]

    def scanned(df) -> int:
        execution = df._jdf.queryExecution()
        df._jdf.collect()
        leaves = execution.executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    # The item's own row groups at most; one that isn't there is ruled out by the filters nearly everywhere.
    assert scanned(audit.for_item(spark, path, some.item_id)) < 20_000
    assert scanned(audit.for_item(spark, path, "I5" + "0" * 8)) < 10_000


def test_chains_under_a_union_stay_whole(spark):
    """Both sides of the union are dealt by chain already, and adaptive execution merges their partitions each in its own way."""
    log = spark.range(40_000).select((F.col("id") % 50).cast("int").alias("chain_id"), F.col("id").alias("seq"), F.lit(1).alias("day"), F.lit("write").alias("op"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("item_id"), F.sha2(F.col("id").cast("string"), 512).alias("detail"))
    numbered = log.withColumn("seq", (F.row_number().over(Window.partitionBy("chain_id").orderBy("seq")) - 1).cast("long"))
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.shuffle.partitions": "16"}
    old = {c: spark.conf.get(c) for c in small}
    try:
        for c, v in small.items():
            spark.conf.set(c, v)
        built = staged(chain.build(chain.attested(numbered, chain.attest(64))), "chain")
        assert built.where("seq = 0").select("op").distinct().collect() == [(chain.ATTEST,)] and built.where("seq = 0").count() == 50
        assert built.groupBy("chain_id").agg(F.max("seq").alias("n")).where("n <> 800").count() == 0
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_equal_queries_search_once(spark, monkeypatch):
    """200 queries of 10 texts and 2 agents over vectors with many copies, in many small blocks: as each by itself."""
    monkeypatch.setattr(search, "BLOCK", 40)
    monkeypatch.setattr(search, "AT_ONCE", 3)
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, (30, 4)).astype(float)
    held = [(int(i), int(i % 2), int(i % 7), float(i % 5) / 10, points[int(p)].tolist()) for i, p in zip(rng.permutation(900), rng.integers(0, 30, 900))]
    asked = [(q, q % 2, points[q % 10].tolist()) for q in range(200)]
    v = spark.createDataFrame(held, "vec_id long, agent_id int, created_day int, importance double, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, agent_id int, embedding array<double>")
    seen, exact = [], search.exact_top
    monkeypatch.setattr(search, "exact_top", lambda vectors, queries, n: seen.append(queries.count()) or exact(vectors, queries, n))
    got = {(r.query_id, r.agent_id, r.rank): (r.vec_id, round(r.score, 9)) for r in search.recall(v, q, 5, 30).collect()}
    assert seen == [len({(a, tuple(e)) for _, a, e in asked})] == [10]
    for i, agent, e in asked[::7]:
        near = sorted((-float(np.dot(e, x)), n, day, w) for n, a, day, w, x in held if a == agent)[:20]
        best = sorted((-round(-s + 0.25 * 0.5 ** ((30 - day) / 21) + 0.1 * w, 12), s, n) for s, n, day, w in near)[:5]
        assert [got[i, agent, k + 1] for k in range(5)] == [(n, round(-s, 9)) for s, _, n in best]
