"""Goldens, invariants and SQL over the smallest tables."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import items
from palimpsest.operators import chain, evaluate, lifecycle, search
from palimpsest.plans import registry
from palimpsest.sources import records

TABLES = "documents embeddings benchmark conversations events".split()
FAST = ["p1_ingest", "a1_dedupe", "a2_consolidate", "a3_consolidation_audit", "a4_stats", "p6_retention", "p7_candidates", "w4_working_memory", "j4_lineage", "t1_exact_top", "t3_recall", "u4_hit_flags", "a5_ablation", "a6_retrieval_metrics", "a6_searched_metrics", "a5_searched_ablation", "wc_conversation_benchmark", "p8_for_item", "a8_access", "t1_block_join", "s7_report_rows", "t3_recall_by_day", "w6_vector_ids", "x4_chain_build", "x4_attested_chain", "s5_snapshot", "w3_chain_verify", "r2_stream_current"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if v is None or v is not v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    expected = db.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    floats = lambda f: f.assign(**{c: f[c].astype(float) for c in f.columns if f[c].dtype.kind in "fiu" or str(f[c].dtype).startswith("Int")})
    assert rows(floats(got)) == rows(floats(expected))


STATED = [("city", "Rome", 1), ("city", "Oslo", 5), ("city", "Rome", 9), ("job", "cook", 3), (None, None, 4), ("", "x", 4)]


def memories(spark, stated=STATED):
    rows = [(0, i, f"M{i}", d, "t", "user", a, v) for i, (a, v, d) in enumerate(stated)]
    return lifecycle.ingest(spark.createDataFrame(rows, "agent_id int, seq long, id string, ts_day int, text string, subject string, attribute string, value string"))


def test_reasserted_value_is_one_active_item(spark):
    found = {r.value: r for r in lifecycle.consolidate(memories(spark)).collect()}
    assert set(found) == {"Rome", "Oslo", "cook"}
    assert found["Rome"].superseded_by is None and found["Rome"].support == 2 and found["Rome"].created_day == 9 and found["Rome"].provenance == ["M0", "M2"]
    assert found["Oslo"].superseded_by == found["Rome"].id and found["cook"].superseded_by is None
    assert found["Rome"].content == "city: Rome"


def test_ties_go_to_the_later_ingested(spark):
    found = lifecycle.consolidate(memories(spark, [("city", "Rome", 1), ("city", "Oslo", 1)])).where("superseded_by is null").collect()
    assert [r.value for r in found] == ["Oslo"]


def test_order_of_rows_does_not_matter(spark):
    m = memories(spark)
    a, b = (sorted(map(str, lifecycle.consolidate(x).collect())) for x in (m, m.orderBy(F.rand(3))))
    assert a == b


def test_working_memory_golden(spark):
    m = memories(spark, [(None, None, 1), (None, None, 2), (None, None, 3)]).withColumn("importance", F.element_at(F.array(F.lit(0.9), F.lit(0.2), F.lit(0.8)), (F.col("seq") + 1).cast("int")))
    assert sorted(r.id for r in lifecycle.working_memory(m, 2).collect()) == ["M0", "M2"]


GOLDEN = [
    (0, 0, 1, "write", "M0001", "episodic", "59224e731543cf628186d33a5bde594f7595de37e72e5c4cb36cd5f1c42e52db", "8ad91ab66bff2cd3df22c947da502b3502bccaa81969f1d7d9bcc18e50201dc1", "c771c251cc840af2"),
    (0, 1, 1, "write", "M0002", "episodic", "8296690beec609620f6e1dc283edc1cf8695c356781768361f982df085452451", "4e690f2a2ab3c041a6d3fdc6eb98e077067a15317cfeb65d7e695e5bdbf8cbfc", "3485ad0b135bb8bc"),
    (0, 2, 2, "supersede", "S0001", "superseded-by:S0002", "b1e84cc1da5710ddbb47713fb7929d2a525fc95c052ab8d07a3c85bf2c36b47f", "e6d0eab8cec12886c8ceb4c2d87f008a7a41c415234c23338d19009c31a44cea", "5d2810d29a5fe53c"),
]
LOG = "chain_id int, seq long, day int, op string, item_id string, detail string"


def test_chain_golden_and_tampering(spark):
    key = b"test-signing-key"
    built = chain.build(spark.createDataFrame([g[:6] for g in GOLDEN], LOG), key)
    got = built.orderBy("seq").collect()
    assert [(r.content_hash, r.entry_hash, r.sig[:16]) for r in got] == [g[6:] for g in GOLDEN]
    assert chain.verify(built, key).first()["ok"]
    changed = built.withColumn("detail", F.when(F.col("seq") == 2, "x").otherwise(F.col("detail")))
    assert chain.verify(changed, key).first()["broken_at"] == 2
    assert not chain.verify(built.where("seq <> 1"), key).first()["ok"]
    forged = chain.verify(built.withColumn("sig", F.when(F.col("seq") == 1, "0").otherwise(F.col("sig"))), key).first()
    assert forged["sig_failures"] == [1] and forged["broken_at"] is None and not forged["ok"]
    assert chain.verify(built).first()["signed"] is False


def test_chain_beyond_ascii_and_snapshot(spark, tmp_path):
    built = chain.build(spark.createDataFrame([(1, 0, 1, "write", "é", "a\nb"), (1, 1, 1, "write", "M", "日本")], LOG))
    assert chain.verify(built).first()["ok"]
    chain.export(built, str(tmp_path / "s"))
    assert chain.restore(spark, str(tmp_path / "s")).count() == 2
    chain.export(built.withColumn("detail", F.lit("other")), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        chain.restore(spark, str(tmp_path / "bad"))
    more = chain.build(spark.createDataFrame([(1, 0, 2, "write", "N", "x")], LOG), heads=chain.heads(built))
    assert chain.verify(built.unionByName(more)).first()["length"] == 2 + 1 and chain.verify(built.unionByName(more)).first()["ok"]


def test_fingerprint_golden():
    assert chain.attest(64)["fingerprint"] == "cfg:852089a94b29860c4d0ee67505cfd6f0"
    assert chain.attest(384)["fingerprint"] == "cfg:72398d41827ef541ce8bc7ea97393998"


def test_hashing_embedder_golden(spark):
    import pandas as pd

    for word, a, b in (("manager", 372, 52), ("my", 155, 27), ("bob", 274, 18), ("tran", 119, 55), ("is", 338, 18)):
        assert search.hash_embed(pd.Series([word]), 384)[0].argmax() == a and search.hash_embed(pd.Series([word]), 64)[0].argmax() == b


def test_answer_f1_golden(spark):
    pairs = [("7 May 2023", "7 May, 2023", 1.0), ("Paris, France", "paris france", 1.0), ("the cat and the dog", "cat dog", 1.0), ("Bob Tran", "Bob Tran", 1.0), ("She went running", "running was the activity", 0.333333), ("no information available", "Caroline visited the museum", 0.0)]
    answers = spark.createDataFrame([(str(i), 1, p, g) for i, (p, g, _) in enumerate(pairs)], "id string, category int, prediction string, gold string")
    got = {r.id: r.f1 for r in evaluate.answer_f1(answers).collect()}
    assert all(abs(got[str(i)] - f) < 1e-5 for i, (*_, f) in enumerate(pairs))


#: Words and stems, of the published examples of the rules and of their common extensions.
STEMS = """caresses caress, ponies poni, ties tie, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl,
 sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration,
 valenci valenc, hesitanci hesit, digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic,
 operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form,
 formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop,
 adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ,
 angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, dying die, die die, lying lie, tying tie, skies sky,
 news news, innings inning, inning inning, outings outing, cannings canning, howe howe, proceed proceed, exceed exceed, succeed succeed, enjoy enjoy, enjoys enjoy, enjoyed enjoy, played play, plays play,
 playing play, say say, cry cri, by by, dies die, died die, cried cri, cries cri, tied tie, spied spi, flies fli, dogs dog, gently gentli, geology geolog, geologi geolog, biologi biolog, usefulli use, carefulli care,
 running run, was wa, activity activ, caroline carolin, visited visit, museum museum, information inform, available avail, owed owe, used use, using use, is is, as as, his hi, this thi, buses buse, boxes box, churches church,
 generalizations gener, oscillators oscil, abilities abil, happiness happi, quickly quickli, possibly possibl, capable capabl, stopped stop, planning plan, hoped hope, hoping hope, trying tri, tries tri, babies babi,
 wolves wolv, mice mice, children children, women women, argument argument, arguing argu, argued argu, argues argu, national nation, nationality nation, organization organ, organizer organ, universities univers, university univers"""


def test_stems_golden():
    pairs = [p.split() for p in STEMS.replace("\n", " ").split(",")]
    assert len(pairs) > 150 and {w: evaluate.stem(w) for w, s in pairs if evaluate.stem(w) != s} == {}


def test_conversation_benchmark(spark, tmp_path):
    """Two conversations, one with a repeated turn and evidence that isn't there, by hand."""
    talk = lambda *turns: [{"dia_id": i, "speaker": "A", "text": t} for i, t in turns]
    ask = lambda q, e, c: {"question": q, "answer": "x", "evidence": e, "category": c}
    samples = [
        {"sample_id": "one", "conversation": {"session_1": talk(("D1:1", "red apple"), ("D1:2", "blue sky")), "session_2": talk(("D2:1", "green tree"), ("D1:1", "red wine"))}, "qa": [ask("wine", ["D1:1"], 1), ask("sky", ["D1:2", "D9:9"], 2), ask("red", [], 2), ask("red", ["D1:1"], 5)]},
        {"sample_id": "two", "conversation": {"session_1": talk(("D1:1", "red apple"), ("D1:2", "apple pie"))}, "qa": [ask("apple", "['D1:2']", 1)]},
    ]
    (tmp_path / "talks.json").write_text(json.dumps(samples))
    turns, questions = records.conversations(spark, str(tmp_path / "talks.json"))
    got = {r.category: r for r in evaluate.conversation_benchmark(turns, questions, lambda rows: search.embed(rows, encode=search.md5_encoder(4096))).collect()}
    assert got[None].n == 3 and (got[1].recall_1, got[1].recall_5, got[1].mrr_10) == (0.5, 1.0, 0.75) and (got[2].recall_1, got[2].recall_20, got[2].mrr_10) == (0.5, 0.5, 1.0)


def test_rank_metrics_golden(spark):
    d = spark.createDataFrame([(["D1:1", "D2:3", "D5:2", "D1:9"], ["D2:3", "D1:9"]), (["D1:1", "D2:3"], ["D2:3", "D9:9"]), (["D1:1"], [])], "r array<string>, g array<string>")
    got = d.select(evaluate.recall_at(F.col("r"), F.col("g"), 5).alias("a"), evaluate.reciprocal_rank(F.col("r"), F.col("g")).alias("b")).collect()
    assert [r.a for r in got] == [1.0, 0.5, None] and [r.b for r in got] == [0.5, 0.5, 0.0]


def test_conversations(spark, tmp_path):
    sample = [{"sample_id": "c1", "conversation": {"session_10": [{"dia_id": "D10:1", "speaker": "A", "text": "z"}], "session_2": [{"dia_id": "D2:1", "text": "x"}, {"dia_id": "D2:2"}], "session_2_date": "x"}, "qa": [{"question": "q", "answer": 2022, "evidence": "['D1:1', 'x', 'D1:1']", "category": 1}, {"question": "r", "evidence": ["D2:1"], "category": 5}]}]
    (tmp_path / "c.json").write_text(json.dumps(sample))
    turns, questions = records.conversations(spark, str(tmp_path / "c.json"))
    assert sorted((r.session, r.dia_id) for r in turns.collect()) == [(0, "D2:1"), (1, "D10:1")]
    got = questions.orderBy("place").collect()
    assert [(r.answer, r.evidence) for r in got] == [("2022", ["D1:1"]), ("", ["D2:1"])]
    assert evaluate.scorable(questions).count() == 1


def test_exact_search_finds_itself_and_clips(spark):
    rng = np.random.default_rng(23)
    v = rng.normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, 0, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, agent_id int, embedding array<float>")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    assert search.exact_top(vectors, asked, 1).where("query_id = vec_id").count() == 50
    assert search.exact_top(vectors, asked, 99).count() == 2500
    assert search.exact_top(vectors.where("false"), asked, 5).count() == 0


def test_expiry_is_strict_and_ttl_comes_first(spark):
    d = spark.createDataFrame([(0, "a", 0, 5, None), (0, "b", 0, 6, None), (0, "c", 0, 5, "z"), (0, "d", 0, None, "z")], "agent_id int, id string, created_day int, ttl_days int, superseded_by string")
    assert {r.id: r.reason for r in lifecycle.retain(d, 6, grace=5)[1].collect()} == {"a": "ttl-expired", "c": "ttl-expired", "d": "superseded-by:z"}


def test_policy_labels():
    assert items.Policy(False, True, False).label == "flat-vector" and items.Policy().label == "recency+consolidation+supersession"


def test_gold_pairs_are_all_found_without_a_nested_loop(spark, small):
    bodies = ["the red fox ran far away", "x the red fox ran", "thered fox", None, "", "fox", "a b c d e f g h i j k l", "zz a b  c"]
    texts = ["he red fox ra", "red fox", "ox", "", None, "b c d e f g h i j", " fox ", "b c d e f g h i z", "  c", "e red fox r"]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate([*bodies, bodies[0]])] + [(None, "ox red fox")], "doc_id long, body string")
    asked = spark.createDataFrame(list(enumerate(texts)), "item_id long, t string")
    got = sorted((r.item_id, -1 if r.doc_id is None else r.doc_id) for r in evaluate.holding(docs, asked).collect())
    assert got == sorted((i, -1 if r.doc_id is None else r.doc_id) for i, t in enumerate(texts) for r in docs.collect() if t is not None and r.body is not None and t in r.body)
    plan = registry._gold(spark, small)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_evaluation_by_search_equals_brute_force(spark, small):
    items_, docs = (spark.read.parquet(f"{small}/{t}.parquet").toPandas() for t in ("benchmark", "documents"))
    bag = lambda texts: search.hash_embed(texts, 64, search.md5_number).astype(float)
    sim = np.round(bag(items_.text) @ bag(docs.text).T, 12)
    recalls, ranks = [], []
    for item, text, row in zip(items_.item_id, items_.text, sim):
        gold = {i for i, body in zip(docs.doc_id, docs.text) if text.lower() in body.lower()}
        order = docs.doc_id.to_numpy()[np.lexsort((docs.doc_id, -row))]
        if gold:
            recalls.append(len(gold & set(order[:5])) / len(gold))
            ranks.append(max([1 / (k + 1) for k, i in enumerate(order[:10]) if i in gold], default=0.0))
    got = registry.QUERIES["a6_searched_metrics"](spark, small).where("category is null").first()
    assert got.n == len(ranks) and abs(got.recall_5 - np.mean(recalls)) < 1e-5 and abs(got.mrr_10 - np.mean(ranks)) < 1e-5

    stated = registry._memories(spark, small).toPandas()
    facts = stated[stated.attribute.notna()]
    made = bag(stated.subject + " " + stated.content)
    hits = registry._searched(spark, small)[0].where("policy = 'flat-vector'").toPandas().sort_values("rank").groupby("query_id").value.apply(list)
    keys = facts[["agent_id", "subject", "attribute"]].drop_duplicates()
    assert len(keys) == len(hits)
    value = stated.agent_id.astype(str) + "|" + stated.subject + "|" + stated.attribute + "=" + stated.value
    for agent, subject, attribute in keys.itertuples(index=False):
        asked = bag([subject + " " + attribute.replace("_", " ")])[0]
        row = np.where(stated.agent_id == agent, np.round(made @ asked, 12), -9)
        best = np.lexsort((stated.seq, -row))[:5]
        assert [v if isinstance(v, str) else None for v in hits[f"{agent}|{subject}|{attribute}"]] == [value[i] if isinstance(value[i], str) else None for i in best if row[i] > -9]


def test_chain_of_two_writers_and_gaps(spark):
    log = spark.createDataFrame([(c, n, n, "write", f"M{n}", "x") for c in (1, 2) for n in range(6)], LOG)
    log = log.withColumn("actor_id", F.when(F.col("seq") % 2 == 1, "planner")).withColumn("model_id", F.when(F.col("seq") % 2 == 1, "modèle"))
    built = chain.build(chain.attested(log, chain.attest(64))).cache()
    first = built.where("chain_id = 1").orderBy("seq").collect()
    assert [r.seq for r in first] == list(range(7)) and first[0].op == "model-attest" and first[0].detail == "hashing-bow-64 (config-hash)"
    assert [r.agent_id for r in first] == ["memory-service"] * 2 + ["planner", "memory-service"] * 2 + ["planner"]
    assert {r.model_id for r in first} == {"hashing-bow-64", "modèle"} and chain.declared("m")["grade"] == "declared"
    report = {r.chain_id: r for r in chain.verify(built).collect()}
    assert all(r.ok and r.content_ok and r.length == 7 for r in report.values())
    at = lambda df: {r.chain_id: r.broken_at for r in chain.verify(df).collect()}
    one = F.col("chain_id") == 1
    assert at(built.where(~one | (F.col("seq") != 3))) == {1: 4, 2: None}
    assert at(built.where(~one | (F.col("seq") != 0))) == {1: 1, 2: None}
    assert at(built.withColumn("agent_id", F.when(one & (F.col("seq") == 2), "other").otherwise(F.col("agent_id")))) == {1: 2, 2: None}
    assert at(built.unionAll(built.where(one & (F.col("seq") == 4)))) == {1: 5, 2: None}
    assert chain.verify(built.where("false")).count() == 0


def test_plain_rows_stay_in_the_jvm(spark):
    plan = chain.hashed(chain.build(spark.createDataFrame([], LOG))).where("payload is null")._jdf.queryExecution().optimizedPlan().toString()
    # Python is above the filter of rows that aren't plain.
    assert "ArrowEvalPython" in plan and plan.index("Union") < plan.index("ArrowEvalPython")


#: Attribute, value, last day, statements, in the order of ids, of the golden consolidation.
STATED = [
    ("name", "Jordan Ellison", 10, 2), ("employee_id", "E-44817", 17, 2), ("home_city", "Denver", 15, 2), ("hire_date", "2019-06-03", 17, 2), ("timezone", "Mountain Time", 3, 1),
    ("current_manager", "Alice Reyes", 6, 2), ("current_manager", "Bob Tran", 40, 1), ("current_project", "Project Atlas", 23, 2), ("current_project", "Project Borealis", 28, 1), ("current_project", "Project Cygnus", 62, 1),
    ("job_title", "Senior Analyst", 22, 2), ("job_title", "Staff Analyst", 55, 1), ("office_location", "Floor 3, Building A", 4, 1), ("office_location", "fully remote", 70, 1),
    ("primary_metric", "weekly active users", 12, 2), ("primary_metric", "net revenue retention", 33, 1), ("preferred_ide", "VS Code", 10, 2), ("preferred_ide", "PyCharm", 48, 1),
    ("sprint_goal", "ship the ingestion API", 15, 2), ("sprint_goal", "cut p99 latency below 200ms", 24, 1), ("sprint_goal", "instrument retention dashboards", 38, 1), ("sprint_goal", "harden the eval harness", 66, 1),
]


def test_golden_run_of_interactions(spark, tmp_path):
    """Files to the searchable set: 42 statements, 22 active items, 10 superseded ones."""
    import json

    rows = []
    for attribute, value, day, times in STATED:
        for back in reversed(range(times)):
            rows.append({"id": f"M{len(rows) + 1:04d}", "ts_day": day - back, "text": f"My {attribute} is {value}.", "type": "episodic", "subject": "user", "attribute": attribute, "value": value, "importance": 0.8})
    rows += [{"id": f"M{33 + i:04d}", "ts_day": i, "text": f"Thing number {i}.", "type": "episodic", "subject": None, "attribute": None, "value": None, "importance": 0.3, "provenance": f"session:{i}"} for i in range(10)]
    assert len(rows) == 42
    (tmp_path / "interactions.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    found = records.interactions(spark, str(tmp_path / "interactions.jsonl"))
    assert found.count() == 42 and [r.id for r in found.orderBy("seq").collect()] == [r["id"] for r in rows]
    memories = lifecycle.ingest(found)
    semantic = lifecycle.consolidate(memories)
    pool = lifecycle.candidates(memories, semantic, 71)
    assert pool.count() == 22 and semantic.where("superseded_by is not null").count() == 10 and semantic.agg(F.sum("support")).first()[0] == 32
    current = {r.attribute: (r.value, r.created_day, r.support) for r in lifecycle.active(semantic).collect()}
    assert current == {a: (v, d, n) for a, v, d, n in STATED}
    asked = spark.createDataFrame([(1, 0, "Who is my current manager? current_manager")], "query_id long, agent_id int, content string")
    held = search.embed(search.vector_ids(pool))
    hits = search.recall(held, search.embed(asked), 5, 71).join(held.select("vec_id", "content"), "vec_id")
    said = " ".join(r.content for r in hits.collect())
    assert "Bob Tran" in said and "Alice Reyes" not in said


def test_order_of_ingest_is_the_place_in_the_files(spark, tmp_path):
    said = [{"id": f"Z{9 - i}", "ts_day": 1, "text": "x" * 50, "subject": "u", "attribute": "a", "value": f"v{i}"} for i in range(9)]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, said[5:])))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, said[:5])))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "200b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = records.interactions(spark, str(tmp_path))
            assert [r.id for r in found.orderBy("seq").collect()] == [r["id"] for r in said]
            assert lifecycle.active(lifecycle.consolidate(lifecycle.ingest(found))).first().value == "v8"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_temporary_folder_on_a_cluster():
    from types import SimpleNamespace

    from palimpsest import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(far)


def test_gold_queries_reader(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "Q1", "query": "Who?", "subject": "user", "attribute": "a", "gold_value": "x", "prior_values": ["y", "z"], "category": "changing"}\n\n{"id": "Q2", "query": "What?", "subject": null, "attribute": "b", "gold_value": "v", "prior_values": [], "category": "stable"}\n')
    got = {r.id: r for r in records.gold_queries(spark, str(tmp_path / "q.jsonl")).collect()}
    assert set(got) == {"Q1", "Q2"} and got["Q1"].prior_values == ["y", "z"] and got["Q2"].prior_values == []


def test_another_encoder(spark):
    import numpy as np

    def factory():
        return lambda texts: np.array([[len(t), t.count("a"), 1] for t in texts], np.float32)

    rows = spark.createDataFrame([(1, "banana"), (2, None), (3, "x" * 70)], "id long, content string")
    got = {r.id: list(r.embedding) for r in search.embed(rows, encode=factory, batch=2).collect()}
    assert got == {1: [6.0, 3.0, 1.0], 2: [0.0, 0.0, 1.0], 3: [70.0, 0.0, 1.0]}


def test_approximate_search_reaches_its_recall(spark, small):
    v = records.vectors_of(spark.read.parquet(f"{small}/embeddings.parquet"))
    q = records.vector_queries(v)
    exact = {(r.query_id, r.vec_id) for r in search.exact_top(v, q, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in search.approximate_top(v, q, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert search.approximate_top(v.where("false"), q, 10).count() == 0


def test_exact_search_in_blocks_and_days(spark, small, monkeypatch):
    v = records.vectors_of(spark.read.parquet(f"{small}/embeddings.parquet")).withColumn("until", F.when(F.col("vec_id") % 2 == 0, 5)).repartition(3)
    q = records.vector_queries(v).withColumn("day", (F.col("query_id") / 25 % 10).cast("int"))
    rows = lambda: sorted((r.query_id, r.rank, r.vec_id, r.sim) for r in search.exact_top(v, q, 4).collect())
    whole = rows()
    monkeypatch.setattr(search, "QUERY_BLOCK", 6)
    assert rows() == whole
    day = {r.query_id: r.day for r in q.collect()}
    assert all(vec % 2 or day[query] <= 5 for query, _, vec, _ in whole) and any(vec % 2 == 0 for _, _, vec, _ in whole)


def test_windows_are_hashed_by_arrays():
    """Equal windows have equal hashes wherever they stand; others differ."""
    words = [f"w{i % 97}" for i in range(500)]
    made, at = evaluate._grams(words, [1, 8]), 0
    for n in (1, 8):
        own = made[at : at + 500 - n + 1].tolist()
        texts = [" ".join(words[i : i + n]) for i in range(500 - n + 1)]
        assert own == [evaluate._gram("w", n, t) for t in texts] and len(set(own)) == len(set(texts)) == 97
        at += len(own)
    assert at == len(made) and len(evaluate._grams([], [1])) == len(evaluate._grams(["a"], [2])) == 0
