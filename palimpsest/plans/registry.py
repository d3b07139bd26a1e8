"""Queries of the library over the test tables, and the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import items
from ..operators import chain, evaluate, lifecycle, search
from ..session import shared_dir, staged
from ..sources import audit, records
from ..streaming import jobs

NOW = 30
FLAGSHIP = "a2_consolidate"
KEY = b"test-signing-key"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _statements(spark, sf_dir) -> DataFrame:
    return records.statements(_read(spark, sf_dir, "events"))


def _memories(spark, sf_dir) -> DataFrame:
    return lifecycle.ingest(_statements(spark, sf_dir))


def _semantic(spark, sf_dir, supersession: bool = True) -> DataFrame:
    return lifecycle.consolidate(_memories(spark, sf_dir), supersession)


def _vectors(spark, sf_dir) -> DataFrame:
    return records.vectors_of(_read(spark, sf_dir, "embeddings"))


S = """WITH st AS (SELECT (user_id % 10)::INT AS agent_id, event_id AS seq, printf('M%07d', event_id) AS id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS created_day,
 'user:' || user_id AS subject, CASE WHEN event_type <> 'error' THEN 'last_' || event_type END AS attribute, CASE WHEN event_type <> 'error' THEN 'v' || ((props->>'$.k')::INT % 7) END AS "value",
 least("value", 100.0) / 100 AS importance, CASE event_type WHEN 'view' THEN 7 WHEN 'error' THEN 14 END AS ttl_days, CASE WHEN event_type <> 'error' THEN 'last ' || event_type || ': v' || ((props->>'$.k')::INT % 7) ELSE 'error of user ' || user_id END AS content FROM events)"""

SEM = S + """, g AS (SELECT agent_id, subject, attribute, "value", max((created_day, seq)) AS o, max(created_day) AS created_day, max(importance) AS importance, count(*) AS support,
 string_agg(id, ',' ORDER BY created_day, seq) AS provenance FROM st WHERE attribute IS NOT NULL GROUP BY agent_id, subject, attribute, "value"),
 s0 AS (SELECT *, sha256(agent_id || '|' || subject || '|' || attribute || '|' || coalesce('=' || "value", 'null')) AS id, replace(attribute, '_', ' ') || ': ' || coalesce("value", '') AS content, first_value("value") OVER w AS top FROM g WINDOW w AS (PARTITION BY agent_id, subject, attribute ORDER BY o DESC)),
 sem AS (SELECT agent_id, subject, attribute, "value", created_day, importance, support, provenance, id, content, CASE WHEN "value" IS DISTINCT FROM top THEN sha256(agent_id || '|' || subject || '|' || attribute || '|' || coalesce('=' || top, 'null')) END AS superseded_by FROM s0)"""

_EP = "agent_id, seq, id, content, created_day, importance, subject, attribute, value, ttl_days"


@query("p1_ingest", S + f" SELECT {_EP}, 1::BIGINT AS support, 'episodic' AS mtype FROM st")
def p1(spark, d):
    return _memories(spark, d).select(*_EP.split(", "), "support", "mtype")


@query("p2_write_audit", S + " SELECT agent_id, seq, created_day AS day, 'write' AS op, id AS item_id, coalesce(attribute || '=' || value, 'episodic') AS detail FROM st")
def p2(spark, d):
    return lifecycle.write_audit(_memories(spark, d))


@query("p3_fact_split", S + " SELECT agent_id, count(attribute)::BIGINT AS facts, (count(*) - count(attribute))::BIGINT AS others FROM st GROUP BY agent_id")
def p3(spark, d):
    m = _memories(spark, d)
    both = lifecycle.facts(m).select("agent_id", F.lit(1).alias("f")).unionAll(lifecycle.non_facts(m).select("agent_id", F.lit(0)))
    return both.groupBy("agent_id").agg(F.sum("f").alias("facts"), F.sum(1 - F.col("f")).alias("others"))


@query("a1_dedupe", SEM + " SELECT agent_id, subject, attribute, value, created_day, importance, support, provenance, content FROM sem")
def a1(spark, d):
    return _semantic(spark, d, False).select("agent_id", "subject", "attribute", "value", "created_day", "importance", "support", F.array_join("provenance", ",").alias("provenance"), "content")


@query("a2_consolidate", SEM + " SELECT agent_id, subject, attribute, value, created_day, importance, support, id, superseded_by, superseded_by IS NULL AS active FROM sem")
def a2(spark, d):
    return lifecycle.consolidate(_memories(spark, d), lineage=False).select("agent_id", "subject", "attribute", "value", "created_day", "importance", "support", "id", "superseded_by", F.col("superseded_by").isNull().alias("active"))


@query("p4_active", SEM + " SELECT agent_id, subject, attribute, value, id FROM sem WHERE superseded_by IS NULL")
def p4(spark, d):
    return lifecycle.active(_semantic(spark, d)).select("agent_id", "subject", "attribute", "value", "id")


@query("p5_expired", S + f" SELECT id, {NOW} - created_day > ttl_days AS expired FROM st WHERE ttl_days IS NOT NULL")
def p5(spark, d):
    return _memories(spark, d).where("ttl_days is not null").select("id", items.expired(F.col("created_day"), F.col("ttl_days"), F.lit(NOW)).alias("expired"))


@query("p6_retention", SEM + f""", a AS (SELECT agent_id, id, created_day, ttl_days, NULL AS superseded_by FROM st UNION ALL SELECT agent_id, id, created_day, NULL, superseded_by FROM sem),
 j AS (SELECT agent_id, id, CASE WHEN {NOW} - created_day > ttl_days THEN 'ttl-expired' WHEN superseded_by IS NOT NULL AND {NOW} - created_day > 20 THEN 'superseded-by:' || superseded_by END AS detail FROM a)
 SELECT agent_id, {NOW} AS day, 'forget' AS op, id AS item_id, detail FROM j WHERE detail IS NOT NULL""")
def p6(spark, d):
    m, s = _memories(spark, d), _semantic(spark, d)
    every = m.select("agent_id", "id", "created_day", "ttl_days", F.lit(None).cast("string").alias("superseded_by")).unionByName(s.select("agent_id", "id", "created_day", F.lit(None).cast("int").alias("ttl_days"), "superseded_by"))
    return lifecycle.retain(every, NOW, grace=20)[2]


_POOL = SEM + f""", pool AS (SELECT agent_id, id, content, 'semantic' AS mtype, created_day, importance FROM sem WHERE superseded_by IS NULL
 UNION ALL SELECT agent_id, id, content, 'episodic', created_day, importance FROM st WHERE attribute IS NULL AND NOT coalesce({NOW} - created_day > ttl_days, false))"""


@query("p7_candidates", _POOL + " SELECT * FROM pool")
def p7(spark, d):
    return lifecycle.candidates(_memories(spark, d), _semantic(spark, d), NOW).select("agent_id", "id", "content", "mtype", "created_day", "importance")


@query("u1_pool_without_consolidation", S + f" SELECT agent_id, count(*) AS n, sum(created_day)::BIGINT AS days FROM st WHERE NOT coalesce({NOW} - created_day > ttl_days, false) GROUP BY agent_id")
def u1(spark, d):
    return lifecycle.candidates(_memories(spark, d), None, NOW).groupBy("agent_id").agg(F.count("*").alias("n"), F.sum("created_day").alias("days"))


_AUDIT = S + ", au AS (SELECT agent_id, seq, created_day AS day, 'write' AS op, id AS item_id, coalesce(attribute || '=' || value, 'episodic') AS detail FROM st)"


def _kept_log(spark, d) -> str:
    """The folder of an audit log of writes, consolidation and retention."""
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    m = _memories(spark, d)
    semantic = staged(lifecycle.consolidate(m, lineage=False), "semantic")
    gone = lifecycle.retain(m.select("agent_id", "id", "created_day", "ttl_days"), NOW)[2]
    for rows in (lifecycle.write_audit(m).drop("seq"), lifecycle.consolidation_audit(semantic, True, NOW), gone):
        audit.append_log(rows.select("agent_id", "day", "op", "item_id", "detail"), path)
    return path


@query("p8_audit_lookup", _AUDIT + " SELECT agent_id, day, op, item_id, detail FROM au WHERE item_id LIKE 'M00011%' AND day BETWEEN 2 AND 20")
def p8(spark, d):
    return audit.by_op(spark, _kept_log(spark, d), "write", 2, 20).where("item_id like 'M00011%'")


@query("p8_for_item", _AUDIT + f" SELECT agent_id, day, op, item_id, detail FROM au WHERE item_id = 'M0000123' UNION ALL SELECT agent_id, {NOW}, 'forget', id, 'ttl-expired' FROM st WHERE id = 'M0000123' AND {NOW} - created_day > ttl_days")
def p8i(spark, d):
    return audit.for_item(spark, _kept_log(spark, d), "M0000123")


@query("p8_by_op", _AUDIT + f" SELECT agent_id, {NOW} AS day, 'forget' AS op, count(*) AS n FROM st WHERE {NOW} - created_day > ttl_days GROUP BY agent_id")
def p8o(spark, d):
    return audit.by_op(spark, _kept_log(spark, d), "forget", NOW).groupBy("agent_id", "day", "op").agg(F.count("*").alias("n"))


@query("a3_consolidation_audit", SEM + f""" SELECT agent_id, {NOW} AS day, 'supersede' AS op, id AS item_id, 'superseded-by:' || superseded_by AS detail FROM sem WHERE superseded_by IS NOT NULL
 UNION ALL SELECT agent_id, {NOW}, 'consolidate', max(id) FILTER (superseded_by IS NULL), 'statements=' || sum(support)::BIGINT FROM sem GROUP BY agent_id, subject, attribute""")
def a3(spark, d):
    return lifecycle.consolidation_audit(_semantic(spark, d), True, NOW)


@query("a3_dedupe_audit", SEM + f" SELECT agent_id, {NOW} AS day, 'consolidate' AS op, id AS item_id, 'support=' || support AS detail FROM sem")
def a3b(spark, d):
    return lifecycle.consolidation_audit(_semantic(spark, d, False), False, NOW)


@query("a4_stats", SEM + " SELECT agent_id, count(*) FILTER (a) AS active, count(*) FILTER (NOT a) AS superseded FROM (SELECT agent_id, superseded_by IS NULL AS a FROM sem UNION ALL SELECT agent_id, true FROM st WHERE attribute IS NULL) GROUP BY agent_id")
def a4(spark, d):
    return lifecycle.stats(_memories(spark, d), _semantic(spark, d))


@query("a9_op_counts", SEM + " SELECT 'write' AS op, count(*) AS n FROM st UNION ALL SELECT 'supersede', count(*) FROM sem WHERE superseded_by IS NOT NULL UNION ALL SELECT 'consolidate', count(*) FROM sem WHERE superseded_by IS NULL")
def a9(spark, d):
    return lifecycle.op_counts(lifecycle.write_audit(_memories(spark, d)).drop("seq").unionByName(lifecycle.consolidation_audit(_semantic(spark, d), True, NOW)))


@query("a10_clock", S + " SELECT agent_id, (max(created_day) + 1)::INT AS now FROM st GROUP BY agent_id")
def a10(spark, d):
    return lifecycle.clock(_memories(spark, d))


@query("w4_working_memory", S + " SELECT agent_id, id, importance, created_day, row_number() OVER (PARTITION BY agent_id ORDER BY importance DESC, created_day, seq DESC)::INT AS place FROM st QUALIFY place <= 8")
def w4(spark, d):
    return lifecycle.working_memory(_memories(spark, d)).select("agent_id", "id", "importance", "created_day", "place")


@query("w7_procedures", S + " SELECT agent_id, subject AS trigger, arg_max(content, seq) AS content, max(seq) AS seq FROM st GROUP BY agent_id, subject")
def w7(spark, d):
    return lifecycle.procedures(_memories(spark, d).withColumn("trigger", F.col("subject")))


@query("j3_prior_values", SEM + " SELECT a.agent_id, a.subject, a.attribute, a.value AS current, b.value AS prior, b.created_day AS prior_day FROM sem a JOIN sem b ON a.agent_id = b.agent_id AND a.subject = b.subject AND a.attribute = b.attribute WHERE a.superseded_by IS NULL AND b.superseded_by IS NOT NULL")
def j3(spark, d):
    return lifecycle.prior_values(_semantic(spark, d))


@query("j4_lineage", SEM + " SELECT s.agent_id, s.id AS fact_id, st.id, row_number() OVER (PARTITION BY s.id ORDER BY st.created_day, st.seq) - 1 AS place, st.created_day AS stated_day, st.content AS statement FROM sem s JOIN st USING (agent_id, subject, attribute, value)")
def j4(spark, d):
    m = _memories(spark, d)
    return lifecycle.lineage_links(lifecycle.consolidate(m, lineage=False), m)


@query("f3_words_and_recency", S + f" SELECT id, len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''))::BIGINT AS words, round(pow(0.5, greatest(0, {NOW} - created_day) / 21.0), 6) AS recency FROM st")
def f3(spark, d):
    return _memories(spark, d).select("id", items.word_count(F.col("content")).alias("words"), F.round(items.recency(F.col("created_day"), F.lit(NOW)), 6).alias("recency"))


@query("f8_policy_label", "SELECT r, c, s, coalesce(nullif(concat_ws('+', CASE WHEN r THEN 'recency' END, CASE WHEN c THEN 'consolidation' END, CASE WHEN c AND s THEN 'supersession' END), ''), 'flat-vector') AS label, n FROM (SELECT event_type IN ('click', 'view') AS r, user_id % 2 = 0 AS c, user_id % 3 = 0 AS s, count(*) AS n FROM events GROUP BY 1, 2, 3)")
def f8(spark, d):
    flags = _read(spark, d, "events").groupBy(F.col("event_type").isin("click", "view").alias("r"), (F.col("user_id") % 2 == 0).alias("c"), (F.col("user_id") % 3 == 0).alias("s")).agg(F.count("*").alias("n"))
    return flags.withColumn("label", items.policy_label(F.col("r"), F.col("c"), F.col("s")))


@query("f7_tokens", "SELECT doc_id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def f7(spark, d):
    t = items.tokens(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query("f6_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def f6(spark, d):
    v = F.col("embedding")
    return _read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(items.dot(v, v)), 6).alias("norm"))


@query("x1_md5_embedding", r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), b AS (SELECT item_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS bucket, count(*) AS n FROM t GROUP BY ALL)
 SELECT item_id, bucket, round((n::FLOAT / sqrt(sum(n * n) OVER (PARTITION BY item_id))::FLOAT)::DOUBLE, 6) AS weight FROM b""")
def x1(spark, d):
    made = search.embed(_read(spark, d, "benchmark"), text="text", encode=search.md5_encoder(64)).select("item_id", F.posexplode("embedding").alias("bucket", "weight"))
    return made.where("weight > 0").select("item_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query("x1_blake2b_embedding")
def x1b(spark, d):
    return search.embed(_read(spark, d, "benchmark"), 64, "text").select("item_id", F.round(items.dot(F.col("embedding"), F.col("embedding")), 4).alias("length"), F.array_position("embedding", F.array_max("embedding")).alias("top"))


@query("j6_embed_once", "SELECT count(*) AS items, count(DISTINCT text) AS texts, count(*) AS embedded FROM conversations")
def j6(spark, d):
    turns = _read(spark, d, "conversations").withColumnRenamed("text", "content").select("conv_id", "turn", "content")
    cache = search.embed(turns.where("turn = 0").withColumn("text_key", F.sha2("content", 256)).dropDuplicates(["text_key"]).select("text_key", "content"), 32).select("text_key", "embedding")
    cache = staged(cache, "embed-cache")
    done, grown = search.embed_new(turns, cache, 32)
    counts = done.agg(F.count("*").alias("items"), F.count("embedding").alias("embedded"))
    return counts.join(F.broadcast(grown.agg(F.count("*").alias("texts")))).select("items", "texts", "embedded")


_SIM = """WITH v AS (SELECT vec_id, label::INT AS agent_id, embedding::DOUBLE[] AS e, (vec_id % 30)::INT AS created_day, (vec_id % 10) / 10.0 AS importance FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, m.agent_id, m.vec_id, m.created_day, m.importance, round(list_dot_product(q.e, m.e), 12) AS sim FROM v q JOIN v m USING (agent_id) WHERE q.vec_id % 25 = 0)"""


@query("t1_exact_top", _SIM + " SELECT query_id, agent_id, vec_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10")
def t1(spark, d):
    v = _vectors(spark, d)
    return search.exact_top(v, records.vector_queries(v), 10).withColumn("sim", F.round("sim", 6))


@query("t1_block_join", _SIM.replace(" WHERE q.vec_id % 25 = 0", "") + " SELECT query_id, agent_id, vec_id, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10")
def t1b(spark, d):
    """Every vector asks for its nearest: vectors and queries meet in blocks."""
    v = _vectors(spark, d)
    found = search.block_top(search.dated(v), search.asked_on(v.withColumnRenamed("vec_id", "query_id")), 10)
    return search.ranked(found, 10).select("query_id", "agent_id", "vec_id", F.round("sim", 6).alias("sim"))


_T3 = _SIM + f""", sl AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 20),
 sc AS (SELECT *, round(sim + 0.25 * pow(0.5, greatest(0, {NOW} - created_day) / 21.0) + 0.1 * importance, 12) AS score FROM sl),
 hit AS (SELECT query_id, agent_id, vec_id, sim, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, vec_id)::INT AS rank FROM sc QUALIFY rank <= 5)"""


@query("t3_recall", _T3 + " SELECT * REPLACE (round(sim, 6) AS sim, round(score, 6) AS score) FROM hit")
def t3(spark, d):
    v = _vectors(spark, d)
    return search.recall(v, records.vector_queries(v), 5, NOW).select("query_id", "agent_id", "vec_id", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"), "rank")


@query("t4_recall_audit", _T3 + f" SELECT agent_id, {NOW} AS day, 'recall' AS op, vec_id::VARCHAR AS item_id, left('vector ' || query_id, 48) AS detail FROM hit")
def t4(spark, d):
    v = _vectors(spark, d)
    q = records.vector_queries(v)
    return search.recall_audit(search.recall(v, q, 5, NOW), q, NOW)


@query("a8_access", _T3 + """ SELECT agent_id, vec_id::VARCHAR AS item_id, count(*) AS access_count, arg_max((query_id * 7 % 31)::INT, (rank, query_id)) AS last_access_day FROM hit GROUP BY agent_id, vec_id""")
def a8(spark, d):
    """Hits as a log in the order of rank and query; days go up and down in it, so the last row's isn't the greatest."""
    v = _vectors(spark, d)
    hits = search.recall(v, records.vector_queries(v), 5, NOW)
    log = hits.select("agent_id", (F.col("query_id") * 7 % 31).cast("int").alias("day"), F.lit("recall").alias("op"), F.col("vec_id").cast("string").alias("item_id"), F.struct("rank", "query_id").alias("seq"))
    return lifecycle.access(log)


@query("p9_public_hits", _T3 + " SELECT query_id, rank, 'V' || h.vec_id AS id, 'vector ' || h.vec_id AS content, 'semantic' AS type, v.importance, false AS superseded FROM hit h JOIN v USING (vec_id)")
def p9(spark, d):
    v = _vectors(spark, d)
    hits = search.recall(v, records.vector_queries(v), 5, NOW).withColumn("id", F.concat(F.lit("V"), F.col("vec_id").cast("string")))
    known = v.select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"), F.lit("semantic").alias("mtype"), "importance", F.lit(None).cast("string").alias("superseded_by"))
    return search.public_hits(hits, known)


@query("t2_approximate_top")
def t2(spark, d):
    """Recall of the approximate search against the exact one, by query; 0.9 on average at least (see tests)."""
    v = _vectors(spark, d)
    q = records.vector_queries(v)
    near = search.approximate_top(v, q, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return search.exact_top(v, q, 10).join(near, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query("j5_remove", "SELECT count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE label <> 3")
def j5(spark, d):
    v = _vectors(spark, d)
    return search.without(v, v.where("agent_id = 3")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("w6_vector_ids", SEM + " SELECT agent_id, id, ('0x' || substr(md5(agent_id || '|' || id), 1, 15))::BIGINT AS vec_id FROM sem")
def w6(spark, d):
    return search.vector_ids(_semantic(spark, d)).select("agent_id", "id", "vec_id")


@query("s4_vector_table", "SELECT label::INT AS agent_id, count(*) AS n FROM embeddings GROUP BY label")
def s4(spark, d):
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    search.save_vectors(_vectors(spark, d), path)
    return search.load_vectors(spark, path).groupBy("agent_id").agg(F.count("*").alias("n"))


@query("s4_pruned_recall", _T3 + " SELECT query_id, vec_id, rank FROM hit WHERE agent_id IN (3, 7)")
def s4p(spark, d):
    """Recall of two agents over a kept table of vectors: only the buckets that hold them are read."""
    v, path = _vectors(spark, d), f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    search.save_vectors(v, path)
    asked = records.vector_queries(v).where("agent_id in (3, 7)")
    return search.recall(search.load_vectors(spark, path, asked), asked, 5, NOW).select("query_id", "vec_id", "rank")


_EV = """WITH q AS (SELECT item_id, lower(text) AS t, CASE item_id % 3 WHEN 0 THEN 5 ELSE (item_id % 3)::INT END AS category FROM benchmark),
 h AS (SELECT q.item_id, category, doc_id FROM q JOIN documents d ON contains(lower(d.text), q.t)), g AS (SELECT item_id, category, list(doc_id ORDER BY doc_id) AS ids FROM h GROUP BY ALL)"""


def _gold(spark, d) -> DataFrame:
    """item_id, category, doc_id: benchmark items by the documents that hold their text."""
    items_ = _read(spark, d, "benchmark").select("item_id", F.lower("text").alias("t"), F.when(F.col("item_id") % 3 == 0, 5).otherwise((F.col("item_id") % 3).cast("int")).alias("category"))
    docs = _read(spark, d, "documents").select("doc_id", F.lower("text").alias("body"))
    return evaluate.holding(docs, items_)


@query("p10_scorable", _EV + " SELECT item_id, category FROM g WHERE category <> 5")
def p10(spark, d):
    asked = _gold(spark, d).groupBy("item_id", "category").agg(F.collect_set("doc_id").alias("evidence"))
    return evaluate.scorable(asked).select("item_id", "category")


@query("a6_retrieval_metrics", _EV + """, r AS (SELECT item_id, category, list_prepend(-1::BIGINT, ids) AS ranked, ids FROM g),
 m AS (SELECT category, len(list_intersect(ranked[1:1], ids)) / len(ids) AS r1, len(list_intersect(ranked[1:5], ids)) / len(ids) AS r5, len(list_intersect(ranked[1:10], ids)) / len(ids) AS r10, len(list_intersect(ranked[1:20], ids)) / len(ids) AS r20 FROM r)
 SELECT category, round(avg(r1), 6) AS recall_1, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(r20), 6) AS recall_20, 0.5 AS mrr_10, count(*) AS n FROM m GROUP BY ROLLUP (category)""")
def a6(spark, d):
    """The metrics alone, over the list that the SQL makes: a miss, then the gold. a6_searched_metrics searches."""
    gold = staged(_gold(spark, d).withColumnRenamed("item_id", "query_id"), "gold")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return evaluate.metrics_of_rows(gold.withColumn("rank", place).where("rank < 20").select("query_id", "doc_id", F.col("rank") + 1).toDF("query_id", "doc_id", "rank"), gold)


#: Bags of words by MD5, 64 buckets, as floats; similarity over buckets in common; the shortlist of 20, then the score.
_W = "(n::FLOAT / sqrt(sum(n * n) OVER (PARTITION BY {0}))::FLOAT)::DOUBLE AS w"
_BUCKET = "(('0x' || substr(md5(t), 1, 8))::BIGINT % 64)::INT AS b"


def _bag(table: str, key: str, text: str) -> str:
    """SQL: weights of buckets of a table's texts."""
    return f"SELECT {key}, b, {_W.format(key)} FROM (SELECT {key}, b, count(*) AS n FROM (SELECT {key}, {_BUCKET} FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {table})) GROUP BY ALL)"


_A6S = _EV + f""", db AS ({_bag('documents', 'doc_id', 'text')}), qb AS ({_bag('benchmark', 'item_id', 'text')}),
 sp AS (SELECT item_id, doc_id, sum(qb.w * db.w) AS s FROM qb JOIN db USING (b) GROUP BY ALL),
 r AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(s, 0), 12) DESC, d.doc_id) AS rank FROM (SELECT DISTINCT item_id FROM h) b, documents d LEFT JOIN sp ON sp.item_id = b.item_id AND sp.doc_id = d.doc_id QUALIFY rank <= 20),
 f AS (SELECT h.item_id, h.category, count(*) AS g, count(*) FILTER (rank <= 1) AS r1, count(*) FILTER (rank <= 5) AS r5, count(*) FILTER (rank <= 10) AS r10, count(*) FILTER (rank <= 20) AS r20, min(rank) AS first FROM h LEFT JOIN r ON r.item_id = h.item_id AND r.doc_id = h.doc_id GROUP BY ALL)
 SELECT category, round(avg(r1 / g), 6) AS recall_1, round(avg(r5 / g), 6) AS recall_5, round(avg(r10 / g), 6) AS recall_10, round(avg(r20 / g), 6) AS recall_20, round(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END), 6) AS mrr_10, count(*) AS n FROM f GROUP BY ROLLUP (category)"""


@query("a6_searched_metrics", _A6S)
def a6s(spark, d):
    """Items search all documents by similarity only; gold are the documents that hold the item."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("agent_id"), F.col("text").alias("content"), F.lit(0).alias("created_day"), F.lit(0.0).alias("importance"))
    asked = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("agent_id"), F.col("text").alias("content"))
    bag = search.md5_encoder(64)
    hits = search.recall(staged(search.embed(docs, encode=bag).drop("content"), "vectors"), staged(search.embed(asked, encode=bag), "asked"), 20, NOW, items.Policy(recency=False))
    return evaluate.metrics_of_rows(hits.select("query_id", F.col("vec_id").alias("doc_id"), "rank"), _gold(spark, d).withColumnRenamed("item_id", "query_id"))


@query("u2_u3_columns", _EV + """, r AS (SELECT item_id, list_prepend(-1::BIGINT, ids) AS ranked, ids FROM g)
 SELECT item_id, round(len(list_intersect(ranked[1:5], ids)) / len(ids), 6) AS recall_5, 0.5 AS rr FROM r""")
def u2(spark, d):
    """The column functions over a list of each item: a miss, then the gold."""
    lists = _gold(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_set("doc_id")).alias("gold")).withColumn("ranked", F.concat(F.array(F.lit(-1).cast("long")), "gold"))
    return lists.select("item_id", F.round(evaluate.recall_at(F.col("ranked"), F.col("gold"), 5), 6).alias("recall_5"), evaluate.reciprocal_rank(F.col("ranked"), F.col("gold")).alias("rr"))


def _conversation_file(spark, d) -> str:
    """The conversations as a benchmark's file, one a line: sessions of two turns; a user's turn asks, the one after it
    is the evidence, and the answer is its length. Categories go around, 5 among them; every third evidence is a text."""
    t = _read(spark, d, "conversations").withColumn("session", F.floor(F.col("turn") / 2).cast("int"))
    t = t.withColumn("dia_id", F.concat(F.lit("D"), (F.col("session") + 1).cast("string"), F.lit(":"), F.col("turn").cast("string")))
    sessions = t.groupBy("conv_id", "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "dia_id", F.col("role").alias("speaker"), "text"))), lambda x: F.struct(x["dia_id"].alias("dia_id"), x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("turns"))
    talks = sessions.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("session_"), (F.col("session") + 1).cast("string")), "turns"))).alias("conversation"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("dia_id").alias("evidence"), F.length("text").alias("answer"))
    asked = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(after, ["conv_id", "turn"])
    listed = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("['"), "evidence", F.lit("', 'x']"))).otherwise(F.to_json(F.array("evidence")))
    qa = asked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer", listed.alias("evidence"), (F.col("turn") % 5 + 1).cast("int").alias("category")))).alias("qa"))
    path = f"{shared_dir(spark)}/conversations-{uuid.uuid4().hex}"
    talks.join(qa, "conv_id", "left").select(F.col("conv_id").cast("string").alias("sample_id"), "conversation", "qa").write.json(path)
    return path


@query("s3_read_turns", "SELECT conv_id::VARCHAR AS sample_id, (turn // 2)::INT AS session, 'D' || ((turn // 2) + 1) || ':' || turn AS dia_id, role AS speaker, text FROM conversations WHERE text IS NOT NULL")
def s3r(spark, d):
    return records.conversations(spark, _conversation_file(spark, d), True)[0].select("sample_id", "session", "dia_id", "speaker", "text")


@query("wc_conversation_benchmark", f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role || ': ' || text AS said, text, role FROM conversations),
 q AS (SELECT t.id, t.conv_id, t.text, (t.turn % 5 + 1)::INT AS category, e.id AS gold FROM t JOIN t e ON e.conv_id = t.conv_id AND e.turn = t.turn + 1 WHERE t.role = 'user' AND t.turn % 5 <> 4),
 qb AS ({_bag('q', 'id', 'text')}), tb AS ({_bag('t', 'id', 'said')}),
 sp AS (SELECT qb.id AS a, tb.id AS b, sum(qb.w * tb.w) AS s FROM qb JOIN tb USING (b) WHERE qb.id // 1000 = tb.id // 1000 GROUP BY ALL),
 r AS (SELECT q.id, q.category, q.gold, t.id AS e, row_number() OVER (PARTITION BY q.id ORDER BY round(coalesce(s, 0), 12) DESC, t.turn) AS rank FROM q JOIN t USING (conv_id) LEFT JOIN sp ON a = q.id AND sp.b = t.id)
 SELECT category, round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg((rank <= 5)::INT), 6) AS recall_5, round(avg((rank <= 10)::INT), 6) AS recall_10, round(avg((rank <= 20)::INT), 6) AS recall_20,
 round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS mrr_10, count(*) AS n FROM r WHERE e = gold GROUP BY ROLLUP (category)""")
def wc(spark, d):
    """From the file to the metrics."""
    turns, questions = records.conversations(spark, _conversation_file(spark, d), True)
    return evaluate.conversation_benchmark(turns, questions, lambda rows: search.embed(rows, encode=search.md5_encoder(64)))


def _recalled(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Under each policy, what recall inside a key gives; the key's values as gold. Similarity is alike inside a key."""
    m, sem = _memories(spark, d), _semantic(spark, d)
    stated = lifecycle.facts(m).select(*lifecycle.KEY, "value", "content", "created_day", "importance", "seq", F.lit(False).alias("consolidated"), F.lit(False).alias("superseded"))
    known = sem.select(*lifecycle.KEY, "value", "content", "created_day", "importance", "seq", F.lit(True).alias("consolidated"), F.col("superseded_by").isNotNull().alias("superseded"))
    policies = spark.createDataFrame([("flat-vector", False, False, False), ("recency", True, False, False), ("recency+consolidation", True, True, False), ("recency+consolidation+supersession", True, True, True)], "policy string, r boolean, c boolean, s boolean")
    pool = stated.unionByName(known).join(F.broadcast(policies), F.col("consolidated") == F.col("c")).where("not (s and superseded)")
    score = F.when(F.col("r"), F.round(0.25 * items.recency(F.col("created_day"), F.lit(NOW)) + 0.1 * F.col("importance"), 6)).otherwise(F.lit(0.0))
    query_id = F.concat_ws("|", *[F.col(c).cast("string") for c in lifecycle.KEY])
    order = Window.partitionBy("policy", "query_id").orderBy(F.desc("score"), "seq")
    hits = pool.withColumns({"score": score, "query_id": query_id}).withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    hits = hits.select("policy", "query_id", "rank", "value", items.word_count(F.col("content")).alias("words"))
    return hits, *_gold_of(sem.withColumn("query_id", query_id))


def _gold_of(sem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of semantic rows with query_id: the current value and category of each key, and its prior values as rows."""
    old = F.col("superseded_by").isNotNull()
    gold = sem.groupBy("query_id").agg(F.max(F.when(~old, F.col("value"))).alias("gold_value"), F.when(F.max(old.cast("int")) == 1, "changing").otherwise("stable").alias("category"))
    return gold, sem.where(old).select("query_id", "value")


_FLAGS = SEM + f""", p AS (SELECT * FROM (VALUES ('flat-vector', false, false, false), ('recency', true, false, false), ('recency+consolidation', true, true, false), ('recency+consolidation+supersession', true, true, true)) t(policy, r, c, s)),
 u AS (SELECT agent_id, subject, attribute, value, content, created_day, importance, seq, false AS cons, false AS sup FROM st WHERE attribute IS NOT NULL UNION ALL SELECT agent_id, subject, attribute, value, content, created_day, importance, NULL, true, superseded_by IS NOT NULL FROM sem),
 u2 AS (SELECT u.* REPLACE (coalesce(seq, (SELECT max(st.seq) FROM st WHERE st.agent_id = u.agent_id AND st.subject = u.subject AND st.attribute = u.attribute AND st.value = u.value AND st.created_day = u.created_day)) AS seq) FROM u),
 k AS (SELECT policy, agent_id || '|' || subject || '|' || attribute AS query_id, value, content, row_number() OVER (PARTITION BY policy, agent_id, subject, attribute ORDER BY CASE WHEN r THEN round(0.25 * pow(0.5, greatest(0, {NOW} - created_day) / 21.0) + 0.1 * importance, 6) ELSE 0 END DESC, seq) AS rank FROM u2 JOIN p ON cons = c AND NOT (s AND sup)),
 l AS (SELECT policy, query_id, list(value ORDER BY rank) AS vs, sum(len(string_split(content, ' ')))::BIGINT AS words FROM k WHERE rank <= 5 GROUP BY ALL),
 gd AS (SELECT agent_id || '|' || subject || '|' || attribute AS query_id, max(value) FILTER (superseded_by IS NULL) AS gv, list(value) FILTER (superseded_by IS NOT NULL) AS pv FROM sem GROUP BY 1),
 fl AS (SELECT policy, l.query_id, CASE WHEN pv IS NULL OR len(pv) = 0 THEN 'stable' ELSE 'changing' END AS category, (vs[1] = gv)::INT::DOUBLE AS acc_1, list_contains(vs, gv)::INT::DOUBLE AS found_k, coalesce(list_has_any(vs, pv), false)::INT::DOUBLE AS stale_k, words FROM l JOIN gd USING (query_id))"""


@query("u4_hit_flags", _FLAGS + " SELECT * FROM fl")
def u4(spark, d):
    return evaluate.hit_flags(*_recalled(spark, d))


@query("a5_ablation", _FLAGS + " SELECT policy, category, round(avg(acc_1), 3) AS acc_1, round(avg(found_k), 3) AS found_k, round(avg(stale_k), 3) AS stale_k, round(avg(words), 3) AS ctx_words, count(*) AS n FROM fl GROUP BY GROUPING SETS ((policy), (policy, category))")
def a5(spark, d):
    return evaluate.ablation(evaluate.hit_flags(*_recalled(spark, d)))


def _searched(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As _recalled, by search: a key's subject and attribute are asked in the agent's whole pool under each policy, so
    that memories of other keys compete. Values carry their key: another key's equal value isn't right."""
    m, sem = _memories(spark, d), search.vector_ids(_semantic(spark, d))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in lifecycle.KEY])
    columns = ["vec_id", "agent_id", key.alias("key"), F.concat(key, F.lit("="), "value").alias("value"), "content", F.concat_ws(" ", "subject", "content").alias("said"), "created_day", "importance"]
    stated = m.withColumn("vec_id", F.col("seq")).select(*columns, F.lit(False).alias("consolidated"), F.lit(False).alias("superseded"))
    # Statements of no fact are in the pool under every policy, as in lifecycle.candidates.
    others = m.withColumn("vec_id", F.col("seq")).where("attribute is null").select(*columns, F.lit(True).alias("consolidated"), F.lit(False).alias("superseded"))
    known = sem.select(*columns, F.lit(True).alias("consolidated"), F.col("superseded_by").isNotNull().alias("superseded"))
    pool = staged(search.embed(stated.unionByName(others).unionByName(known), text="said", encode=search.md5_encoder(64)).drop("said"), "pool")
    keys = lifecycle.facts(m).select(*lifecycle.KEY).distinct().select("agent_id", key.alias("key"), F.xxhash64(key).alias("query_id"), F.concat_ws(" ", "subject", F.replace("attribute", F.lit("_"), F.lit(" "))).alias("asked"))
    keys = staged(search.embed(keys, text="asked", encode=search.md5_encoder(64)), "asked")
    out = None
    for policy in (items.Policy(False, False, False), items.Policy(False, False, True), items.Policy(True, False, True), items.Policy(True, True, True)):
        mine = pool.where(F.col("consolidated") == policy.consolidation)
        mine = mine.where("not superseded") if policy.supersession else mine
        hits = search.recall(mine, keys, 5, NOW, policy).select("query_id", "vec_id", "rank").join(mine.select("vec_id", "value", "content"), "vec_id")
        hits = hits.join(keys.select("query_id", "key"), "query_id").select(F.lit(policy.label).alias("policy"), F.col("key").alias("query_id"), "rank", "value", items.word_count(F.col("content")).alias("words"))
        out = hits if out is None else out.unionByName(hits)
    return out, *_gold_of(sem.select(key.alias("query_id"), F.concat(key, F.lit("="), "value").alias("value"), "superseded_by"))


@query("s7_report_rows", _FLAGS + """, m AS (SELECT policy, category, avg(acc_1) AS acc_1, avg(found_k) AS found_k, avg(stale_k) AS stale_k, avg(words) AS ctx_words, count(*)::DOUBLE AS n FROM fl GROUP BY GROUPING SETS ((policy), (policy, category)))
 SELECT policy, coalesce(category, 'overall') AS category, metric, round("value", 3) AS "value" FROM (UNPIVOT m ON acc_1, found_k, stale_k, ctx_words, n INTO NAME metric VALUE "value")""")
def s7(spark, d):
    return evaluate.report_rows(evaluate.ablation(evaluate.hit_flags(*_recalled(spark, d))), ["policy", "category"])


@query("t3_recall_by_day", """WITH v AS (SELECT vec_id, label::INT AS agent_id, embedding::DOUBLE[] AS e, (vec_id % 30)::INT AS created_day, (vec_id % 10) / 10 AS importance, CASE WHEN vec_id % 3 = 0 THEN 5 END AS ttl FROM embeddings),
 q AS (SELECT vec_id AS query_id, agent_id, e, (10 + vec_id % 20)::INT AS day FROM v WHERE vec_id % 25 = 0),
 p AS (SELECT query_id, vec_id, round(list_dot_product(q.e, v.e), 12) AS sim, created_day, importance, day FROM q JOIN v USING (agent_id) WHERE ttl IS NULL OR day - created_day <= ttl),
 s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 20),
 b AS (SELECT query_id, vec_id, sim, round(sim + 0.25 * pow(0.5, greatest(0, day - created_day) / 21.0) + 0.1 * importance, 12) AS score FROM s)
 SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, vec_id) AS rank FROM b QUALIFY rank <= 5""")
def t3d(spark, d):
    """Recall on a day of each query's own; every third vector lives five days."""
    v = _vectors(spark, d).withColumn("ttl_days", F.when(F.col("vec_id") % 3 == 0, 5))
    asked = records.vector_queries(v).withColumn("day", (10 + F.col("query_id") % 20).cast("int"))
    return search.recall(v, asked, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


_SEARCHED = SEM + f""", u AS (SELECT agent_id, seq AS vec_id, concat_ws('|', agent_id, subject, attribute) || '=' || "value" AS v, content, concat_ws(' ', subject, content) AS said, created_day, importance, false AS cons, false AS sup FROM st
 UNION ALL SELECT agent_id, seq, NULL, content, concat_ws(' ', subject, content), created_day, importance, true, false FROM st WHERE attribute IS NULL
 UNION ALL SELECT agent_id, ('0x' || substr(md5(agent_id || '|' || id), 1, 15))::BIGINT, agent_id || '|' || subject || '|' || attribute || '=' || "value", content, subject || ' ' || content, created_day, importance, true, superseded_by IS NOT NULL FROM sem),
 ub AS (SELECT cons, vec_id, b, {_W.format('cons, vec_id')} FROM (SELECT cons, vec_id, b, count(*) AS n FROM (SELECT cons, vec_id, {_BUCKET} FROM (SELECT cons, vec_id, unnest(regexp_extract_all(lower(said), '[a-z0-9]+')) AS t FROM u)) GROUP BY ALL)),
 k AS (SELECT DISTINCT agent_id, agent_id || '|' || subject || '|' || attribute AS q, subject || ' ' || replace(attribute, '_', ' ') AS asked FROM st WHERE attribute IS NOT NULL),
 kb AS (SELECT q, b, {_W.format('q')} FROM (SELECT q, b, count(*) AS n FROM (SELECT q, {_BUCKET} FROM (SELECT q, unnest(regexp_extract_all(lower(asked), '[a-z0-9]+')) AS t FROM k)) GROUP BY ALL)),
 sp AS (SELECT q, cons, vec_id, sum(kb.w * ub.w) AS s FROM kb JOIN ub USING (b) GROUP BY ALL),
 si AS (SELECT k.q, u.*, round(coalesce(sp.s, 0), 12) AS sim FROM k JOIN u USING (agent_id) LEFT JOIN sp ON sp.q = k.q AND sp.vec_id = u.vec_id AND sp.cons = u.cons),
 p AS (SELECT * FROM (VALUES ('flat-vector', false, false, false), ('recency', true, false, false), ('recency+consolidation', true, true, false), ('recency+consolidation+supersession', true, true, true)) t(policy, r, c, s)),
 sh AS (SELECT * FROM si JOIN p ON cons = c AND NOT (s AND sup) QUALIFY row_number() OVER (PARTITION BY policy, q ORDER BY sim DESC, vec_id) <= 20),
 sc AS (SELECT *, round(sim + CASE WHEN r THEN 0.25 * pow(0.5, greatest(0, {NOW} - created_day) / 21.0) + 0.1 * importance ELSE 0 END, 12) AS score FROM sh),
 hi AS (SELECT *, row_number() OVER (PARTITION BY policy, q ORDER BY score DESC, sim DESC, vec_id) AS rank FROM sc QUALIFY rank <= 5),
 gd AS (SELECT agent_id || '|' || subject || '|' || attribute AS q, max(agent_id || '|' || subject || '|' || attribute || '=' || "value") FILTER (superseded_by IS NULL) AS gv, CASE WHEN count(superseded_by) > 0 THEN 'changing' ELSE 'stable' END AS category FROM sem GROUP BY 1),
 pv AS (SELECT DISTINCT agent_id || '|' || subject || '|' || attribute AS q, agent_id || '|' || subject || '|' || attribute || '=' || "value" AS v, true AS old FROM sem WHERE superseded_by IS NOT NULL),
 fl AS (SELECT policy, hi.q AS query_id, category, max(coalesce(rank = 1 AND hi.v = gv, false)::INT)::DOUBLE AS acc_1, max(coalesce(hi.v = gv, false)::INT)::DOUBLE AS found_k, max(coalesce(old, false)::INT)::DOUBLE AS stale_k, sum(len(string_split(content, ' ')))::BIGINT AS words FROM hi JOIN gd ON gd.q = hi.q LEFT JOIN pv ON pv.q = hi.q AND pv.v = hi.v GROUP BY ALL)"""


@query("u4_searched_flags", _SEARCHED + " SELECT * FROM fl")
def u4s(spark, d):
    return evaluate.hit_flags(*_searched(spark, d))


@query("a5_searched_ablation", _SEARCHED + " SELECT policy, category, round(avg(acc_1), 3) AS acc_1, round(avg(found_k), 3) AS found_k, round(avg(stale_k), 3) AS stale_k, round(avg(words), 3) AS ctx_words, count(*) AS n FROM fl GROUP BY GROUPING SETS ((policy), (policy, category))")
def a5s(spark, d):
    return evaluate.ablation(evaluate.hit_flags(*_searched(spark, d)))


@query("a7_answer_f1")
def a7(spark, d):
    """An assistant's turn as the answer to the user's turn before it, by words in common."""
    t = _read(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    answers = t.withColumn("gold", F.lag("text").over(before)).where("role = 'assistant' and gold is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("turn") % 4 + 1).cast("int").alias("category"), F.col("text").alias("prediction"), "gold")
    return evaluate.f1_metrics(evaluate.answer_f1(answers))


@query("s3_turns", "SELECT conv_id AS sample_id, (turn // 2)::INT AS session, 'D' || ((turn // 2) + 1) || ':' || turn AS dia_id, role || ': ' || text AS content FROM conversations")
def s3(spark, d):
    return records.turns_of(_read(spark, d, "conversations"))


def _audit(spark, d) -> DataFrame:
    """Write rows by chain of a user, numbered from 0."""
    log = lifecycle.write_audit(_memories(spark, d).withColumn("chain", F.regexp_extract("subject", r"(\d+)", 1).cast("int")).withColumn("agent_id", F.col("chain")))
    place = Window.partitionBy("agent_id").orderBy("seq")
    return log.withColumn("seq", (F.row_number().over(place) - 1).cast("long")).withColumnRenamed("agent_id", "chain_id")


_CHAIN = S.replace("WITH st", "WITH RECURSIVE st", 1) + """, au AS (SELECT replace(subject, 'user:', '')::INT AS chain_id, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS seq, created_day AS day, id AS item_id, coalesce(attribute || '=' || value, 'episodic') AS detail FROM st),
 b AS (SELECT *, sha256('{"detail":' || to_json(detail) || ',"item_id":' || to_json(item_id) || ',"op":"write","payload":null}') AS content_hash FROM au),
 ch AS (SELECT chain_id, -1::BIGINT AS seq, NULL::VARCHAR AS content_hash, NULL::VARCHAR AS prev_hash, 'pag:genesis' AS entry_hash FROM (SELECT DISTINCT chain_id FROM b)
 UNION ALL SELECT b.chain_id, b.seq, b.content_hash, ch.entry_hash, sha256(ch.entry_hash || '{"agent_id":"memory-service","attestation_level":"none","content_hash":"' || b.content_hash || '","day":' || b.day || ',"detail":' || to_json(b.detail) || ',"item_id":' || to_json(b.item_id) || ',"model_id":null,"op":"write","payload":null,"seq":' || b.seq || '}')
 FROM ch JOIN b ON b.chain_id = ch.chain_id AND b.seq = ch.seq + 1)"""


def _CHAIN_OF(first: str) -> str:
    """As _CHAIN, with an attestation at 0 and the writers of x4_attested_chain."""
    # Fixed values, written here and not taken from the code that is held against them.
    identity = '{"fingerprint":"cfg:852089a94b29860c4d0ee67505cfd6f0","grade":"config-hash","model":"hashing-bow-64"}'
    named = lambda odd, even: f"CASE WHEN chain_id % 2 = 1 THEN '{odd}' ELSE '{even}' END"
    model, grade = "hashing-bow-64", "config-hash"
    return S.replace("WITH st", "WITH RECURSIVE st", 1) + f""", a0 AS (SELECT replace(subject, 'user:', '')::INT AS chain_id, row_number() OVER (PARTITION BY subject ORDER BY seq) AS seq, created_day AS day, 'write' AS op, id AS item_id, coalesce(attribute || '=' || value, 'episodic') AS detail, 'null' AS payload FROM st),
 au AS (SELECT *, {named('planner', 'memory-service')} AS agent_id, {named('m-1', model)} AS model_id, {named('declared', grade)} AS attestation_level FROM a0
 UNION ALL SELECT DISTINCT chain_id, 0, 0, '{first}', 'embedder', '{model} ({grade})', '{identity}', 'memory-service', '{model}', '{grade}' FROM a0),
 b AS (SELECT *, sha256('{{"detail":' || to_json(detail) || ',"item_id":' || to_json(item_id) || ',"op":' || to_json(op) || ',"payload":' || payload || '}}') AS content_hash FROM au),
 ch AS (SELECT chain_id, -1::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS agent_id, NULL::VARCHAR AS model_id, NULL::VARCHAR AS attestation_level, NULL::VARCHAR AS content_hash, NULL::VARCHAR AS prev_hash, 'pag:genesis' AS entry_hash FROM (SELECT DISTINCT chain_id FROM b)
 UNION ALL SELECT b.chain_id, b.seq, b.op, b.agent_id, b.model_id, b.attestation_level, b.content_hash, ch.entry_hash, sha256(ch.entry_hash || '{{"agent_id":' || to_json(b.agent_id) || ',"attestation_level":' || to_json(b.attestation_level) || ',"content_hash":"' || b.content_hash || '","day":' || b.day || ',"detail":' || to_json(b.detail) || ',"item_id":' || to_json(b.item_id) || ',"model_id":' || to_json(b.model_id) || ',"op":' || to_json(b.op) || ',"payload":' || b.payload || ',"seq":' || b.seq || '}}')
 FROM ch JOIN b ON b.chain_id = ch.chain_id AND b.seq = ch.seq + 1)"""


@query("x4_chain_build", _CHAIN + " SELECT chain_id, seq, content_hash, prev_hash, entry_hash FROM ch WHERE seq >= 0")
def x4(spark, d):
    return chain.build(_audit(spark, d)).select("chain_id", "seq", "content_hash", "prev_hash", "entry_hash")


@query("x4_attested_chain", _CHAIN_OF("model-attest") + " SELECT chain_id, seq, op, agent_id, model_id, attestation_level, content_hash, prev_hash, entry_hash FROM ch WHERE seq >= 0")
def x4a(spark, d):
    """Chains of two writers, one with a model of its own; each begins with the attestation of the embedder."""
    odd = F.col("chain_id") % 2 == 1
    log = _audit(spark, d).withColumns({"actor_id": F.when(odd, "planner"), "model_id": F.when(odd, "m-1"), "attestation_level": F.when(odd, "declared")})
    return chain.build(chain.attested(log, chain.attest(64))).select("chain_id", "seq", "op", "agent_id", "model_id", "attestation_level", "content_hash", "prev_hash", "entry_hash")


@query("x4_segmented_chain", S.replace("WITH st", "WITH RECURSIVE st", 1) + """, au AS (SELECT agent_id, row_number() OVER (PARTITION BY agent_id, created_day ORDER BY seq) - 1 AS seq, created_day AS day, id AS item_id, coalesce(attribute || '=' || value, 'episodic') AS detail FROM st),
 b AS (SELECT *, sha256('{"detail":' || to_json(detail) || ',"item_id":' || to_json(item_id) || ',"op":"write","payload":null}') AS content_hash FROM au),
 ch AS (SELECT agent_id, day, -1::BIGINT AS seq, 'pag:genesis' AS entry_hash FROM (SELECT DISTINCT agent_id, day FROM b)
 UNION ALL SELECT b.agent_id, b.day, b.seq, sha256(ch.entry_hash || '{"agent_id":"memory-service","attestation_level":"none","content_hash":"' || b.content_hash || '","day":' || b.day || ',"detail":' || to_json(b.detail) || ',"item_id":' || to_json(b.item_id) || ',"model_id":null,"op":"write","payload":null,"seq":' || b.seq || '}')
 FROM ch JOIN b ON b.agent_id = ch.agent_id AND b.day = ch.day AND b.seq = ch.seq + 1)
 SELECT agent_id AS chain_id, day, max(seq) + 1 AS n, arg_max(entry_hash, seq) AS head FROM ch GROUP BY agent_id, day""")
def x4s(spark, d):
    """Ten agents' logs, cut by day: each segment's length and head, as the summary names them."""
    log = lifecycle.write_audit(_memories(spark, d)).withColumnRenamed("agent_id", "chain_id")
    summary = chain.segments(log)[1]
    named = F.split("detail", ":")
    return summary.select("chain_id", "day", named[0].cast("long").alias("n"), named[1].alias("head"))


@query("w3_verify_segments", S + """ SELECT agent_id AS chain_id, agent_id % 2 = 0 AS ok, count(DISTINCT created_day) AS days, count(*) AS length, CASE WHEN agent_id % 2 = 1 THEN 7 END AS broken_day, true AS summary_ok FROM st GROUP BY agent_id""")
def w3s(spark, d):
    """Every second agent's first entry of day 7 is changed: its chain breaks on that day."""
    entries, summary = chain.segments(lifecycle.write_audit(_memories(spark, d)).withColumnRenamed("agent_id", "chain_id"), KEY)
    hit = (F.col("chain_id") % 2 == 1) & (F.col("day") == 7) & (F.col("seq") == 0)
    return chain.verify_segments(entries.withColumn("detail", F.when(hit, "changed").otherwise(F.col("detail"))), summary, KEY)


@query("w3_chain_verify", S + """, n AS (SELECT replace(subject, 'user:', '')::INT AS chain_id, count(*) AS length FROM st GROUP BY subject)
 SELECT chain_id, NOT (chain_id % 3 = 0 AND length > 2) AS ok, length, CASE WHEN chain_id % 3 = 0 AND length > 2 THEN 2::BIGINT END AS broken_at, true AS signed, NOT (chain_id % 3 = 0 AND length > 2) AS content_ok FROM n""")
def w3(spark, d):
    """Every third chain has its third entry changed."""
    entries = staged(chain.build(_audit(spark, d), KEY), "chain")
    touched = entries.withColumn("detail", F.when((F.col("chain_id") % 3 == 0) & (F.col("seq") == 2), "changed").otherwise(F.col("detail")))
    return chain.verify(touched, KEY).drop("sig_failures", "n_sig_failures")


@query("s5_snapshot", _CHAIN + " SELECT chain_id, max(seq) AS last_seq, arg_max(entry_hash, seq) AS head, count(*) AS length FROM ch WHERE seq >= 0 GROUP BY chain_id")
def s5(spark, d):
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    chain.export(staged(chain.build(_audit(spark, d)), "chain"), path)
    return chain.heads(chain.restore(spark, path))


def _in_runs(spark, d, by: str, job) -> DataFrame:
    """What job(stream, checkpoint) gives at last over the events in three parts, in the order of an expression: a part
    arrives, the job runs and stops, the next one arrives. Each run goes on where the one before has stopped."""
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    events = _read(spark, d, "events").withColumn("_at", F.expr(by).cast("double"))
    first, second = events.approxQuantile("_at", [1 / 3, 2 / 3], 0.01) or (0.0, 0.0)
    out = None
    for part in (F.col("_at") <= first, (F.col("_at") > first) & (F.col("_at") <= second), (F.col("_at") > second) | F.col("_at").isNull()):
        events.where(part).drop("_at").write.mode("append").parquet(f"{folder}/events")
        out = job(jobs.event_stream(spark, f"{folder}/events", 64), f"{folder}/job")
    return out


@query("r1_stream_ingest", _AUDIT + " SELECT agent_id, seq, day, op, item_id, detail FROM au")
def r1(spark, d):
    return _in_runs(spark, d, "event_id", lambda stream, at: jobs.continuous_ingest(stream, at)[1])


@query("r1_stream_upsert", S.replace("printf('M%07d', event_id)", "printf('U%05d-%02d', user_id, event_id % 7)") + f" SELECT {_EP} FROM st QUALIFY row_number() OVER (PARTITION BY agent_id, id ORDER BY seq DESC) = 1")
def r1u(spark, d):
    """Seven ids a user, written again and again in all batches: the last one of an id stays."""
    again = F.format_string("U%05d-%02d", F.regexp_extract("subject", r"(\d+)", 1).cast("int"), F.col("seq") % 7)
    return _in_runs(spark, d, "event_id", lambda stream, at: jobs.continuous_ingest(stream.withColumn("id", again), at)[0]).select(*_EP.split(", "))


@query("r2_stream_current", SEM + ", n AS (SELECT agent_id, subject, attribute, sum(support)::BIGINT AS statements FROM sem GROUP BY ALL) SELECT agent_id, subject, attribute, value, created_day, statements FROM sem JOIN n USING (agent_id, subject, attribute) WHERE superseded_by IS NULL")
def r2(spark, d):
    return _in_runs(spark, d, "event_id", jobs.current_facts)


@query("r3_stream_changes", S + ", l AS (SELECT agent_id, subject, attribute, lag(value) OVER w AS old_value, value AS new_value, created_day AS day, seq FROM st WHERE attribute IS NOT NULL WINDOW w AS (PARTITION BY agent_id, subject, attribute ORDER BY created_day, seq)) SELECT * FROM l WHERE old_value IS NOT NULL AND old_value <> new_value")
def r3(spark, d):
    return _in_runs(spark, d, "datediff(ts, date '2024-01-01')", jobs.change_log)


@query("r4_stream_working_memory", S + " SELECT agent_id, id, importance, created_day AS day, seq FROM st QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY importance DESC, created_day, seq DESC) > 8")
def r4(spark, d):
    return _in_runs(spark, d, "event_id", lambda stream, at: jobs.bounded_memory(stream, checkpoint=at))


@query("r5_stream_expiry", S + " SELECT agent_id, id, created_day + ttl_days + 1 AS day FROM st WHERE created_day + ttl_days + 1 <= 28")
def r5(spark, d):
    return _in_runs(spark, d, "datediff(ts, date '2024-01-01')", lambda stream, at: jobs.expiry(stream, 28, at))


def _log_of(stream: DataFrame) -> DataFrame:
    return stream.select(F.regexp_extract("subject", r"(\d+)", 1).cast("int").alias("chain_id"), "seq", F.col("ts_day").alias("day"), F.lit("write").alias("op"), F.col("id").alias("item_id"), F.coalesce(F.concat("attribute", F.lit("="), "value"), F.lit("episodic")).alias("detail"))


@query("r6_stream_chain", _CHAIN + " SELECT chain_id, true AS ok, count(*) AS length, arg_max(entry_hash, seq) AS head FROM ch WHERE seq >= 0 GROUP BY chain_id")
def r6(spark, d):
    entries = _in_runs(spark, d, "event_id", lambda stream, at: jobs.append_chain(_log_of(stream), checkpoint=at))
    return chain.verify(entries).select("chain_id", "ok", "length").join(chain.heads(entries).select("chain_id", "head"), "chain_id")


@query("r7_stream_refresh", _POOL + " SELECT * FROM pool")
def r7(spark, d):
    def rebuild(rows: DataFrame) -> DataFrame:
        m = lifecycle.ingest(rows)
        return lifecycle.candidates(m, lifecycle.consolidate(m, lineage=False), NOW)

    return _in_runs(spark, d, "event_id", lambda stream, at: jobs.refresh(stream, rebuild, at)).select("agent_id", "id", "content", "mtype", "created_day", "importance")


@query("x3_extract_facts", S + " SELECT agent_id, id, split_part(content, ' ', 1) AS attribute, content AS value FROM st WHERE attribute IS NOT NULL UNION ALL SELECT agent_id, id, NULL, NULL FROM st WHERE attribute IS NULL")
def x3(spark, d):
    def extractor(row):
        if row["text"].startswith("error"):
            raise ValueError("nothing to extract")
        return None, row["text"].split(" ")[0], row["text"]

    return search.extract_facts(_statements(spark, d).select("agent_id", "id", "text", "subject", "attribute", "value"), extractor).select("agent_id", "id", "attribute", "value")
