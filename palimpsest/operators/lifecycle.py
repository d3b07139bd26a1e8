"""Ingest, consolidation, retention and the views on memories. Every job is keyed by agent_id; seq is the order of
ingest within an agent and decides all ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.items import expired, fact_content, is_fact
from ..session import staged

KEY = ["agent_id", "subject", "attribute"]


def ingest(records: DataFrame) -> DataFrame:
    """Episodic memories of records (agent_id, seq, id, text, ts_day, subject, attribute, value and, if there,
    importance, ttl_days, provenance). Of rows with one id the last ingested counts."""
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    rows = records.select(
        "agent_id", "seq", "id", F.col("text").alias("content"), F.lit("episodic").alias("mtype"), F.coalesce(F.col("ts_day"), F.lit(0)).cast("int").alias("created_day"),
        F.coalesce(has("importance", "double"), F.lit(0.5)).alias("importance"), "subject", "attribute", "value", has("ttl_days", "int").cast("int").alias("ttl_days"),
        F.lit(1).cast("long").alias("support"), F.array(F.coalesce(has("provenance", "string"), F.col("id"))).alias("provenance"),
    )
    last = Window.partitionBy("agent_id", "id").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def write_audit(memories: DataFrame) -> DataFrame:
    detail = F.when(is_fact(F.col("attribute")), F.concat("attribute", F.lit("="), F.coalesce("value", F.lit("")))).otherwise("episodic")
    return memories.select("agent_id", "seq", F.col("created_day").alias("day"), F.lit("write").alias("op"), F.col("id").alias("item_id"), detail.alias("detail"))


def facts(memories: DataFrame) -> DataFrame:
    return memories.where(is_fact(F.col("attribute")))


def non_facts(memories: DataFrame) -> DataFrame:
    return memories.where(~is_fact(F.col("attribute")))


def fact_id(*columns: Column) -> Column:
    """Stable over runs: a hash of agent, key and value; a null value is told from an empty one."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


#: A key with more values than this is joined with its winner by broadcast, while such keys are few enough.
HOT_VALUES, BROADCAST_KEYS = 10_000, 1_000_000


def _current(values: DataFrame) -> DataFrame:
    """values (written, with KEY, id and _last) with _active, the id of the last one of their key.

    The last one comes from an aggregation, which is partial before it is shuffled. Keys of many values aren't shuffled
    to meet it: there are fewer of them than values divided by HOT_VALUES, so their winners are broadcast."""
    named = {c: f"_{c}" for c in KEY}
    winners = values.groupBy(*[F.col(c).alias(n) for c, n in named.items()]).agg(F.max_by("id", "_last").alias("_active"), F.count("*").alias("_n"))
    same = lambda right: [values[c].eqNullSafe(right[n]) for c, n in named.items()]
    hot = staged(winners.where(F.col("_n") > HOT_VALUES), "hot-keys")
    count = hot.count()
    if not count or count > BROADCAST_KEYS:
        return values.join(winners, same(winners)).drop("_n", *named.values())
    few, hot = winners.where(F.col("_n") <= HOT_VALUES), F.broadcast(hot)
    return values.join(few, same(few)).unionByName(values.join(hot, same(hot))).drop("_n", *named.values())


def consolidate(memories: DataFrame, supersession: bool = True, lineage: bool = True) -> DataFrame:
    """One semantic row a value of a key: newest day, highest importance, number of statements; with supersession
    all but the last stated value point at it. lineage: also provenance, the statements' ids in order; leave it out
    where a value may have very many, and take `lineage_links` instead."""
    stated = facts(memories).withColumn("subject", F.coalesce("subject", F.lit("")))
    aggregates = [F.max(F.struct("created_day", "seq")).alias("_last"), F.max("created_day").alias("created_day"), F.max("importance").alias("importance"), F.count("*").alias("support")]
    if lineage:
        aggregates.append(F.transform(F.array_sort(F.collect_list(F.struct("created_day", "seq", "id"))), lambda s: s["id"]).alias("provenance"))
    values = stated.groupBy(*KEY, "value").agg(*aggregates)
    values = values.withColumn("id", _id_of_value()).withColumn("content", fact_content(F.col("attribute"), F.col("value")))
    if supersession:
        values = _current(staged(values, "values"))
    by = F.when(F.col("_active") != F.col("id"), F.col("_active")) if supersession else F.lit(None).cast("string")
    return values.withColumn("superseded_by", by).withColumn("seq", F.col("_last.seq")).drop("_last", "_active")


def _id_of_value() -> Column:
    return fact_id(F.col("agent_id"), F.col("subject"), F.col("attribute"), F.coalesce(F.concat(F.lit("="), "value"), F.lit("null")))


def active(semantic: DataFrame) -> DataFrame:
    return semantic.where("superseded_by is null")


def consolidation_audit(semantic: DataFrame, supersession: bool, now: int) -> DataFrame:
    """A row for each superseded item, and one for each key (or, without supersession, each item) with its statements."""
    row = lambda df, op, detail: df.select("agent_id", F.lit(now).alias("day"), F.lit(op).alias("op"), F.col("id").alias("item_id"), detail.alias("detail"))
    if not supersession:
        return row(semantic, "consolidate", F.concat(F.lit("support="), F.col("support").cast("string")))
    keys = semantic.groupBy(*KEY).agg(F.sum("support").alias("n"), F.max(F.when(F.col("superseded_by").isNull(), F.col("id"))).alias("id"))
    old = semantic.where("superseded_by is not null")
    return row(old, "supersede", F.concat(F.lit("superseded-by:"), "superseded_by")).unionByName(row(keys, "consolidate", F.concat(F.lit("statements="), F.col("n").cast("string"))))


def forget_reason(now: int, grace: int = 365) -> Column:
    """Why an item goes: its time to live first, then a superseded item's age; null: it stays."""
    old = F.col("superseded_by").isNotNull() & (F.lit(now) - F.col("created_day") > grace)
    return F.when(expired(F.col("created_day"), F.col("ttl_days"), F.lit(now)), "ttl-expired").when(old, F.concat(F.lit("superseded-by:"), "superseded_by"))


def retain(items: DataFrame, now: int, grace: int = 365) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, forgotten with reason, audit rows)."""
    for name, kind in (("superseded_by", "string"), ("ttl_days", "int")):
        items = items if name in items.columns else items.withColumn(name, F.lit(None).cast(kind))
    judged = items.withColumn("reason", forget_reason(now, grace))
    gone = judged.where("reason is not null")
    audit = gone.select("agent_id", F.lit(now).alias("day"), F.lit("forget").alias("op"), F.col("id").alias("item_id"), F.col("reason").alias("detail"))
    return judged.where("reason is null").drop("reason"), gone, audit


POOL = ["agent_id", "id", "content", "mtype", "created_day", "importance", "ttl_days", "superseded_by", "seq"]


def candidates(episodic: DataFrame, semantic: DataFrame | None, now: int) -> DataFrame:
    """What recall may search: active facts and other episodes, or, without semantic, all episodes; nothing expired."""
    episodes = episodic.withColumn("superseded_by", F.lit(None).cast("string"))
    pool = episodes.select(POOL)
    if semantic is not None:
        known = active(semantic).withColumns({"mtype": F.lit("semantic"), "ttl_days": F.lit(None).cast("int")})
        pool = known.select(POOL).unionByName(non_facts(episodes).select(POOL))
    return pool.where(~expired(F.col("created_day"), F.col("ttl_days"), F.lit(now)))


def stats(episodic: DataFrame, semantic: DataFrame) -> DataFrame:
    """active and superseded memories of each agent: active facts and other episodes; superseded facts."""
    both = semantic.select("agent_id", F.col("superseded_by").isNull().alias("active")).unionAll(non_facts(episodic).select("agent_id", F.lit(True)))
    return both.groupBy("agent_id").agg(F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("superseded"))


def working_memory(memories: DataFrame, capacity: int = 8) -> DataFrame:
    """What a bounded memory holds that evicts its least important item (on ties the newest day, then the first in):
    evicting the least one by one leaves the greatest under the same order."""
    kept = Window.partitionBy("agent_id").orderBy(F.desc("importance"), F.asc("created_day"), F.desc("seq"))
    return memories.withColumn("place", F.row_number().over(kept)).where(F.col("place") <= capacity)


def procedures(memories: DataFrame) -> DataFrame:
    """The last written row of each trigger of an agent."""
    return memories.groupBy("agent_id", "trigger").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


def prior_values(semantic: DataFrame) -> DataFrame:
    """Active facts with each superseded value of their key."""
    now = active(semantic).select(*KEY, F.col("value").alias("current"))
    return now.join(semantic.where("superseded_by is not null").select(*KEY, F.col("value").alias("prior"), F.col("created_day").alias("prior_day")), KEY)


def lineage_links(semantic: DataFrame, memories: DataFrame, parts: int | None = None) -> DataFrame:
    """The statements that facts rest on, a row each: agent_id, id, fact_id, place (from 0 in the order of day and seq),
    stated_day and statement. A statement's fact follows from its own key and value, so nothing is collected, and the
    join only leaves the facts that semantic has.

    Links are dealt by ranges of (fact, day, seq), so a fact of many statements lies in several parts; the place is the
    number inside the part, plus what earlier parts hold of the fact (a row a part and fact)."""
    stated = facts(memories).withColumn("subject", F.coalesce("subject", F.lit("")))
    links = stated.select("agent_id", "id", _id_of_value().alias("fact_id"), "seq", F.col("created_day").alias("stated_day"), F.col("content").alias("statement"))
    links = links.join(semantic.select("agent_id", F.col("id").alias("fact_id")).distinct(), ["agent_id", "fact_id"], "left_semi")
    order = ["fact_id", "stated_day", "seq"]
    ranged = links.repartitionByRange(*([parts] if parts else []), *order).withColumn("_part", F.spark_partition_id())
    # Written, so that a part's number stays what it was.
    ranged = staged(ranged, "links")
    before = ranged.groupBy("fact_id", "_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("fact_id").orderBy("_part")) - F.col("_n"))
    inside = F.row_number().over(Window.partitionBy("_part", "fact_id").orderBy("stated_day", "seq")) - 1
    return ranged.withColumn("_place", inside).join(before.where("_before > 0").drop("_n"), ["fact_id", "_part"], "left").select("agent_id", "id", "fact_id", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias("place"), "stated_day", "statement")


def clock(memories: DataFrame) -> DataFrame:
    """The evaluation day of each agent: one after its last."""
    return memories.groupBy("agent_id").agg((F.max("created_day") + 1).cast("int").alias("now"))


def access(recall_audit: DataFrame) -> DataFrame:
    """How often each item was recalled, and the day of the last time in log order."""
    return recall_audit.where("op = 'recall'").groupBy("agent_id", "item_id").agg(F.count("*").alias("access_count"), F.max_by("day", "seq").alias("last_access_day"))


def op_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("op").agg(F.count("*").alias("n"))
