"""Readers of interactions, gold queries and conversations, and adapters of event, conversation and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INTERACTION = "agent_id int, seq long, id string, ts_day int, text string, type string, subject string, attribute string, value string, importance double, ttl_days int, provenance string"
QUERY = "id string, query string, subject string, attribute string, gold_value string, prior_values array<string>, category string"
SAMPLE = "sample_id string, conversation string, qa array<struct<question: string, answer: string, evidence: string, category: int>>"


def interactions(spark: SparkSession, path: str, agent_id: int = 0) -> DataFrame:
    """JSON lines; blank ones are skipped. seq is the order of ingest: as given, else the place in the files (by path,
    block and line), which tasks number each for themselves."""
    rows = spark.read.schema(INTERACTION).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    rows = rows.where("id is not null").withColumns({"agent_id": F.coalesce("agent_id", F.lit(agent_id)), "_line": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    # A row for each block that files are read in.
    blocks = rows.select("_file", "_start").distinct().withColumn("_block", F.row_number().over(Window.orderBy("_file", "_start")) - 1)
    place = F.shiftleft(F.col("_block").cast("long"), 33) + F.col("_line")
    return rows.join(F.broadcast(blocks), ["_file", "_start"]).withColumn("seq", F.coalesce("seq", place)).drop("_file", "_start", "_line", "_block")


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY).json(path).where("id is not null")


def evidence_ids(raw: Column) -> Column:
    """Distinct turn ids of a list, or of a string that spells one; empty where it is neither."""
    listed = F.coalesce(F.from_json(F.regexp_replace(raw, "'", '"'), "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(listed, lambda e: e.startswith("D")))


def conversations(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a JSON array of conversations, or of files with one a line. Sessions are numbered by rank from 0; turns without a
    text or an id go after that."""
    samples = spark.read.schema(SAMPLE).option("multiLine", not lines).json(path)
    sessions = samples.select("sample_id", F.explode(F.from_json("conversation", "map<string,string>")).alias("name", "body")).where(F.col("name").rlike(r"^session_\d+$"))
    sessions = sessions.withColumn("number", F.regexp_extract("name", r"(\d+)$", 1).cast("int"))
    sessions = sessions.withColumn("session", F.dense_rank().over(Window.partitionBy("sample_id").orderBy("number")) - 1)
    turns = sessions.select("sample_id", "session", F.posexplode(F.from_json("body", "array<struct<dia_id: string, speaker: string, text: string>>")).alias("place", "t"))
    turns = turns.select("sample_id", "session", "place", "t.dia_id", F.coalesce("t.speaker", F.lit("")).alias("speaker"), "t.text").where("dia_id is not null and text is not null")
    questions = samples.select("sample_id", F.posexplode("qa").alias("place", "q")).select("sample_id", "place", "q.question", F.coalesce("q.answer", F.lit("")).alias("answer"), evidence_ids(F.coalesce("q.evidence", F.lit("[]"))).alias("evidence"), "q.category")
    return turns, questions


def statements(events: DataFrame) -> DataFrame:
    """Events as statements about users: an error states nothing, other events the last one of their type."""
    error = F.col("event_type") == "error"
    attribute = F.when(~error, F.concat(F.lit("last_"), "event_type"))
    value = F.when(~error, F.concat(F.lit("v"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string")))
    ttl = F.when(F.col("event_type") == "view", 7).when(error, 14)
    text = F.coalesce(F.concat(F.replace(attribute, F.lit("_"), F.lit(" ")), F.lit(": "), value), F.concat(F.lit("error of user "), F.col("user_id").cast("string")))
    return events.select(
        (F.col("user_id") % 10).cast("int").alias("agent_id"), F.col("event_id").alias("seq"), F.format_string("M%07d", "event_id").alias("id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("ts_day"), text.alias("text"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"), attribute.alias("attribute"), value.alias("value"), (F.least("value", F.lit(100.0)) / 100).alias("importance"), ttl.alias("ttl_days"),
    )


def turns_of(table: DataFrame) -> DataFrame:
    session = F.floor(F.col("turn") / 2).cast("int")
    return table.select(F.col("conv_id").alias("sample_id"), session.alias("session"), F.concat(F.lit("D"), (session + 1).cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("dia_id"), F.concat("role", F.lit(": "), "text").alias("content"))


def vectors_of(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", F.col("label").cast("int").alias("agent_id"), "embedding", (F.col("vec_id") % 30).cast("int").alias("created_day"), ((F.col("vec_id") % 10) / 10).alias("importance"))


def vector_queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "agent_id", "embedding", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"))
