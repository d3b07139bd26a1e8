"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of docs (the last one the
tokens), extra ones and columns with the names of the operators' own included. Stages change text with n_chars; null
and empty texts have no words, so the first stage drops them and the others leave them as they are; equal rows are
judged alike, and become one in the second stage; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontamination, ngram_jaccard, pii, quality_rules
from palimpsest.llm.queries import vocabulary
from palimpsest.llm.staging import staged
from palimpsest.session import ship


#: The columns of documents.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

#: The key of surrogates over the test tables; production runs have a secret one.
PII_KEY = "key-of-the-test-tables"

#: doc_ids that are broadcast at most, some 100 MB as a hash table; more of them are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _changed(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else df
    return out.select(*columns)


def _aside(stage):
    """The stage with columns that documents don't have renamed meanwhile, so that none clashes with an operator's own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        named = {c: c if c in OWN else f"_extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in named.items()])

    return run_stage


@_aside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, labels).where("kept").select(*docs.columns)


@_aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class; those without a doc_id all stay. Rows that share a doc_id are one
    document: if it stays, each of its different texts does, in the row that is least by its columns."""
    ship(spark)
    classes = staged(ngram_jaccard.classes(docs), "classes")
    others = staged(classes.where("component_id <> doc_id").select("doc_id").distinct(), "others")
    # Texts stay where they are while the list of ids is short.
    others = F.broadcast(others) if others.count() <= BROADCAST_IDS else others.hint("shuffle_merge")
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    repeated = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = staged(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated.hint("shuffle_merge")
    row = F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("row")
    merged = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", F.md5(F.col("text").cast("binary"))).agg(row).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(merged.select(*docs.columns))


@_aside
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and documents that consist of them by more than half."""
    items = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return _changed(decontamination.decontaminate(docs, items).where("2 * n_hit <= n_words"), docs.columns)


@_aside
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates."""
    return _changed(pii.replace_pii(docs, PII_KEY), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with a check that they decode to the text."""
    ship(spark)
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary(), bpe.PATTERN, and_decode=True)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"), "ids")


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark_passages), ("pii", personal_data), ("byte_bpe", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
