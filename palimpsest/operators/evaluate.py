"""Retrieval and answer metrics."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.items import Policy
from ..session import staged
from .search import recall

#: ASCII punctuation, without the comma that goes first.
PUNCTUATION = "!\"#$%&'()*+-./:;<=>?@[\\]^_`{|}~"


#: Words of an item's anchor at most (characters, where it has no inner word), and anchors sent to all tasks at once;
#: more are taken in blocks, a scan each.
ANCHOR, ANCHOR_BLOCK = 8, 1 << 20


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """Share of gold ids among the first k; null without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), gold)) / F.size(F.array_distinct(gold)))


def reciprocal_rank(ranked: Column, gold: Column, cutoff: int = 10) -> Column:
    places = F.filter(F.transform(F.slice(ranked, 1, cutoff), lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def scorable(questions: DataFrame) -> DataFrame:
    return questions.where((F.col("category") != 5) & (F.size("evidence") > 0))


def metrics_of_rows(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), cutoff: int = 10) -> DataFrame:
    """Means by category and overall (null), from rows: ranked (query_id, doc_id, rank) and gold (query_id, category,
    doc_id), both without repeated rows. No query's ids are collected."""
    found = gold.join(ranked, ["query_id", "doc_id"], "left").groupBy("query_id", "category")
    scores = found.agg(*[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks], F.min("rank").alias("first"))
    first = F.coalesce(F.when(F.col("first") <= cutoff, 1 / F.col("first")), F.lit(0.0))
    return scores.rollup("category").agg(*[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg(first), 6).alias(f"mrr_{cutoff}"), F.count("*").alias("n"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (written) with a column of numbers from 0 without gaps; each task numbers its own part."""
    rows = staged(rows.withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # A row a partition.
    before = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.col(name) - F.shiftleft(F.col("_part"), 33) + F.col("_before")).drop("_part", "_before")


def conversation_benchmark(turns: DataFrame, questions: DataFrame, embedded: Callable[[DataFrame], DataFrame], ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Recall of evidence turns, by category and overall: each question that can be scored searches the turns of its
    own conversation by similarity. turns and questions as `records.conversations` gives them; a session's rank is its
    day, a question's day is the one after the last. embedded adds `embedding` to rows with `content`."""
    samples = numbered(turns.groupBy("sample_id").agg((F.max("session") + 1).cast("int").alias("day")), "agent_id").withColumn("agent_id", F.col("agent_id").cast("int"))
    # Vectors are numbered in the order of the conversation: equal similarities go to the turn that came first.
    number = F.shiftleft(F.col("agent_id").cast("long"), 32) + F.shiftleft(F.col("session").cast("long"), 16) + F.col("place")
    said = turns.join(samples, "sample_id").select("agent_id", "dia_id", F.col("session").alias("created_day"), F.lit(0.5).alias("importance"), F.concat("speaker", F.lit(": "), "text").alias("content"), number.alias("vec_id"))
    # Of turns with one id the last counts, as for any other memory.
    said = said.groupBy("agent_id", "dia_id").agg(F.max_by(F.struct("vec_id", "created_day", "importance", "content"), "vec_id").alias("t")).select("agent_id", "dia_id", "t.*")
    said = staged(embedded(said).drop("content"), "turns")
    asked = numbered(scorable(questions).join(samples, "sample_id"), "query_id").select("query_id", "agent_id", "category", "day", "evidence", F.col("question").alias("content"))
    asked = staged(asked, "questions")
    hits = recall(said, staged(embedded(asked.select("query_id", "agent_id", "day", "content")), "asked"), max(ks), policy=Policy(recency=False))
    # Evidence that no turn has can't be found, but counts.
    gold = asked.select("query_id", "category", "agent_id", F.explode("evidence").alias("dia_id")).join(said.select("agent_id", "dia_id", "vec_id"), ["agent_id", "dia_id"], "left")
    gold = gold.select("query_id", "category", F.coalesce("vec_id", -1 - F.row_number().over(Window.partitionBy("query_id").orderBy("dia_id"))).alias("doc_id"))
    return metrics_of_rows(hits.select("query_id", F.col("vec_id").alias("doc_id"), "rank"), gold, ks)


#: Fixed value: an odd number with bits all over, for hashes of windows.
ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(units: list[str] | str, sizes: list[int]) -> np.ndarray:
    """Hashes of all windows of these sizes over words or characters: each unit is hashed once."""
    codes = pd.util.hash_array(np.array(list(units), dtype=object), categorize=False) if units else np.zeros(0, np.uint64)
    made = [np.zeros(0, np.uint64)]
    for n in sizes:
        if 0 < (m := len(codes) - n + 1):
            own = np.full(m, n, np.uint64)
            for j in range(n):
                own = (own ^ (own >> np.uint64(29))) * ODD + codes[j : j + m]
            made.append(own)
    return np.concatenate(made).view(np.int64)


def _gram(kind: str, n: int, text: str) -> int:
    return int(_grams(text.split(" ") if kind == "w" else text, [n])[0]) if n else 0


def _among(own: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Those of own that are in every, which is in order."""
    if not len(every):
        return own[:0]
    return own[every[np.minimum(np.searchsorted(every, own), len(every) - 1)] == own]


def _anchor(text: str) -> tuple[str, int, str]:
    """A window that any text that contains this one has too: a substring can cut the first and the last word only."""
    words = text.split()[1:-1][:ANCHOR]
    return ("w", len(words), " ".join(words)) if words else ("c", min(ANCHOR, len(text)), text[:ANCHOR])


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """items (with a text t) by the docs (doc_id, body) whose body contains t: the columns of items but t, and doc_id.

    Bodies are searched for the hash of a window of each item, by arrays of a body's words; what is found is compared
    exactly."""
    spark = docs.sparkSession

    def anchors(batches):
        for batch in batches:
            made = [_anchor(t) for t in batch.column(batch.schema.get_field_index("t")).to_pylist()]
            yield batch.append_column("kind", pa.array([m[0] for m in made], pa.string())).append_column("size", pa.array([m[1] for m in made], pa.int32())).append_column("anchor", pa.array([_gram(*m) for m in made], pa.int64()))

    rows = items.where("t is not null")
    keyed = rows.mapInArrow(anchors, rows.withColumns({"kind": F.lit(""), "size": F.lit(0), "anchor": F.lit(0).cast("long")}).schema)
    # At most 2 * ANCHOR kinds of windows.
    kinds = [(r["kind"], r["size"]) for r in keyed.select("kind", "size").distinct().collect()]
    sizes = {k: sorted(n for kind, n in kinds if kind == k and n) for k in "wc"}
    wanted = keyed.select("anchor").distinct()
    blocks, found = max(1, math.ceil(wanted.count() / ANCHOR_BLOCK)), None
    texts = docs.where("body is not null")
    for block in range(blocks):
        sent = spark.sparkContext.broadcast(np.sort(wanted.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block).toArrow()["anchor"].to_numpy()))

        def search(batches, sent=sent):
            every = sent.value
            for batch in batches:
                at = batch.schema.get_field_index("doc_id")
                rows, hits = [], []
                for i, body in enumerate(batch.column(batch.schema.get_field_index("body")).to_pylist()):
                    own = np.unique(np.concatenate([_among(_grams(units, sizes[k]), every) for k, units in (("w", body.split() if sizes["w"] else []), ("c", body if sizes["c"] else ""))]))
                    if ("c", 0) in kinds:
                        own = np.union1d(own, np.zeros(1, np.int64))
                    rows += [i] * len(own)
                    hits += own.tolist()
                yield pa.record_batch([batch.column(at).take(pa.array(rows, pa.int64())), pa.array(hits, pa.int64())], names=["doc_id", "anchor"])

        part = texts.select("doc_id", "body").mapInArrow(search, texts.select("doc_id", F.lit(0).cast("long").alias("anchor")).schema)
        found = part if found is None else found.unionAll(part)
    pairs = found.distinct().join(keyed, "anchor").drop("anchor", "kind", "size").withColumnRenamed("doc_id", "_doc_id")
    held = texts.join(pairs, F.col("_doc_id").eqNullSafe(F.col("doc_id"))).where(F.col("body").contains(F.col("t")))
    return held.select(*[c for c in items.columns if c != "t"], "doc_id")


def hit_flags(hits: DataFrame, gold: DataFrame, prior: DataFrame, k: int = 5) -> DataFrame:
    """For each policy and query: right at rank 1, found in k, stale in k, and words of context.
    hits: policy, query_id, rank, value, words; gold: query_id, category, gold_value; prior: query_id, value, a row for
    each value that held before. Lists are joined, not collected: a key may have any number of prior values."""
    old = prior.select("query_id", "value").distinct().withColumn("_stale", F.lit(True))
    rows = hits.where(F.col("rank") <= k).join(old, ["query_id", "value"], "left").join(gold.select("query_id", "category", "gold_value"), "query_id")
    right = F.coalesce(F.col("value") == F.col("gold_value"), F.lit(False))
    any_ = lambda c, name: F.max(c.cast("double")).alias(name)
    return rows.groupBy("policy", "query_id", "category").agg(any_(right & (F.col("rank") == 1), "acc_1"), any_(right, "found_k"), any_(F.coalesce("_stale", F.lit(False)), "stale_k"), F.sum("words").alias("words"))


def ablation(flags: DataFrame) -> DataFrame:
    """Means of the flags by policy, and by policy and category."""
    means = [F.round(F.avg(c), 3).alias(c) for c in ("acc_1", "found_k", "stale_k")]
    return flags.groupingSets([("policy",), ("policy", "category")], "policy", "category").agg(*means, F.round(F.avg("words"), 3).alias("ctx_words"), F.count("*").alias("n"))


def normalised_answer(text: Column) -> Column:
    text = F.lower(F.replace(text, F.lit(","), F.lit("")))
    text = F.regexp_replace(F.translate(text, PUNCTUATION, ""), r"(?U)\b(a|an|the|and)\b", " ")
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def answer_f1(answers: DataFrame) -> DataFrame:
    """answers (id, category, prediction, gold) with f1: overlap of stemmed words, counted with repetition."""
    both = answers.select("id", F.lit("p").alias("side"), F.explode(normalised_answer(F.coalesce("prediction", F.lit("")))).alias("word")).unionAll(answers.select("id", F.lit("g"), F.explode(normalised_answer(F.coalesce("gold", F.lit(""))))))
    stems = both.select("word").distinct().withColumn("stem", stem_words("word"))
    counts = both.join(stems, "word").groupBy("id", "stem").agg(F.count_if(F.col("side") == "p").alias("p"), F.count_if(F.col("side") == "g").alias("g"))
    totals = counts.groupBy("id").agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum(F.least("p", "g")).alias("same"))
    return answers.join(totals, "id", "left").withColumn("f1", F.coalesce(F.when(F.col("same") > 0, 2 * F.col("same") / (F.col("p") + F.col("g"))), F.lit(0.0))).drop("p", "g", "same")


def f1_metrics(scored: DataFrame) -> DataFrame:
    return scored.where("category <> 5").rollup("category").agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(stem)


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _ends_cvc(word: str) -> bool:
    """The extended rules take a word of a vowel and a consonant (as in "ow(e)") for one that needs its e, too."""
    shape = _shape(word)
    return shape[-3:] == "cvc" and word[-1] not in "wxy" or shape == "vc"


#: Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

#: Suffixes of the stemmer's second, third and fourth steps.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            return word[: -len(suffix)] + new if _measure(word[: -len(suffix)]) > 0 else word
    return word


def _plurals(word: str) -> str:
    """-ies becomes -y, which a later step makes -i, but -ie in a word of four letters."""
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _endings(word: str) -> str:
    """-eed, -ed and -ing; -ied like -ies."""
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                return word + "e"
            if len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
                return word if word[-1] in "lsz" else word[:-1]
            return word + "e" if _measure(word) == 1 and _ends_cvc(word) else word
    return word


def _second(word: str) -> str:
    """The second step; -alli is undone first and what is left goes through the step again, and -logi loses its i after
    a stem that has a measure with the l."""
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replaced(word, STEP_2)


@cache
def stem(word: str) -> str:
    """Porter's stemmer with the common extensions to the rules of 1980: words with a stem of their own, -ies and -ied
    in short words, y to i only after a consonant that isn't the first letter, -bli, -fulli and -logi."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _endings(_plurals(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _replaced(_second(word), STEP_3)
    for suffix in sorted([*STEP_4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _ends_cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def report_rows(metrics: DataFrame, by: list[str], places: int = 3) -> DataFrame:
    """A report as rows: by's columns, metric, value (rounded), and null values left out; a null in by is "overall"."""
    named = [c for c in metrics.columns if c not in by]
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("overall")).alias(c) for c in by]
    long = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in named]).unpivot(by, named, "metric", "value")
    return long.where("value is not null").withColumn("value", F.round("value", places))
