"""Embedding and top-k search by inner product inside an agent, and recall in two stages."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.items import Policy, blended, expired
from ..session import shared_dir, staged
from ..sources.buckets import Buckets

#: Queries that are sent to all tasks at once; more of them meet the vectors in blocks.
QUERY_BLOCK = 4096

#: Vectors, and queries, of a block; queries whose similarities a task holds at once.
BLOCK, AT_ONCE = 8192, 256

#: Agents of many rows that are broadcast at most; beyond that they are joined by shuffle.
BROADCAST_AGENTS = 1_000_000

#: Digits that decide ranks: what is left of a similarity beyond the noise of the order of summation.
DIGITS = 12

HITS = "query_id long, agent_id int, vec_id long, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _first(sim: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the n greatest, by id where equal."""
    order = np.lexsort((ids, -sim), axis=1)[:, :n]
    return np.take_along_axis(sim, order, 1), np.take_along_axis(ids, order, 1)


def _top(sim: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As _first where all rows have the same ids, which are in order: only rows with a tie at the edge are sorted whole."""
    if sim.shape[1] > 4 * n:
        part = np.sort(np.argpartition(-sim, n - 1, axis=1)[:, :n], axis=1)
        held = np.take_along_axis(sim, part, 1)
        for row in np.flatnonzero((sim >= held.min(axis=1)[:, None]).sum(axis=1) > n):
            part[row] = np.sort(np.argsort(-sim[row], kind="stable")[:n])
            held[row] = sim[row, part[row]]
        return _first(held, ids[part], n)
    order = np.argsort(-sim, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(sim, order, 1), ids[order]


def _better(held: tuple[np.ndarray, np.ndarray, np.ndarray] | None, sim: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n greatest of what is held and of sim, whose ids are in order; rows that nothing new can enter stay as they are."""
    if held is None:
        return _top(sim, ids, n)
    _, best, own = held
    if best.shape[1] < n:
        sim, new = _top(sim, ids, n)
        return _first(np.concatenate([best, sim], axis=1), np.concatenate([own, new], axis=1), n)
    edge, last = best[:, -1:], own[:, -1:]
    rows = np.flatnonzero(((sim > edge) | (sim == edge) & (ids[None, :] < last)).any(axis=1))
    if len(rows):
        more, new = _top(sim[rows], ids, n)
        best[rows], own[rows] = _first(np.concatenate([best[rows], more], axis=1), np.concatenate([own[rows], new], axis=1), n)
    return best, own


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterable[pa.Table]:
    """Batches put together until they have size rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _similar(asks: np.ndarray, day: np.ndarray, rows: np.ndarray, until: np.ndarray) -> np.ndarray:
    sim = np.round(asks @ rows.T, DIGITS)
    sim[day[:, None] > until[None, :]] = -np.inf
    return sim


def _hits(query: np.ndarray, agent: int, sim: np.ndarray, vec: np.ndarray) -> pa.RecordBatch:
    q, k = np.nonzero(sim > -np.inf)
    return pa.record_batch([pa.array(query[q]), pa.array(np.full(len(q), agent, np.int32)), pa.array(vec[q, k]), pa.array(sim[q, k])], names=["query_id", "agent_id", "vec_id", "sim"])


def dated(vectors: DataFrame) -> DataFrame:
    """vec_id, agent_id, until (the last day, far away where none is given) and embedding of vectors that have one."""
    never = F.lit(2**31 - 1)
    until = F.coalesce(F.col("until").cast("int"), never) if "until" in vectors.columns else never
    return vectors.where("embedding is not null").select("vec_id", F.col("agent_id").cast("int").alias("agent_id"), until.alias("until"), "embedding")


def asked_on(queries: DataFrame) -> DataFrame:
    """query_id, agent_id, day (long ago where none is given) and embedding of queries that have one."""
    day = F.coalesce(F.col("day").cast("int"), F.lit(-(2**31))) if "day" in queries.columns else F.lit(-(2**31))
    return queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("agent_id").cast("int").alias("agent_id"), day.alias("day"), F.col("embedding").alias("embedding"))


def exact_top(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, agent_id, vec_id, sim and rank of the n nearest vectors of the query's agent (fewer if it has fewer).
    Where vectors have a last day, `until`, and queries a `day`, a query doesn't see vectors whose last day has passed.

    Up to QUERY_BLOCK queries go to all tasks: vectors stay where they are, and a task sends each query's best only.
    More queries are dealt with the vectors: one pass over both, see block_top.
    """
    corpus, asked = dated(vectors), asked_on(queries)
    if asked.count() > QUERY_BLOCK:
        return ranked(block_top(corpus, asked, n), n)
    part = asked.toArrow()
    sent = vectors.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), part["agent_id"].to_numpy(), part["day"].to_numpy(), _matrix(part["embedding"])))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ids, agents, days, matrix = sent.value
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for rows in _blocks(batches, BLOCK):
            agent, vec, last, every = rows["agent_id"].to_numpy(), rows["vec_id"].to_numpy(), rows["until"].to_numpy(), _matrix(rows["embedding"])
            for a in np.unique(agent).tolist():
                mine, asks = np.flatnonzero(agent == a), np.flatnonzero(agents == a)
                mine = mine[np.argsort(vec[mine], kind="stable")]
                for at in range(0, len(asks), AT_ONCE):
                    some = asks[at : at + AT_ONCE]
                    held[a, at] = (some, *_better(held.get((a, at)), _similar(matrix[some], days[some], every[mine], last[mine]), vec[mine], n))
        for (a, _), (asks, sim, own) in held.items():
            yield _hits(ids[asks], a, sim, own)

    return ranked(corpus.mapInArrow(best, HITS), n)


def block_top(corpus: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """The n nearest of each query in each block of vectors that it meets.

    Vectors and queries are dealt by agent: those of small agents by the agent's hash, so that a block has about BLOCK
    rows; those of an agent with more of either are cut into blocks by their ids, and each block of its vectors meets
    each block of its queries in a task of its own. A row is sent as often as the other side has blocks.
    """
    sizes = corpus.groupBy("agent_id").agg(F.count("*").alias("v")).join(asked.groupBy("agent_id").agg(F.count("*").alias("q")), "agent_id")
    sizes = staged(sizes, "agents")
    agents, rows = sizes.agg(F.count("*"), F.greatest(F.sum("v"), F.sum("q"))).first()
    cells = max(1, math.ceil((rows or 0) / BLOCK))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    large = sizes.where((F.col("v") > BLOCK) | (F.col("q") > BLOCK)).select("agent_id", blocks("v").alias("vs"), blocks("q").alias("qs"))
    large = F.broadcast(large) if large.count() <= BROADCAST_AGENTS else large
    # Vectors of agents that nobody asks stay behind, if the list of the others is short.
    corpus = corpus.join(F.broadcast(sizes.select("agent_id")), "agent_id", "left_semi") if agents <= BROADCAST_AGENTS else corpus

    def dealt(df: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        df = df.join(large, "agent_id", "left").withColumn("cell", F.when(F.col("vs").isNull(), F.pmod(F.xxhash64("agent_id"), F.lit(cells))).otherwise(-1 - F.col("agent_id").cast("long")))
        df = df.withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int"))
        return df.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("vs", "qs")

    left, right = dealt(corpus, "vec_id", "vs", "qs", "i", "j"), dealt(asked, "query_id", "qs", "vs", "j", "i")
    key = ["cell", "i", "j"]

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [pa.record_batch([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.float64())], names=["query_id", "agent_id", "vec_id", "sim"])]
        if vectors.num_rows and queries.num_rows:
            agent, vec, until, rows = vectors["agent_id"].to_numpy(), vectors["vec_id"].to_numpy(), vectors["until"].to_numpy(), _matrix(vectors["embedding"])
            whose, ids, day, matrix = queries["agent_id"].to_numpy(), queries["query_id"].to_numpy(), queries["day"].to_numpy(), _matrix(queries["embedding"])
            order, turn = np.lexsort((vec, agent)), np.argsort(whose, kind="stable")
            every, first = np.unique(agent[order], return_index=True)
            for a, x, y in zip(every.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                asks, mine = turn[np.searchsorted(whose[turn], a) : np.searchsorted(whose[turn], a, side="right")], order[x:y]
                for at in range(0, len(asks), AT_ONCE):
                    some = asks[at : at + AT_ONCE]
                    found.append(_hits(ids[some], a, *_top(_similar(matrix[some], day[some], rows[mine], until[mine]), vec[mine], n)))
        return pa.Table.from_batches(found)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, HITS)


def ranked(hits: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def approximate_top(vectors: DataFrame, queries: DataFrame, n: int, cells: int | None = None, target: float = 0.97, seed: int = 7) -> DataFrame:
    """As exact_top, by an index that is built for this search: see operators/quantised.py for one that is kept."""
    from . import quantised

    path = f"{shared_dir(vectors.sparkSession)}/index-{uuid.uuid4().hex}"
    quantised.build(vectors, path, cells, target, seed)
    return quantised.search(vectors.sparkSession, path, queries, n)


def recall(vectors: DataFrame, queries: DataFrame, k: int, now: int | None = None, policy: Policy = Policy(), index: str | None = None) -> DataFrame:
    """The k best by blended score among the max(4k, 20) nearest: an item outside that shortlist can't come back.
    vectors: vec_id, agent_id, embedding, created_day, importance and, if there, ttl_days, superseded_by. The day is
    now, or each query's own in a column `day`. index: the folder of a kept index of the vectors; the shortlist is
    then the nearest that it finds (vectors that aren't in the pool any more are left out of it).

    Queries of one agent and day with equal embeddings find the same: one of them searches for all."""
    if now is None and "day" not in queries.columns:
        raise ValueError("a day is needed: now, or queries with a column day")
    every = queries if now is None else queries.withColumn("day", F.lit(now))
    every = every.where("embedding is not null").select("query_id", "agent_id", "day", "embedding")
    asked = staged(every.groupBy("agent_id", "day", "embedding").agg(F.min("query_id").alias("query_id")), "distinct-queries")
    pool = vectors
    if "superseded_by" in pool.columns:
        pool = pool.where("superseded_by is null")
    if "ttl_days" in pool.columns:
        pool = pool.withColumn("until", F.col("created_day") + F.col("ttl_days"))
        pool = pool if now is None else pool.where(~expired(F.col("created_day"), F.col("ttl_days"), F.lit(now)))
    if index:
        from . import quantised

        # Some of what the index holds may have been superseded since: a longer list, of which those in the pool count.
        near = quantised.search(pool.sparkSession, index, asked, 2 * max(4 * k, 20)).drop("rank")
        short = ranked(near.join(pool.select("vec_id"), "vec_id", "left_semi"), max(4 * k, 20)).drop("rank")
    else:
        short = exact_top(pool, asked, max(4 * k, 20)).drop("rank")
    items = pool.select("vec_id", "created_day", "importance")
    short = short.withColumn("_day", F.lit(now)) if now is not None else short.join(asked.select("query_id", F.col("day").alias("_day")), "query_id")
    scored = short.join(items, "vec_id").withColumn("score", blended(F.col("sim"), F.col("created_day"), F.col("importance"), F.col("_day"), policy)).drop("_day")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("sim"), "vec_id")
    hits = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Each query by the one that searched for it.
    by = asked.select(F.col("query_id").alias("_by"), F.col("agent_id").alias("_agent"), F.col("day").alias("_day"), F.col("embedding").alias("_embedding"))
    whose = every.join(by, F.col("agent_id").eqNullSafe(F.col("_agent")) & F.col("day").eqNullSafe(F.col("_day")) & (F.col("embedding") == F.col("_embedding"))).select("query_id", "_by")
    return hits.withColumnRenamed("query_id", "_by").join(whose, "_by").select("query_id", *[c for c in hits.columns if c != "query_id"])


def recall_audit(hits: DataFrame, queries: DataFrame, now: int) -> DataFrame:
    """A row for each hit; the detail is the query's first 48 characters."""
    return hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").select("agent_id", F.lit(now).alias("day"), F.lit("recall").alias("op"), F.col("vec_id").cast("string").alias("item_id"), F.substring("query", 1, 48).alias("detail"))


def public_hits(hits: DataFrame, items: DataFrame) -> DataFrame:
    """What a caller sees of a hit."""
    return hits.select("query_id", "id", "rank").join(items.select("id", "content", F.col("mtype").alias("type"), "importance", F.col("superseded_by").isNotNull().alias("superseded")), "id")


def vector_ids(items: DataFrame) -> DataFrame:
    """A number of 60 bits for each item that stays over rebuilds: the first digits of an MD5 of its agent and id."""
    return items.withColumn("vec_id", F.conv(F.substring(F.md5(F.concat_ws("|", F.col("agent_id").cast("string"), "id").cast("binary")), 1, 15), 16, 10).cast("long"))


def without(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id"), "vec_id", "left_anti")


def vector_table(spark: SparkSession, path: str, buckets: int = 16) -> Buckets:
    """The table of vectors at path, in buckets of agents: `write`, `upsert` and `read`."""
    return Buckets(spark, path, ["agent_id"], n=buckets)


def save_vectors(vectors: DataFrame, path: str, buckets: int = 16) -> None:
    """A new version of the table at path: readers of the one before aren't disturbed."""
    table = vector_table(vectors.sparkSession, path, buckets)
    last = table.latest()
    table.write(vectors, 0 if last is None else last + 1)


def load_vectors(spark: SparkSession, path: str, queries: DataFrame | None = None, buckets: int = 16) -> DataFrame:
    """The table's vectors, or only the buckets that hold agents of the queries (agent_id)."""
    table = vector_table(spark, path, buckets)
    return table.read(None if queries is None else table.touched(queries.select(F.col("agent_id").cast("int").alias("agent_id"))))


def blake2b_number(word: str) -> int:
    """An 8-byte BLAKE2b digest as a number."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


def md5_number(word: str) -> int:
    """The first 8 hexadecimal digits of an MD5 as a number: SQL has it too."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hash_embed(texts: Iterable[str | None], dim: int, number: Callable[[str], int] = blake2b_number) -> np.ndarray:
    """Unit vectors of word counts by bucket: a word's number modulo dim."""
    known: dict[str, int] = {}
    texts = list(texts)
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts):
        for w in re.findall("[a-z0-9]+", (text or "").lower()):
            if w not in known:
                known[w] = number(w) % dim
            row[known[w]] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def md5_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """For `embed`: the hashing embedder by MD5."""
    return lambda: lambda texts: hash_embed(texts, dim, md5_number)


def embed(df: DataFrame, dim: int = 384, text: str = "content", encode: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, batch: int = 64) -> DataFrame:
    """df with embedding added. encode: a factory of another encoder, called once a task, given batches of texts."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        model = encode() if encode else None
        for rows in batches:
            texts = [t or "" for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
            made = np.concatenate([model(texts[i : i + batch]) for i in range(0, len(texts), batch)]) if model and texts else hash_embed(texts, dim)
            yield rows.append_column("embedding", pa.array(list(made.astype(np.float32)), pa.list_(pa.float32())))

    return df.mapInArrow(run, schema)


def embed_new(items: DataFrame, cache: DataFrame, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """(items with embedding, cache with the new texts): each distinct text is embedded once."""
    keyed = items.withColumn("text_key", F.sha2("content", 256))
    new = keyed.select("text_key", "content").dropDuplicates(["text_key"]).join(cache.select("text_key"), "text_key", "left_anti")
    grown = cache.select("text_key", "embedding").unionByName(embed(new, dim).select("text_key", "embedding"))
    return keyed.join(grown, "text_key", "left"), grown


def extract_facts(records: DataFrame, extractor: Callable[[dict], tuple] | None = None) -> DataFrame:
    """records with subject, attribute and value, as given or as an extractor finds them in text; null where it fails."""
    if extractor is None:
        return records
    rest = records.drop("subject", "attribute", "value")

    def run(frames):
        for frame in frames:
            found = []
            for row in frame.to_dict("records"):
                try:
                    found.append(tuple(extractor(row)))
                except Exception:  # an extractor's failure is an answer: no fact
                    found.append((None, None, None))
            yield frame.assign(**{n: [f[i] for f in found] for i, n in enumerate(("subject", "attribute", "value"))})

    return rest.mapInPandas(run, T.StructType([*rest.schema.fields, *(T.StructField(n, T.StringType()) for n in ("subject", "attribute", "value"))]))
