"""An approximate index of vectors that is built once, kept in a folder, appended to and searched.

Vectors are filed under coarse cells of two levels (centres of the first, and of the second inside each), whose number
follows the square root of the number of vectors; what is left of a vector beyond its cell's centre is coded by product
quantisation, a byte for each part of some dimensions. A search scans the codes of probed cells only: similarities come
from tables of a query's products with the code words, each task keeps a query's best, and the best of all tasks are
scored again with the vectors themselves. Codes and vectors are columns of one table, so the scan reads no vector.

    path/model     centres and code words       path/members   the vectors, by shard of cells

Fitted on samples: SAMPLE vectors for the first level and the code words, PER_CELL for each cell for the second level
(in tasks, one a cell of the first), and SAMPLE others that tell how many cells a query has to probe. Every vector is filed. The model has 4 * dim bytes a cell; it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.items import dot
from ..session import staged
from .search import HITS, DIGITS, _matrix, asked_on, dated, ranked

#: Vectors of the sample for the first level and the code words; for each cell of the second level; tried as queries.
#: Up to FEW vectors nothing is held out.
SAMPLE, PER_CELL, TRIED, FEW = 20_000, 32, 300, 2000

#: Dimensions of a part, and code words of each.
PART, WORDS = 4, 256

#: Files of members by shard of cells; queries whose tables a task holds; rows that it scores at once.
SHARDS, QUERIES, ROWS = 64, 1024, 8192

MEMBERS = "cell int, agent_id int, vec_id long, until int, codes binary, embedding array<float>"


def _near(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centres."""
    return (centres**2).sum(axis=1) - 2 * rows @ centres.T


def kmeans(rows: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """At most k centres. A centre that loses all rows takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    rows = rows.astype(np.float32)
    k = min(k, len(rows))
    centres = rows[np.sort(rng.choice(len(rows), k, replace=False))].copy()
    for _ in range(rounds):
        far = np.concatenate([_near(rows[i : i + ROWS], centres) for i in range(0, len(rows), ROWS)])
        own = far.argmin(axis=1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        if len(empty := np.flatnonzero(count == 0)):
            distance = far[np.arange(len(rows)), own] + (rows**2).sum(axis=1)
            centres[empty] = rows[np.argsort(-distance, kind="stable")[: len(empty)]]
    return centres


class Model:
    """first: centres of the first level; centres: all cells, those of a first-level one together; begin: where they
    begin (one more than first); words: for each part, its code words; probe: cells that a query needs."""

    def __init__(self, first: np.ndarray, centres: np.ndarray, begin: np.ndarray, words: np.ndarray, probe: int):
        self.first, self.centres, self.begin, self.words, self.probe = first, centres, begin, words, probe

    def cells(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, among those of the first-level cells that are nearest and have them."""
        rows = rows.astype(np.float32)
        sizes = np.diff(self.begin)
        wide = min(len(self.first), max(2 * math.ceil(math.sqrt(len(self.first))), math.ceil(8 * n / max(1, sizes.mean()))))
        if wide == len(self.first):
            return np.argsort(_near(rows, self.centres), axis=1, kind="stable")[:, :n]
        top = np.argsort(_near(rows, self.first), axis=1, kind="stable")[:, :wide]
        if n == 1:
            least, out = np.full(len(rows), np.inf, np.float32), np.zeros((len(rows), 1), np.int64)
            for c in np.flatnonzero(sizes).tolist():
                some = np.flatnonzero((top == c).any(axis=1))
                far = _near(rows[some], self.centres[self.begin[c] : self.begin[c + 1]])
                best = far.argmin(axis=1)
                far = far[np.arange(len(some)), best]
                nearer = far < least[some]
                least[some[nearer]], out[some[nearer], 0] = far[nearer], best[nearer] + self.begin[c]
            return out
        out = np.empty((len(rows), min(n, len(self.centres))), np.int64)
        for i, row in enumerate(rows):
            some = np.concatenate([np.arange(self.begin[c], self.begin[c + 1]) for c in top[i]])
            own = some[np.argsort(_near(row[None], self.centres[some])[0], kind="stable")[: out.shape[1]]]
            out[i] = np.pad(own, (0, out.shape[1] - len(own)), constant_values=-1)
        return out

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """rows as (row, part, PART), filled up with zeros."""
        width = len(self.words) * PART
        return np.pad(rows.astype(np.float32), ((0, 0), (0, width - rows.shape[1]))).reshape(len(rows), -1, PART)

    def codes(self, rows: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self.parts(rows - self.centres[cell])
        return np.stack([_near(rest[:, p], w).argmin(axis=1) for p, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def tables(self, rows: np.ndarray) -> np.ndarray:
        """Products of each row's parts with the code words: (row, part, word)."""
        return np.einsum("rpd,pwd->rpw", self.parts(rows), self.words)


def _assign(batches, sent) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        rows = _matrix(batch.column("embedding"))
        if not len(rows):
            continue
        model = sent.value
        cell = model.cells(rows, 1)[:, 0]
        codes = model.codes(rows, cell)
        yield pa.record_batch([pa.array(cell, pa.int32()), batch.column("agent_id"), batch.column("vec_id"), batch.column("until"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding").cast(pa.list_(pa.float32()))], names=["cell", "agent_id", "vec_id", "until", "codes", "embedding"])


def _filed(vectors: DataFrame, model: Model) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    return dated(vectors).mapInArrow(lambda batches: _assign(batches, sent), MEMBERS).withColumn("shard", F.pmod("cell", F.lit(SHARDS)))


def _sample(known: DataFrame, total: int, n: int, seed: int, held_out: bool = False) -> DataFrame:
    """About n vectors, the same in every run; held-out ones are never among the others. Few vectors are taken all."""
    share = 1.0 if total < FEW else min(0.3 if held_out else 0.7, 1.2 * n / total)
    place = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    return known.where(place >= int((1 - share) * (1 << 30)) if held_out else place < int(share * (1 << 30)))


def fit(known: DataFrame, total: int, cells: int | None, target: float, seed: int) -> Model:
    cells = max(1, min(total, cells or 4 * round(math.sqrt(total))))
    k = max(1, round(math.sqrt(cells)))
    rows = _sample(known, total, SAMPLE, seed).select("agent_id", "embedding").limit(2 * SAMPLE).toArrow()
    agents, rows = rows["agent_id"].to_numpy(), _matrix(rows["embedding"]).astype(np.float32)
    first = kmeans(rows, k, seed)
    spark, each = known.sparkSession, -(-cells // len(first))
    sent = spark.sparkContext.broadcast(first)

    def nearest(batches):
        for batch in batches:
            part = _matrix(batch.column("embedding"))
            yield pa.record_batch([pa.array(_near(part, sent.value).argmin(axis=1) if len(part) else [], pa.int32()), batch.column("embedding").cast(pa.list_(pa.float32()))], names=["over", "embedding"])

    def split(table: pa.Table) -> pa.Table:
        made = kmeans(_matrix(table["embedding"]), each, seed)
        return pa.table({"over": pa.array(np.full(len(made), table["over"][0].as_py()), pa.int32()), "centre": pa.array(made.tolist(), pa.list_(pa.float32()))})

    wide = _sample(known, total, max(SAMPLE, PER_CELL * cells), seed).select("embedding").mapInArrow(nearest, "over int, embedding array<float>")
    second = wide.groupBy("over").applyInArrow(split, "over int, centre array<float>").toArrow()
    over = second["over"].to_numpy()
    order = np.argsort(over, kind="stable")
    centres = _matrix(second["centre"])[order].astype(np.float32)
    begin = np.searchsorted(over[order], np.arange(len(first) + 1))
    parts = -(-rows.shape[1] // PART)
    model = Model(first, centres, begin, np.zeros((parts, 1, PART), np.float32), 1)
    own = model.cells(rows, 1)[:, 0]
    rest = model.parts(rows - centres[own])
    words = [kmeans(rest[:, p], WORDS, seed + p) for p in range(parts)]
    model.words = np.stack([np.pad(w, ((0, WORDS - len(w)), (0, 0)), mode="edge") for w in words])
    # Centres lie nearer to the vectors they were fitted on than to others: probes are counted on others.
    tried = _sample(known, total, SAMPLE, seed, held_out=True).select("agent_id", "embedding").limit(2 * SAMPLE).toArrow()
    if len(tried):
        agents, rows = tried["agent_id"].to_numpy(), _matrix(tried["embedding"]).astype(np.float32)
    model.probe = _probe(model, rows, agents, model.cells(rows, 1)[:, 0], target)
    return model


def _probe(model: Model, rows: np.ndarray, agents: np.ndarray, own: np.ndarray, target: float, n: int = 10) -> int:
    """The least number of nearest cells that hold the target's share of the n nearest among vectors that no centre was
    fitted on."""
    depths = []
    for i in np.linspace(0, len(rows) - 1, min(TRIED, len(rows))).astype(int).tolist():
        mine = np.flatnonzero(agents == agents[i])
        top = mine[np.argsort(-(rows[mine] @ rows[i]), kind="stable")[:n]]
        place = np.empty(len(model.centres), np.int64)
        place[np.argsort(_near(rows[i : i + 1], model.centres)[0], kind="stable")] = np.arange(len(model.centres))
        depths.append(place[own[top]])
    return int(np.quantile(np.concatenate(depths), target, method="higher")) + 1


def build(vectors: DataFrame, path: str, cells: int | None = None, target: float = 0.97, seed: int = 7) -> None:
    """Fits the model and files all vectors (vec_id, agent_id, embedding and, if there, until). cells: their number,
    from the number of vectors if none is given; target: the share of nearest that probed cells are to hold."""
    known = dated(vectors)
    total = known.count()
    spark = vectors.sparkSession
    if not total:
        spark.createDataFrame([], "name string, i int, vector array<float>").write.mode("overwrite").parquet(f"{path}/model")
        spark.createDataFrame([], MEMBERS + ", shard int").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/members")
        return
    model = fit(known, total, cells, target, seed)
    rows = [("first", i, v.tolist()) for i, v in enumerate(model.first)] + [("centre", i, v.tolist()) for i, v in enumerate(model.centres)]
    rows += [("word", i, v.tolist()) for i, v in enumerate(model.words.reshape(-1, PART))] + [("begin", int(b), []) for b in model.begin] + [("probe", model.probe, [])]
    spark.createDataFrame(rows, "name string, i int, vector array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    _write(_filed(vectors, model), path, "overwrite")


def append(vectors: DataFrame, path: str) -> None:
    """Files more vectors under the cells that there are."""
    model = load(vectors.sparkSession, path)
    if model is None:
        return build(vectors, path)
    _write(_filed(vectors, model), path, "append")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.hint("rebalance", "shard").sortWithinPartitions("shard", "cell", "agent_id").write.mode(mode).partitionBy("shard").parquet(f"{path}/members")


def load(spark: SparkSession, path: str) -> Model | None:
    rows = spark.read.parquet(f"{path}/model").toArrow()
    if not len(rows):
        return None
    name, i = np.array(rows["name"].to_pylist()), rows["i"].to_numpy()

    def of(kind: str) -> np.ndarray:
        at = np.flatnonzero(name == kind)
        return _matrix(rows["vector"].take(pa.array(at[np.argsort(i[at], kind="stable")]))).astype(np.float32)

    return Model(of("first"), of("centre"), np.sort(i[name == "begin"]), of("word").reshape(-1, WORDS, PART), int(i[name == "probe"][0]))


def members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMBERS + ", shard int").parquet(f"{path}/members")


def search(spark: SparkSession, path: str, queries: DataFrame, n: int, probe: int | None = None, again: int | None = None) -> DataFrame:
    """As search.exact_top, over the kept index: `again` of a query's best by codes are scored with the vectors, of the
    `probe` nearest cells. Queries are taken in blocks of QUERIES, a scan of the probed shards' codes each."""
    model, asked = load(spark, path), asked_on(queries)
    total = asked.count()
    if model is None or not total:
        return ranked(spark.createDataFrame([], HITS), n)
    blocks, found = -(-total // QUERIES), None
    asked = staged(asked, "asked") if blocks > 1 else asked
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        hits = _block(spark, path, model, part, min(len(model.centres), probe or model.probe), again or max(100, 10 * n))
        if hits is not None:
            hits = staged(hits, "near") if blocks > 1 else hits
            found = hits if found is None else found.unionAll(hits)
    return ranked(spark.createDataFrame([], HITS) if found is None else found, n)


def _block(spark: SparkSession, path: str, model: Model, asked: DataFrame, probe: int, again: int) -> DataFrame | None:
    part = asked.toArrow()
    if not len(part):
        return None
    ids, agents, days, rows = part["query_id"].to_numpy(), part["agent_id"].to_numpy(), part["day"].to_numpy(), _matrix(part["embedding"]).astype(np.float32)
    cells = model.cells(rows, probe)
    shards = sorted({int(c) % SHARDS for c in np.unique(cells) if c >= 0})
    sent = spark.sparkContext.broadcast((model, ids, agents, days, rows, cells))

    def best(batches):
        model, ids, agents, days, rows, cells = sent.value
        tables = model.tables(rows)
        query = np.repeat(np.arange(len(cells)), cells.shape[1])
        order = np.lexsort((query, cells.ravel()))
        cell, query = cells.ravel()[order], query[order]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for own, agent, vec, until, codes in _rows(batches):
            start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (agent[1:] != agent[:-1])]))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(own)]):
                asks = query[np.searchsorted(cell, own[a]) : np.searchsorted(cell, own[a], side="right")]
                asks = asks[agents[asks] == agent[a]]
                if not len(asks):
                    continue
                score = np.repeat((rows[asks] @ model.centres[own[a]])[:, None], b - a, axis=1)
                for p in range(codes.shape[1]):
                    score += tables[asks, p][:, codes[a:b, p]]
                score[days[asks][:, None] > until[a:b][None, :]] = -np.inf
                for q, line in zip(asks.tolist(), score):
                    s, v, c = np.concatenate([held[q][0], line]), np.concatenate([held[q][1], vec[a:b]]), np.concatenate([held[q][2], np.full(b - a, own[a])])
                    if len(s) > again:
                        keep = np.lexsort((v, -s))[:again]
                        s, v, c = s[keep], v[keep], c[keep]
                    held[q] = (s, v, c)
        for q, (s, v, c) in enumerate(held):
            good = s > -np.inf
            if good.any():
                n = int(good.sum())
                yield pa.record_batch([pa.array(np.full(n, ids[q])), pa.array(np.full(n, agents[q], np.int32)), pa.array(v[good]), pa.array(c[good], pa.int32()), pa.array(s[good].astype(np.float64))], names=["query_id", "agent_id", "vec_id", "cell", "sim"])

    kept = members(spark, path).where(F.col("shard").isin(shards))
    near = kept.select("cell", "agent_id", "vec_id", "until", "codes").mapInArrow(best, "query_id long, agent_id int, vec_id long, cell int, sim double")
    # At most QUERIES * again rows.
    near = staged(ranked(near, again).select("query_id", "agent_id", "vec_id", "cell"), "near")
    own = asked.select("query_id", F.col("embedding").alias("_asked"))
    held = kept.select("shard", "cell", "agent_id", "vec_id", "embedding").join(F.broadcast(near), ["cell", "agent_id", "vec_id"]).join(F.broadcast(own), "query_id")
    return held.select("query_id", "agent_id", "vec_id", F.round(dot(F.col("_asked"), F.col("embedding")), DIGITS).alias("sim"))


def _rows(batches):
    """cell, agent, vec, until and codes of some batches together, in the order of cell and agent."""
    waiting, n = [], 0

    def together():
        table = pa.Table.from_batches(waiting)
        cell, agent = table["cell"].to_numpy(), table["agent_id"].to_numpy()
        order = np.lexsort((agent, cell))
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(table), -1)
        return cell[order], agent[order], table["vec_id"].to_numpy()[order], table["until"].to_numpy()[order], codes[order]

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if n >= ROWS:
            yield together()
            waiting, n = [], 0
    if n:
        yield together()
