"""Operator 13, ranked lexical search by presence-mask grouping.

Documents are scanned once for the terms of the items: a row of the postings holds a document's number of terms and,
of the terms that any item has, which ones it holds and how often. Spark sums up the corpus (documents, terms) and the
documents of each term. Then each task takes its documents in chunks: a chunk has a bitmap of documents for each term,
an item's bitmaps are turned into one mask a document, documents of one mask are a group, and groups are evaluated by
descending greatest score (every term of the mask at the chunk's greatest frequency, in its shortest text) until no
group left can reach the item's best so far. A task sends its best of each item only. All figures are integers but for
the logarithm, so the ranks are exact; a task's best so far only saves work.

Items are taken in blocks of at most BLOCK_TERMS terms, one scan of the documents each; what tasks hold is bounded by
that, the chunk and the number of items of a block times `top`. Terms are told apart by 64-bit hashes.

Cases: null and empty texts have no terms: such documents don't count and such items find nothing; copies of an item
(equal item_id and text) are one, and an item_id with two texts is ranked for each; copies of a document are ranked
each, at equal scores by doc_id, a null one last; empty tables give no rows; extra columns aren't read, whatever their
names. A text is held whole by a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import staged
from .words import LETTERS_DIGITS, scan

#: Distinct terms of items that are sent to tasks at once: 8 bytes each, and 16 for each term of each item.
BLOCK_TERMS = 1 << 18

#: Documents whose masks are made at once.
CHUNK = 2048

#: Stands for a null doc_id: it comes last.
LAST = 2**63 - 1


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text), each once, with a number `_item`, its distinct terms as hashes and how often it has each."""
    known = items.select("item_id", "text").where("text is not null").distinct().withColumn("_item", F.monotonically_increasing_id())
    known = staged(known, "search-items")

    def run(batches):
        for batch in batches:
            words = scan(batch.column("text"), LETTERS_DIGITS, lower=True)
            terms, times = [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                own, count = np.unique(words.key[a:b], return_counts=True)
                terms.append(own.view(np.int64))
                times.append(count)
            yield batch.drop_columns(["text"]).append_column("terms", pa.array(terms, pa.list_(pa.int64()))).append_column("times", pa.array(times, pa.list_(pa.int64())))

    return known.mapInArrow(run, known.drop("text").withColumns({"terms": F.array().cast("array<bigint>"), "times": F.array().cast("array<bigint>")}).schema)


def postings(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """doc, n (all terms of the document), terms (places in wanted, which is sorted) and tf. Documents without terms go."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text").where("text <> ''")

    def run(batches):
        every = sent.value
        for batch in batches:
            words = scan(batch.column("text"), LETTERS_DIGITS, lower=True)
            place = np.minimum(np.searchsorted(every, words.key), len(every) - 1)
            hit = np.flatnonzero(every[place] == words.key)
            pair, tf = np.unique(words.doc[hit] * len(every) + place[hit], return_counts=True)
            offsets = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(every)).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32)))
            out = pa.record_batch([batch.column("doc"), pa.array(np.diff(words.first), pa.int64()), lists(pair % len(every)), lists(tf)], names=["doc", "n", "terms", "tf"])
            yield out.filter(pa.array(np.diff(words.first) > 0))

    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tf array<int>")


class _Chunk:
    """Bitmaps and frequencies of some documents' terms."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, term: np.ndarray, row: np.ndarray, tf: np.ndarray, corpus: tuple[int, int]):
        self.doc, self.size = doc, len(doc)
        self.m = 100 - 25 + (25 * n * corpus[0]) // corpus[1]
        order = np.lexsort((row, term))
        self.terms, start = np.unique(term[order], return_index=True)
        self.tf = tf[order].astype(np.int64)
        self.most = np.maximum.reduceat(self.tf, start) if len(start) else self.tf
        place = np.repeat(np.arange(len(self.terms)), np.diff(np.append(start, len(order))))
        self.at = place * self.size + row[order]
        bits = np.zeros((len(self.terms), -(-self.size // 8)), np.uint8)
        np.bitwise_or.at(bits, (place, row[order] >> 3), (128 >> (row[order] & 7)).astype(np.uint8))
        self.bits = bits

    def groups(self, places: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents by descending greatest score of their mask; where each group ends; its greatest score."""
        held = np.unpackbits(self.bits[places], axis=1, count=self.size)
        some = np.flatnonzero(held.any(axis=0))
        packed = np.packbits(held[:, some], axis=0)
        masks = np.zeros((len(some), -(-len(packed) // 8) * 8), np.uint8)
        masks[:, : len(packed)] = packed.T
        masks = masks.view("<u8")[:, 0] if masks.shape[1] == 8 else masks.view(f"V{masks.shape[1]}")[:, 0]
        _, first, group, count = np.unique(masks, return_index=True, return_inverse=True, return_counts=True)
        best = weight * ((1_000_000_000 * self.most[places]) // (1000 * self.most[places] + 12 * int(self.m.min())))
        bound = best @ held[:, some[first]].astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        turn = np.empty_like(order)
        turn[order] = np.arange(len(order))
        return some[np.argsort(turn[group], kind="stable")], np.cumsum(count[order]), bound[order]

    def scores(self, rows: np.ndarray, places: np.ndarray, weight: np.ndarray) -> np.ndarray:
        wanted = places[:, None] * self.size + rows[None, :]
        found = np.minimum(np.searchsorted(self.at, wanted), len(self.at) - 1)
        tf = np.where(self.at[found] == wanted, self.tf[found], 0)
        return weight @ ((1_000_000_000 * tf) // (1000 * tf + 12 * self.m[rows][None, :]))


def _better(held: tuple[np.ndarray, np.ndarray] | None, score: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    if held is not None:
        score, doc = np.concatenate([held[0], score]), np.concatenate([held[1], doc])
    order = np.lexsort((doc, -score))[:top]
    return score[order], doc[order]


def _search(chunk: _Chunk, terms: np.ndarray, weight: np.ndarray, held, top: int):
    """The item's best, with those of the chunk."""
    place = np.minimum(np.searchsorted(chunk.terms, terms), len(chunk.terms) - 1)
    there = chunk.terms[place] == terms
    places, weight = place[there], weight[there]
    if not len(places):
        return held
    rows, ends, bound = chunk.groups(places, weight)
    done, step = 0, 4 * top
    while done < len(ends):
        least = held[0][-1] if held is not None and len(held[0]) == top else 1
        # Groups in order, as many as can still reach the best, some at a time.
        stop = min(int(np.searchsorted(-bound, -least, side="right")), max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step))))
        if stop <= done:
            break
        some = rows[ends[done - 1] if done else 0 : ends[stop - 1]]
        score = chunk.scores(some, places, weight)
        good = score >= least
        held = _better(held, score[good], chunk.doc[some[good]], top)
        done, step = stop, 2 * step
    return held


def _chunks(batches, corpus):
    """Chunks of postings, of several batches or of a part of one."""
    waiting, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            waiting.append(batch.slice(at, CHUNK))
            rows += waiting[-1].num_rows
            if rows >= CHUNK:
                yield _chunk(waiting, corpus)
                waiting, rows = [], 0
    if rows:
        yield _chunk(waiting, corpus)


def _chunk(batches: list[pa.RecordBatch], corpus) -> _Chunk:
    table = pa.Table.from_batches(batches).combine_chunks()
    column = lambda c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0)
    terms = column("terms")
    row = np.repeat(np.arange(len(table)), terms.value_lengths().to_numpy())
    return _Chunk(column("doc").to_numpy(), column("n").to_numpy(), terms.flatten().to_numpy(), row, column("tf").flatten().to_numpy(), corpus)


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    known = staged(item_terms(items), "search-terms")
    total = known.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, found = max(1, math.ceil(total / BLOCK_TERMS)), None
    for block in range(blocks):
        part = known.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).select("_item", "terms", "times").where("size(terms) > 0").toArrow()
        hits = _block(docs, part, top)
        if hits is not None:
            hits = staged(hits, "search-hits") if blocks > 1 else hits
            found = hits if found is None else found.unionAll(hits)
    if found is None:
        found = spark.createDataFrame([], "_item long, doc long, score long")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(known.select("_item", "item_id"), "_item").select("item_id", "rank", F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "score")


def _block(docs: DataFrame, items: pa.Table, top: int) -> DataFrame | None:
    """_item, doc, score: of each task, the best of each item. Without items, or documents that have terms: none."""
    if not len(items):
        return None
    lists, times = items["terms"].combine_chunks(), items["times"].combine_chunks()
    keys = lists.flatten().to_numpy().view(np.uint64)
    wanted = np.unique(keys)
    rows = staged(postings(docs, wanted), "postings")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    # At most BLOCK_TERMS rows, or the terms of one item.
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(wanted), np.int64)
    df[held["term"].to_numpy()] = held["df"].to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    place = np.searchsorted(wanted, keys)
    worth = weight[place] * times.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    sent = docs.sparkSession.sparkContext.broadcast((items["_item"].to_numpy(), ends, place, worth))
    corpus = (int(n_docs), int(n_terms))

    def best(batches):
        numbers, ends, place, worth = sent.value
        # Terms that are in so many documents that they weigh nothing don't count.
        asked = [(place[a:b][worth[a:b] > 0], worth[a:b][worth[a:b] > 0]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        held: list = [None] * len(asked)
        for chunk in _chunks(batches, corpus):
            if len(chunk.terms):
                for i, (terms, weight) in enumerate(asked):
                    if len(terms):
                        held[i] = _search(chunk, terms, weight, held[i], top)
        for i, h in enumerate(held):
            if h is not None and len(h[0]):
                yield pa.record_batch([pa.array(np.full(len(h[0]), numbers[i])), pa.array(h[1]), pa.array(h[0])], names=["_item", "doc", "score"])

    return rows.mapInArrow(best, "_item long, doc long, score long")
