"""Operator 2, substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of (window + 1) // 2 words; any window of `window`
words holds one whole block of its own document. The blocks' hashes are the index, and every rolling window of
a block's length is a probe. A probe that meets a block found at another place is an anchor; a window around
an anchored block is extended to its full length, and its two hashes, of two independent keys for each word and 96 bits
together, are counted over the corpus. Windows that
start at two or more places are exact repeats; overlapping ones join into maximal repeats, whose words go.

Only hashes are dealt out: documents are grouped into chunks, a chunk sends each hash range ("part") one row
with its distinct hashes, sorted and packed, and gets one row of flags back. A hash that a third of all
documents share is therefore one entry a chunk, never a pair of documents.

Cases: null and empty texts have no words, and keep null hash input ("" as kept text); equal rows and copies are
places of their own, so all their words from `window` words on go; an empty table gives an empty result; extra
columns are dropped unless named in `keep`; a name in `keep` that a new column has is refused. A task holds a chunk
whole, and a single text; rows that are equal in text and in all of `keep` are of one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import grain, text_bytes
from .words import U64, Words, buffers, scan

PACKED = "part int, chunk long, n int, probes binary, more binary, blocks binary"
FLAGS = "chunk long, round int, part int, n int, flags binary"


def _ranged(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash range above, 32 bits of the hash below."""
    return ((h >> U64(33)) % U64(parts) << U64(32)) | (h & U64(0xFFFFFFFF))


def _edges(ranged: np.ndarray, parts: int, shift: int = 32) -> np.ndarray:
    return np.searchsorted(ranged >> U64(shift) if shift else ranged, np.arange(parts + 1).astype(ranged.dtype))


def _unflag(table: pa.Table, number: int) -> np.ndarray:
    """A chunk's flags in the order of the hash ranges, as the chunk had sent its hashes."""
    rows = sorted((p, n, f) for r, p, n, f in zip(*(table[c].to_pylist() for c in ("round", "part", "n", "flags"))) if r == number)
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for _, n, f in rows)])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_packed = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("probes", pa.binary()), ("more", pa.binary()), ("blocks", pa.binary())])
_flags = pa.schema([("chunk", pa.int64()), ("round", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("flags", pa.binary())])


def _probe(words: Words, block: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a rolling window starts, its ranged hash, and whether it is a reference block."""
    at, h = words.windows(block)
    return at, _ranged(h, parts), (at - words.first[words.doc[at]]) % block == 0


def _send_probes(table: pa.Table, block: int, parts: int) -> pa.Table:
    words = scan(table["text"])
    _, ranged, is_block = _probe(words, block, parts)
    probes, counts = np.unique(ranged, return_counts=True)
    blocks = np.unique(ranged[is_block])
    pe, be = _edges(probes, parts), _edges(blocks, parts)
    low, low_b, more = probes.astype(np.uint32), blocks.astype(np.uint32), counts > 1
    chunk = table["chunk"][0].as_py()
    rows = [(p, chunk, pe[p + 1] - pe[p], low[pe[p] : pe[p + 1]].tobytes(), np.packbits(more[pe[p] : pe[p + 1]]).tobytes(), low_b[be[p] : be[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(pe)).tolist()]
    return _table(rows, _packed)


def _answer_probes(batches):
    """For one hash range: flags the probes that meet a block and are found at two or more places."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    if not rows:
        return
    probes = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
    places = 1 + np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=r[2]) for r in rows])
    index = np.unique(np.concatenate([np.frombuffer(r[5], np.uint32) for r in rows]))
    anchored = np.isin(probes, index)
    _, inverse = np.unique(probes[anchored], return_inverse=True)
    anchored[anchored] = np.bincount(inverse, places[anchored])[inverse] >= 2
    yield from _reply(rows, anchored, 1)


def _reply(rows: list[tuple], flags: np.ndarray, number: int):
    ends = np.cumsum([r[2] for r in rows])
    out = [(r[1], number, r[0], r[2], np.packbits(flags[e - r[2] : e]).tobytes()) for r, e in zip(rows, ends.tolist())]
    yield from _table(out, _flags).to_batches()


def _extend(words: Words, flags: np.ndarray, window: int, parts: int):
    """Windows whose own block is anchored: their starts and (range, hash, second hash), sorted and distinct, with the way back."""
    block = (window + 1) // 2
    at, ranged, _ = _probe(words, block, parts)
    hit = np.zeros(len(words.key) + 1, bool)
    if len(at):
        hit[at] = flags[np.unique(ranged, return_inverse=True)[1]]
    start, h = words.windows(window)
    own = start + (words.first[words.doc[start]] - start) % block
    found = hit[own]
    start, h, h2 = start[found], h[found], words.windows(window, second=True)[1][found].astype(np.uint32)
    part = ((h >> U64(33)) % U64(parts)).astype(np.int64)
    order = np.lexsort((h2, h, part))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    firsts = order[new]
    return start, group, part[firsts], h[firsts], h2[firsts]


def _send_windows(docs: pa.Table, replies: pa.Table, window: int, parts: int) -> pa.Table:
    if not docs.num_rows:
        return _packed.empty_table()
    _, group, part, h, h2 = _extend(scan(docs["text"], second=True), _unflag(replies, 1), window, parts)
    edges, more = _edges(part, parts, 0), np.bincount(group, minlength=len(h)) > 1
    chunk = docs["chunk"][0].as_py()
    rows = [(p, chunk, edges[p + 1] - edges[p], h[edges[p] : edges[p + 1]].tobytes(), np.packbits(more[edges[p] : edges[p + 1]]).tobytes(), h2[edges[p] : edges[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(edges)).tolist()]
    return _table(rows, _packed)


def _answer_windows(batches):
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    if not rows:
        return
    h, h2 = np.concatenate([np.frombuffer(r[3], U64) for r in rows]), np.concatenate([np.frombuffer(r[5], np.uint32) for r in rows])
    places = 1 + np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=r[2]) for r in rows])
    order = np.lexsort((h2, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    yield from _reply(rows, np.bincount(group, places)[group] >= 2, 2)


def _remove(docs: pa.Table, replies: pa.Table, window: int, parts: int, keep: list[str], schema: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    words = scan(docs["text"], second=True)
    start, group, *_ = _extend(words, _unflag(replies, 1), window, parts)
    start = start[_unflag(replies, 2)[group]] if len(group) else start
    n = len(words.key)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    data, _ = buffers(docs["text"])
    raw, texts, removed = data.tobytes(), [], np.add.reduceat(np.append(gone, False), words.first[:-1]) if n else np.zeros(docs.num_rows, int)
    removed = np.where(np.diff(words.first) > 0, removed, 0)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        left = np.flatnonzero(~gone[a:b]) + a
        texts.append(b" ".join(raw[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist())).decode())
    return pa.table([*(docs[c] for c in keep), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=schema.names).cast(schema)


def remove_repeats(docs: DataFrame, window: int = 35, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns, n_words, n_removed and kept_text (words left, joined by one space), a row for each row of docs."""
    spark = docs.sparkSession
    if clash := {"n_words", "n_removed", "kept_text"} & {c.lower() for c in keep}:
        raise ValueError(f"{sorted(clash)} are the result's own columns")
    chunks, parts = grain(spark, text_bytes(docs, text))
    block = (window + 1) // 2
    keep = list(keep)
    # What a row holds decides its chunk, so a rerun task deals it alike; copies differ by keep, which has their ids.
    dealt = docs.select(F.pmod(F.xxhash64(*keep, F.crc32(F.col(text).cast("binary"))), F.lit(chunks)).alias("chunk"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    names = [f"keep_{i}" for i in range(len(keep))]
    to_part = lambda df: df.repartitionById(parts, F.col("part"))
    probes = dealt.groupBy("chunk").applyInArrow(lambda t: _send_probes(t, block, parts), PACKED)
    anchors = to_part(probes).mapInArrow(_answer_probes, FLAGS)
    windows = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(lambda d, r: _send_windows(d, r, window, parts), PACKED)
    repeats = to_part(windows).mapInArrow(_answer_windows, FLAGS)
    out = T.StructType([T.StructField(n, dealt.schema[n].dataType) for n in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    done = dealt.groupBy("chunk").cogroup(anchors.unionAll(repeats).groupBy("chunk")).applyInArrow(lambda d, r: _remove(d, r, window, parts, names, schema), out)
    return done.withColumnsRenamed(dict(zip(names, keep)))
