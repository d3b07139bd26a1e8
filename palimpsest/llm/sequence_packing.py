"""Operator 12, packing of tokenised documents into sequences by the sum-of-squares rule.

`pieces` gives the tokens of each document with an end token behind them, cut where a document is longer than a
sequence: the first piece takes the remainder, so that all others are full and only one piece a document needs packing.

`packed` deals the pieces evenly to groups of about GROUP. A task keeps open sequences by their residual gap and puts
each piece where the sum over all gaps of the squared number of open sequences becomes smallest, in a new sequence if
that is best. Gaps then stay evenly used, and nearly every sequence ends exactly full; the few hundred of a group that
don't are taken apart, and their pieces dealt to fewer groups, until one group of at most GROUP pieces is left, which
is packed in two orders (long ones first, and as dealt), the better of which counts. Where a round fills next to
nothing (say, all pieces longer than half a sequence), its sequences stay as they are.

Documents are encoded by the tokenizers library. Where its file is a plain byte-level BPE, texts are first cut at
single spaces between visible characters, where its pre-tokens end whatever stands around, and what recurs in some
megabytes is encoded once, by tiktoken over the same ranks; long runs without a space always go to the library.

Cases: null counts as the empty text, which is one end token; equal rows are packed each for itself; a document of
exactly one sequence isn't cut; an empty table gives no rows; extra columns pass through, but columns that have the
names of the new ones are replaced. A text and its tokens are held whole by a task.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_columns, without
from .staging import staged
from .words import buffers, word_keys

#: Tokens of a sequence, and the token behind each document.
CAPACITY, END = 2048, 0

#: Pieces that a task packs together; less than this share of a round's pieces in full sequences ends the rounds.
GROUP, WORTH = 1 << 15, 0.1

#: Bytes of texts that are encoded at once, and of runs without a space that always go to the library.
ENCODED_BYTES, LONG_RUN = 8 << 20, 2000

PIECE = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
IDS = {"ids": "array<int>"}
PLACE = {"sequence_id": "long", "offset": "long"}


# --- tokens


@cache
def _fast(blob: str) -> tuple | None:
    """tiktoken's encoding and each token's number of bytes, if the file is a plain byte-level BPE."""
    import tiktoken

    spec = json.loads(blob)
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not (spec.get("truncation") or spec.get("padding"))
    if not plain or any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or not a.get("special") for a in added):
        return None
    # The alphabet of byte-level vocabularies: visible bytes stand for themselves, others for characters from 256 on.
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(seen)))}
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get("".join(m)) for m in merges]
    if None in made or made != sorted(made):
        return None
    # The pattern of byte-level pre-tokens.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
        size[i] = len(token)
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), size


@cache
def _library(blob: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_str(blob)


def _breaks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, and which of them begin and end so that others may stand beside them. A run begins with a row,
    and at a single space between two characters that are surely not white space."""
    ascii_ = (data > 0x20) & (data < 0x7F)
    # No white space has two bytes with these first bytes, nor begins with those of `next_`.
    last = ascii_.copy()
    last[1:] |= (data[1:] & 0xC0 == 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    next_ = ascii_ | (data >= 0xC3) & ~np.isin(data, (0xE1, 0xE2, 0xE3))
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 0x20) & last[:-2] & next_[2:]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    # A space that begins or ends a row has its neighbour in another one.
    cut[rows], cut[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False, False
    inner = np.flatnonzero(cut)
    starts = np.union1d(rows, inner)
    clean = cut[starts] & last[np.append(starts[1:], len(data)) - 1] if len(starts) else np.zeros(0, bool)
    return starts, clean


def encode(column: pa.Array, blob: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows, and the n+1 offsets of rows in them."""
    data, offsets = buffers(column)
    if not len(data) or (fast := _fast(blob)) is None:
        return _joined([e.ids for e in _library(blob).encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)])
    encoding, size = fast
    starts, clean = _breaks(data, offsets)
    length = np.diff(np.append(starts, len(data)))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    _, index, which = np.unique(word_keys(padded, starts, length), return_index=True, return_inverse=True)
    ids, ends = _joined(_runs(data, starts[index], length[index], clean[index], encoding, size, _library(blob)))
    count = np.diff(ends)[which]
    total = np.concatenate([[0], np.cumsum(count)])
    flat = ids[np.repeat(ends[:-1][which] - total[:-1], count) + np.arange(total[-1])]
    return flat, total[np.searchsorted(starts, offsets)]


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *[np.asarray(x, np.uint32) for x in lists]]).astype(np.uint32), ends


def _runs(data, start, length, clean, encoding, size, library) -> list:
    """The ids of each run. Clean ones are encoded as one text and told apart by their bytes."""
    raw, out = data.tobytes(), [None] * len(start)
    long = length > LONG_RUN
    joined = np.flatnonzero(clean & ~long)
    begin, stop = start.tolist(), (start + length).tolist()
    ids = encoding.encode_to_numpy(b"".join([raw[begin[i] : stop[i]] for i in joined.tolist()]).decode(errors="replace"), allowed_special="all") if len(joined) else np.zeros(0, np.uint32)
    at = np.concatenate([[0], np.cumsum(size[ids])])
    edge = np.concatenate([[0], np.cumsum(length[joined])])
    place = np.searchsorted(at, edge)
    fits = len(joined) > 0 and place[-1] < len(at) and bool((at[place] == edge).all())
    for k, i in enumerate(joined.tolist() if fits else ()):
        out[i] = ids[place[k] : place[k + 1]]
    for i in range(len(out)):
        if out[i] is None:
            text = raw[begin[i] : stop[i]].decode(errors="replace")
            out[i] = library.encode(text, add_special_tokens=False).ids if long[i] else encoding.encode_to_numpy(text, allowed_special="all")
    return out


# --- pieces


def _cut(column: pa.Array, blob: str, capacity: int, end: int, with_ids: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The row of each piece, and the pieces."""
    ids, offsets = encode(column, blob)
    rows = len(offsets) - 1
    flat = np.full(len(ids) + rows, end, "<u4")
    flat[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(offsets))] = ids
    offsets = offsets + np.arange(rows + 1)
    total = np.diff(offsets)
    n = -(-total // capacity)
    row = np.repeat(np.arange(rows), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lead = total - (n - 1) * capacity
    start = np.where(piece == 0, 0, lead[row] + (piece - 1) * capacity)
    length = np.where(piece == 0, lead[row], capacity)
    at = offsets[:-1][row] + start
    crc = [zlib.crc32(flat[a:b].data) for a, b in zip(at.tolist(), (at + length).tolist())]
    out = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
    if with_ids:
        # Pieces follow each other without a gap.
        out["ids"] = pa.LargeListArray.from_arrays(pa.array(np.append(at, len(flat))), pa.array(flat.astype(np.int32))).cast(pa.list_(pa.int32()))
    return row, out


def pieces(docs: DataFrame, blob: str, text: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """docs less the text, a row a piece, with piece, start, length and ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers) and, if wanted, ids. blob: the tokenizer's file, as text."""
    new = PIECE | (IDS if ids else {})
    kept = without(docs, new, text)
    schema = with_columns(kept.drop(text), new)
    sent = docs.sparkSession.sparkContext.broadcast(blob)

    def made(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches)
        row, out = _cut(whole[text], sent.value, capacity, end, ids)
        rest = whole.drop_columns([text]).take(pa.array(row)).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rest.columns]
        return pa.RecordBatch.from_arrays([*columns, *out.values()], [*rest.column_names, *out])

    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            for one in _split(batch, text):
                waiting.append(one)
                held += int(buffers(one.column(text))[1][-1])
                if held >= ENCODED_BYTES:
                    yield made(waiting)
                    waiting, held = [], 0
        if waiting:
            yield made(waiting)

    return kept.mapInArrow(run, schema)


def _split(batch: pa.RecordBatch, text: str):
    """Slices of about ENCODED_BYTES."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + ENCODED_BYTES, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


# --- packing


class Bins:
    """Open sequences by residual gap; members are numbers of pieces."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[int]]] = defaultdict(list)

    def put(self, number: int, size: int) -> list[int] | None:
        """The members of the sequence that the piece fills, if it does."""
        if size == self.capacity:
            return [number]
        # From a gap g to g - size, the sum of squares changes by 2 * (count[g - size] - count[g] + 1), to no gap by
        # 1 - 2 * count[g]; a new sequence changes it by 2 * count[capacity - size] + 1.
        here = self.count[size : self.capacity]
        change = np.where(here > 0, 2 * (self.count[: self.capacity - size] - here + 1), np.iinfo(np.int64).max)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]
        best = int(change.argmin())
        if change[best] >= 2 * self.count[self.capacity - size] + 1:
            members, gap = [number], self.capacity - size
        else:
            self.count[size + best] -= 1
            members, gap = self.open[size + best].pop(), best
            members.append(number)
        if gap == 0:
            return members
        self.count[gap] += 1
        self.open[gap].append(members)
        return None

    def rest(self) -> list[list[int]]:
        return [members for gap in sorted(self.open) for members in self.open[gap]]


def pack(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[list[int]]]:
    """Full sequences, and others, of pieces in the order given."""
    bins, full = Bins(capacity), []
    for i, size in enumerate(sizes):
        if done := bins.put(i, size):
            full.append(done)
    return full, bins.rest()


def _round(rows: DataFrame, groups: int, number: int, last: bool, capacity: int, schema: T.StructType) -> DataFrame:
    names = [c for c in rows.columns]

    def run(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        sizes = table["length"].to_numpy().tolist()
        full, rest = pack(sizes, capacity)
        if last:
            order = np.argsort(-np.array(sizes), kind="stable").tolist()
            again = pack([sizes[i] for i in order], capacity)
            if len(again[0]) + len(again[1]) < len(full) + len(rest):
                full, rest = ([[order[i] for i in m] for m in part] for part in again)
        base = number << 58 | TaskContext.get().partitionId() << 32
        bins = [*full, *rest]
        n = np.array([len(m) for m in bins])
        members = np.array([i for m in bins for i in m])
        length = np.array(sizes)[members]
        end = np.cumsum(length)
        first = np.repeat(np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)[:-1]])], n)
        out = table.select(names).take(pa.array(members))
        out = out.append_column("sequence_id", pa.array(np.repeat(base + np.arange(len(bins)), n), pa.int64())).append_column("offset", pa.array(end - length - first, pa.int64()))
        out = out.append_column("_full", pa.array(np.repeat(np.arange(len(bins)) < len(full), n)))
        yield from out.to_batches()

    dealt = rows.repartition(groups).sortWithinPartitions(F.xxhash64(*[F.col(f"`{c}`") for c in PIECE]))
    return staged(dealt.mapInArrow(run, T.StructType([*schema.fields, T.StructField("_full", T.BooleanType())])), f"packing-{number}")


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with length, from 1 to capacity, and the other columns of PIECE) with sequence_id and offset."""
    rows = staged(without(rows, PLACE, *PIECE), "pieces")
    schema, left, done, number = with_columns(rows, PLACE), rows.count(), None, 0
    while True:
        groups = max(1, -(-left // GROUP))
        found = _round(rows, groups, number, groups == 1, capacity, schema)
        full = found.where("_full")
        open_ = left - full.count()
        stop = groups == 1 or open_ > (1 - WORTH) * left or not open_
        part = (found if stop else full).drop("_full")
        done = part if done is None else done.unionByName(part)
        if stop:
            return done
        rows, left, number = found.where("not _full").drop("_full", *PLACE), open_, number + 1


def sequences(packed_rows: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from packed rows with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
