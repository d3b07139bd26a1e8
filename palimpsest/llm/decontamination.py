"""Operator 6, benchmark decontamination by a broadcast hash set of the items' word windows.

Words are lower-cased runs of ASCII letters, digits and any non-ASCII character. The windows of all benchmark items
(`size` words; an item of fewer words is one window) are hashed in Spark and sent to every task as sorted arrays: a
window is one, however many items have it, with its place in one buffer of the items' words and the numbers of its
items. Each document's rolling windows are looked up in them, and a hit counts only after its words have been compared
with the item's. Items beyond BLOCK_BYTES are taken in blocks, one scan of the documents each, and a block's result is
written before the next one is sent, so that what tasks hold is bounded: copies of an item are one, and a long item is
cut into pieces, in Spark, that have each of its windows once. A document gets the runs of words that are hit and the
set of items, never a row for each occurrence of each item.

Cases: null and empty texts have no words and no hits; items without words find nothing; copies of an item or of a
document are judged alike; a null item_id is named "null"; empty tables give no hits or no rows; extra columns pass
through, but columns that have the names of the new ones are replaced. A text is held whole by a task.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import replaced, with_columns, without
from .staging import staged
from .words import LETTERS_DIGITS, LOWER, U64, Words, buffers, scan

#: Bytes of item texts whose windows are sent to the tasks at once; about 6 bytes of arrays for each.
BLOCK_BYTES = 8 << 20

#: Of each piece of an item: its words, joined by a space, and the windows: number of words, two hashes, and where they
#: begin and end in the words.
PIECE = {"words": pa.binary(), "length": pa.int32(), "hash": pa.list_(pa.int64()), "hash_2": pa.list_(pa.int64()), "start": pa.list_(pa.int32()), "stop": pa.list_(pa.int32())}
PIECES = "item string, words binary, length int, hash array<bigint>, hash_2 array<bigint>, start array<int>, stop array<int>"

#: What is added: runs of hit words by number, from the first to before the last, and the items found.
FOUND = {"_runs": "array<struct<start: bigint, stop: bigint>>", "_items": "array<string>"}
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
COUNTS = {"n_words": "long", "n_hit": "long"}
NAMED = {"n_items": "long", "items_sha256": "string"}


def _folded(column) -> bytes:
    return LOWER[buffers(column)[0]].tobytes()


def _texts_of(words: Words, raw: bytes, at: int, length: int) -> bytes:
    return b" ".join(raw[s:e] for s, e in zip(words.start[at : at + length].tolist(), words.end[at : at + length].tolist()))


def piece_windows(batches, size: int):
    """A row of PIECES for each (item, text) that has words."""
    for batch in batches:
        column = batch.column("text")
        words, raw = scan(column, LETTERS_DIGITS, lower=True, second=True), _folded(column)
        counts = np.diff(words.first)
        found: dict[int, tuple] = {}
        for length in sorted({min(size, n) for n in counts.tolist() if n}):
            at, h = words.windows(length)
            _, h2 = words.windows(length, second=True)
            mine = np.minimum(size, counts[words.doc[at]]) == length
            found[length] = at[mine], h[mine].view(np.int64), h2[mine].view(np.int64)
        rows: dict[str, list] = {name: [] for name in PIECE}
        kept = np.flatnonzero(counts)
        for row in kept.tolist():
            a, b = int(words.first[row]), int(words.first[row + 1])
            sizes = words.end[a:b] - words.start[a:b]
            begin = np.cumsum(sizes + 1) - sizes - 1
            length = min(size, b - a)
            at, h, h2 = found[length]
            x, y = np.searchsorted(at, [a, b])
            own = at[x:y] - a
            values = _texts_of(words, raw, a, b - a), length, h[x:y], h2[x:y], begin[own].astype(np.int32), (begin + sizes)[own + length - 1].astype(np.int32)
            for name, value in zip(PIECE, values):
                rows[name].append(value)
        yield pa.record_batch([batch.column("item").take(pa.array(kept)), *(pa.array(rows[name], kind) for name, kind in PIECE.items())], names=["item", *PIECE])


class Windows:
    """The windows of a block of items. by_length: of each number of words, the sorted hashes, and the numbers of the
    windows they stand for; of each window: where its words lie in text, and where its items lie in items."""

    def __init__(self, pieces: pa.Table):
        column = lambda c: pieces[c].combine_chunks()
        names, piece_item = np.unique(np.array(pieces["item"].to_pylist(), object), return_inverse=True)
        self.names: list[str] = names.tolist()
        texts = pieces["words"].to_pylist()
        self.text = b"\n".join(texts)
        origin = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
        n = column("hash").value_lengths().to_numpy()
        flat = lambda c: column(c).flatten().to_numpy()
        shift = np.repeat(origin, n)
        start, stop, item, length = flat("start") + shift, flat("stop") + shift, np.repeat(piece_item, n), np.repeat(pieces["length"].to_numpy(), n)
        h, h2 = flat("hash").view(U64), flat("hash_2")
        order = np.lexsort((item, h2, h, length))
        h, h2, item, length = h[order], h2[order], item[order], length[order]
        new, once = np.ones(len(h), bool), np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (length[1:] != length[:-1])
        # Of a window that an item has twice one counts.
        once[1:] = new[1:] | (item[1:] != item[:-1])
        self.start, self.stop = start[order][new].astype(np.int32), stop[order][new].astype(np.int32)
        self.items, self.first = item[once].astype(np.int32), np.append(np.flatnonzero(new[once]), once.sum()).astype(np.int32)
        h, length = h[new], length[new]
        edges = np.searchsorted(length, np.unique(length))
        self.by_length = {int(length[a]): (h[a:b], a) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(h)])}

    def nbytes(self) -> int:
        return len(self.text) + sum(x.nbytes for x in (self.start, self.stop, self.items, self.first, *(h for h, _ in self.by_length.values())))

    def matching(self, length: int, place: int, text: bytes) -> int | None:
        """The window with this text, of those from place on that have one hash."""
        hashes, base = self.by_length[length]
        h = hashes[place]
        while place < len(hashes) and hashes[place] == h:
            if self.text[self.start[base + place] : self.stop[base + place]] == text:
                return base + place
            place += 1
        return None

    def items_of(self, window: int) -> np.ndarray:
        return self.items[self.first[window] : self.first[window + 1]]


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _find(column, windows: Windows, old: list[tuple[list, list]] | None) -> tuple[list[list[dict]], list[list[str]]]:
    """Runs of hit words and sorted items for each row, with those of old."""
    words, raw = scan(column, LETTERS_DIGITS, lower=True), None
    change, found = np.zeros(len(words.key) + 1, np.int64), [set() for _ in range(len(column))]
    for length, (hashes, _) in windows.by_length.items():
        at, h = words.windows(length)
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for i in np.flatnonzero(hashes[place] == h).tolist():
            raw = _folded(column) if raw is None else raw
            start = int(at[i])
            window = windows.matching(length, int(place[i]), _texts_of(words, raw, start, length))
            if window is not None:
                found[words.doc[start]].add(window)
                change[start] += 1
                change[start + length] -= 1
    items = []
    for row, own in enumerate(found):
        numbers = np.unique(np.concatenate([windows.items_of(w) for w in own])).tolist() if own else []
        items.append({windows.names[k] for k in numbers} | set(old[row][1] if old else ()))
    for row, (runs, _) in enumerate(old or []):
        for run in runs:
            change[words.first[row] + run["start"]] += 1
            change[words.first[row] + run["stop"]] -= 1
    covered = np.cumsum(change[:-1]) > 0
    spans = [[{"start": a, "stop": b} for a, b in _runs(covered[x:y])] if covered[x:y].any() else [] for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    return spans, [sorted(i) for i in items]


def _pieces(batches, size: int, limit: int):
    """item, text of at most `limit` bytes or `size` words: a longer text is cut so that each window is in one piece."""
    for batch in batches:
        column = batch.column("text")
        words, (data, offsets) = scan(column, LETTERS_DIGITS, lower=True), buffers(column)
        names, texts = [], []
        for row, (item, text) in enumerate(zip(batch.column("item").to_pylist(), column.to_pylist())):
            at, end = int(words.first[row]), int(words.first[row + 1])
            if offsets[row + 1] - offsets[row] <= limit or end - at <= size:
                names.append(item)
                texts.append(text)
                continue
            while end - at >= size:
                stop = max(at + size, at + int(np.searchsorted(words.end[at:end], words.start[at] + limit, side="right")))
                names.append(item)
                texts.append(data[int(words.start[at]) : int(words.end[stop - 1])].tobytes().decode())
                at = stop - size + 1
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])


def scan_items(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """docs with FOUND's columns added: runs of words in an occurrence of an item's window, and the items that have one there."""
    spark = docs.sparkSession
    known = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where(F.col("text").isNotNull())
    limit = BLOCK_BYTES // 8
    known = staged(known.mapInArrow(lambda b: _pieces(b, size, limit), known.schema).distinct(), "benchmark-items")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    docs = without(docs, FOUND, text)
    schema, out = with_columns(docs, FOUND), docs
    for block in range(blocks):
        # A block has about BLOCK_BYTES of items, by hash.
        part = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        pieces = part.mapInArrow(lambda b: piece_windows(b, size), PIECES).toArrow()
        sent = spark.sparkContext.broadcast(Windows(pieces))

        def look(batches, sent=sent, again=block > 0):
            for batch in batches:
                old = list(zip(batch.column("_runs").to_pylist(), batch.column("_items").to_pylist())) if again else None
                runs, names = _find(batch.column(text), sent.value, old)
                yield replaced(batch.drop_columns(list(FOUND)) if again else batch, {"_runs": pa.array(runs, RUNS), "_items": pa.array(names, pa.list_(pa.string()))})

        out = out.mapInArrow(look, schema)
        if block + 1 < blocks:
            out = staged(out, "benchmark-hits")
    return out


def _cut_hits(batches, text: str, remove: bool):
    """n_words, n_hit and, if wanted, the text without the words that are hit."""
    for batch in batches:
        words = scan(batch.column(text), LETTERS_DIGITS, lower=True)
        data, _ = buffers(batch.column(text))
        n_hit, texts = [], []
        old = batch.column(text).to_pylist() if remove else []
        for i, runs in enumerate(batch.column("_runs").to_pylist()):
            n_hit.append(sum(r["stop"] - r["start"] for r in runs))
            if remove:
                texts.append(_without(words, i, [(r["start"], r["stop"]) for r in runs], old[i]) if runs else old[i])
        at = batch.schema.get_field_index(text)
        out = batch.set_column(at, text, pa.array(texts, pa.string())) if remove else batch.drop_columns([text])
        yield replaced(out, {"n_words": pa.array(np.diff(words.first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64())})


def _without(words: Words, row: int, runs: list[tuple[int, int]], text: str) -> str:
    """The text less each run of hit words, from its first word's start to its last word's end."""
    raw, first = text.encode(), int(words.first[row])
    offset = int(words.start[first]) - _lead(raw)
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at : int(words.start[first + a]) - offset])
        at = int(words.end[first + b - 1]) - offset
    return b"".join([*out, raw[at:]]).decode()


def _lead(raw: bytes) -> int:
    return int(np.flatnonzero(LETTERS_DIGITS[np.frombuffer(raw, np.uint8)])[0])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """docs, a row each, with n_words, n_hit, n_items and items_sha256; text loses the spans that are hit."""
    return _finished(docs, items, size, text, True)


def report(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """As decontaminate, without the text."""
    return _finished(docs, items, size, text, False)


def _finished(docs: DataFrame, items: DataFrame, size: int, text: str, remove: bool) -> DataFrame:
    found = scan_items(without(docs, COUNTS | NAMED, text), items, size, text)
    counted = found.mapInArrow(lambda b: _cut_hits(b, text, remove), with_columns(found if remove else found.drop(text), COUNTS))
    return counted.withColumns({"n_items": F.size("_items").cast("long"), "items_sha256": F.sha2(F.array_join("_items", ",").cast("binary"), 256)}).drop(*FOUND)
