"""Operator 3, byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern; each piece ("pre-token") is merged on its own. Merging keeps the
pieces' parts in a linked list and files every adjacent pair that has a rank in that rank's bucket, by position. A
bitmap of three levels of 64-bit words marks the ranks whose bucket isn't empty; find-first-set on each level gives
the lowest one, so the next merge costs a few steps at any length, and a pre-token of n bytes O(n log n).
A bucket's positions are a heap, because equal ranks merge from the left; entries whose pair has changed meanwhile
are skipped when they come up.

Cases: null and empty texts have no ids; equal rows and copies are encoded alike; the vocabulary has no special
tokens, so their strings are ordinary text; an empty table gives an empty result; other columns pass through, but
columns that have the names of the new ones (ids, decoded) are replaced. A text is held whole by a task.
"""

from __future__ import annotations

import base64
import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .batches import replaced, with_columns, without

#: Distinct pre-tokens, of at most LONGEST_KEPT characters, whose ids a task keeps; beyond, it starts anew.
KEPT, LONGEST_KEPT = 100_000, 64

#: Characters of texts that a task splits at once, if not one text has more, and of those whose new pre-tokens are
#: merged together, so that a step of the queue has many positions.
GROUP_CHARS, MERGED_CHARS = 250_000, 1_000_000

#: Positions of a bucket that are worked off one by one.
FEW = 60

#: Fixed value: the pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary file's tokens and ranks; about 50,000 lines, read by Spark."""
    lines = spark.read.text(path if "://" in path else f"file://{path}")
    return {base64.b64decode(t): int(r) for t, r in (row.value.split() for row in lines.collect() if row.value.strip())}


class RankQueue:
    """Buckets of positions by rank. Bit r of the lowest level is set while bucket r holds positions; a bit of a level above while its word below isn't 0."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.groups: dict[int, int] = {}
        self.top = 0

    def open(self, rank: int) -> list[int]:
        """A new bucket."""
        word, group = rank >> 6, rank >> 12
        self.words[word] = self.words.get(word, 0) | 1 << (rank & 63)
        self.groups[group] = self.groups.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group
        bucket = self.buckets[rank] = []
        return bucket

    def close(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        del self.buckets[rank]
        self.words[word] ^= 1 << (rank & 63)
        if not self.words[word]:
            self.groups[group] ^= 1 << (word & 63)
            if not self.groups[group]:
                self.top ^= 1 << group

    def lowest(self) -> int:
        """By find-first-set from the top level down; only while top isn't 0."""
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.words[word]
        return word << 6 | (bits & -bits).bit_length() - 1


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank that two adjacent tokens a, b merge into, by a << 20 | b: every way to cut a token into two."""
    return {x << 20 | y: r for t, r in ranks.items() for i in range(1, len(t)) if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None}


class Pairs:
    """Ranks of adjacent tokens for whole arrays of them; -1: none. of_bytes: those of two bytes, by a << 8 | b."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = pair_ranks(ranks)
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.of_bytes = self(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    def __call__(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before, the first included."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def merge(data: np.ndarray, ends: np.ndarray, ranks: dict[bytes, int], pairs: Pairs, pair_dict: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pre-tokens data[ends[k-1]:ends[k]], one after the other, and where each one's ids end.

    All pre-tokens share one linked list and one queue; no pair reaches over a pre-token's end. A step takes the
    lowest rank of all. A bucket of few positions is worked off one by one, from the left; of a larger one the
    leftmost valid position of each pre-token is taken at once, and the others wait in the bucket. Within a pre-token
    both are the order of one merge at a time.
    """
    byte, first_pairs = pairs.byte, pairs.of_bytes
    n = len(data)
    token, piece = byte[data], np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1
    # The rank of the pair that starts at each position; a bucket's entry is stale if this is another one by now. Pairs
    # of a position only grow, so it is never filed twice in a bucket.
    filed = np.full(n, -1, np.int64)
    filed[:-1] = first_pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
    filed[ends - 1] = -1
    # The same memory, for single positions.
    tokens, afters, befores, ranked = memoryview(token), memoryview(after), memoryview(before), memoryview(filed)
    queue, get = RankQueue(), pair_dict.get
    buckets = queue.buckets

    def push(position: np.ndarray) -> None:
        key = np.sort(filed[position] << 32 | position)
        key = key[np.searchsorted(key, 0) :]
        rank = key >> 32
        edges = np.flatnonzero(changes(rank))
        position = (key & 0xFFFFFFFF).tolist()
        for r, a, b in zip(rank[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(position)]):
            bucket = buckets.get(r)
            (queue.open(r) if bucket is None else bucket).extend(position[a:b])

    push(np.arange(n))
    while queue.top:
        rank = queue.lowest()
        bucket = buckets[rank]
        if len(bucket) <= FEW:
            queue.close(rank)
            bucket.sort()
            for at, i in enumerate(bucket):
                if ranked[i] != rank:
                    continue
                j = afters[i]
                k = afters[i] = afters[j]
                tokens[i], tokens[j], ranked[i], ranked[j] = rank, -1, -1, -1
                lower = False
                if k >= 0:
                    befores[k] = i
                    if (r := get(rank << 20 | tokens[k])) is not None:
                        ranked[i] = r
                        (queue.open(r) if (own := buckets.get(r)) is None else own).append(i)
                        lower = r < rank
                if (h := befores[i]) >= 0:
                    if (r := get(tokens[h] << 20 | rank)) is not None:
                        ranked[h] = r
                        (queue.open(r) if (own := buckets.get(r)) is None else own).append(h)
                        lower |= r < rank
                    else:
                        ranked[h] = -1
                if lower and at + 1 < len(bucket):
                    # What is left waits for the lower rank.
                    queue.open(rank).extend(bucket[at + 1 :])
                    break
            continue
        i = np.sort(np.array(bucket))
        i = i[filed[i] == rank]
        first = changes(piece[i])
        if first.all():
            queue.close(rank)
        else:
            bucket[:] = i[~first].tolist()
            i = i[first]
        if not len(i):
            continue
        j = after[i]
        k = after[i] = after[j]
        token[i], token[j], filed[i], filed[j] = rank, -1, -1, -1
        h = before[i]
        right, left = k >= 0, h >= 0
        k, i, h = k[right], i[right], h[left]
        before[k] = i
        filed[i], filed[h] = pairs(rank, token[k]), pairs(token[h], rank)
        push(np.concatenate([i, h]))
    kept = token >= 0
    return token[kept].astype(np.int32), np.cumsum(kept)[ends - 1]


def merge_long(piece: bytes, ranks: dict[bytes, int], pairs: dict[int, int]) -> list[int]:
    """The ids of one long pre-token: as merge, one position at a time, in buckets that are heaps."""
    token = [ranks[piece[i : i + 1]] for i in range(len(piece))]
    after, before = [*range(1, len(token)), -1], list(range(-1, len(token) - 1))
    queue, get = RankQueue(), pairs.get
    buckets = queue.buckets

    def push(rank: int, position: int) -> None:
        bucket = buckets.get(rank)
        heappush(queue.open(rank) if bucket is None else bucket, position)

    for i in range(len(token) - 1):
        if (r := get(token[i] << 20 | token[i + 1])) is not None:
            push(r, i)
    while queue.top:
        rank = queue.lowest()
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            queue.close(rank)
        j = after[i]
        if j < 0 or token[i] < 0 or get(token[i] << 20 | token[j]) != rank:
            continue
        k = after[i] = after[j]
        token[i], token[j] = rank, -1
        if k >= 0:
            before[k] = i
            if (r := get(rank << 20 | token[k])) is not None:
                push(r, i)
        if (h := before[i]) >= 0 and (r := get(token[h] << 20 | rank)) is not None:
            push(r, h)
    return [t for t in token if t >= 0]


SPACE, LETTER, NUMBER, OTHER = range(4)


def char_classes() -> np.ndarray:
    """The class of every code point, as the regex library has it."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end()))
            out[a:b] = kind
    return out


def cuts(chars: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of PATTERN start in texts laid end to end (rows: where each text starts); the same as
    its matches in each text: runs of letters, numbers or others with one space before; "'s" and its like; the
    rest of a run of white space, less a last character that isn't at the text's end."""
    n = len(chars)
    kind = classes[chars]
    fresh = np.zeros(n + 1, bool)
    fresh[rows] = fresh[n] = True
    starts = fresh.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(starts[:n])
    stop = np.append(run[1:], n)
    # Runs of white space that another run of the same text follows.
    lead = (kind[run] == SPACE) & ~fresh[stop]
    last = stop[lead] - 1
    starts[last] = True
    starts[last[chars[last] == 32] + 1] = False
    # A lone apostrophe that begins a pre-token, before letters.
    quote = run[(chars[run] == 39) & (stop - run == 1) & ~fresh[stop]]
    quote = quote[starts[quote] & (kind[quote + 1] == LETTER)]
    after = np.append(chars, [0, 0])
    one = np.isin(after[quote + 1], [ord(c) for c in "stmd"])
    inside = ~fresh[np.minimum(quote + 2, n)]
    two = inside & np.isin(after[quote + 1] * 0x110000 + after[quote + 2], [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
    for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
        starts[at + 1] = False
        starts[at + size] = True
    return np.flatnonzero(starts[:n])


class Coder:
    """Encodes groups of texts; ids of pre-tokens are kept from group to group. And decodes ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.pairs, self.pair_dict = ranks, Pairs(ranks), pair_ranks(ranks)
        self.classes, self.kept = char_classes(), {}
        by_rank = {r: t for t, r in ranks.items()}
        tokens = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
        self.edges, self.bytes = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), np.frombuffer(b"".join(tokens), np.uint8)

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Keeps the int32 ids of pre-tokens that aren't kept yet; gives those of long ones back instead."""
        new, long = [], {}
        for p in pieces:
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.kept[p] = np.int32(whole).tobytes()
            elif len(p) > LONGEST_KEPT:
                long[p] = np.array(merge_long(b, self.ranks, self.pair_dict), np.int32).tobytes()
            else:
                new.append((p, b))
        if new:
            ids, ends = merge(np.frombuffer(b"".join(b for _, b in new), np.uint8), np.cumsum([len(b) for _, b in new]), self.ranks, self.pairs, self.pair_dict)
            raw = ids.tobytes()
            self.kept.update((p, raw[4 * a : 4 * b]) for (p, _), a, b in zip(new, [0, *ends.tolist()], ends.tolist()))
        return long

    def split(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The texts' pre-tokens, one after the other, and how many there are up to the end of each text."""
        joined = "".join(t or "" for t in texts)
        sizes = np.array([len(t or "") for t in texts])
        if not joined:
            return [], np.zeros(len(texts), np.int64)
        at = cuts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), (np.cumsum(sizes) - sizes)[sizes > 0], self.classes)
        edges = at.tolist()
        return [joined[a:b] for a, b in zip(edges, [*edges[1:], len(joined)])], np.searchsorted(at, np.cumsum(sizes))

    def encode(self, groups: list[list[str | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each group of texts, their ids, one after the other, and where each text's ids end. Pre-tokens are told
        apart by their characters, and those of all groups that are new are merged together."""
        split = [self.split(g) for g in groups]
        if len(self.kept) >= KEPT:
            # Those of the groups at hand stay.
            self.kept = {p: ids for pieces, _ in split for p in set(pieces) if (ids := self.kept.get(p)) is not None}
        kept = self.kept
        long = self.learn({p for pieces, _ in split for p in pieces if p not in kept})
        out = []
        for pieces, rows in split:
            ids = [kept[p] if p in kept else long[p] for p in pieces] if long else list(map(kept.__getitem__, pieces))
            ends = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, out=ends[1:])
            out.append((np.frombuffer(b"".join(ids), np.int32), ends[rows]))
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each text's ids."""
        size = self.edges[ids + 1] - self.edges[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.repeat(self.edges[ids] - stop[:-1], size) + np.arange(stop[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(stop[np.append(0, ends)]), pa.py_buffer(data)]).cast(pa.binary())


_coders: dict[int, Coder] = {}


def _coder(sent, name: int) -> Coder:
    # A worker's later tasks use the coder again, but not the ids it has kept.
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(sent.value)
    return _coders[name]


def _groups(batches, text: str):
    """Pieces of batches whose texts have GROUP_CHARS characters together, or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_CHARS, side="right")))
            yield batch.slice(at, stop - at), int(sizes[stop - 1] - (sizes[at - 1] if at else 0))
            at = stop


def _encode(batches, text: str, sent, name: int, new: tuple[str, ...]):
    coder, held, chars = _coder(sent, name), [], 0

    def done():
        for group, (ids, ends) in zip(held, coder.encode([g.column(text).to_pylist() for g in held])):
            columns = {"ids": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))}
            if "decoded" in new:
                columns["decoded"] = coder.decode(ids, ends)
            yield replaced(group, columns)
        held.clear()

    for group, size in _groups(batches, text):
        held.append(group)
        chars += size
        if chars >= MERGED_CHARS:
            yield from done()
            chars = 0
    if held:
        yield from done()
    # Workers outlive the stage, and so would this.
    coder.kept = {}


def _sent(spark: SparkSession, path: str):
    ranks = load_ranks(spark, path)
    return spark.sparkContext.broadcast(ranks), zlib.crc32(b"".join(b"%d %b" % (r, t) for t, r in ranks.items()))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", and_decode: bool = False) -> DataFrame:
    """docs with ids array<int>; and_decode: also decoded binary, what the ids decode to, in the same pass. Columns of
    these names are replaced. pattern: only PATTERN is known."""
    if pattern != PATTERN:
        raise ValueError(f"pre-tokens of another pattern than {PATTERN}")
    sent, name = _sent(docs.sparkSession, path)
    new = {"ids": "array<int>", "decoded": "binary"} if and_decode else {"ids": "array<int>"}
    docs = without(docs, new, text)
    return docs.mapInArrow(lambda b: _encode(b, text, sent, name, tuple(new)), with_columns(docs, new))


def _decode(batches, sent, name: int):
    coder = _coder(sent, name)
    for batch in batches:
        column = pc.fill_null(batch.column("ids"), [])
        ends = np.asarray(column.offsets).astype(np.int64)
        yield replaced(batch, {"decoded": coder.decode(column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends[1:] - ends[0])})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded, with a column ids, with decoded binary, the ids' bytes (null ids: none); a column of this name is replaced."""
    sent, name = _sent(encoded.sparkSession, path)
    encoded = without(encoded, {"decoded": "binary"}, "ids")
    return encoded.mapInArrow(lambda b: _decode(b, sent, name), with_columns(encoded, {"decoded": "binary"}))
