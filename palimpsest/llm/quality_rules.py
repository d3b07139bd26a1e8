"""Operator 5, quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a document as content or boilerplate; Viterbi decoding
gives the best sequence, and the share of words in content lines decides whether the document is kept. The field is
fitted here on at most FIT_DOCS labelled documents. Only documents have labels, so those of lines are hidden: they
begin with the document's own, but lines that repeat an earlier one or consist of symbols are boilerplate in good
documents too, and plain sentences are content in bad ones too. Then gradient ascent on the conditional likelihood and
decoding take turns, and a document's decoded lines have to agree with its label: content words are at least
LEAST_CONTENT of a good one's and fewer of a bad one's. The weight of a change of label is free.

Base rules come first: too few words, or most words in repeated 3-word windows, fail whatever the lines say.

Cases: null and empty texts have no words and fail; equal rows and copies are judged alike; of labelled rows that
share a doc_id the least text counts, and of its labels the lowest; with no labelled documents the field has
DEFAULT_WEIGHTS; an empty table gives an empty result; other columns pass through, but columns that have the names of
the new ones are replaced. A text is held whole by a task, some forty times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import replaced, with_columns, without
from .words import NOT_SPACE, U64, buffers, mix, scan

#: Labelled documents that the field is fitted on, the lowest by hash of doc_id.
FIT_DOCS = 1000

MIN_WORDS, MOST_REPEATED, LEAST_CONTENT = 50, 50, 0.5

#: The symbols that base rules count.
SYMBOLS = "#*$%&|<>"

FEATURES = ["bias", "symbols", "many symbols", "one word", "long words", "capitals", "digits", "marks", "repeated word", "seen before", "no sentence end", "short", "long"]

#: Log-odds of boilerplate by feature, and of a change of label from line to line, without labelled documents.
DEFAULT_WEIGHTS = np.array([-2.0, 1.5, 3.0, 0.0, 0.5, 2.0, 0.5, 2.0, 3.0, 1.0, 0.2, 0.2, -1.0])
DEFAULT_CHANGE = -1.0

_IS_SYMBOL, _IS_UPPER, _IS_LOWER, _IS_DIGIT, _IS_MARK = (np.isin(np.arange(256), [ord(c) for c in chars]) for chars in (SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?^~=_{}[]\\/"))


class Lines:
    """Lines with a word, of all texts of a column: row, word numbers, features; and base counts by row."""

    def __init__(self, column) -> None:
        data, offsets = buffers(column)
        words, n = scan(column), len(offsets) - 1
        self.n_rows, n_words = n, len(words.key)
        heads = (data & 0xC0) != 0x80
        inside = NOT_SPACE[data]

        def per_word(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return total[words.end] - total[words.start]

        def per_row(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return total[offsets[1:]] - total[offsets[:-1]]

        self.n_words, self.word_chars, self.n_symbols = np.diff(words.first), per_row(heads & inside), per_row(_IS_SYMBOL[data])
        # Words in 3-word windows found twice or more in their own text.
        at, h = words.windows(3)
        h = mix(h + words.doc[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        again = np.zeros(n_words + 3, bool)
        found = at[counts[inverse] > 1] if len(at) else at
        for i in range(3):
            again[found + i] = True
        again = again[:n_words]
        self.n_repeat_words = np.bincount(words.doc[again], minlength=n)
        # A line's number, over all rows: line ends and rows before it.
        line_of = np.concatenate([[0], np.cumsum(data == 10)])[words.start] + words.doc
        first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if n_words else np.zeros(0, np.int64)
        self.first, self.last = first, np.append(first[1:], n_words)
        self.row = words.doc[first]
        # Whole lines, white space included, by hash: equal to an earlier one of the row?
        feeds = np.flatnonzero(data == 10)
        ends = np.unique(np.concatenate([feeds, offsets[1:]]))
        # A line starts after the line feed before it, or where its row does.
        starts = np.maximum(offsets[self.row], np.append(-1, feeds)[np.searchsorted(feeds, words.start[first])] + 1) if n_words else first
        stops = ends[np.searchsorted(ends, words.end[self.last - 1])] if n_words else first
        raw, seen, self.duplicate = data.tobytes(), set(), np.zeros(len(first), bool)
        row = -1
        for i, (r, a, b) in enumerate(zip(self.row.tolist(), starts.tolist(), stops.tolist())):
            if r != row:
                row, seen = r, set()
            line = raw[a:b]
            self.duplicate[i] = line in seen
            seen.add(line)
        self.n_dup_lines = np.bincount(self.row[self.duplicate], minlength=n)
        self.sizes = self.last - self.first
        sums = lambda x: np.add.reduceat(x, first) if n_words else np.zeros(0)
        chars, symbols, upper, lower, digits, marks = (sums(per_word(m)) for m in (heads, _IS_SYMBOL[data], _IS_UPPER[data], _IS_LOWER[data], _IS_DIGIT[data], _IS_MARK[data]))
        share = symbols / np.maximum(self.sizes, 1)
        same = np.zeros(n_words, bool)
        same[1:] = (words.key[1:] == words.key[:-1]) & (words.doc[1:] == words.doc[:-1])
        final = data[words.end[self.last - 1] - 1] if n_words else np.zeros(0, np.uint8)
        self.x = np.stack([np.ones(len(first)), share > 0.02, share > 0.5, self.sizes == 1, chars > 12 * self.sizes, upper > 2 * lower, digits > 0.3 * chars, marks > 0.5 * self.sizes, sums(same) > 0.3 * self.sizes, self.duplicate, ~np.isin(final, [ord(c) for c in ".!?:;"]), self.sizes < 5, self.sizes >= 20], axis=1).astype(float) if len(first) else np.zeros((0, len(FEATURES)))


def viterbi(score: np.ndarray, change: float) -> np.ndarray:
    """The best labels of one sequence of lines; score: log-odds of label 1 for each line."""
    best, back = (0.0, 0.0), []
    for s in score.tolist():
        stay0, stay1 = best[0] >= best[1] + change, best[1] >= best[0] + change
        back.append((0 if stay0 else 1, 1 if stay1 else 0))
        best = (best[0] if stay0 else best[1] + change), (best[1] if stay1 else best[0] + change) + s
    label, out = int(best[1] > best[0]), []
    for b in reversed(back):
        out.append(label)
        label = b[label]
    return np.array(out[::-1], bool)


def seeds(lines: Lines, bad: np.ndarray) -> np.ndarray:
    """Labels of lines that are plain whatever their document is (bad: of each line's document): 1 boilerplate, 0 content, -1 unknown."""
    x = {n: lines.x[:, i] > 0 for i, n in enumerate(FEATURES)}
    odd = x["many symbols"] | x["seen before"] | x["repeated word"]
    plain = ~(odd | x["symbols"] | x["marks"] | x["no sentence end"] | x["short"] | x["capitals"] | x["digits"])
    return np.where(~bad & odd, 1, np.where(bad & plain, 0, -1))


def agreeing(score: np.ndarray, change: float, sizes: np.ndarray, bad: bool) -> np.ndarray:
    """The best labels of a document's lines of which the share of content agrees with the document's label: by the
    least shift of all scores, found by halving."""
    enough = lambda y: sizes[~y].sum() >= LEAST_CONTENT * sizes.sum()
    best = viterbi(score, change)
    if enough(best) != bad:
        return best
    low, high = 0.0, 64.0
    for _ in range(12):
        middle = (low + high) / 2
        found = viterbi(score + (middle if bad else -middle), change)
        low, high = (low, middle) if enough(found) != bad else (middle, high)
    return viterbi(score + (high if bad else -high), change)


#: Turns of fitting and decoding, and the score of a line whose label is plain.
TURNS, PLAIN = 3, 30.0


def fit(texts: list[str], bad: list[bool], steps: int = 60, rate: float = 1.0, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the features and of a change, from documents with labels of their own only."""
    lines = Lines(pa.array(texts, pa.string()))
    of_doc = np.array(bad)[lines.row]
    plain = seeds(lines, of_doc)
    y = np.where(plain >= 0, plain, of_doc).astype(int)
    edges = np.searchsorted(lines.row, np.arange(len(texts) + 1))
    weights, change = np.zeros(len(FEATURES)), 0.0
    for turn in range(TURNS):
        weights, change = ascend(lines, y, weights, change, steps, rate, ridge)
        if turn + 1 < TURNS:
            score = lines.x @ weights + np.where(plain >= 0, PLAIN * (2 * plain - 1), 0)
            for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                if b > a:
                    y[a:b] = agreeing(score[a:b], change, lines.sizes[a:b], bad[i])
    return weights, change


def ascend(lines: Lines, y: np.ndarray, weights: np.ndarray, change: float, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights of the greatest conditional likelihood of labels y, by gradient ascent over all sequences at once."""
    starts = np.flatnonzero(np.concatenate([[True], lines.row[1:] != lines.row[:-1]]))
    sizes = np.diff(np.append(starts, len(y)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    pairs = np.flatnonzero(lines.row[1:] == lines.row[:-1])
    changed = (y[pairs] != y[pairs + 1]).sum()
    speed = np.zeros(len(FEATURES) + 1)
    for _ in range(steps):
        score = lines.x @ weights
        forward, backward = np.zeros((len(y), 2)), np.zeros((len(y), 2))
        forward[starts, 1] = score[starts]
        step = np.array([[0, change], [change, 0]])
        # All sequences advance together, longest first; a step handles those that are that long.
        for t in range(1, int(sizes[0])):
            i = starts[: np.searchsorted(-sizes, -t)] + t
            forward[i] = np.logaddexp.reduce(forward[i - 1][:, :, None] + step, axis=1)
            forward[i, 1] += score[i]
        for t in range(int(sizes[0]) - 1, 0, -1):
            i = starts[: np.searchsorted(-sizes, -t)] + t
            own = backward[i].copy()
            own[:, 1] += score[i]
            backward[i - 1] = np.logaddexp.reduce(step + own[:, None, :], axis=2)
        both = forward + backward
        norm = np.logaddexp.reduce(both, axis=1)
        p = np.exp(both[:, 1] - norm)
        own = backward[pairs + 1].copy()
        own[:, 1] += score[pairs + 1]
        cross = np.exp(forward[pairs, 0] + change + own[:, 1] - norm[pairs]) + np.exp(forward[pairs, 1] + change + own[:, 0] - norm[pairs])
        gradient = np.append(lines.x.T @ (y - p), changed - cross.sum()) / len(y) - ridge * np.append(weights, change)
        speed = 0.9 * speed + gradient
        weights, change = weights + rate * speed[:-1], float(change + rate * speed[-1])
    return weights, change


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The field, from the FIT_DOCS labelled documents that are first by hash of doc_id."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    # At most FIT_DOCS rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    rows = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    if len({r.quality for r in rows}) < 2:
        return DEFAULT_WEIGHTS, DEFAULT_CHANGE
    return fit([r.text for r in rows], [r.quality == 0 for r in rows])


OUT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "content_share": "double", "kept": "boolean"}

ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

#: Bytes of texts whose lines a task holds at once, if not one text has more.
GROUP_BYTES = 2 << 20


def _judge(batches, weights: np.ndarray, change: float, text: str):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = buffers(column)
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, side="right")) - 1)
            lines = Lines(column.slice(at, stop - at))
            score = lines.x @ weights
            content = np.zeros(lines.n_rows, np.int64)
            edges = np.searchsorted(lines.row, np.arange(lines.n_rows + 1))
            for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                content[i] = lines.sizes[a:b][~viterbi(score[a:b], change)].sum()
            failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MOST_REPEATED * lines.n_words)
            share = content / np.maximum(lines.n_words, 1)
            values = (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, share, ~failed & (share >= LEAST_CONTENT))
            yield replaced(batch.slice(at, stop - at), {n: pa.array(v, ARROW[t]) for (n, t), v in zip(OUT.items(), values)})
            at = stop


def judge(docs: DataFrame, labels: DataFrame | None = None, field: tuple[np.ndarray, float] | None = None, text: str = "text") -> DataFrame:
    """docs with OUT's columns added; field, or else labels (doc_id, quality) of docs to fit one."""
    weights, change = field or (fitted(docs, labels) if labels is not None else (DEFAULT_WEIGHTS, DEFAULT_CHANGE))
    docs = without(docs, OUT, text)
    return docs.mapInArrow(lambda b: _judge(b, weights, change, text), with_columns(docs, OUT))
