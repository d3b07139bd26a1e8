"""Operator 9, language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 lower-cased letters, with word edges) weighted by TF-IDF: share of the
text's n-grams times inverse document frequency, which is counted over all learning documents. The model is trained
with follow-the-regularised-leader (proximal, with L1 and L2 penalties, so most weights are 0) on at most FIT_DOCS
documents, and its scores are calibrated with one temperature, fitted on documents left out of training.

Cases: null texts and those without a letter are "und" with score 0; equal rows and copies get equal results; ties
go to the first language by name; with nothing to learn from all texts are "und"; of learning rows that share a doc_id the
least text counts, with its least language; an empty table gives an empty result; other columns pass through, but
columns named lang_pred or score are replaced. A text is held whole by a task, some fifty times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import replaced, with_columns, without
from .words import buffers

#: Documents that the model is trained on, the lowest by hash of doc_id; the last fifth calibrates.
FIT_DOCS = 3000

BITS, ORDERS = 15, 3

#: Characters of texts whose n-grams a task holds at once, if not one text has more.
GROUP_CHARS = 500_000

SCALE = 30.0


def in_fold(doc_id: Column) -> Column:
    """The third that is held out: CRC-32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_tables: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """The lower-case letter of every code point; 0 for those that are no letters."""
    if not _tables:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables.append(out)
    return _tables[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts, one after the other, and where each text's begin (n+1)."""
    # An edge before each text, after it, and for each run of other characters.
    chars = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t or "") + 2 for t in texts])
    letters = lower_letters()[chars]
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0
    keep[np.cumsum(sizes) - sizes] = True
    letters, row = letters[keep].astype(np.uint64), row[keep]
    found, rows = [], []
    h = letters
    for order in range(1, ORDERS + 1):
        if order > 1:
            h = h[:-1] * np.uint64(0x1000193) + letters[order - 1 :]
        same = (row[: len(h)] == row[order - 1 :]) & ((letters[: len(h)] > 0) | (order > 1))
        found.append(((h[same] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[: len(h)][same])
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))


def _groups(batch: pa.RecordBatch, text: str):
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_CHARS, side="right")) - 1)
        yield at, stop, column[at:stop].to_pylist()
        at = stop


def _document_frequency(batches):
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, _, texts in _groups(batch, "text"):
            f, first = grams(texts)
            pairs = np.sort(np.repeat(np.arange(len(texts)), np.diff(first)) << BITS | f)
            if len(pairs):
                total += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] & ((1 << BITS) - 1), minlength=1 << BITS)
            n += len(texts)
    found = np.flatnonzero(total)
    if n:
        yield pa.record_batch([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["gram", "n"])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.languages, self.weights, self.bias, self.temperature = languages, weights.astype(np.float32), bias, temperature

    def scores(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds by row and language; weights already hold the inverse document frequencies."""
        total = np.zeros((len(f) + 1, len(self.languages)))
        np.cumsum(self.weights[f], axis=0, out=total[1:], dtype=np.float64)
        return SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None] + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 2) -> Model:
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    k, size = len(languages), (1 << BITS) + 1
    z, n = np.zeros((size, k)), np.zeros((size, k))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rows = []
    for t in texts:
        f, _ = grams([t])
        at, count = np.unique(f, return_counts=True)
        rows.append((np.append(at, size - 1), np.append(SCALE * count / max(1, len(f)) * idf[at], 1.0)))
    used = max(1, len(rows) - len(rows) // 5)
    for _ in range(epochs):
        for (at, x), label in zip(rows[:used], y[:used].tolist()):
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    held = np.array([x @ w[at] for at, x in rows[used:]]) if len(rows) > used else np.zeros((0, k))
    temperature = min(np.geomspace(0.05, 20, 121).tolist(), key=lambda t: -np.log(np.maximum(softmax(held / t)[np.arange(len(held)), y[used:]], 1e-12)).sum() + 1e-9 * abs(np.log(t)))
    return Model(languages, w[:-1] * idf[:, None], w[-1], temperature)


def fitted(docs: DataFrame) -> Model | None:
    """The model, from text and lang of the documents that aren't held out."""
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = {r.gram: r.n for r in learn.select("text").mapInArrow(_document_frequency, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return None
    df = np.zeros(1 << BITS)
    for gram, n in counts.items():
        if gram >= 0:
            df[gram] = n
    idf = np.where(df > 0, np.log((1 + counts[-1]) / (1 + df)) + 1, 0.0)
    # Ids only are sorted; then at most FIT_DOCS texts are fetched.
    chosen = learn.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    rows = learn.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("least")).select("doc_id", "least.*", F.xxhash64("doc_id").alias("h")).collect()
    rows.sort(key=lambda r: (r.h, r.doc_id))
    return train([r.text for r in rows], [r.lang for r in rows], idf)


def _predict(batches, model: Model | None, text: str):
    for batch in batches:
        for at, stop, texts in _groups(batch, text):
            langs, best = np.full(stop - at, "und", object), np.zeros(stop - at)
            if model:
                f, first = grams(texts)
                p = softmax(model.scores(f, first) / model.temperature)
                found, got = np.diff(first) > 0, p.argmax(axis=1)
                letters = np.add.reduceat(lower_letters()[np.frombuffer(" ".join(["", *(t or "" for t in texts)]).encode("utf-32-le"), np.uint32)] > 0, np.cumsum([0, *(len(t or "") + 1 for t in texts[:-1])])) > 0
                found &= letters
                langs[found] = np.array(model.languages, object)[got[found]]
                best[found] = p.max(axis=1)[found]
            yield replaced(batch.slice(at, stop - at), {"lang_pred": pa.array(langs.tolist(), pa.string()), "score": pa.array(best)})


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred": "string", "score": "double"}
    docs = without(docs, new, text)
    return docs.mapInArrow(lambda b: _predict(b, sent.value, text), with_columns(docs, new))
