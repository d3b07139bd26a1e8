"""Operator 11, fill-in-middle transformation by rotation of blocks in place.

A text is cut into prefix, middle and suffix at token borders. Its bytes and the sentinels are written once into a
bytearray, in the order prefix, middle, suffix; two neighbouring blocks then change places by three reversals (each
block, then both together), piece by piece inside the buffer, so that no second copy of a text is made. Form `psm`
swaps middle and suffix, `spm` swaps prefix and middle with suffix. `restored` reads the sentinels of an output, does
the rotation that undoes it and closes the gaps.

Tokens are runs of ASCII letters and single other characters; they are counted on the UTF-8 bytes of a whole batch.
Where to cut, and which form, comes from a hash of the document's key, in DataFrame functions.

Cases: null counts as the empty text, which stays plain, as do texts that hold a sentinel; a null key hashes as the
text "null"; equal rows are cut alike; an empty table gives an empty result; extra columns pass through, but columns
that have the names of the new ones are replaced. A text is held whole by a task, its output in the same buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import replaced, with_columns, without
from .words import buffers

#: The sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Bytes that a reversal moves at once, and bytes of texts in an outgoing batch, about.
STEP, OUT_BYTES = 1 << 16, 4 << 20

#: What is added: tokens, form, code points of prefix and middle (null where plain), the output, and the text again.
NEW = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "restored": "string"}

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from a SHA-256 of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def reverse(view: np.ndarray, start: int, stop: int) -> None:
    """view[start:stop] backwards, by swapping pieces from both ends."""
    while stop - start > 1:
        step = min(STEP, (stop - start) // 2)
        left = view[start : start + step][::-1].copy()
        view[start : start + step] = view[stop - step : stop][::-1]
        view[stop - step : stop] = left
        start, stop = start + step, stop - step


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """The blocks [start, middle) and [middle, stop) change places."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, middle)
    reverse(view, middle, stop)
    reverse(view, start, stop)


def transformed(text: bytes, a: int, b: int, form: str) -> bytearray:
    """The text cut at bytes a and b, in its form."""
    out = bytearray(len(text) + 9)
    out[:3], out[3 : a + 3] = PREFIX, text[:a]
    out[a + 3 : a + 6], out[a + 6 : b + 6] = MIDDLE, text[a:b]
    out[b + 6 : b + 9], out[b + 9 :] = SUFFIX, text[b:]
    rotate(out, a + 3 if form == "psm" else 0, b + 6, len(out))
    return out


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return bytes(output)
    out = bytearray(output)
    middle = out.index(MIDDLE)
    if form == "psm":
        at = out.index(SUFFIX)
        rotate(out, at, middle, len(out))
        at, suffix = at, at + len(out) - middle
    else:
        at = out.index(PREFIX)
        suffix = len(out) - at
        rotate(out, 0, at, len(out))
        at = middle - at
    # Now prefix, middle at `at`, suffix at `suffix`, each behind its sentinel.
    del out[suffix : suffix + 3], out[at : at + 3], out[:3]
    return bytes(out)


def _cuts(column: pa.Array, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: number of tokens, the bytes at which it is cut, and the code points of prefix and middle."""
    data, offsets = buffers(column)
    letter, first = _LETTER[data], (data & 0xC0) != 0x80
    joined = np.zeros(len(data), bool)
    joined[1:] = letter[1:] & letter[:-1]
    joined[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(first & ~joined)
    at = np.searchsorted(starts, offsets)
    n = np.diff(at)
    low, high = (np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)) if len(n) else (n, n)
    ends = np.append(starts, len(data))
    # A cut behind the last token is the row's end, which may lie before the next row's first token.
    place = lambda k: np.where(k == n, offsets[1:], ends[at[:-1] + np.minimum(k, np.maximum(n - 1, 0))])
    a, b = place(low), place(high)
    points = np.concatenate([[0], np.cumsum(first)])
    return n, a - offsets[:-1], b - offsets[:-1], points[a] - points[offsets[:-1]], points[b] - points[a]


def _forms(h: list[np.ndarray], rate: int, spm: int) -> np.ndarray:
    return np.where(h[2] % 100 >= rate, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))


def _groups(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about OUT_BYTES of texts."""
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + OUT_BYTES, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """docs with NEW's columns: rate in a hundred texts are cut, and spm in a hundred of these get the form spm."""
    kept = without(docs, NEW, key, text)
    names = [f"_draw_{i}" for i in range(4)]

    def run(batches):
        for whole in batches:
            for batch in _groups(whole, text):
                h = [batch.column(c).to_numpy() for c in names]
                n, a, b, before, inside = _cuts(batch.column(text), h)
                forms, out, back = _forms(h, rate, spm).tolist(), [], []
                data, offsets = buffers(batch.column(text))
                for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    raw = data[x:y].tobytes()
                    if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw:
                        forms[i] = "plain"
                    out.append(raw if forms[i] == "plain" else bytes(transformed(raw, int(a[i]), int(b[i]), forms[i])))
                    back.append(restored(out[-1], forms[i]))
                plain = np.array([f == "plain" for f in forms], bool)
                yield replaced(batch.drop_columns(names), {
                    "n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(before, pa.int64(), mask=plain), "middle_chars": pa.array(inside, pa.int64(), mask=plain),
                    "output": pa.array(out, pa.binary()).view(pa.string()), "restored": pa.array(back, pa.binary()).view(pa.string()),
                })

    return kept.withColumns(dict(zip(names, draws(F.col(key), seed)))).mapInArrow(run, with_columns(kept, NEW))
