"""Fill-in-middle: texts cut at two places into prefix, middle and suffix, and put in another order.

Cuts fall between units (lines or code points) and are chosen by a hash of the id, so a
retried task gives the same text.  Work is on the UTF-8 bytes of a whole batch: only the places
and excess bytes of its multibyte characters are recorded, and ``searchsorted`` in them turns
byte cuts into code points and back; spans of ASCII are plain subtraction.

Null is an empty text; empty texts and texts that hold a sentinel stay plain (``n`` still counts
their units, ``prefix_chars`` and ``middle_chars`` are null).  A null id hashes as an empty one;
rows of equal ids are cut by the same hashes, each in its own text.  Other columns are not read,
so their names can't clash.  Each row is its own: no shuffle, and memory is that of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .words import pieces_of

#: What stands before prefix, suffix and middle: fixed values of the contract.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
PIECE_CHARS = 4_000_000


@dataclass
class Exceptions:
    """The multibyte characters of a UTF-8 buffer: byte place, place in code points, and excess bytes up to each."""

    byte_at: np.ndarray
    char_at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))]).astype(np.int64)
        return cls(at, at - excess[:-1], excess)

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut."""
        return cuts - self.excess[np.searchsorted(self.byte_at, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each cut in code points."""
        return cuts + self.excess[np.searchsorted(self.char_at, cuts)]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins, with the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def cut_places(data: np.ndarray, bounds: np.ndarray, unit: str, first, second) -> tuple[np.ndarray, np.ndarray, np.ndarray, Exceptions]:
    """Each text's number of units, and the byte places of two cuts after ``first % (n + 1)`` and ``second % (n + 1)`` units, the smaller first."""
    index = Exceptions.of(data)
    if unit == "char":
        begin = index.chars(bounds)
        n = np.diff(begin)
        place = lambda k: index.bytes(begin[:-1] + k)
    else:
        ends = np.flatnonzero(data == 0x0A) + 1
        before = np.searchsorted(ends, bounds, side="right")  # a line end belongs to the text that it is in
        whole = np.diff(before)
        last = np.maximum(bounds[1:] - 1, 0)
        rest = (bounds[1:] > bounds[:-1]) & (data[last] != 0x0A if len(data) else False)
        n = whole + rest
        ends = np.append(ends, 0)
        place = lambda k: np.where(k == 0, bounds[:-1], np.where(k <= whole, ends[np.minimum(before[:-1] + k - 1, len(ends) - 1)], bounds[1:]))
    x, y = first % (n + 1), second % (n + 1)
    return n, place(np.minimum(x, y)), place(np.maximum(x, y)), index


def _transform(unit: str, rate: int, spm: int, sentinels: tuple[str, str, str]):
    marks = [s.encode() for s in sentinels]

    def one(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = _buffer(rows.column("text"))
        h1, h2, h3, h4 = (rows.column(c).to_numpy() for c in ("h1", "h2", "h3", "h4"))
        n, a, b, index = cut_places(data, bounds, unit, h1, h2)
        texts = rows.column("text")
        plain = (h3 % 100 >= rate) | (np.diff(bounds) == 0)
        for s in sentinels:
            plain |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        chars = index.chars(np.stack([bounds[:-1], a, b]))
        raw, p, s, m = data.tobytes(), *marks
        out = []
        for i, (begin, x, y, end) in enumerate(zip(bounds[:-1].tolist(), a.tolist(), b.tolist(), bounds[1:].tolist())):
            if plain[i]:
                out.append(raw[begin:end])
            elif h4[i] % 100 < spm:
                out.append(b"".join((s, raw[y:end], p, raw[begin:x], m, raw[x:y])))
            else:
                out.append(b"".join((p, raw[begin:x], s, raw[y:end], m, raw[x:y])))
        form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
        columns = [rows.column("id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(chars[1] - chars[0], pa.int64(), mask=plain), pa.array(chars[2] - chars[1], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches):
        for batch in batches:
            for rows in pieces_of(batch, "text", PIECE_CHARS):
                yield one(rows)

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text in prefix-suffix-middle or suffix-prefix-middle order.

    ``rate`` of a hundred texts are changed, ``spm`` of a hundred of those begin with the suffix;
    ``unit`` is ``line`` or ``char``."""
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    if not all(sentinels) or any(x.endswith(y[:k]) for x in sentinels for y in sentinels for k in range(1, len(y) + (x != y))):
        raise ValueError("sentinels must not run into each other")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *hashes)
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_transform(unit, rate, spm, sentinels), f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    text = lambda *order: F.concat(*(F.get(parts, F.lit(k)) for k in order))
    return F.when(form == "psm", text(1, 3, 2)).when(form == "spm", text(2, 3, 1)).otherwise(output)
