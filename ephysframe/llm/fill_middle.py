"""Fill-in-middle transformation with SWAR words.

A text's UTF-8 bytes are read as 64-bit words. A byte ends a unit (a code
point) if the next byte is no continuation byte; these bytes are marked by
arithmetic on whole words and counted by one population count a word. The byte
where a unit ends is found by a search in the words' cumulative counts and a
select inside the word. Cuts are drawn from a digest of the document's id, so
a lost task makes the same output again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import slices
from .common import id_string, text_or_empty

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: of texts that are transformed, and of those the share in the order suffix, prefix, middle.
CUT_RATE, SPM_RATE = 90, 20
DRAWS = ("h1", "h2", "h3", "h4")

#: The lowest bit, and all bits but the lowest, of each byte of a word.
LOW = np.uint64(0x0101010101010101)
TOP = np.uint64(0x8080808080808080)


class Units:
    """Ends of the units of adjacent texts: counts up to a byte, and the byte where a unit ends."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        n = len(body)
        self.size = n
        room = np.zeros((n // 8 + 2) * 8, np.uint8)
        room[:n] = body
        word = room.view("<u8")
        # a byte starts a unit unless its two top bits are 10
        start = (~word >> np.uint64(7) | word >> np.uint64(6)) & LOW
        end = start >> np.uint64(8)
        end[:-1] |= start[1:] << np.uint64(56)
        marks = end.view(np.uint8)
        marks[n:] = 0
        filled = offsets[1:] > offsets[:-1]
        marks[offsets[1:][filled] - 1] = 1  # no unit reaches into the next text
        self.end = end
        self.before = np.zeros(len(end) + 1, np.int64)
        np.cumsum(np.bitwise_count(end), out=self.before[1:])

    def count(self, byte: np.ndarray) -> np.ndarray:
        """Units that end before a byte."""
        word, inside = byte >> 3, (byte & 7).astype(np.uint64)
        mask = (np.uint64(1) << (inside * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.end[word] & mask)

    def after(self, unit: np.ndarray) -> np.ndarray:
        """The byte after the unit of a number, counted from 1 over all texts; 0 for unit 0."""
        if not self.size:
            return np.zeros(len(unit), np.int64)
        word = np.maximum(np.searchsorted(self.before, unit, "left") - 1, 0)
        rank = (unit - self.before[word]).astype(np.uint64)
        # byte i of the product counts the ends among bytes 0 to i; those with fewer than the rank lie before the wanted byte
        sums = self.end[word] * LOW
        fewer = (((rank * LOW) | TOP) - sums - LOW) & TOP
        return np.where(unit > 0, word * 8 + np.bitwise_count(fewer) + 1, 0)


def _transform(marks: tuple[str, str, str], rate: int, spm: int):
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [batch.column(h).to_numpy() for h in DRAWS]
            for first, last, body, offsets in slices(batch.column("text")):
                units = Units(body, offsets)
                h1, h2, h3, h4 = (h[first:last] for h in draws)
                base = units.count(offsets[:-1])
                n = units.count(offsets[1:]) - base
                one, two = h1 % (n + 1), h2 % (n + 1)
                low, high = np.minimum(one, two), np.maximum(one, two)
                at, to = (np.maximum(units.after(base + k), offsets[:-1]) for k in (low, high))
                data = body.tobytes()
                cut = (h3 % 100 < rate) & (n > 0)
                back = h4 % 100 < spm
                form, out = [], []
                for a, x, y, b, c, r in zip(offsets[:-1].tolist(), at.tolist(), to.tolist(), offsets[1:].tolist(), cut.tolist(), back.tolist()):
                    text = data[a:b]
                    if not c or p in text or s in text or m in text:
                        form.append("plain")
                        out.append(text)
                    elif r:
                        form.append("spm")
                        out.append(b"".join((s, data[y:b], p, data[a:x], m, data[x:y])))
                    else:
                        form.append("psm")
                        out.append(b"".join((p, data[a:x], s, data[y:b], m, data[x:y])))
                form = np.array(form, object)
                plain = form == "plain"
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, last - first), pa.array(n), pa.array(form, pa.string()),
                    pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).view(pa.string()),
                ], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, rate: int = CUT_RATE, spm: int = SPM_RATE,
              marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of each row of ``docs``, in one pass without a shuffle.

    ``n`` counts code points. Prefix and middle end after the smaller and the
    larger of two cuts drawn from the sha256 of seed and id, so rows of one id
    share their draws (a null id draws as ``null``) and repeated rows stay
    repeated. A null or empty text, and one that holds a mark, is ``plain``:
    its output is the text, its lengths are null. A text is handled whole,
    however long; one text is held at a time beyond a slice's size. Columns
    of other names are left out.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), id_string(doc_id)), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(h) for k, h in enumerate(DRAWS)]
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"), *draws)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_transform(marks, rate, spm), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output and its form were made of.

    A transformed text holds no mark, and no mark can begin inside another, so
    an output splits at its three marks and nowhere else.
    """
    part = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    return (F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
            .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1))))
            .otherwise(output))
