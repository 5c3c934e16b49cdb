"""Fill-in-middle: each text is cut at two unit boundaries and its three parts are dealt out anew behind sentinels.

Units are lines, their line feed included. A text's UTF-8 bytes are divided into fixed blocks; a Fenwick tree over the blocks
stores how many units end in them and how many code points begin in them. The cut behind the u-th unit is found by a
binary-lifting descent, which sums code points on its way, to the block that holds that unit's end; there the bytes are
looked through. All texts of a slice of the batch share their numpy arrays, a row of the descent for each cut.

Where a text is cut, and into which form it goes, hangs on the SHA-256 of seed and id alone (see `fill_in_middle`), so rows
can be worked at anywhere, in any order and again. Nothing is shuffled; memory is a few times a slice of SLICE bytes, or one text.

Defined results: a null text counts as empty, an empty text or one that holds a sentinel stays plain, so that every output
can be undone (`restored`). A null id counts as the empty string in the hash. Repeated rows are returned as often and equal;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import documents
from hindcast.llm._words import portions, slices, texts

#: Bytes of a block.
BLOCK = 256
#: Bytes of text that are worked at together.
SLICE = 2 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = "n long, form string, prefix_chars long, middle_chars long, output string"


class Fenwick:
    """Trees of many texts, one behind the other: node i of a text sums its blocks i - lowbit(i) + 1 .. i (from 1)."""

    def __init__(self, counts: np.ndarray, first: np.ndarray):
        """counts: a value of each block (columns: what is counted); first: of each text, its first block, and one past the last."""
        self.first, self.size = first[:-1], np.diff(first)
        total = np.zeros((len(counts) + 1, counts.shape[1]), np.int64)
        np.cumsum(counts, axis=0, out=total[1:])
        i = np.arange(1, len(counts) + 1) - np.repeat(self.first, self.size)  # number within the text
        below = np.arange(1, len(counts) + 1) - (i & -i)
        self.nodes = total[1:] - total[below]

    def descend(self, text: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each (text, rank >= 1): the block (from 0, within the text) where the first count reaches rank, what of rank is left for
        it, and the second count before it."""
        at, left, other = np.zeros(len(text), np.int64), rank.astype(np.int64), np.zeros(len(text), np.int64)
        step = 1 << int(self.size.max(initial=1)).bit_length()
        while step:
            to = at + step
            rows = np.flatnonzero(to <= self.size[text])
            node = self.nodes[self.first[text[rows]] + to[rows] - 1]
            go = node[:, 0] < left[rows]
            rows, node = rows[go], node[go]
            at[rows] += step
            left[rows] -= node[:, 0]
            other[rows] += node[:, 1]
            step >>= 1
        return at, left, other


class Lines:
    """The lines of texts, found through trees over blocks."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, size = data, at, np.diff(at)
        blocks = -(-size // BLOCK)
        first = np.r_[0, np.cumsum(blocks)]
        number = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
        self.begin = np.repeat(at[:-1], blocks) + number * BLOCK
        ends, points = (np.r_[0, np.cumsum(x)] for x in (data == 0x0A, (data & 0xC0) != 0x80))
        edge = np.minimum(self.begin + BLOCK, np.repeat(at[1:], blocks))
        self.points = points[at[1:]] - points[at[:-1]]
        whole = ends[at[1:]] - ends[at[:-1]]
        self.n = whole + ((size > 0) & (data[np.maximum(at[1:] - 1, 0)] != 0x0A) if len(data) else np.zeros(len(size), bool))
        self.tree = Fenwick(np.stack([ends[edge] - ends[self.begin], points[edge] - points[self.begin]], 1), first)

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, bytes and code points in its first `units` units."""
        size = np.diff(self.at)
        inner = np.flatnonzero((units > 0) & (units < self.n))
        places, points = np.where(units > 0, size, 0), np.where(units > 0, self.points, 0)
        block, left, before = self.tree.descend(inner, units[inner])
        start = self.begin[self.tree.first[inner] + block] if len(inner) else inner
        window = start[:, None] + np.arange(BLOCK)
        inside = window < self.at[inner + 1][:, None]
        byte = np.where(inside, self.data[np.minimum(window, max(len(self.data) - 1, 0))], 0) if len(inner) else np.zeros((0, BLOCK), np.uint8)
        at = np.argmax(np.cumsum(byte == 0x0A, axis=1) == left[:, None], axis=1) if len(inner) else inner
        leads = np.cumsum(inside & ((byte & 0xC0) != 0x80), axis=1)
        places[inner] = start + at + 1 - self.at[inner]
        points[inner] = before + leads[np.arange(len(inner)), at]
        return places, points


def _task(sentinels: tuple[str, str, str], rate: int, spm_rate: int):
    p, s, m = (x.encode() for x in sentinels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2000):
            data, at = texts(batch.column("text"))
            h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
            for low, high in slices(at, SLICE):
                part, cut = data[at[low] : at[high]], at[low : high + 1] - at[low]
                lines, (h1, h2, h3, h4) = Lines(part, cut), (x[low:high] for x in h)
                one, two = h1 % (lines.n + 1), h2 % (lines.n + 1)
                (a, a_points), (b, b_points) = lines.cut(np.minimum(one, two)), lines.cut(np.maximum(one, two))
                raw, form, output = part.tobytes(), [], []
                for i, (x, y, begin, end) in enumerate(zip(a.tolist(), b.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    text = raw[begin:end]
                    if not text or h3[i] % 100 >= rate or p in text or s in text or m in text:
                        form.append("plain"), output.append(text)
                    elif h4[i] % 100 < spm_rate:
                        form.append("spm"), output.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
                    else:
                        form.append("psm"), output.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
                plain = np.array([f == "plain" for f in form], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(lines.n), pa.array(form, pa.string()), pa.array(a_points, mask=plain), pa.array(b_points - a_points, mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return task


def fill_in_middle(df: DataFrame, seed: str = "7", rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (null if plain), output.

    h1 to h4 are the first groups of eight hex digits of the SHA-256 of "seed:id". The prefix ends behind the smaller of h1 % (n + 1)
    and h2 % (n + 1) lines, the middle behind the larger. `rate` per cent of texts are transformed (h3), `spm_rate` of these put the
    suffix first (h4); sentinels are those of prefix, suffix and middle, which must differ and not overlap each other.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    docs = documents(df, id_col=id_col, text_col=text_col)
    groups = (F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4))
    return docs.select("doc_id", "text", *groups).mapInArrow(_task(sentinels, rate, spm_rate), f"doc_id long, {FORMS}")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of, from output and form alone."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
