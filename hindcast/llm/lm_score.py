"""LM scoring: context-tree weighting over bytes, beside a smoothed word-count score.

A text ends with an end symbol (byte 255, which UTF-8 never has). Each byte is predicted from the DEPTH bytes before it in
the text, white space included (before the first byte stand end symbols), as eight binary decisions down a tree of bit
prefixes. At every context and bit prefix a Krichevsky-Trofimov estimator holds
the counts of training bytes; a context's prediction is the mixture of its own estimate and that of the next longer
context, weighted by how well either coded the training bytes (the weights of context-tree weighting, in closed form from
the counts). So all depths are mixed, and the score is a proper probability of the whole text, end included.

Scale: texts are stored in batches of some 32 MB. Each batch asks once for each of its distinct symbols (context and byte)
and words, with their training counts, as packed rows; no count is left out. Questions meet by a hash of the whole symbol, so
a context that is everywhere is spread over all cells; there every symbol's counts are summed over the batches, and go on,
once each, to the shard of all symbols that share their last two context bytes, whose subtree is built there. A shard so grows
with the distinct symbols behind its pairs, not with the batches. Of it only sums per last byte and bit prefix, 2**16 rows at most
at any size, reach the driver, which mixes depths 0 and 1 and hands them back. Shards give each symbol's value to its cell, cells
answer the batches, and batches meet their answers once: rows are shuffled per distinct symbol of a batch, not per position.

Defined results: a null or empty text is the end symbol alone. A row without doc_id is scored, its id taken as an empty text
when held out rows are chosen. Rows that repeat are returned as often. Without any training row every count is 0. Words are
told apart by 64-bit hashes. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import documents, stored
from hindcast.llm._words import LOWER, Words, long_column, mix, slices, texts

DEPTH = 5
END = 255
#: Bytes of text in a batch, and bytes of text that a shard is made for.
BATCH = 32 << 20
SHARD = 32 << 20
#: Bytes of text whose symbols are held at once, some 50 bytes each.
SLICE = 2 << 20
#: Depths below this one are mixed in the driver: at most 256 contexts of 255 bit prefixes.
TOP = 2


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2, by Stirling's series after shifting x up."""
    x, shift = x.astype(np.float64), np.zeros(len(x))
    for _ in range(8):
        shift += np.log(x)
        x = x + 1
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - shift


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 2 * 0.5723649429247001 - _log_gamma(zeros + ones + 1.0)


def _nodes(symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary counts of (context, bit prefix): key = context << 8 | prefix, a prefix being led by a one bit."""
    keys, zeros, ones = [], [], []
    byte, context = symbols & np.uint64(0xFF), symbols >> np.uint64(8) << np.uint64(8)
    for bit in range(8):
        prefix = (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
        key, back = np.unique(context | prefix, return_inverse=True)
        one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
        keys.append(key), zeros.append(np.bincount(back, weights=np.where(one, 0, n), minlength=len(key))), ones.append(np.bincount(back, weights=np.where(one, n, 0), minlength=len(key)))
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def _symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """context << 8 | byte at each position of the lower-cased texts with their end symbols, and where each text begins."""
    data, bounds = np.insert(LOWER[data], at[1:], END), at + np.arange(len(at))
    out = data.astype(np.uint64)
    for depth in range(1, DEPTH + 1):
        before = np.full(len(data), END, np.uint64)
        before[depth:] = data[:-depth]
        for j in range(depth):
            early = bounds[:-1] + j
            before[early[early < bounds[1:]]] = END
        out |= before << np.uint64(8 * depth)
    return out, bounds


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the number of each value among them."""
    found = pa.array(values).dictionary_encode()
    key = found.dictionary.to_numpy()
    order = np.argsort(key)
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    return key[order], place[found.indices.to_numpy()]


def _sum(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate([np.zeros(0), *n]), minlength=len(key))


def _pack(values: np.ndarray) -> bytes:
    """Eight-byte numbers, first bytes first: small ones are mostly zeros in a row, which files and shuffles compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(packed: pa.Scalar, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed.as_buffer(), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _keys(packed: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the batch; numbers are fixed once the table is stored."""
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = texts(batch.column("text"))[1] + done
        done = int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, long_column((part << 32) + at[:-1] // BATCH)], [*batch.schema.names, "batch"])


def _split(key: np.ndarray, by: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted keys and their values by the group that each belongs to, packed."""
    order = np.argsort(by, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(by[order]) != 0, True]) if len(key) else np.zeros(1, int)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = order[low:high]
        yield int(by[mine[0]]), _pack(np.diff(key[mine], prepend=np.uint64(0))), _pack(values[mine])


def _cell(key: np.ndarray, cells: int) -> np.ndarray:
    """Where all batches' questions about a symbol or word meet: by all its bytes, so no context is hot."""
    return (mix(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(cells)).astype(np.int64)


def _pair(key: np.ndarray, shards: int) -> np.ndarray:
    """Where the symbols meet that share their last TOP context bytes."""
    return (mix(key >> np.uint64(8) & np.uint64((1 << 8 * TOP) - 1)) % np.uint64(shards)).astype(np.int64)


def _asked(cells: int):
    """Of each batch, its distinct symbols (kind 0) and words (kind 1) by cell, with their counts in training texts."""

    def rows(number: int, parts: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        out = []
        for kind in (0, 1):
            key, n = _sum(*zip(*parts[kind], strict=True))
            out += [(number, kind, *x) for x in _split(key, _cell(key, cells), n.astype(np.uint64))]
        names = ["batch", "kind", "cell", "keys", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, ([], [])
        for batch in batches:
            number = batch.column("batch").to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
            edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
            for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if now is not None and number[first] != now:
                    yield from rows(now, parts)
                    parts = ([], [])
                now = int(number[first])
                data, at = texts(batch.column("text").slice(first, last - first))
                for low, high in slices(at, SLICE):
                    part, inside, taught = data[at[low] : at[high]], at[low : high + 1] - at[low], train[first + low : first + high]
                    symbols, bounds = _symbols(part, inside)
                    key, back = _distinct(symbols)
                    parts[0].append((key, np.bincount(back, weights=np.repeat(taught, np.diff(bounds)), minlength=len(key))))
                    words = Words(LOWER[part], inside)
                    key, back = _distinct(words.hashes())
                    parts[1].append((key, np.bincount(back, weights=taught[words.text_of()], minlength=len(key))))
        if now is not None:
            yield from rows(now, parts)

    return task


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def _weighted(zeros: np.ndarray, ones: np.ndarray, rest: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes whose children's code lengths sum to rest: weighted code length, prediction of a one bit, own weight."""
    own = _estimate(zeros, ones)
    total = own if rest is None else np.logaddexp(own, rest) - np.log(2)
    weight = np.ones(len(own)) if rest is None else np.exp(np.minimum(own - np.log(2) - total, 0.0))
    return total, (ones + 0.5) / (zeros + ones + 1.0), weight


def _parents(depth: int, key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums over nodes of this depth by their parents' keys."""
    key, back = np.unique(key & np.uint64((1 << 8 * depth) - 1), return_inverse=True)
    return key, [np.bincount(back, weights=x, minlength=len(key)) for x in sums]


def _subtree(symbols: np.ndarray, n: np.ndarray) -> tuple[list[Level], tuple[np.ndarray, list[np.ndarray]]]:
    """Levels of depths TOP to DEPTH over a shard's training symbols, and what their parents need: key; zeros, ones, rest."""
    symbols, n = symbols[n > 0], n[n > 0]
    levels, rest = [], None
    for depth in range(DEPTH, TOP - 1, -1):
        short, back = np.unique(symbols & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        key, zeros, ones = _nodes(short, np.bincount(back, weights=n, minlength=len(short)))
        total, p, weight = _weighted(zeros, ones, rest)
        levels.insert(0, (key, p, weight))
        up = _parents(depth, key, zeros, ones, total)
        rest = up[1][2]
    return levels, up


def _top(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, rest: np.ndarray) -> list[Level]:
    levels = []
    for depth in range(TOP - 1, -1, -1):
        total, p, weight = _weighted(zeros, ones, rest)
        levels.insert(0, (key, p, weight))
        key, (zeros, ones, rest) = _parents(depth, key, zeros, ones, total)
    return levels


def _log10(levels: list[Level], symbols: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol's byte after its context: each depth shares out what the shorter ones left to it."""
    total = np.zeros(len(symbols))
    byte = symbols & np.uint64(0xFF)
    for bit in range(8):
        prefix = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
        p, done, left = np.full(len(symbols), 0.5), np.zeros(len(symbols)), np.ones(len(symbols))
        for depth, (key, own, weight) in enumerate(levels):
            if not len(key):
                break
            wanted = (symbols & np.uint64((1 << 8 * (depth + 1)) - 1)) >> np.uint64(8) << np.uint64(8) | prefix
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            known = np.flatnonzero(key[at] == wanted)
            at = at[known]
            p[known] = done[known] + left[known] * own[at]
            done[known] += left[known] * weight[at] * own[at]
            left[known] *= 1 - weight[at]
        total += np.log10(np.where(byte >> np.uint64(7 - bit) & np.uint64(1) == 1, p, 1 - p))
    return total


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys of some rows, and the sums of their counts."""
    return _sum([_keys(x) for x in table["keys"]], [_unpack(x) for x in table["n"]])


def _merged(shards: int):
    """A cell's symbols, each once, with their training counts over all batches, by shard; of words only the sums (shard -1)."""

    def task(table: pa.Table) -> pa.Table:
        key, n = _met(table)
        if table["kind"][0].as_py():
            rows = [(-1, b"", b"", int(n.sum()), int((n > 0).sum()))]
        else:
            rows = [(*x, 0, 0) for x in _split(key, _pair(key, shards), n.astype(np.uint64))]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "keys", "n", "tokens", "distinct"])

    return task


def _sums(table: pa.Table) -> pa.Table:
    """What the driver needs of a shard: sums by last context byte and bit prefix."""
    _, (key, sums) = _subtree(*_met(table))
    return pa.table([long_column(key), *map(pa.array, sums)], ["key", "zeros", "ones", "rest"])


def _values(top: list[Level], cells: int):
    """The log10 probability of each symbol of a shard, by the cell that asks for it."""

    def task(table: pa.Table) -> pa.Table:
        key, n = _met(table)
        # Values are exact to 2**-25, so their last bytes are zeros.
        value = np.round(_log10([*top, *_subtree(key, n)[0]], key) * 2**24) / 2**24
        rows = zip(*_split(key, _cell(key, cells), value), strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "keys", "found"])

    return task


def _answers(asked: pa.Table, values: pa.Table) -> pa.Table:
    """Each batch's questions of one kind and cell with what was found: log10 probabilities of symbols, counts of words."""
    if not asked.num_rows:
        return asked.select(["batch", "kind", "keys"]).append_column("found", pa.array([], pa.binary()))
    if asked["kind"][0].as_py():
        key, value = _met(asked)
    else:
        key, value = np.concatenate([_keys(x) for x in values["keys"]]), np.concatenate([_unpack(x, np.float64) for x in values["found"]])
        order = np.argsort(key)
        key, value = key[order], value[order]
    found = [_pack(value[np.searchsorted(key, _keys(x))]) for x in asked["keys"]]
    return pa.table([asked["batch"], asked["kind"], asked["keys"], pa.array(found, pa.binary())], ["batch", "kind", "keys", "found"])


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Of each text: its bytes and words, how many words are known, the sum of log10 (count + 1), and its log10 probability."""
    values = []
    for kind in (0, 1):
        mine = answers.filter(pa.array(answers["kind"].to_numpy() == kind))
        key = np.concatenate([np.zeros(0, np.uint64), *(_keys(x) for x in mine["keys"])])
        order = np.argsort(key)
        values.append((key[order], np.concatenate([np.zeros(0), *(_unpack(x, np.float64) for x in mine["found"])])[order]))

    def looked_up(kind: int, wanted: np.ndarray) -> np.ndarray:
        if not len(wanted):
            return np.zeros(0)
        (key, value), (distinct, back) = values[kind], _distinct(wanted)
        at = np.minimum(np.searchsorted(key, distinct), len(key) - 1)
        if not np.array_equal(key[at], distinct):
            raise ValueError("a batch lacks answers")
        return value[at][back]

    data, at = texts(docs["text"])
    parts = []
    for low, high in slices(at, SLICE):
        part, inside = data[at[low] : at[high]], at[low : high + 1] - at[low]
        symbols, bounds = _symbols(part, inside)
        score = np.add.reduceat(looked_up(0, symbols), bounds[:-1])
        words = Words(LOWER[part], inside)
        c, text, n = looked_up(1, words.hashes()), words.text_of(), high - low
        parts.append((np.diff(inside), np.diff(words.first), np.bincount(text, weights=c > 0, minlength=n), np.bincount(text, weights=np.log10(c + 1), minlength=n), score))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([docs["doc_id"], *(pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "bytes", "n_words", "known", "base", "score"])


def lm_score(df: DataFrame, is_training: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte."""
    docs = documents(df, id_col=id_col, text_col=text_col).withColumn("train", F.coalesce(is_training(F.col("doc_id")), F.lit(False)))
    docs = stored(docs.mapInArrow(_in_batches, "doc_id long, text string, train boolean, batch long"), "texts", "zstd")
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.when(F.col("train"), 1))).first()
    shards = 1 + size // SHARD
    asked = stored(docs.select("batch", "text", "train").mapInArrow(_asked(shards), "batch long, kind int, cell long, keys binary, n binary"), "asked", "zstd")
    merged = asked.select("kind", "cell", "keys", "n").repartition(2 * shards, "kind", "cell").groupBy("kind", "cell").applyInArrow(_merged(shards), "shard long, keys binary, n binary, tokens long, distinct long")
    merged = stored(merged, "symbols", "zstd")
    words = merged.where("shard < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = words[0] + ends, words[1] + (ends > 0)
    by_shard = merged.where("shard >= 0").select("shard", "keys", "n").repartition(shards, "shard").groupBy("shard")
    sums = by_shard.applyInArrow(_sums, "key long, zeros double, ones double, rest double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "rest"))).orderBy("key").toArrow()
    key, *of = (sums[c].to_numpy() for c in sums.column_names)
    top = _top(key.view(np.uint64), *of)
    values = by_shard.applyInArrow(_values(top, shards), "cell long, keys binary, found binary").withColumn("kind", F.lit(0))
    answers = asked.groupBy("kind", "cell").cogroup(values.groupBy("kind", "cell")).applyInArrow(_answers, "batch long, kind int, keys binary, found binary")
    met = docs.select("batch", "doc_id", "text").groupBy("batch").cogroup(answers.groupBy("batch"))
    rows = met.applyInArrow(_scored, "doc_id long, bytes long, n_words long, known long, base double, score double")
    n_tokens = F.col("n_words") + 1
    return rows.select(
        "doc_id", n_tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(ends + 1.0))) - n_tokens * F.lit(float(np.log10(tokens + distinct + 1.0)))).alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
