"""Substring dedup: remove every word covered by a run of `window` words that also starts earlier in the corpus.

Level-wise doubling. Runs of window/2 words that occur twice or more anywhere are the first level's survivors; only runs
of `window` words that hold a surviving half are hashed and compared at the second level. Doubling ends there, for the
answer depends on runs of `window` words alone. A run of `window` words holds window/2+1 halves; its leftmost half of
smallest hash stands for it, so equal runs agree on the half, and about a sixth of all halves need to be counted.

Scale: both levels shuffle (hash, document, position) rows, never texts. Each task first settles what repeats among its
own batch of documents and sends one row per distinct hash, so a passage that a third of all documents hold costs one
row per batch. Texts are shuffled by document once; the answers of both levels meet them there.

Equality of halves is by 64-bit hash (a collision only lets a candidate through to the second level), equality of runs by
128 bits of two independent hashes.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a null or empty text has none. "Earlier" is a smaller doc_id, or the same
doc_id and an earlier start. Rows that repeat a doc_id start at the same places: none of them is earlier than another, and
all lose the words that any of them loses. A row without doc_id is returned whole and compared with nothing. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._shared import documents
from hindcast.llm._words import Words, long_column, runs, slices, texts

_ROWS = "key long, pos int, doc_id long, packed binary"


def _rows(key: np.ndarray, pos: np.ndarray, doc: np.ndarray, packs: list[tuple[int, bytes]], mark: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows to compare everywhere, and behind them one row per document of what its own batch has settled.

    Rows go out in the order of their documents and in few columns, for shuffle files compress them better so.
    """
    ids, order = np.array([d for d, _ in packs], np.int64), np.lexsort((pos, doc))
    columns = [
        pa.concat_arrays([long_column(key[order]), long_column(ids * 0x9E3779B1)]),
        pa.concat_arrays([pa.array(pos[order].astype(np.int32)), pa.nulls(len(ids), pa.int32())]),
        pa.concat_arrays([pa.array(doc[order].astype(np.int64)), pa.array(ids)]),
        pa.concat_arrays([pa.nulls(len(key), pa.binary()), pa.array([p for _, p in packs], pa.binary())]),
    ]
    names = ["key", "pos", "doc_id", "packed"]
    if mark is not None:
        columns, names = [*columns, pa.concat_arrays([long_column(mark[order]), pa.nulls(len(ids), pa.int64())])], [*names, "mark"]
    return pa.RecordBatch.from_arrays(columns, names)


def _by_document(doc: np.ndarray, pos: np.ndarray) -> list[tuple[int, bytes]]:
    if not len(doc):
        return []
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]).tolist()
    return [(int(doc[a]), pos[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True)]


def _halves(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each half; the runs that lie within one text; for each of those, where its half of smallest hash starts."""
    half = window // 2
    hashed, runs_at = runs(h, half), np.flatnonzero(words.inside(window))
    best, where = hashed[runs_at], runs_at.copy()
    for j in range(1, window - half + 1):
        other = hashed[runs_at + j]
        less = other < best
        best, where = np.where(less, other, best), np.where(less, runs_at + j, where)
    return hashed, runs_at, where


def first_level(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = texts(batch.column("text"))
            keys, docs, starts = [], [], []
            for low, high in slices(at):
                words = Words(data[at[low] : at[high]], at[low : high + 1] - at[low])
                if len(words) < window:
                    continue
                hashed, _, where = _halves(words, words.hashes(), window)
                chosen = np.unique(where)
                text = words.text_of()[chosen]
                keys.append(hashed[chosen]), docs.append(ids[low + text]), starts.append(chosen - words.first[text])
            if not keys:
                continue
            key, doc, pos = np.concatenate(keys), np.concatenate(docs), np.concatenate(starts)
            found, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            here = n[back] > 1
            # What repeats in this batch is known to be a survivor; its first place is sent for the other batches' sake.
            yield _rows(found, np.where(n > 1, -1, pos[first]), doc[first], _by_document(doc[here], pos[here]))

    return task


def _known(batch: pa.RecordBatch, i: int) -> np.ndarray:
    one, many = batch.column("single")[i].as_py(), batch.column("packs")[i].as_py()
    parts = [np.array([p for p in one or [] if p >= 0], np.int32), *(np.frombuffer(p, np.int32) for p in many or [])]
    return np.concatenate(parts)


def second_level(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.or_(batch.column("single").is_valid(), batch.column("packs").is_valid()))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = texts(batch.column("text"))
            keys, marks, docs, starts = [], [], [], []
            for low, high in slices(at):
                words = Words(data[at[low] : at[high]], at[low : high + 1] - at[low])
                if len(words) < window:
                    continue
                h = words.hashes()
                _, runs_at, where = _halves(words, h, window)
                alive = np.zeros(len(words) + 1, bool)
                for i in range(low, high):
                    known = _known(batch, i)
                    begin, end = words.first[i - low], words.first[i - low + 1]
                    alive[begin + known[known < end - begin]] = True
                chosen = runs_at[alive[where]]
                text = words.text_of()[chosen]
                keys.append(runs(h, window)[chosen]), marks.append(runs(words.hashes(1), window, 1)[chosen])
                docs.append(ids[low + text]), starts.append(chosen - words.first[text])
            if not keys:
                continue
            key, mark, doc, pos = map(np.concatenate, (keys, marks, docs, starts))
            order = np.lexsort((pos, doc, mark, key))
            key, mark, doc, pos = key[order], mark[order], doc[order], pos[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])] if len(key) else np.zeros(0, bool)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, int)
            later = (doc != doc[lead]) | (pos != pos[lead])
            yield _rows(key[new], pos[new], doc[new], _by_document(doc[later], pos[later]), mark[new])

    return task


def _keep(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            single, packs = batch.column("single"), batch.column("packs")
            for i, text in enumerate(batch.column("text")):
                words = text.as_py().encode().split()
                counts.append(len(words))
                if not single[i].is_valid and not packs[i].is_valid:
                    gone.append(0), kept.append(b" ".join(words))
                    continue
                known = _known(batch, i)
                edge = np.zeros(len(words) + window + 1, np.int32)
                np.add.at(edge, known[known < len(words)], 1)
                np.add.at(edge, known[known < len(words)] + window, -1)
                covered = np.cumsum(edge)[: len(words)] > 0
                gone.append(int(covered.sum()))
                kept.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c))
            carried = [c for c in ("carried",) if c in batch.schema.names]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carried], ["doc_id", "n_words", "n_removed", "kept_text", *carried])

    return task


def substring_dedup(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space).

    carry: columns of the input to return beside these, as fields of a column `carried`.
    """
    if window < 2 or window % 2:
        raise ValueError("window is an even number of words")
    docs = documents(df, *([F.struct(*carry).alias("carried")] if carry else []), id_col=id_col, text_col=text_col)
    place = F.struct("doc_id", "pos")

    def met(rows: DataFrame) -> DataFrame:
        """Every document with what is known of it. Both levels read the same shuffle of texts: no filter may differ."""
        return docs.join(rows.groupBy("doc_id").agg(F.collect_list("pos").alias("single"), F.collect_list("packed").alias("packs")), "doc_id", "left")

    halves = docs.select("doc_id", "text").mapInArrow(first_level(window), _ROWS).repartition("key")
    per_key = Window.partitionBy("key")
    alive = halves.withColumn("n", F.count(F.lit(1)).over(per_key)).withColumn("least", F.min("pos").over(per_key))
    alive = alive.where("n > 1 OR least < 0 OR packed IS NOT NULL").where("packed IS NOT NULL OR pos >= 0")
    whole = met(alive.select("doc_id", "pos", "packed")).mapInArrow(second_level(window), _ROWS + ", mark long").repartition("key")
    later = whole.withColumn("first", F.min(place).over(Window.partitionBy("key", "mark"))).where(F.col("packed").isNotNull() | (place > F.col("first")))
    kinds = "doc_id long, n_words long, n_removed long, kept_text string"
    return met(later).mapInArrow(_keep(window), kinds + (f", carried {docs.schema['carried'].dataType.simpleString()}" if carry else ""))
