"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (letters, digits and non-ASCII characters, A-Z lowered) hashed to 2^11 places, with weights
1 + ln(count) scaled to a small length, and an indicator for the bin of each structure statistic: lengths, shares of kinds of
bytes, shares of repeated neighbours and of distinct words, words a line, and metadata columns such as n_chars. Bins are
logarithmic and fixed. The machine's log-odds are

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the last sum, over all pairs, is found in linear time as 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Fitting is pyspark.ml's, over a stored table of features: at most `max_train` labelled documents, chosen by hash of the id,
all of them where there are fewer. That bounds the broadcast table of labels and the fit; each step sums gradients on the
executors. The machine has a fixed size (about 0.1 MB), goes out with the task, and scores every text whole, where it lies.

Defined results: a null or empty text has the statistics of an empty text and is scored by them. Null labels count as absent,
several of one doc_id as the largest; of documents that share a doc_id one is learnt from, the smallest by features. Without training rows
the score is 0.5; where all have one label it is that label's smoothed share. Absent or null metadata is a bin of its own.
Repeated rows are returned as often; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import discard, documents, prepare, stored
from hindcast.llm._words import LOWER, PLAIN, Words, slices, texts

WORDS = 1 << 11
#: Length of the vector of words beside that of the statistics, which is one.
WORD_LENGTH = 0.25
#: Bins of each statistic.
BINS = 16
FACTORS = 4
ITERATIONS, STEP, RIDGE, SPREAD, SEED = 60, 0.05, 3e-3, 0.05, 11
MAX_TRAIN = 10_000
THRESHOLD = 0.5
#: Bytes of text that are cut into words at once.
SLICE = 2 << 20
#: Kinds of bytes whose shares are statistics.
KINDS = tuple(np.isin(np.arange(256), x) for x in ([*range(0x41, 0x5B)], [*range(0x30, 0x3A)], [0x0A], [0x20, 0x09], [*b"!?"], [*b"|"], [*b"#$%&*@^~\\<>{}[]="], [*b",.;:'\"()-"], [*range(0x80, 0x100)]))
#: Statistics besides the kinds: bytes, words, bytes a word, words a line, repeated neighbours, distinct words.
OTHERS = 6


def dimensions(metadata: Sequence[str]) -> int:
    return WORDS + BINS * (len(KINDS) + OTHERS + len(metadata))


def _size_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + np.maximum(x, 0)), BINS - 2).astype(np.int64)


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, then by doublings from 1/4096 up; the last bin is for an empty whole."""
    share = part / np.maximum(whole, 1)
    return np.where(whole > 0, np.ceil(np.log2(1 + 4096 * share)), BINS - 1).astype(np.int64)


def features(data: np.ndarray, at: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of each feature, by texts and places; metadata: a column of numbers each, NaN for null."""
    n = len(at) - 1
    words = Words(LOWER[data], at, PLAIN)
    h, text = words.hashes(), words.text_of()
    key, count = np.unique(text * WORDS + (h % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    of, place = np.divmod(key, WORDS)
    value = 1 + np.log(count)
    value *= WORD_LENGTH / np.sqrt(np.bincount(of, value * value, n))[of]

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    size, number = np.diff(at), np.bincount(text, minlength=n)
    again = np.bincount(text[1:][(h[1:] == h[:-1]) & (text[1:] == text[:-1])], minlength=n)
    kinds = [within(k[data]) for k in KINDS]
    letters = size - sum(kinds)
    bins = [_share_bin(kinds[0], kinds[0] + letters), *(_share_bin(k, size) for k in kinds[1:])]
    bins += [_size_bin(size), _size_bin(number), _size_bin(4 * size / np.maximum(number, 1)), _size_bin(2 * number / (kinds[2] + 1)), _share_bin(again, number), _share_bin(np.bincount(of, minlength=n), number)]
    bins += [np.where(np.isnan(m), BINS - 1, _size_bin(np.nan_to_num(m))) for m in metadata]
    fixed = WORDS + BINS * np.arange(len(bins)) + np.stack(bins, 1)
    of, place = np.r_[of, np.repeat(np.arange(n), len(bins))], np.r_[place, fixed.ravel()]
    value = np.r_[value, np.full(n * len(bins), 1 / np.sqrt(len(bins)))]
    order = np.argsort(of, kind="stable")
    return of[order], place[order], value[order]


def _sliced(batches: Iterator[pa.RecordBatch], metadata: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    for batch in batches:
        data, at = texts(batch.column("text"))
        numbers = np.stack([batch.column(f"_{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(metadata))]) if metadata else np.zeros((0, batch.num_rows))
        for low, high in slices(at, SLICE):
            yield batch.slice(low, high - low), features(data[at[low] : at[high]], at[low : high + 1] - at[low], numbers[:, low:high])


def _featurize(metadata: Sequence[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (of, place, value) in _sliced(batches, metadata):
            ends = pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), value))], ["doc_id", "label", "place", "value"])

    return task


class Machine:
    """Weights, and a row of FACTORS numbers, of each place."""

    def __init__(self, intercept: float, linear: np.ndarray, factors: np.ndarray):
        self.intercept, self.linear, self.factors = intercept, linear, factors

    def log_odds(self, n: int, of: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = self.intercept + np.bincount(of, self.linear[place] * value, n)
        for f in range(self.factors.shape[1]):
            x = self.factors[place, f] * value
            total = np.bincount(of, x, n)
            out += (total * total - np.bincount(of, x * x, n)) / 2
        return out


def _score(machine: Machine, metadata: Sequence[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sliced(batches, metadata):
            odds = machine.log_odds(part.num_rows, *found)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], ["doc_id", "score"])

    return task


def training_features(docs: DataFrame, labels: DataFrame, is_training: Callable[[Column], Column], metadata: Sequence[str], max_train: int, label_col: str = "quality") -> DataFrame:
    """label, place, value of at most about max_train labelled documents, stored."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    known = known.where(is_training(F.col("doc_id")))
    rows = known.count()
    if rows > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * max_train // rows)
    found = docs.join(F.broadcast(known), "doc_id").mapInArrow(_featurize(metadata), "doc_id long, label int, place array<int>, value array<double>")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("place", "value")).alias("x"))
    return stored(one.select("label", "x.place", "x.value"), "quality")


def fit(docs: DataFrame, labels: DataFrame, is_training: Callable[[Column], Column], metadata: Sequence[str], max_train: int = MAX_TRAIN, label_col: str = "quality", iterations: int = ITERATIONS) -> Machine:
    taught, size = training_features(docs, labels, is_training, metadata, max_train, label_col), dimensions(metadata)
    rows, good = taught.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < good < rows:
        share = (good + 1) / (rows + 2)
        return Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)))
    vector = F.udf(lambda place, value: Vectors.sparse(size, place, value), VectorUDT())  # of the bounded sample only
    # The sample's size is bounded, so few partitions hold it, and each step of the fit is a few tasks.
    prepared = taught.select(F.col("label").cast("double").alias("label"), vector("place", "value").alias("features")).repartition(8)
    model = FMClassifier(factorSize=FACTORS, maxIter=iterations, stepSize=STEP, regParam=RIDGE, initStd=SPREAD, solver="adamW", seed=SEED, tol=0.0).fit(prepared)
    discard(taught)
    return Machine(model.intercept, model.linear.toArray(), model.factors.toArray())


def quality(df: DataFrame, labels: DataFrame, is_training: Callable[[Column], Column], metadata: Sequence[str] = ("n_chars",), max_train: int = MAX_TRAIN, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, score (probability of label 1), predicted. metadata: numeric columns, those the table has are used."""
    prepare(df.sparkSession)
    used = [c for c in metadata if c in df.columns]
    docs = documents(df, *(F.col(c).try_cast("double").alias(f"_{i}") for i, c in enumerate(used)), id_col=id_col, text_col=text_col)
    machine = fit(docs, labels, is_training, used, max_train, label_col)
    found = docs.mapInArrow(_score(machine, used), "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
