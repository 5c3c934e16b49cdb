"""Toxicity: every significant toxic passage of a text, by maximum-scoring segments over token log-odds.

Tokens are words of letters, digits and non-ASCII characters, A-Z lowered. A token's share of occurrences in toxic rows is
estimated with Dirichlet priors along a chain: the prior of a word is the estimate of its first eight bytes, whose prior is
that of its first seven, and so on down to four and to the share of all tokens. So inflected and compounded forms that were
never seen take their stem's odds, and a frequent clean word under a toxic stem keeps its own. A token's log-odds against the
share of all tokens, above or below zero, are shrunk by their squared standard error (what one sighting says is mostly
noise); its score is that less a fixed drift, which alone a word without any known stem gets.

Each text is scanned once for all maximal scoring segments (linear time: every segment keeps a link to the last one before
it that begins lower). In clean text of n words, segments of score S or more are expected E = K * n * exp(-lambda * S) times;
lambda and K are the maximum-likelihood fit of the extreme-value law to the best segments of clean training rows. A segment
whose tail probability 1 - exp(-E) is at most `SIGNIFICANT` is a toxic passage. The passages' surprise, -ln of the tail
probability, is summed and calibrated to a probability by a logistic fit on the training rows. Both fits use scores that
were learnt from the other half of the training rows, so no row is judged by odds that it made itself.

Scale: training counts are combined per batch and summed by Spark. At most `max_train` labelled rows are learnt from (chosen
by hash of the id; all of them where there are fewer); that bounds the table of labels that is broadcast and the lexicon,
16 bytes for each distinct word and stem of these rows, which goes out with the task. Every text is scored whole.

Defined results: a null or empty text has no passage and scores as any text without one. Labels that are null count as
absent, several of one doc_id as the largest. Without any training row the score is 0. Rows that repeat are returned as
often; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import documents, give_back
from hindcast.llm._words import LOWER, PLAIN, Words, long_column, slices, texts

STEMS = (4, 5, 6, 7, 8)
WHOLE = 255
PRIOR = 10.0
DRIFT = 1.2
#: No share is taken as surer than this, toxic or (times the share of all tokens) clean. The error of log-odds is 1 / (share * (1 - share) * n):
#: nearer to 1 it would outgrow their square, and chains of stems, which reach 1 soon, would lose the surest tokens' scores.
SURE = 0.01
SIGNIFICANT = 0.05
#: Tokens whose scores are worked out at once on the driver.
LOOKED_UP = 1 << 18
MAX_TRAIN = 50_000
THRESHOLD = 0.3
#: Bytes of text that are cut into words at once.
SLICE = 2 << 20
_PASSAGES = "array<struct<start:int,end:int,score:double>>"
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _chains(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Level, the words concerned, the token's hash, and its parent's hash (0: none), from the shortest stem to the word."""
    length, parent = words.end - words.start, np.zeros(len(words), np.uint64)
    for level in (*STEMS, WHOLE):
        which = np.flatnonzero(length > level) if level != WHOLE else np.arange(len(words))
        h = words.hashes(0, level if level != WHOLE else None)
        # The level is part of the hash: a stem and a word that read the same are two tokens.
        h ^= np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
        yield level, which, h[which], parent[which]
        parent = parent.copy()
        parent[which] = h[which]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of tokens in clean and toxic rows of both halves."""
    for batch in batches:
        data, at = texts(batch.column("text"))
        label, half = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "half"))
        for low, high in slices(at, SLICE):
            words = Words(LOWER[data[at[low] : at[high]]], at[low : high + 1] - at[low], PLAIN)
            group = (2 * half + label)[low:high][words.text_of()]
            for level, which, h, parent in _chains(words):
                token, first, back = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(back * 4 + group[which], minlength=4 * len(token)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), level, np.int16)), long_column(token), long_column(parent[first]), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(4))], ["level", "token", "parent", *_GROUPS])


_GROUPS = ["clean_0", "toxic_0", "clean_1", "toxic_1"]


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    return np.log(p) - np.log1p(-p)


class Lexicon:
    """Scores of all tokens of the training rows, sorted by hash."""

    def __init__(self, level: np.ndarray, token: np.ndarray, parent: np.ndarray, clean: np.ndarray, toxic: np.ndarray):
        seen = clean + toxic > 0
        order = np.flatnonzero(seen)[np.argsort(token[seen])]
        level, self.tokens, parent, good, bad = (x[order] for x in (level, token, parent, clean, toxic))
        self.scores = np.empty(len(order), np.float32)
        del seen, order
        whole = level == WHOLE
        base = (bad[whole].sum() + 1) / (bad[whole].sum() + good[whole].sum() + 2)
        share = np.full(len(level), base)
        for now in (*STEMS, WHOLE):
            mine = np.flatnonzero(level == now)
            for low in range(0, len(mine), LOOKED_UP):
                some = mine[low : low + LOOKED_UP]
                at = np.minimum(np.searchsorted(self.tokens, parent[some]), len(level) - 1)
                prior, n = np.where(self.tokens[at] == parent[some], share[at], base), good[some] + bad[some] + PRIOR
                share[some] = p = np.clip((bad[some] + PRIOR * prior) / n, SURE * base, 1 - SURE)
                odds = _logit(p) - _logit(base)
                self.scores[some] = odds * np.maximum(0, 1 - 1 / (p * (1 - p) * n) / np.maximum(odds * odds, 1e-12)) - DRIFT

    def of(self, words: Words) -> np.ndarray:
        """Each word's score: of its longest known token, or minus the drift."""
        out = np.full(len(words), -DRIFT)
        if not len(self.tokens):
            return out
        for _, which, h, _ in _chains(words):
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
            known = self.tokens[at] == h
            out[which[known]] = self.scores[at[known]]
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time; runs of losses are taken at once."""
    gains = np.flatnonzero(scores > 0)
    total = np.r_[0.0, np.cumsum(scores)]
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, the last that begins lower
    for i, left, right in zip(gains.tolist(), total[gains].tolist(), total[gains + 1].tolist(), strict=True):
        start, end, j = i, i + 1, len(found) - 1
        while True:
            # All that stands between a segment and the one it links to begins higher than itself.
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left, before = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = before
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _segments(lexicon: Lexicon, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Row number, number of words and segments of each text that has words."""
    data, at = texts(column)
    for low, high in slices(at, SLICE):
        words = Words(LOWER[data[at[low] : at[high]]], at[low : high + 1] - at[low], PLAIN)
        scores = lexicon.of(words)
        gains = np.bincount(words.text_of()[scores > 0], minlength=high - low).tolist()
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if b > a:
                yield low + i, b - a, segments(scores[a:b]) if gains[i] else []


class Law:
    """The extreme-value law of segments in clean text: tail(S, n) = 1 - exp(-K * n * exp(-lambda * S))."""

    def __init__(self, best: np.ndarray, n: np.ndarray):
        """Maximum likelihood from the best scores of clean texts (0: no segment, which counts as "0 at most") and their words."""
        x, m, none = best[best > 0], n[best > 0], float(n[best <= 0].sum())
        self.rate, self.log_k = 1.0, -math.log(none + 1)
        if len(x):
            low, high = 1e-3, 50.0
            for _ in range(60):
                self.rate = (low + high) / 2
                weight = m * np.exp(-self.rate * x)
                low, high = (self.rate, high) if 1 / self.rate - x.mean() + (weight * x).sum() / (weight.sum() + none) > 0 else (low, self.rate)
            self.log_k = math.log(len(x) / (float((m * np.exp(-self.rate * x)).sum()) + none))

    def surprise(self, score: float, n: int) -> float:
        """-ln of the tail probability."""
        log_e = self.log_k + math.log(n) - self.rate * score
        return -log_e if log_e < -20 else -math.log(-math.expm1(-math.exp(min(log_e, 5.0))))


def judged(lexicon: Lexicon, law: Law, column: pa.Array, with_passages: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
    """Of each text: the summed surprise of its significant passages, and these."""
    total, passages, least = np.zeros(len(column)), [[] for _ in range(len(column))] if with_passages else [], -math.log(SIGNIFICANT)
    for i, n, found in _segments(lexicon, column):
        for start, end, s in found:
            surprise = law.surprise(s, n)
            if surprise >= least:
                total[i] += surprise
                if with_passages:
                    passages[i].append({"start": start, "end": end, "score": s})
    return total, passages


def _by_halves(lexicons: list[Lexicon], law: Law | None):
    """Training rows by the lexicon of the other half. Without a law: words and best score; with it: surprise."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy()
            for k in (0, 1):
                mine = batch.filter(pa.array(half == k))
                n, value = np.zeros(mine.num_rows, np.int64), np.zeros(mine.num_rows)
                if law:
                    value, _ = judged(lexicons[1 - k], law, mine.column("text"), False)
                else:
                    for i, words, found in _segments(lexicons[1 - k], mine.column("text")):
                        n[i], value[i] = words, max((s for _, _, s in found), default=0.0)
                yield pa.RecordBatch.from_arrays([mine.column("label"), pa.array(n), pa.array(value)], ["label", "n", "value"])

    return task


def _scan(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            excess, passages = judged(model.lexicon, model.law, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(excess), pa.array(passages, _KIND)], ["doc_id", "excess", "passages"])

    return task


def _fit(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic fit of P(toxic) on log(1 + excess), by Newton steps with a weak ridge; bins: value, rows, toxic rows."""
    x = np.array([[1.0, math.log1p(v)] for v, _, _ in bins])
    n, y = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    w = np.array([-2.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - n * p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


class Model:
    """What is learnt from labelled rows: the lexicon, the law of chance segments, and the logistic fit of the surprise."""

    def __init__(self, lexicon: Lexicon | None, law: Law | None, a: float, b: float):
        self.lexicon, self.law, self.a, self.b = lexicon, law, a, b

    def score(self, excess: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.a) + F.lit(self.b) * F.log1p(excess))))


def fit(docs: DataFrame, labels: DataFrame, is_training: Callable[[Column], Column], max_train: int) -> Model:
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("label"))
    known = known.where(is_training(F.col("doc_id")))
    rows = known.count()
    if rows > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * max_train // rows)
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int").alias("half")
    taught = docs.join(F.broadcast(known), "doc_id").select("text", "label", half)

    kind = "level short, token long, parent long, " + ", ".join(f"{c} long" for c in _GROUPS)
    counts = taught.mapInArrow(_count, kind).groupBy("level", "token", "parent").agg(*(F.sum(c).cast("int").alias(c) for c in _GROUPS)).toArrow()
    if not counts.num_rows:
        return Model(None, None, -30.0, 0.0)
    held: dict[str, np.ndarray] = {}
    for name in counts.column_names:  # one column at a time: only one is held twice
        held[name] = counts[name].to_numpy().copy()
        counts = counts.drop_columns([name])
    del counts
    pa.default_memory_pool().release_unused()
    level, token, parent, *n = held.values()
    halves = [Lexicon(level, token, parent, n[2 * k], n[2 * k + 1]) for k in (0, 1)]
    lexicon = Lexicon(level, token, parent, n[0] + n[2], n[1] + n[3])
    del held, level, token, parent, n
    scanned = taught.mapInArrow(_by_halves(halves, None), "label boolean, n long, value double")
    clean = scanned.where("NOT label AND n > 0").select("n", "value").toArrow()  # at most max_train rows of two numbers
    law = Law(clean["value"].to_numpy(), clean["n"].to_numpy())
    step = F.floor(F.log1p("value") * 8)
    scanned = taught.mapInArrow(_by_halves(halves, law), "label boolean, n long, value double")
    bins = scanned.groupBy(step.alias("bin")).agg(F.avg("value"), F.count(F.lit(1)), F.sum(F.col("label").cast("int"))).toArrow().to_pylist()
    a, b = _fit([tuple(r.values())[1:] for r in bins])
    del halves, scanned, clean, bins
    give_back()
    return Model(lexicon, law, a, b)


def toxicity(df: DataFrame, labels: DataFrame, is_training: Callable[[Column], Column], max_train: int = MAX_TRAIN, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, passages (word numbers and scores of the significant ones)."""
    docs = documents(df, id_col=id_col, text_col=text_col)
    model = fit(docs, labels, is_training, max_train)
    if model.lexicon is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"), F.expr(f"CAST(array() AS {_PASSAGES})").alias("passages"))
    score = model.score(F.col("excess"))
    return docs.mapInArrow(_scan(model), f"doc_id long, excess double, passages {_PASSAGES}").select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "passages")


def clean_documents(df: DataFrame, labels: DataFrame, is_training: Callable[[Column], Column], max_train: int = MAX_TRAIN, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that are not predicted toxic, with all their columns. Only texts go to Python; rows stay where they are."""
    model = fit(documents(df, id_col=id_col, text_col=text_col), labels, is_training, max_train)
    if model.lexicon is None:
        return df

    @F.arrow_udf("double")
    def excess(column: pa.Array) -> pa.Array:
        return pa.array(judged(model.lexicon, model.law, column, False)[0])

    return df.where(model.score(excess(F.coalesce(F.col(text_col), F.lit("")))) < threshold)
