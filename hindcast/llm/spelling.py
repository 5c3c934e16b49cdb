"""Spelling variants: words that differ by one code point, found through an index of variable-length grams.

Words are counted by Spark. A word is framed by two marks. Its grams begin at every place but the last: two code points
long, extended while what is there is frequent among all words, until it is rare, `LONGEST` long, or at the end mark. So the
dictionary is pruned by frequency: common beginnings are told apart by more characters. It needs only the frequent grams
to be known, and as no more than total / least grams of a length can be met more than `least` times, its size is bounded by
`MOST` a length, whatever the corpus. A gram is decided by its own characters alone.

An edit of one code point affects the grams that hold its place; all others are kept, moved by a place at most. A word's
probes are its rarest grams, taken until they number more than any edit can affect (the word's affected-gram bound over the
chosen set), less those that the bound can do without: mostly two that don't overlap. A near word then shares at least one
probe, at the same place, or a place later in a word that is longer by one. LONGEST is at most the shortest word's length, so
that the bound is always met: a word has one gram more than its characters, and an edit affects no more than LONGEST.

The lists of gram, place and length are merged by one equi-join of probes with all grams. Every candidate is verified by its
edit distance in the same stage, so only near pairs are shuffled. A word of n characters over an alphabet of a has less than
(2n + 1) a near words, hence groups are small. Forms make chains in which counts grow fivefold, so they are resolved by
doubling in few rounds, their number known from the largest count.

Defined results: null and empty texts have no words; a null id counts as the empty string in the hash; repeated rows count as
often; other columns are ignored; an empty table gives an empty table. Ties: see `spelling_variants`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import discard, documents, prepare, stored

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LONGEST = 2, 6
#: A gram met more often is extended; and as many grams of a length are held as frequent at most.
LEAST, MOST = 40, 100_000
BEGIN, END = "<", ">"
RESULT = "word string, form string, root string, n long, n_near long, form_n long"


def word_counts(df: DataFrame, damage: int | None, min_length: int, min_count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters with A-Z lowered. With `damage`, of runs whose crc32 of "id:run" that number divides, the code
    point at crc32 % length is left out first."""
    runs = F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(RUN), F.lit(0))
    words = documents(df, id_col=id_col, text_col=text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("word")).alias("word"))
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def framed(word: Column | str) -> Column:
    return F.concat(F.lit(BEGIN), word, F.lit(END))


def frequent_grams(words: DataFrame, least: int, longest: int = LONGEST) -> dict[str, int]:
    """Grams met more than `least` times, with their counts; every prefix of one is another, down to the shortest."""
    cut = "flatten(transform(sequence(1, length(w) - 1), i -> transform(sequence({0}, least({1}, length(w) - i + 1)), k -> substring(w, i, k))))".format(SHORTEST, longest)
    grams = words.select(framed("word").alias("w")).select(F.explode(F.expr(cut)).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).toLocalIterator()}


def grams(word: str, known: dict[str, int], longest: int = LONGEST) -> list[tuple[int, int]]:
    """Begin and end of each gram of the framed word."""
    w, out = BEGIN + word + END, []
    for i in range(len(w) - SHORTEST + 1):
        k = i + SHORTEST
        while k < len(w) and k - i < longest and w[i:k] in known:
            k += 1
        out.append((i, k))
    return out


def affected(chosen: list[tuple[int, int]]) -> int:
    """The most of these grams that one edit can affect: those that hold one place."""
    return max((sum(a <= i < b for a, b in chosen) for i, _ in chosen), default=0)


def probes(word: str, found: list[tuple[int, int]], known: dict[str, int]) -> list[tuple[int, int]]:
    """The rarest grams that number more than an edit can affect; the dearest that aren't needed for that are left out again."""
    w, chosen = BEGIN + word + END, []
    for g in sorted(found, key=lambda g: (known.get(w[g[0] : g[1]], 0), g[0] - g[1], g[0])):
        chosen.append(g)
        if len(chosen) > affected(chosen):
            break
    for g in chosen[-2::-1]:
        rest = [x for x in chosen if x != g]
        if len(rest) > affected(rest):
            chosen = rest
    return chosen


def _index(known: dict[str, int], longest: int, probing: bool):
    """Gram, place and length of the words that a row can meet, with the word. Probing: in words as long or longer by one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, place, length, at = [], [], [], []
            for row, word in enumerate(batch.column("word").to_pylist()):
                w, found = BEGIN + word + END, grams(word, known, longest)
                for a, b in probes(word, found, known) if probing else found:
                    for p, n in ((a, len(w)), (a, len(w) + 1), (a + 1, len(w) + 1)) if probing else ((a, len(w)),):
                        gram.append(w[a:b]), place.append(p), length.append(n), at.append(row)
            rows = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(place, pa.int32()), pa.array(length, pa.int32()), rows.column("word"), rows.column("n")], ["gram", "place", "length", "word", "n"])

    return task


def near_pairs(words: DataFrame, known: dict[str, int], longest: int = LONGEST) -> DataFrame:
    """word, n, near, near_n of all words at distance one, both ways round."""
    prepare(words.sparkSession)
    kind = "gram string, place int, length int, word string, n long"
    key = F.xxhash64("gram", "place", "length").alias("key")
    probe, index = (words.select("word", "n").mapInArrow(_index(known, longest, probing), kind) for probing in (True, False))
    probe = probe.select(key, "word", "n")
    index = index.select(key, F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Of two words of one length the smaller asks, of others the shorter one; a key's collision only makes one candidate more.
    asks = (F.char_length("near") > F.char_length("word")) | ((F.char_length("near") == F.char_length("word")) & (F.col("word") < F.col("near")))
    found = probe.join(index, "key").where(asks & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n").distinct()
    return found.select(F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")).select("x.*")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word, root of words that have a form: the last word that forms lead to, in `rounds` doublings."""
    jumps = stored(forms.select("word", F.col("form").alias("root")), "jumps")
    for i in range(rounds):
        after = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(jumps.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"jumps{i}")
        discard(jumps)
        jumps = further
    return jumps


def spelling_variants(df: DataFrame, damage: int | None = 199, min_length: int = 6, min_count: int = 5, factor: int = 5, least: int = LEAST, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of at least `min_length` code points met `min_count` times.

    Two words are near at an edit distance of one. A word's form is its near word of largest n (of equal ones the smallest in
    code-point order), if that n is at least `factor` times the word's, else null; root is where forms end, or the word itself.
    """
    if min_length < SHORTEST or factor < 2:
        raise ValueError("words have two code points at least, and forms must be met more often than their variants")
    spark = prepare(df.sparkSession)
    words = stored(word_counts(df, damage, min_length, min_count, id_col, text_col), "words")
    total, highest = words.agg(F.sum(F.char_length("word") + 1), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    longest = min(LONGEST, min_length)
    known = frequent_grams(words, max(least, math.ceil(total / most)), longest)
    best = near_pairs(words, known, longest).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    judged = stored(judged, "judged")
    links = max(1, math.ceil(math.log(max(highest, 2), factor)))
    ends = roots(judged.where("form IS NOT NULL"), math.ceil(math.log2(links)) if links > 1 else 0)
    discard(words)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
