"""Quality classifier, fill-in-middle and spelling variants against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import fim, quality, spelling
from hindcast.llm import queries as Q
from hindcast.llm._shared import crc_mod

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (1, "one\ntwo\nthree"), (1, "one\ntwo\nthree"), (2, "\n\n\n"), (3, None), (4, ""), (5, "no line feed"), (None, "no\nid"), (6, "has <P> inside\nhere"), (7, "<\nP>\n<\nS>\n<M\n>"),
    (8, "é\n日本\n😀\n" * 300), (9, "x" * 5000 + "\n" + "y" * 255 + "\n"), (10, "a\n" * 128 + "b"), (11, "\r\nwindows\r\n"), (12, "line of a very long text\n" * 150_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("7") for c in ("n", "form", "output", "word", "h1", "h", "n_chars", "_0", "label", "place", "id")})


def brute_fim(doc_id, text, seed="7", rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,spm,seed", [(100, 50, "7"), (60, 0, "8"), (100, 100, "9")])
def test_fill_in_middle(docs, odd, rate, spm, seed):
    for df in (docs.select("doc_id", "text"), odd):
        found = fim.fill_in_middle(df, seed=seed, rate=rate, spm_rate=spm)
        got = found.select(*found.columns, fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
        want = [(r["doc_id"], *brute_fim(r["doc_id"], r["text"], seed, rate, spm), r["text"] or "") for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_cuts_are_found_by_descent():
    rng = random.Random(3)
    all_texts = ["".join(rng.choice("ab\né") for _ in range(rng.choice((0, 1, 5, 255, 256, 257, 900, 4000)))) for _ in range(60)]
    data = np.frombuffer("".join(all_texts).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len(t.encode()) for t in all_texts])]
    lines = fim.Lines(data, at)
    units = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in all_texts]
    assert lines.n.tolist() == [len(u) for u in units]
    for _ in range(20):
        k = np.array([rng.randint(0, len(u)) for u in units])
        places, points = lines.cut(k)
        assert points.tolist() == [len("".join(u[:x])) for u, x in zip(units, k)]
        assert places.tolist() == [len("".join(u[:x]).encode()) for u, x in zip(units, k)]


def brute_spelling(rows, damage=199, min_length=6, min_count=5, factor=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    holders, near = {}, {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            holders.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holders.values():
        for a, b in itertools.permutations(set(group), 2):
            near[a].add(b)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= factor * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled(rows):
    rows = rows.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def test_spelling_variants(docs, odd):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert spelled(spelling.spelling_variants(docs)) == brute_spelling(rows)
    assert spelled(spelling.spelling_variants(docs, damage=7, min_count=2, least=5)) == brute_spelling(rows, 7, 6, 2)
    assert spelled(spelling.spelling_variants(odd, min_length=4, min_count=2)) == brute_spelling(ODD, 199, 4, 2)
    empty = spelling.spelling_variants(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("alphabet,least", [("ab", 1), ("abé", 3), ("abc", 40), ("aÿ", 10_000)])
def test_near_words_over_few_letters(spark, alphabet, least):
    """Over few letters every edit is tried beside many equal grams; chains of forms are several links long."""
    rng = random.Random(alphabet)
    rows = [(1, " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(3000))), (2, "aaaaaa " * 4000 + "aaaaab " * 700 + "aaaabb " * 120 + "aaabbb " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spelled(spelling.spelling_variants(df, min_count=1, least=least)) == brute_spelling(rows, min_count=1)


def test_bounds_of_affected_grams():
    """Whatever one edit changes, a probe's gram is met again at its place or, in a longer word, a place later."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 12))) for _ in range(300)]
    count = Counter(w[i : i + k] for w in (f"<{x}>" for x in words) for k in range(2, 7) for i in range(len(w) - k + 1))
    known = {g: n for g, n in count.items() if n > 30}
    for word in words:
        found = spelling.grams(word, known)
        chosen = spelling.probes(word, found, known)
        assert len(chosen) > spelling.affected(chosen) and set(chosen) <= set(found)
        asked = {(f"<{word}>"[a:b], a) for a, b in chosen}
        for i in range(len(word) + 1):
            for c in "abd":
                for other, moves in ((word[:i] + c + word[i:], (0, 1)), (word[:i] + c + word[i + 1 :], (0,))):
                    if other != word:
                        there = {(f"<{other}>"[a:b], a) for a, b in spelling.grams(other, known)}
                        assert any((g, a + m) in there for g, a in asked for m in moves)


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    rows = [rng.choice(50, k, replace=False) for k in (0, 1, 5, 20)]
    values = [rng.normal(size=len(r)) for r in rows]
    want = [0.3 + sum(machine.linear[r] * x) + sum(x[i] * x[j] * (machine.factors[r[i]] @ machine.factors[r[j]]) for i in range(len(r)) for j in range(i)) for r, x in zip(rows, values)]
    of = np.repeat(np.arange(4), [len(r) for r in rows])
    assert np.allclose(machine.log_odds(4, of, np.concatenate(rows).astype(int), np.concatenate(values)), want)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = Q.op11_quality_classifier(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = (got[got.quality == k].score.to_numpy() for k in (1, 0))
    assert (good[:, None] > bad).mean() > 0.97
    assert (good >= 0.5).mean() > 0.97 and (bad < 0.5).mean() > 0.6
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_of_odd_tables(spark, odd, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, 0, "x"), (3, 1, None), (5, None, "x"), (None, 1, "x"), (8, 1, "x"), (9, 0, "x"), (10, 1, "x")], "doc_id long, quality int, text string")
    everyone = lambda doc_id: F.lit(True)
    got = quality.quality(odd, labels, everyone).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert {r["score"] for r in quality.quality(odd.drop("n_chars"), labels.limit(0), everyone).collect()} == {0.5}
    assert {r["score"] for r in quality.quality(odd, labels.where("doc_id = 1"), everyone).collect()} == {2 / 3}
    assert quality.quality(docs.limit(0), labels, everyone).collect() == []


def test_scores_see_nothing_but_text_and_metadata(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    one = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels, lambda i: crc_mod(i, 3) != 1).collect()}
    other = {r["doc_id"]: r["score"] for r in quality.quality(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("?")}), labels, lambda i: crc_mod(i, 3) != 1).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 for k in one)
