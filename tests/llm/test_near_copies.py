"""Near copies of one text that don't link with it: links among them are found, and no row is made of a pair."""

import random

import numpy as np
import pyarrow as pa
from test_operators import brute_components

from hindcast.llm import ngram_join as N


def near_copies(many, seed=5):
    """Text 0, `many` texts with changes of their own that are too many for a link with it, and for every tenth of those one near to it."""
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(160)], []
    rows.append((0, " ".join(base)))
    for k in range(many):
        words = list(base)
        for at in rng.sample(range(10, 150, 7), 6):
            words[at] = f"x{k}y{at}"
        rows.append((k + 1, " ".join(words)))
        if k % 10 == 0:
            words[4] = f"z{k}"
            rows.append((many + 1 + k, " ".join(words)))
    return rows


def test_links_among_near_copies_of_a_text(spark):
    rows = near_copies(400)
    found = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got, want = {r[0]: tuple(r[1:]) for r in found.collect()}, brute_components(rows)
    assert got == want
    assert 300 < len({c for _, c in want.values()}) < len(rows)


def test_block_stage_makes_rows_of_documents_not_of_pairs():
    rng = np.random.default_rng(3)
    base, made = rng.integers(0, 1 << 63, 100, dtype=np.uint64), {}
    for many in (100, 200):
        sets = [np.unique(np.r_[base[:84], rng.integers(0, 1 << 63, 16, dtype=np.uint64)]) for _ in range(many)]
        n = len(sets)
        columns = [np.zeros(n, np.int64)] * 3 + [np.zeros(n, np.int64), np.arange(n), np.arange(n), np.zeros(n, np.int64), np.array([len(x) for x in sets])]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([N._sketch(x).tobytes() for x in sets])], ["key", "p", "q", "block", "doc_id", "comp", "pivot", "size", "packed"])
        made[many] = sum(b.num_rows for b in N._near_rows(75)(iter([batch])))
    assert made[100] > 50 and made[200] <= 200


def test_spared_keys_leave_one_to_linked_sets():
    rng = np.random.default_rng(11)
    bands, spared, met = N.Bands(75), 0, 0
    for _ in range(2000):
        size = int(rng.integers(20, 600))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        change = int(rng.integers(0, size // 5 + 1))
        b = np.unique(np.r_[a[change:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 5 + 1)), dtype=np.uint64)])
        if not N._linked(a, b, 75):
            continue
        keys, popular = [N._segment_keys(x, bands) for x in (a, b)], np.intersect1d(N._segment_keys(a, bands), N._segment_keys(b, bands))
        left = []
        for x, k in zip((a, b), keys, strict=True):
            # The keys that both have count as the most shared of all.
            k = k[np.lexsort((k, ~np.isin(k, popular)))]
            for spare in N._spares(x, bands):
                mine = np.flatnonzero((k & np.uint64(7)) == np.uint64(spare & 7))[: spare >> 3]
                spared += len(mine)
                k = np.delete(k, mine)
            left.append(k)
        met += 1
        assert len(np.intersect1d(*left))
    assert met > 300 and spared > 1000

def test_copies_have_no_buckets(spark, monkeypatch):
    """Copies that lie in different batches make no rows of buckets; a repeated id that is a copy with one of its texts keeps the links of the other."""
    kept = {}

    def stored(df, name, **more):
        out = real(df, name, **more)
        kept.setdefault(name, []).append(out.count())
        return out

    real = N.stored
    monkeypatch.setattr(N, "stored", stored)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(20)]
    rows = [(100 * k + i, t) for k in range(4) for i, t in enumerate(texts)]
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: d % 100 for d, _ in rows}
    assert kept["buckets"] == [0]
    near = texts[1] + " and more"
    rows = [(5, texts[0]), (7, texts[0]), (7, texts[1]), (9, near), (3, texts[2]), (11, texts[2])]
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(3, 3), (5, 5), (7, 5), (7, 5), (9, 5), (11, 3)]


def test_rounds_of_links_make_few_stages(spark):
    """Pivots stay from the second round on, stars are seen to be stars by one count: links that meet only through several texts ask for no more rounds."""
    rng, rows = random.Random(8), []
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(120)]
        for k in range(10):
            words[(37 * k + 3) % 120] = f"f{family}x{k}"
            rows.append((rng.randrange(10**6) * 1000 + len(rows), " ".join(words)))
    rows += [(d + 10**10, t) for d, t in near_copies(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.sparkContext.setJobGroup("rounds", "rounds of links")
    try:
        got = {r[0]: tuple(r[1:]) for r in N.ngram_components(df).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == brute_components(rows)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) < 250
