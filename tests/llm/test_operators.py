"""Each operator against brute force on a small corpus, and on tables with nulls, repeats, long texts and odd columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hindcast.llm import bpe, exact_dedup, license_scan, lm_score, media, ngram_join, packing, substring_dedup, token_store, toxicity
from hindcast.llm import queries as Q
from hindcast.llm._components import components
from hindcast.llm._tokens import encode
from hindcast.llm._words import Words, runs, texts

from context_tree import Tree

FOLDER = "/root/testdata/sf0.001"
BYTE_RANKS, BYTE_BPE, WORD_BPE = (Q.vocabulary(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))

ODD = [
    (1, "Same text  here"), (2, "Same\ttext here "), (2, "Same\ttext here "), (3, None), (4, ""), (5, " \n\t"), (None, "no id at all"), (None, None), (6, "one"), (7, "ONE"),
    (8, "x" * 3000), (9, "ab " * 4000), (10, "é日本 😀 don't 'S 12\r\n\r\n  tail  "), (11, "Released under the MIT License.\nnothing"), (12, "Apache\nLicense Apache License"), (13, "same passage " * 40), (14, "same passage " * 40 + "more"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def corpus(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that need a defined result, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("hash", "norm", "key", "n", "packed", "carried", "row", "label", "word", "train", "uid", "_id", "_row", "piece")})


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def brute_components(rows, n=5, percent=75):
    sets = {}
    for i, text in rows:
        w = lower(text).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g] if j > i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            run = tuple(w[p : p + window])
            if run in seen:
                gone[p : p + window] = [True] * window
            seen.add(run)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_word_kernels():
    column = pa.array(["a bb\tccc", None, "", "  x ", "bb a"])
    words = Words(*texts(column))
    assert [words.data[a:b].tobytes() for a, b in zip(words.start, words.end)] == [b"a", b"bb", b"ccc", b"x", b"bb", b"a"]
    assert words.text_of().tolist() == [0, 0, 0, 3, 4, 4]
    h = words.hashes()
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 4
    assert words.inside(2).tolist() == [True, True, False, False, True]
    many = np.arange(40, dtype=np.uint64)
    for k in (1, 2, 3, 5, 7, 10, 20):
        repeated = np.r_[many, many]
        assert len(set(runs(repeated, k)[: 40 - k + 1].tolist())) == 40 - k + 1
        assert (runs(repeated, k)[: 40 - k + 1] == runs(repeated, k)[40 : 80 - k + 1]).all()


def test_exact_dedup(docs, corpus, odd):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t.translate({c: None for c in (32, 9, 10, 11, 12, 13)})].append((-len(t), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, i in g}
    assert {r[0]: tuple(r[1:]) for r in exact_dedup.exact_dedup(docs).collect()} == want
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 1, 3), (2, 1, 3)}
    assert {r["keep_id"] for r in rows if r["doc_id"] in (3, 4)} == {5}  # the longest of the empty texts
    kept = exact_dedup.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(kept.select("doc_id").where("doc_id <= 7").toPandas()["doc_id"]) == [1, 5, 6, 7]


def test_media(docs, corpus, odd):
    def want(text):
        raw = (text or "").encode()
        samples = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        stream = media.header(len(samples)) + samples
        return len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stream), hashlib.sha256(stream).hexdigest()

    named = dict(corpus)
    for r in media.media_columns(docs).collect():
        assert tuple(r[1:7]) == want(named[r["doc_id"]])
    got = sorted((str(r["doc_id"]), *r[1:7]) for r in media.media_columns(odd).collect())
    assert got == sorted((str(i), *want(t)) for i, t in ODD)


def test_media_chunks_follow_content():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, 40_000, np.uint8), rng.integers(0, 256, 777, np.uint8)

    def chunks(x):
        hits = np.flatnonzero(media.gear(x) >> np.uint32(32 - media.MEAN_BITS) == 0) + 1
        ends = media.cuts(hits, 0, len(x))
        assert ends[-1] == len(x) and all(q - p <= media.MOST for p, q in zip([0, *ends[:-1]], ends))
        return {x[p:q].tobytes() for p, q in zip([0, *ends[:-1]], ends)}

    assert len(chunks(a) & chunks(np.r_[b, a])) >= len(chunks(a)) - 3


def test_byte_bpe(spark, odd):
    import tiktoken

    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_RANKS), special_tokens={})
    rng = random.Random(3)
    parts = ["'s", "'re", "'", "a", "B", "don't", "12", "é", "日本", "  ", " ", "\n", "\t", "!", "..", "x'lly", "😀", "½", "\x1c", "\x85", "<|endoftext|>", "zzzzqqq"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))) for i in range(400)] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(df, BYTE_RANKS).collect())
    assert got == sorted((tuple(library.encode_ordinary(t or "")), (t or "").encode()) for _, t in rows)


def test_licenses(odd, docs, corpus):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(lower(t).decode())
    templates = {k: set(split(t)) for k, t in license_scan.TEMPLATES.items()}

    def want(text):
        w, labels, score = split(text), set(), 0.0
        places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        for line in (text or "").split("\n"):
            s = set(split(line))
            for k, t in templates.items():
                if 100 * len(s & t) >= license_scan.PERCENT * len(t):
                    labels.add(k)
                    score = max(score, len(s & t) / len(t))
        starts, base = [i for i, _ in places], {label for _, label in places}
        return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else score

    for df, rows in ((docs, corpus), (odd, ODD)):
        got = sorted((str(r["doc_id"]), *map(str, r[1:8])) for r in license_scan.license_scan(df).collect())
        assert got == sorted((str(i), *map(str, want(t))) for i, t in rows)


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows)


def test_packing(docs, odd, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in corpus}
    rows = packing.packed_documents(docs, BYTE_BPE).collect()
    used, total = check_packing(rows, 1024)
    assert total == sum(map(len, ids.values())) and used <= total / 1024 * 1.03 + 2
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == piece and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        assert r["length"] == 1024 or r["piece"] == 0
    got = packing.packed_documents(odd, BYTE_BPE, with_ids=False).collect()
    assert len([r for r in got if r["piece"] == 0]) == len(ODD) and check_packing(got, 1024)[0] > 0


def test_packing_plan_places_every_piece():
    counts = {1: 40_000, 300: 50_001, 511: 20_000, 700: 13, 1000: 2}
    placed = Counter()
    for many, lengths in packing.plan(counts, 1024):
        assert sum(lengths) <= 1024
        placed.update({s: many * n for s, n in Counter(lengths).items()})
    assert placed == counts


def test_toxicity(spark, odd):
    rng = random.Random(5)
    plain = ["the", "and", "of", "house", "tree", "river", "walks", "sings", "blue", "green", "stone", "cloud"]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scumbag", "scumlike", "scumish"]))
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    every = lambda c: c % 4 != 2
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, df, every).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 4 == 2]
    assert sum(p == y for p, y in held) / len(held) >= 0.97
    passage = next(got[i]["passages"] for i, _, y in rows if y)
    assert passage and all(p["start"] < p["end"] and p["score"] > 0 for p in passage)
    clean = toxicity.clean_documents(df, df, every)
    assert clean.columns == df.columns and clean.where("toxic = 0").count() >= 315 and clean.where("toxic = 1").count() <= 4
    scored = toxicity.toxicity(odd, df, every).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["score"] for r in toxicity.toxicity(odd, df.limit(0), every).collect()} == {0.0}


def brute_segments(scores):
    """Maximal segments by definition: split at the best segment, left and right, over and over."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = -best[2], -best[2] - best[1]
    return brute_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-5, -3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and all(root[x] == x for x in set(root) - set(got))


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") for _ in range(rng.choice([5, 6, 7, 9, 12, 20, 30]))] for _ in range(12)]
    rows = []
    for i in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k, r = rng.randrange(len(w)), rng.random()
            if r < 0.4:
                w[k] = rng.choice("abcdefghij")
            elif r < 0.7:
                w = w[:k] + w[k + 1 :] or ["z"]
            else:
                w.append(rng.choice("xyz"))
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "  "), (903, "one"), (904, "ONE "), (905, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in ngram_join.ngram_components(df).collect()} == brute_components(rows)


def test_ngram_join_on_documents_and_odd_rows(docs, corpus, odd):
    want = brute_components(corpus)
    assert {r[0]: tuple(r[1:]) for r in ngram_join.ngram_components(docs).collect()} == want
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    rows = ngram_join.ngram_components(odd).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}


def test_substring_dedup(spark, docs, corpus, odd):
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.substring_dedup(docs).collect()} == brute_repeats(corpus, 20)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 8, 40, 100])))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.substring_dedup(df, 4).collect()} == brute_repeats(rows, 4)
    got = substring_dedup.substring_dedup(odd, carry=["label"]).collect()
    assert len(got) == len(ODD) and {r["carried"]["label"] for r in got} == {1}
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (9, 13, 14)} == {9: 3981 + 18, 13: 78, 14: 80}
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, 7)


def test_lm_base_score(docs, corpus, odd):
    taught = lambda c: c % 7 != 2
    words = {i: [*lower(t).split(), b"\0end"] for i, t in corpus}
    counts = Counter(w for i, ws in words.items() if i % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in lm_score.lm_score(docs, taught).collect():
        ws = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    rows = lm_score.lm_score(odd, taught).collect()
    assert len(rows) == len(ODD) and all(r["score"] < 0 for r in rows)


def lm_levels(texts_):
    """The operator's own levels over some training texts, in one shard."""
    column = pa.array(texts_)
    symbols, _ = lm_score._symbols(*texts(column))
    key, n = np.unique(symbols, return_counts=True)
    deep, (top, sums) = lm_score._subtree(key, n)
    return [*lm_score._top(top, *sums), *deep]


def test_lm_is_a_probability():
    """After any beginning, the probabilities of all next bytes sum to one; seen texts are likelier than unseen ones."""
    levels = lm_levels(["the cat sat on the mat and the dog"] * 50 + ["é", ""])
    for before in (b"\xff" * 5, b"\xff\xff\xff\xfft", b"at on", b"zq zq", b"the c", bytes(5)):
        context = np.uint64(int.from_bytes(before, "big") << 8)
        assert (10 ** lm_score._log10(levels, context | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)
    score = lambda x: lm_score._log10(levels, np.array([int.from_bytes(x, "big")], np.uint64))[0]
    assert score(b"on the") > -0.1 and score(b"on thz") < -1


def test_lm_questions_about_a_hot_context_are_spread():
    """However many batches ask about the symbols behind one pair, a cell gets its share of them, and a shard gets each once."""
    key = np.sort(lm_score.mix(np.arange(20_000, dtype=np.uint64)) & np.uint64(0xFFFFFF0000FF) | np.uint64(0x202E00))
    assert len(np.unique(lm_score._pair(key, 64))) == 1
    sizes = np.bincount(lm_score._cell(key, 64), minlength=64)
    assert sizes.max() < 1.3 * len(key) / 64
    rows = [(b, 0, *x) for b in range(30) for x in lm_score._split(key, lm_score._cell(key, 64), np.ones(len(key), np.uint64))]
    table = pa.table(dict(zip(("batch", "kind", "cell", "keys", "n"), map(list, zip(*rows)))))
    merged = [lm_score._merged(64)(table.filter(pa.array(table["cell"].to_numpy() == c))) for c in range(64)]
    got = pa.concat_tables(merged)
    assert len(set(got["shard"].to_pylist())) == 1 and len(got) == 64
    keys, n = lm_score._met(got)
    assert (keys == np.unique(key)).all() and (n == 30 * np.unique(key, return_counts=True)[1]).all()


def coded(ids):
    table = token_store.Table.of(ids)
    return table.packed(), token_store.encode_blocks(ids, table)


def test_token_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 5, token_store.BLOCK, token_store.BLOCK + 1, 9000):
        for ids in (rng.integers(0, 65536, n), rng.integers(0, 3, n), np.zeros(n, int), np.minimum(rng.zipf(1.3, n), 49407), np.full(n, 65535)):
            packed, blocks = coded(ids.astype(np.uint32))
            assert (token_store.decode_blocks(blocks, n, token_store.Table.unpacked(packed)) == ids).all()
    ids = np.minimum(rng.zipf(1.3, n), 49407).astype(np.uint32)
    packed, blocks = coded(ids)
    table = token_store.Table.unpacked(packed)
    for i, block in enumerate(blocks):  # every block starts anew, so it can be decoded by itself
        alone = ids[i * token_store.BLOCK : (i + 1) * token_store.BLOCK]
        steps = min(token_store.BLOCK, n)
        assert (token_store.decode_blocks([block], len(alone), table) == alone).all() and len(alone) <= steps
    assert sum(map(len, coded(np.tile(np.arange(50), 400).astype(np.uint32))[1])) < 20_000 / 4
    damaged = [blocks[0][:9] + bytes([blocks[0][9] ^ 1]) + blocks[0][10:], *blocks[1:]]
    with pytest.raises(ValueError):
        token_store.decode_blocks(damaged, n, table)
    for broken in (packed[:-1], packed[:9] + bytes([packed[9] ^ 1]) + packed[10:], b"\0\0\0\1" + packed[4:]):
        with pytest.raises(ValueError):
            token_store.Table.unpacked(broken)
    with pytest.raises(ValueError):
        token_store.Table.of(np.array([1 << 16]))


def test_token_predictions_beat_order_0():
    """Files, their tables included, are smaller than a code that knows how often each id is met; blocks of one id cost next to nothing."""
    import pyarrow.parquet as pq

    column = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")["text"]
    ids = np.concatenate(list(encode(WORD_BPE, column, False, 2)))
    share = np.bincount(ids)[ids] / len(ids)
    packed, blocks = coded(ids)
    assert 8 * (len(packed) + sum(map(len, blocks))) < 0.96 * -np.log2(share).sum()
    assert (token_store.decode_blocks(blocks, len(ids), token_store.Table.unpacked(packed)) == ids).all()
    assert sum(map(len, coded(np.full(20_000, 7, np.uint32))[1])) < 20_000 / 40


def test_token_files_are_small():
    """Order 1 knows the segment, not only the block: under 0.94 of a code that knows how often each id is met (0.947 before)."""
    import pyarrow.parquet as pq

    column = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")["text"]
    ids = np.concatenate(list(encode(WORD_BPE, column, False, 2)))
    packed, blocks = coded(ids)
    assert 8 * (len(packed) + sum(map(len, blocks))) < 0.94 * -np.log2(np.bincount(ids)[ids] / len(ids)).sum()
    # Ids that are rare, and predictions that fail after they held long, take the most words at once.
    for ids in (np.r_[np.zeros(70_000, int), 1 + np.arange(49_000)], np.r_[np.arange(49_000), np.zeros(70_000, int)], np.tile(np.r_[np.full(900, 5), np.arange(300)], 40)):
        packed, blocks = coded(ids.astype(np.uint32))
        assert (token_store.decode_blocks(blocks, len(ids), token_store.Table.unpacked(packed)) == ids).all()


def test_solid_pieces():
    """Pieces found over bytes are the library's, at the ends of texts too; words met before are not encoded again."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    library.encode_special_tokens = True
    rng = np.random.default_rng(7)
    parts = ["'", "'s", "'RE", "'v", "e", "ll", "'d7", "12", " ", "\n", "\u3000", "\u00a0", "é", "e\u0301", "ß", "\u01f0", "Σ", "字", "\U0001f600", "\u0301", "²", "½", "-", '"', "<|endoftext|>", "Ab", ""]
    rows = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(4000)]
    for _ in range(2):
        got = [x.tolist() for x in encode(WORD_BPE, pa.array(rows), False)]
        assert got == [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


def test_token_files(docs, corpus, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    library.encode_special_tokens = True
    want, at = {}, 0
    for i, t in sorted(corpus):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r[0]: tuple(r[1:]) for r in token_store.token_files(docs, WORD_BPE).collect()} == want
    assert token_store.token_files(odd, WORD_BPE).count() == len(ODD)


@pytest.mark.parametrize(("path", "spaced"), [(BYTE_BPE, True), (WORD_BPE, False)])
def test_token_ids(path, spaced):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(3)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'", "''", "a", "B", "1", "23", "é", "ß", "日本", "  ", " ", "\n", "\t", "!", "..", "'S", "Σ", "ΑΣ", "İ", "é", "😀", "½", "\x1c", "\x85", "<|endoftext|>", "_"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(1500)] + ["", None, " ", "\n\n"]
    got = [x.tolist() for x in encode(path, pa.array(rows), spaced)]
    assert got == [x.ids for x in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(n for n in Q.queries() if n != "op6_toxicity"))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert Q.queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline as P

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER).cache()
        assert kept.columns == docs.columns, name
        ids, was = ({r[0] for r in df.select("doc_id").collect()} for df in (kept, before))
        assert ids <= was
        if name == "toxicity":
            flagged = {r["doc_id"] for r in Q.op6_toxicity(spark, FOLDER).where("predicted = 1").collect()}
            assert was - ids == flagged and len(labels) > 0
        rows = [(r["doc_id"], r["text"] or "") for r in before.collect()]
        if name == "exact dedup":
            best = {}
            for i, t in rows:
                k = t.translate({c: None for c in (32, 9, 10, 11, 12, 13)})
                best[k] = min(best.get(k, (1, 0)), (-len(t), i))
            assert ids == {i for _, i in best.values()}
        if name == "n-gram Jaccard join":
            assert ids == {i for i, (_, c) in brute_components(rows).items() if i == c}
        if name == "substring dedup":
            want = brute_repeats(rows, 20)
            assert ids == was and {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {i: (t, len(t)) for i, (_, _, t) in want.items()}
    packed = P.STAGES[-1][1](spark, kept, FOLDER).collect()
    check_packing(packed, 1024)
    assert {r["doc_id"] for r in packed} == {r[0] for r in kept.select("doc_id").collect()}
    assert P.run(spark, FOLDER).count() == len(packed)


def one_process_scores(rows, taught):
    """log10 probabilities by a tree over all training symbols at once; what stands before a position is what _symbols says."""
    texts_ = [lower(t) for _, t in rows]
    data, at = np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0, *map(len, texts_)])
    symbols, bounds = lm_score._symbols(data, at)
    train = np.repeat([taught(i) for i, _ in rows], np.diff(bounds))
    levels = [np.unique(symbols[train] & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(lm_score.DEPTH + 1)]
    tree = Tree(levels)
    # A symbol's six bytes as a text, less its first five.
    distinct, back = np.unique(symbols, return_inverse=True)
    path = (distinct[:, None] >> (np.uint64(8) * np.arange(lm_score.DEPTH, -1, -1, dtype=np.uint64)) & np.uint64(0xFF)).astype(np.uint8)

    def score(x):
        ends = np.arange(1, len(x) + 1) * x.shape[1]
        return tree.score(x.ravel(), ends - x.shape[1], ends)

    return np.add.reduceat((score(path) - score(path[:, :-1]))[back], bounds[:-1])


def test_lm_drops_no_context(spark, corpus, monkeypatch):
    """A context seen once in a large corpus still counts, and shards and batches give what one tree over all counts gives."""
    monkeypatch.setattr(lm_score, "BATCH", 100_000)
    monkeypatch.setattr(lm_score, "SHARD", 100_000)
    taught = lambda i: (i % 7 != 2) & (i != 10_002)

    def scores(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return {r["doc_id"]: r["score"] for r in lm_score.lm_score(df, taught).collect()}

    rows = [*corpus, (10_001, "qzxwvk"), (10_002, "qzxwvk")]
    seen = scores(rows)
    assert [seen[i] for i, _ in rows] == pytest.approx(one_process_scores(rows, taught).tolist(), rel=1e-4)
    assert seen[10_002] > scores([*corpus, (10_001, "other"), (10_002, "qzxwvk")])[10_002] + 3


def test_lm_sees_over_white_space(spark):
    """The same words in another order, each with the same white space behind it, are less likely."""
    prose = "the cat sat on the mat and the dog ran to the door "
    rows = [*((i, prose) for i in range(50)), (100, prose), (101, "mat dog the door ran and the sat cat the to on the ")]
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), lambda c: c < 100).collect()}
    assert sorted(rows[-1][1].split()) == sorted(prose.split()) and got[100] > got[101] + 5


def test_licenses_over_line_ends(spark):
    """Notices that are wrapped are found; their words scattered over a long text are not."""
    grant = license_scan.TEMPLATES["notice:mit-grant"].split()
    wrapped = "words before\n * " + "\n * ".join(" ".join(grant[i : i + 5]) for i in range(0, len(grant), 5)) + "\nwords after"
    scattered = " ".join(f"{w} " + "filler " * 30 for w in license_scan.TEMPLATES["notice:cc-by-nc-4.0"].split())
    df = spark.createDataFrame([(1, wrapped), (2, scattered), (3, wrapped + "\n" + wrapped)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    assert (got[1]["labels"], got[1]["score"], len(got[1]["matches"])) == ("notice:mit-grant", 1.0, 1)
    assert (got[1]["matches"][0]["start"], got[1]["matches"][0]["end"]) == (2, 2 + len(grant))
    assert (got[2]["labels"], got[2]["score"]) == ("", 0.0)
    assert len(got[3]["matches"]) == 2


def _thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_by_arithmetic(spark):
    """Long words and runs of two letters or words, whose polynomial hashes modulo 2**64 would be equal."""
    a, b = _thue_morse(1024, "ab"), _thue_morse(1024, "ba")
    words = Words(*texts(pa.array([f"{a} {b}", a[:40], b[:40]])))
    for lane in (0, 1):
        assert len(set(words.hashes(lane).tolist())) == 4
    from tokenizers import Tokenizer

    for path, spaced in ((BYTE_BPE, True), (WORD_BPE, False)):
        library = Tokenizer.from_file(path)
        assert [x.tolist() for x in encode(path, pa.array([a, b]), spaced)] == [library.encode(t, add_special_tokens=False).ids for t in (a, b)]
    common = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {common}"), (2, f"{b} {common}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {0}
    assert {r["decoded"] for r in bpe.encode_decode(df, BYTE_RANKS).collect()} == {t.encode() for _, t in rows}


@pytest.mark.parametrize("texts_", [[" ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))], ["one two", "three"], [" ".join(f"a{i}" for i in range(30))], [None]])
def test_substring_dedup_without_repeats(spark, texts_):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string").coalesce(1)
    assert [(r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(df).orderBy("doc_id").collect()] == [(0, (t or "").strip()) for t in texts_]


def test_ids_of_characters_newer_than_python_tables():
    from tokenizers import Tokenizer

    texts_ = [f"ab{chr(c)}cd {chr(c)}É x" for c in (0x105E4, 0x10D5B, 0x11BC2, 0x134AA, 0x1C89, 0x0378)]
    for path, spaced in ((BYTE_BPE, True), (WORD_BPE, False)):
        library = Tokenizer.from_file(path)
        assert [x.tolist() for x in encode(path, pa.array(texts_), spaced)] == [library.encode(t, add_special_tokens=False).ids for t in texts_]


def test_segments_take_linear_time_and_law_fits_clean_text(spark):
    import time

    began = time.time()
    assert len(toxicity.segments(np.tile([1.0, -2.0], 200_000))) == 200_000
    assert len(toxicity.segments(np.tile([2.0, -1.0], 200_000))) == 1
    assert time.time() - began < 20
    # Best scores drawn from the law itself, those below zero seen as none.
    rng = np.random.default_rng(4)
    n, rate, k = rng.integers(50, 500, 40_000), 1.5, 0.02
    best = np.log(k * n / -np.log(rng.random(len(n)))) / rate
    law = toxicity.Law(np.maximum(best, 0), n)
    assert abs(law.rate - rate) < 0.05 and abs(math.exp(law.log_k) - k) < 0.002
    assert abs(law.surprise(6.0, 100) + math.log(-math.expm1(-k * 100 * math.exp(-rate * 6.0)))) < 0.3
    nothing = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.toxicity(nothing, nothing, lambda c: c > 0).collect() == [] and toxicity.clean_documents(nothing, nothing, lambda c: c > 0).collect() == []
