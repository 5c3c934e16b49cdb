"""What the main tests leave out: wrapped notices, the packing rule's choice, toxicity scores, media features, odd pipelines, long texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, check_packing

from hindcast.llm import bpe, exact_dedup, fim, license_scan, lm_score, media, ngram_join, packing, quality, substring_dedup, token_store, toxicity
from hindcast.llm import queries as Q
from hindcast.llm._shared import shared_dir
from hindcast.llm._words import PLAIN, Words, texts

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- op4


def brute_licenses(text):
    """A label where some window of so many consecutive words holds enough of a template's words, wherever lines end."""
    w = WORD.findall(lower(text))
    places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for name, template in license_scan.TEMPLATES.items():
        words = WORD.findall(lower(template))
        members = set(words)
        need, width = -(-license_scan.PERCENT * len(members) // 100), -(-100 * len(words) // license_scan.PERCENT)
        most = max((len(members & set(w[i : i + width])) for i in range(len(w))), default=0)
        if most >= need:
            labels.add(name)
            score = max(score, most / len(members))
    return len(w), len(places), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def test_wrapped_notices_by_windows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, template in sorted(license_scan.TEMPLATES.items()):
        words = template.split()
        for lost in (0.0, 0.1, 0.19, 0.21, 0.4):
            for wrap in (3, 11):
                kept = [x for x in words if rng.random() >= lost] + (["of", "things"] if lost else [])
                lines = "\n * ".join(" ".join(kept[i : i + wrap]) for i in range(0, len(kept), wrap))
                rows.append((len(rows), f"Some words before.\n * {lines}\n * and after " + "filler " * int(rng.integers(0, 40)) + " ".join(words[: int(rng.integers(0, 5))])))
        spread = " ".join(f"{x} filler" for x in words)
        rows += [(len(rows), spread), (len(rows) + 1, f"{template}\n{template}"), (len(rows) + 2, " ".join(sorted(words)))]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["base_labels"], r["labels"], pytest.approx(r["score"])) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any("," in v[3] for v in got.values()) or len(license_scan.TEMPLATES) > 1
    for i, text in rows:
        assert brute_licenses(text) == got[i], text


# ---------------------------------------------------------------- op5


def brute_sum_of_squares(lengths, capacity):
    """Every possible place is tried, and the whole sum is taken anew for each."""
    sequences = []
    for s in lengths:
        gaps = Counter(capacity - sum(x) for x in sequences if sum(x) < capacity)
        best = None
        for g in [*sorted(g for g in gaps if g >= s), capacity]:
            then = gaps.copy()
            if g < capacity:
                then[g] -= 1
            if g > s:
                then[g - s] += 1
            total = sum(n * n for n in then.values())
            if best is None or total < best[0]:
                best = total, g
        fit = [x for x in sequences if capacity - sum(x) == best[1]] if best[1] < capacity else []
        if fit:
            fit[-1].append(s)
        else:
            sequences.append([s])
    return sequences


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_takes_the_smallest_sum(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 17, 40]))
    lengths = rng.integers(1, capacity, 120).tolist()  # full pieces are not for the rule to place
    ours, brute = packing.sum_of_squares(lengths, capacity), brute_sum_of_squares(lengths, capacity)
    # Sequences with one gap are alike to the rule: what must agree is how full they are, all along.
    for n in (10, 40, 80, 120):
        a, b = (Counter(sum(x) for x in f(lengths[:n], capacity)) for f in (packing.sum_of_squares, brute_sum_of_squares))
        assert a == b
    assert sorted(x for y in ours for x in y) == sorted(lengths) and len(ours) == len(brute)


def test_plans_over_the_lower_bound():
    """Every piece is placed, and dividing large histograms costs no more than two parts in a hundred."""
    rng, over = np.random.default_rng(0), []
    for total in (3_000, 29_000, 100_000, 3_000_000):
        shares = rng.dirichlet(np.full(1023, 0.3))
        counts = {s + 1: int(n) for s, n in enumerate(np.round(shares * total)) if n >= 1}
        found = packing.plan(counts, 1024)
        placed = Counter()
        for many, lengths in found:
            placed.update({s: many * k for s, k in Counter(lengths).items()})
        assert placed == counts
        bound = math.ceil(sum(s * n for s, n in counts.items()) / 1024)
        over.append(sum(m for m, _ in found) / bound)
    assert max(over) < 1.08 and max(over[2:]) < over[1] + 0.02


# ---------------------------------------------------------------- op6


def chain(word):
    raw = word.encode()
    return [(n, raw[:n]) for n in toxicity.STEMS if len(raw) > n] + [(toxicity.WHOLE, raw)]


def brute_lexicon(rows):
    counts = defaultdict(lambda: [0, 0])
    for text, label in rows:
        for word in WORD.findall(lower(text)):
            for token in chain(word):
                counts[token][label] += 1
    whole = [c for (n, _), c in counts.items() if n == toxicity.WHOLE]
    good, bad = sum(c[0] for c in whole), sum(c[1] for c in whole)
    base = (bad + 1) / (good + bad + 2)

    def score(word):
        share, found = base, -toxicity.DRIFT
        for token in chain(word):
            if token not in counts:
                continue
            g, b = counts[token]
            share = min(max((b + toxicity.PRIOR * share) / (g + b + toxicity.PRIOR), toxicity.SURE), 1 - toxicity.SURE)
            odds = math.log(share / (1 - share)) - math.log(base / (1 - base))
            error = 1 / (share * (1 - share) * (g + b + toxicity.PRIOR))
            found = odds * max(0.0, 1 - error / max(odds * odds, 1e-12)) - toxicity.DRIFT
        return found

    return lambda text: [score(w) for w in WORD.findall(lower(text))]


def surprises(scores, law):
    return sum(law.surprise(s, len(scores)) for _, _, s in toxicity.segments(np.array(scores)) if law.surprise(s, len(scores)) >= -math.log(toxicity.SIGNIFICANT)) if scores else 0.0


def test_toxicity_scores_by_brute_force(spark):
    rng = np.random.default_rng(2)
    plain, nasty = ["the", "and", "house", "trees", "river", "walking", "blue", "stones", "cloudy"], ["idiots", "scumbag", "scumbags", "morons"]
    rows = []
    for i in range(300):
        w = [plain[k] for k in rng.integers(0, len(plain), rng.integers(3, 60))]
        for _ in range(int(rng.integers(2, 5)) if i % 4 == 0 else int(rng.random() < 0.1)):
            w.insert(int(rng.integers(0, len(w))), nasty[rng.integers(0, len(nasty))])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    taught = lambda c: c % 5 != 1
    half = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2))).collect()}
    known = [r for r in rows if taught(r[0])]
    halves = [brute_lexicon([(t, y) for i, t, y in known if half[i] == k]) for k in (0, 1)]
    best = [(max([s for _, _, s in toxicity.segments(np.array(w))], default=0.0), len(w)) for i, t, y in known if not y and (w := halves[1 - half[i]](t))]
    law = toxicity.Law(np.array([s for s, _ in best]), np.array([n for _, n in best]))
    bins = defaultdict(list)
    for i, t, y in known:
        value = surprises(halves[1 - half[i]](t), law)
        bins[math.floor(math.log1p(value) * 8)].append((value, y))
    a, b = toxicity._fit([(sum(v for v, _ in x) / len(x), len(x), sum(y for _, y in x)) for x in bins.values()])
    lexicon = brute_lexicon([(t, y) for _, t, y in known])
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, df, taught).collect()}
    for i, t, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(surprises(lexicon(t), law))))), rel=1e-3, abs=1e-5)


def test_much_met_toxic_words_keep_their_scores():
    """A word met hundreds of times in toxic rows only, under stems as sure as itself, is the surest sign there is."""
    words = {"pathetic": 600, "scum": 600, "vequaire": 5}
    counts = defaultdict(lambda: [0, 0])
    for word, times in words.items():
        for token in chain(word):
            counts[token][1] += times
    counts[toxicity.WHOLE, b"the"][0] += 20_000
    hashes = {}
    text = pa.array([" ".join([*words, "the"])])
    data, at = texts(text)
    for (level, which, h, parent) in toxicity._chains(Words(data, at, PLAIN)):
        for i, token, up in zip(which.tolist(), h.view(np.int64).tolist(), parent.view(np.int64).tolist()):
            raw = [*words, "the"][i].encode()
            hashes[token] = (level, up, *counts[level, raw if level == toxicity.WHOLE else raw[:level]])
    rows = [(level, token, up, good, bad) for token, (level, up, good, bad) in hashes.items()]
    lexicon = toxicity.Lexicon(*(np.array(c, np.int64) for c in zip(*rows)))
    scores = lexicon.of(Words(data, at, PLAIN))
    assert (scores[:3] > 2).all() and scores[3] < 0


# ---------------------------------------------------------------- op3


def test_byte_bpe_folds_a_piece_once(spark):
    """Pieces that several slices hold are one row of the fold; slices of several tasks get all their ids back."""
    import tiktoken

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [(i, f"zqxvk wqzjx the zqxvk{'q' * (i % 3)} " * (i % 4)) for i in range(60)] + [(None, "wqzjx"), (7, None), (8, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    met = {m for _, t in rows for m in re.findall(r" ?[a-z]+", t or "") if m.encode() not in bpe.read_ranks(path)}
    dealt = df.mapInArrow(bpe._cut(path, 4, False), "slice long, bucket int, counts binary, packed binary")
    assert dealt.select("slice").distinct().count() > 1
    words = dealt.repartition(4, "bucket").mapInArrow(bpe._distinct(path), "slice long, bucket int, order binary, word array<int>").where("slice IS NULL")
    assert words.count() == len(met)
    got = bpe.encode_decode(df, path).collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), bytes(r["decoded"])) for r in got) == sorted((str(i), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_byte_bpe_shuffles_few_bytes(spark):
    """What both cuts of a slice send on takes, by LZ4 as shuffles have it, a fifth of the texts at most; numbers come back as they were."""
    import public_tokenizers

    path, rng = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), np.random.default_rng(4)
    words = np.array(["".join(rng.choice([*"etaoinshrdluc"], rng.integers(2, 10))) for _ in range(6000)])
    rows = [(i, " ".join(words[np.minimum(rng.zipf(1.3, 3000), 6000) - 1])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kind = "slice long, bucket int, counts binary, packed binary"
    sent = df.mapInArrow(bpe._cut(path, 4, False), kind).collect() + df.mapInArrow(bpe._cut(path, 4, True), kind + ", tokens binary, docs array<long>").collect()
    size = sum(min(len(v), len(pa.compress(bytes(v), "lz4", asbytes=True))) for r in sent for v in r if isinstance(v, bytes | bytearray))
    assert size < 0.2 * sum(len(text) for _, text in rows)
    for numbers in ([], [0], [1, 70_000, 2**31 - 1] * 500):
        assert bpe._numbers(bpe._unpacked(pa.py_buffer(bpe._packed(bpe._planes(np.array(numbers, np.int64)))))).tolist() == numbers


# ---------------------------------------------------------------- op2


def test_media_features_and_shared_chunks(spark):
    rng = np.random.default_rng(1)
    shared, own = ("".join(chr(x) for x in rng.integers(97, 123, n)) for n in (60_000, 3_000))
    rows = [(1, shared), (2, own + shared), (3, shared + own), (4, "abc"), (5, None), (6, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in media.media_columns(df).collect():
        text = dict(rows)[r["doc_id"]] or ""
        samples = [*text.encode(), *bytes(max(1, -(-len(text) // 64)) * 64 - len(text))]
        x = [s - 128 for s in samples]
        bands = Counter(s >> 5 for s in samples)
        want = f"mean={sum(x) / len(x):.4f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.4f};peak={max(map(abs, x))};cross={sum((p < 0) != (q < 0) for p, q in zip(x, x[1:]))};bands=" + ",".join(f"{bands[k] / len(x):.4f}" for k in range(8))
        assert r["feature"] == want
    path = f"{shared_dir(spark)}/media-test-{rng.integers(1 << 40)}"
    payloads = df.select(media.payload(F.coalesce("text", F.lit(""))).alias("samples")).select(F.unhex(F.sha2("samples", 256)).alias("name"), "samples")
    media.store_media(payloads, path)
    held = spark.read.parquet(f"{path}/store").select(F.explode("held").alias("x")).select("x.digest", F.octet_length("x.bytes").alias("n")).collect()
    assert len({bytes(r["digest"]) for r in held}) == len(held)  # each chunk once
    assert sum(r["n"] for r in held) < 1.4 * (len(shared) + 2 * len(own))
    back = {bytes(r["name"]): r["payload_sha256"] for r in media.read_media(spark, path).collect()}
    assert {k.hex() for k in back} == set(back.values()) and len(back) == 5  # the sixth text is the first again


# ---------------------------------------------------------------- the pipeline


@pytest.fixture(scope="module")
def odd_documents(spark):
    rows = [(i, t, "en", f"s{k % 3}", len(t) if t is not None else None, "x", k) for k, (i, t) in enumerate([*ODD, *ODD[:4], (20, "idiot " * 30), (21, None)])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _gone string, component_id long")


def test_pipeline_on_odd_tables(spark, odd_documents):
    """Nulls in any column, repeated rows and ids, clashing names: every stage keeps the columns, and only what it should reject goes."""
    import corpus_pipeline as P

    kept = odd_documents
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER).cache()
        assert kept.columns == odd_documents.columns and kept.dtypes == odd_documents.dtypes, name
        ids, was = (Counter(r["doc_id"] for r in df.collect()) for df in (kept, before))
        assert not ids - was, name
        if name == "toxicity":
            assert set(was) - set(ids) <= {20}
        if name == "exact dedup":
            texts_ = [r["text"] or "" for r in kept.collect()]
            assert len({re.sub(r"[\x20\x09-\x0D]", "", t) for t in texts_}) == len(texts_)
        if name == "n-gram Jaccard join":
            assert None in ids and {3, 5} & set(ids)  # rows without an id, and without words, are linked with nothing
        if name == "substring dedup":
            assert ids == was
    packed = P.STAGES[-1][1](spark, kept, FOLDER).collect()
    check_packing(packed, 1024)
    assert len([r for r in packed if r["piece"] == 0]) == kept.count()


def test_pipeline_on_empty_tables(spark, odd_documents):
    import corpus_pipeline as P

    kept = odd_documents.limit(0)
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == odd_documents.columns and kept.count() == 0
    assert P.STAGES[-1][1](spark, kept, FOLDER).count() == 0


# ---------------------------------------------------------------- a text of several MB


def test_a_text_of_several_megabytes(spark):
    rng = np.random.default_rng(0)
    words = ["".join(chr(x) for x in rng.integers(97, 123, rng.integers(2, 12))) for _ in range(3000)]
    text = " ".join(words[k] + ("\n" if k % 17 == 0 else "") for k in rng.integers(0, 3000, 600_000))
    assert len(text) > 4_000_000
    df = spark.createDataFrame([(1, text), (2, text), (3, text[:1000]), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    every = lambda c: F.lit(True)
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["n_words"] for r in license_scan.license_scan(df.where("doc_id = 1")).collect()} == {len(WORD.findall(text))}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df, window=20).collect()}
    assert gone[2] == (600_000, 600_000) and gone[1][1] == 0 and gone[3][1] >= gone[3][0] - 20
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(df, labels, every).collect() + quality.quality(df, labels, every).collect())
    assert all(r["score"] < 0 for r in lm_score.lm_score(df, every).collect())
    found = fim.fill_in_middle(df)
    assert {r["doc_id"]: r["back"] for r in found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()}[1] == text
    assert {r["doc_id"]: r["bytes"] for r in media.media_columns(df).select("doc_id", F.col("n_bytes").alias("bytes")).collect()}[2] == len(text)
    rows = packing.packed_documents(df.where("doc_id <> 2"), Q.vocabulary("byte_bpe_50k.json"), with_ids=False).collect()
    check_packing(rows, 1024)
    files = {r["doc_id"]: r for r in token_store.token_files(df.where("doc_id <> 2"), Q.vocabulary("word_bpe_49k.json")).collect()}
    assert files[3]["start"] == files[1]["n_tokens"] and files[4]["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())
    decoded = bpe.encode_decode(df.where("doc_id = 1"), Q.vocabulary("byte_bpe_multi_50k.tiktoken")).select("decoded").first()[0]
    assert bytes(decoded).decode() == text


# ---------------------------------------------------------------- op3


def test_long_pieces_are_folded_as_the_library_merges_them(spark):
    """Pieces without white space of some thousand bytes, by the fold and, beyond its limit, by the heap."""
    import public_tokenizers
    import tiktoken

    path = Q.vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = np.random.default_rng(3)
    letters = lambda n, k: "".join(chr(97 + x) for x in rng.integers(0, k, n))
    rows = [(1, " ".join(letters(4000, 26) for _ in range(20))), (2, letters(bpe.LONG, 20)), (3, letters(bpe.LONG + 1, 20)), (4, "a" * 3000 + " " + "ab" * 2000), (5, letters(2000, 2) + "日本語" * 300)]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in rows}
