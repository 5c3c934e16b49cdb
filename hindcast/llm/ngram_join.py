"""N-gram Jaccard join: link documents whose sets of word 5-grams overlap by 75 % of their union or more; group by links.

Parity-sketch join. A set is cut into M segments by hash; each segment is a wide bit sketch into which every member flips
one bit, kept as the XOR of its members' random 64-bit values. A member that only one of two sets has changes one segment,
so the number of unequal segments is at most the symmetric difference. Two linked sets of sizes a and b differ in at most
(a+b)*(100-p)/(100+p) members, and M is larger than that for its size band, so at least one segment is equal: documents
that share (band, segment, sketch) are the candidates, and nothing linked is missed. Each set enters the band of its own
size and, where a larger partner may stand in the next band, that one too.

An empty segment carries no key. Where a set fills too few segments to rule out that every filled one was hit (short sets,
mostly), it also enters its (100-p) % + 1 smallest members as keys; two such sets share one of them if they link.

Candidates are not expanded into pairs. Each bucket has a pivot, the smallest document of its smallest component. First every document is checked
against the pivot it shares most segments with; links become components; buckets whose documents are of one component are
done. A set with s keys in a band, of which a link may change d, shares s - d of them or more: of the buckets that are left,
each document leaves its s - d - 1 largest, in one order of all keys, so that the smallest it shares with a link stays. Then
the documents of the buckets that are left are checked against the pivots of all their buckets, each pair once and at most
one a bucket's row. From then on a bucket keeps its pivot, whatever components become one, so once is enough.

What is left then are documents of different components that share a bucket, each known not to link with its pivot P or to be
of P's component. In blocks of 1024 x 1024 rows, dense sketches (their Hamming distance is at most the symmetric difference
too) tell which documents may link with any other of the bucket; no row is made of a pair. For these, what all have in
common with P is taken away: with A' and B' the symmetric differences of A and B with P, A and B link only if A' and B' share
(|A'| + |B'| - d) / 2 members or more, where |B'| is at least what not linking with P asks for. So the members of A' are
keys, and again each document leaves as many of its largest buckets as it can spare. Near copies of one text whose changes
differ share no key then. Documents that share one meet in blocks of 256 x 256 rows. All links are verified on the sets.

Copies (equal sets) are grouped by a 128-bit hash before any of this, and the smallest document of each takes part alone.

Defined results: A-Z is lower-cased, words are `[^\\x20\\x09-\\x0D]+`; a text of one to four words has one member, the
whole; a null or empty text, or one without words, has an empty set, links with nothing and is its own component. Members
are 64-bit hashes of 5-grams. A row without doc_id is returned with a null component and compared with nothing. Rows that
repeat a doc_id are one document. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._components import components
from hindcast.llm._shared import discard, documents, stored
from hindcast.llm._words import LOWER, Words, long_column, mix, runs, slices, texts

#: Rows of a block: of sketches, and of whole sets.
SKETCHES, SETS = 1024, 256
#: Bytes of text that are cut into words at once: workers keep what they have used.
SLICE = 1 << 20
FILTER_BITS = 1 << 20
SALTS = 32
#: The last three bits of a key tell what it is made of: the segments of a band (its number modulo 7), or a member (7).
KINDS = 8


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row number, doc_id, sorted members of each text."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    data, at = texts(batch.column("text"))
    for low, high in slices(at, SLICE):
        words = Words(LOWER[data[at[low] : at[high]]], at[low : high + 1] - at[low])
        h = words.hashes()
        grams, first = runs(h, n), words.first.tolist()
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                yield low + i, int(ids[low + i]), np.unique(grams[a : b - n + 1])
            elif b > a:
                yield low + i, int(ids[low + i]), runs(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield low + i, int(ids[low + i]), np.zeros(0, np.uint64)


def _class_of(members: np.ndarray) -> tuple[int, int]:
    if not len(members):
        return 0, 0
    return int(np.bitwise_xor.reduce(mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)))), int(mix(members ^ np.uint64(0x3C3C3C3C3C3C3C3C)).sum())


def _profile(n: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, a, b = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            sketches, spares, bands = [b""] * batch.num_rows, [[]] * batch.num_rows, Bands(percent)
            for i, _, members in _sets(batch.set_column(0, "doc_id", pa.array(np.zeros(batch.num_rows, np.int64))), n):
                size[i], (a[i], b[i]) = len(members), _class_of(members)
                if len(members):
                    sketches[i], spares[i] = _sketch(members).tobytes(), _spares(members, bands)
            columns = [batch.column("doc_id"), pa.array(size), long_column(a), long_column(b), pa.array(sketches, pa.binary()), pa.array(spares, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class_a", "class_b", "sketch", "spares"])

    return task


class Bands:
    """Size bands: the number of segments for pairs whose larger set has at most top[g] members."""

    def __init__(self, percent: int):
        self.p = percent
        self.top = [1]

    def of(self, size: int) -> int:
        while self.top[-1] < size:
            self.top.append(max(self.top[-1] + 1, self.top[-1] * 16 // 9))
        return int(np.searchsorted(self.top, size))

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.p) // (100 + self.p)

    def segments(self, g: int) -> int:
        most = self.differ(self.top[g], self.top[g])
        return most + most // 20 + 1

    def entered(self, size: int) -> range:
        """The bands that a set of this size enters: its own, and those of partners that are larger."""
        return range(self.of(size), self.of(size * 100 // self.p) + 1)

    def most_unequal(self, size: int, g: int) -> int:
        """How many segments of a set differ, at most, from those of a set in band g that it links with."""
        return self.differ(size, min(self.top[g], size * 100 // self.p))


def _segments(members: np.ndarray, m: int) -> np.ndarray:
    return (members >> np.uint64(20)) % np.uint64(m)


def _spares(members: np.ndarray, bands: Bands) -> list[int]:
    """For each band of a set: how many of its keys there can be left out so that it still shares one with all that it links with, << 3 | kind of key."""
    entered = bands.entered(len(members))
    filled = {g: int(np.count_nonzero(np.bincount(_segments(members, bands.segments(g)).astype(np.int64)))) for g in entered}
    return [max(0, filled[g] - bands.most_unequal(len(members), g) - 1) * (len(entered) < KINDS) << 3 | g % (KINDS - 1) for g in entered]


def _of_kind(keys: np.ndarray, kind: int) -> np.ndarray:
    return keys & ~np.uint64(KINDS - 1) | np.uint64(kind)


def _segment_keys(members: np.ndarray, bands: Bands) -> np.ndarray:
    size, keys, short = len(members), [], False
    for g in bands.entered(size):
        segment = _segments(members, bands.segments(g))
        order = np.argsort(segment, kind="stable")
        ranked = segment[order]
        begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        sketch = np.bitwise_xor.reduceat(mix(members)[order], begins)
        keys.append(_of_kind(mix(sketch ^ mix(ranked[begins] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(g + 1))), g % (KINDS - 1)))
        short |= len(begins) <= bands.most_unequal(size, g)
    if short:
        keys.append(_of_kind(mix(members[: size * (100 - bands.p) // 100 + 1] ^ np.uint64(0x517CC1B727220A95)), KINDS - 1))
    return np.concatenate(keys)


def _keys(n: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            seen, keys, docs, sizes = set(), [], [], []
            for _, doc, members in _sets(batch, n):
                kind = _class_of(members)
                if not len(members) or kind in seen:
                    continue
                seen.add(kind)
                k = _segment_keys(members, bands)
                keys.append(k), docs.append(doc), sizes.append(len(k))
                if sum(sizes[-64:]) > 1 << 20 or len(sizes) >= 2048:
                    yield pa.RecordBatch.from_arrays([long_column(np.concatenate(keys)), pa.array(np.repeat(np.array(docs, np.int64), sizes))], ["key", "doc_id"])
                    keys, docs, sizes = [], [], []
            if keys:
                yield pa.RecordBatch.from_arrays([long_column(np.concatenate(keys)), pa.array(np.repeat(np.array(docs, np.int64), sizes))], ["key", "doc_id"])

    return task


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that an id names, and few others: a bit map of fixed size (128 KB), made by a grouped OR, is broadcast as rows of 64 bits."""
    bit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FILTER_BITS))
    slot, mask = F.shiftright(bit, 6).alias("slot"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc_id), {FILTER_BITS}) & 63 AS int))")
    known = ids.select(slot, mask.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("bits"))
    return docs.withColumn("slot", slot).join(F.broadcast(known), "slot").where(F.col("bits").bitwiseAND(mask) != 0).select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents that no row of `gone` names. A bit map of eight bits a row or more (up to 2**26 in all) tells of most that they
    stay, where they lie; the others, with their texts, are joined."""
    size = max(FILTER_BITS, min(1 << 26, 1 << (8 * gone.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(size))
    slot, mask = F.shiftright(bit, 6).alias("slot"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc_id), {size}) & 63 AS int))")
    known = gone.select(slot, mask.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("bits"))
    marked = docs.withColumn("slot", slot).join(F.broadcast(known), "slot", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(mask) != 0, F.lit(False)))
    return marked.where("NOT maybe").select(*docs.columns).union(marked.where("maybe").select(*docs.columns).join(gone, "doc_id", "left_anti"))


def _sketch(members: np.ndarray) -> np.ndarray:
    """The parity sketch as 64-bit words, two bits or more for each member, a power of two in all."""
    bits = max(256, 1 << (2 * len(members) - 1).bit_length())
    return np.packbits((np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same sketch in fewer bits: members that fall together flip the same bit."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _chosen_sets(n: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes, packed = [], [], []
            for _, doc, members in _sets(batch, n):
                docs.append(doc), sizes.append(len(members)), packed.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "size", "packed"])

    return task


def _plausible(percent: int):
    """Pairs whose sizes and sketches allow a link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b"))
            keep = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("sketch_a", "sketch_b"))
                w = min(len(x), len(y))
                far = int(np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum())
                keep[i] = far <= (size_a[i] + size_b[i]) * (100 - percent) // (100 + percent)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return task


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                keep.append(_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return task


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows as columns, cut so that a run of equal `by` is never split."""
    rest = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in now}
        n = len(now[by[0]])
        if not n:
            continue
        last = np.ones(n, bool)
        for c in by:
            last &= now[c] == now[c][-1]
        cut = int(np.argmax(last))
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
        rest = {c: v[cut:] for c, v in now.items()}
    if rest is not None:
        yield rest


def _near(g: dict[str, np.ndarray], sketches: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within the blocks' groups that components, sizes and sketches allow, some hundred thousand at a time."""
    n, size, comp = len(g["doc_id"]), g["size"], g["comp"]
    new = np.r_[True, (g["key"][1:] != g["key"][:-1]) | (g["p"][1:] != g["p"][:-1]) | (g["q"][1:] != g["q"][:-1])]
    group = np.cumsum(new) - 1
    end = np.r_[np.flatnonzero(new)[1:], n][group]
    # Rows are in the order of doc_id, so block p stands before block q: a row of p meets the rows of q that follow it.
    mine = g["block"] == g["p"]
    other = g["p"] != g["q"]
    first = np.where(other, np.flatnonzero(new)[group] + np.bincount(group, weights=mine)[group].astype(np.int64), np.arange(n) + 1)
    partners = np.where(mine, end - first, 0)
    words = np.array([len(x) for x in sketches])
    level = {int(w): np.flatnonzero(words >= w) for w in np.unique(words)}
    folded = {w: (np.cumsum(words >= w) - 1, np.stack([_fold(sketches[i], w) for i in rows.tolist()])) for w, rows in level.items()}
    total, low = np.r_[0, np.cumsum(partners)], 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(total, total[low] + (1 << 19), "right")) - 1)
        i = np.repeat(np.arange(low, high), partners[low:high])
        j = np.arange(len(i)) - np.repeat(total[low:high] - total[low], partners[low:high]) + first[i]
        ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        shared = np.minimum(words[i], words[j])
        for w, (place, matrix) in folded.items():
            x, y = i[shared == w], j[shared == w]
            for a in range(0, len(x), 1 << 14):
                u, v = x[a : a + (1 << 14)], y[a : a + (1 << 14)]
                far = np.bitwise_count(matrix[place[u]] ^ matrix[place[v]]).sum(axis=1, dtype=np.int64)
                close = far <= (size[u] + size[v]) * (100 - percent) // (100 + percent)
                if close.any():
                    yield u[close], v[close]
        low = high


def _near_rows(percent: int, told_of: tuple[str, ...] = ("pivot", "doc_id")):
    """Rows of each block whose sketch allows a link with another of it, of a different component; of a pivot, each document once a task.
    told_of: the columns that tell so."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple] = set()
        for g in _whole_groups(batches, ["key", "p", "q"]):
            near = np.zeros(len(g["doc_id"]), bool)
            for i, j in _near(g, [np.frombuffer(x, np.uint64) for x in g["packed"]], percent):
                near[i] = near[j] = True
            rows = {*zip(*(g[c][near].tolist() for c in told_of), strict=True)} - told
            told = told | rows if len(told) < 1 << 18 else rows
            if rows:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*sorted(rows), strict=True))], [*told_of])

    return task


def _apart(percent: int):
    """Members that one of a document and its pivot has, as keys, and how many of them may be left out: see the module's text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for doc, outside, x, y in zip(batch.column("doc_id").to_pylist(), batch.column("outside").to_pylist(), batch.column("set_a"), batch.column("set_b"), strict=True):
                own, pivot = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                n, p, rest = len(own), len(pivot), np.setxor1d(own, pivot, assume_unique=True)
                partners = np.arange(-(-n * percent // 100), n * 100 // percent + 1)
                most = (n + partners) * (100 - percent) // (100 + percent)
                # Partners that are not of the pivot's component are no links of the pivot either; those that are meet documents that are not.
                shared = len(rest) + (partners + p) * (100 - percent) // (100 + percent) + 1 - most
                if outside:
                    shared = np.minimum(shared, len(rest) + np.maximum(0, len(rest) - most) - most)
                spare = max(0, -(-int(shared.min()) // 2) - 1)
                family = _class_of(pivot)[0]
                keys = mix(rest ^ mix(np.array([family], np.uint64)))
                yield pa.RecordBatch.from_arrays([long_column(np.full(len(keys), family, np.uint64)), pa.array(np.full(len(keys), doc)), long_column(keys), pa.array(np.full(len(keys), spare))], ["family", "doc_id", "key", "spare"])

    return task


def _block_links(percent: int):
    """Pairs of different components in each block that link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, ["key", "p", "q"]):
            members, doc, found = [np.frombuffer(x, np.uint64) for x in g["packed"]], g["doc_id"], set()
            for i, j in _near(g, [_sketch(x) for x in members], percent):
                found |= {(doc[a], doc[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True) if _linked(members[a], members[b], percent)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(found), strict=True)], ["a", "b"])

    return task


def ngram_components(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    docs = documents(df, id_col=id_col, text_col=text_col)
    named = docs.where("doc_id IS NOT NULL")
    profile = stored(docs.mapInArrow(_profile(n, percent), "doc_id long, n_shingles long, class_a long, class_b long, sketch binary, spares array<long>"), "profile")
    sized = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    leaders = sized.groupBy("class_a", "class_b", "n_shingles").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # A class may hold much of the corpus: its rows are dealt over SALTS tasks, and its leader is sent to each.
    salted = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = sized.select("doc_id", "class_a", "class_b", "n_shingles", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    links = stored(copies.join(salted, ["class_a", "class_b", "n_shingles", "salt"]).select(F.col("doc_id").alias("a"), "b").where("a <> b"), "links")

    per_key = Window.partitionBy("key")
    # A copy that isn't its class's leader has the leader's links, so it needs no keys; ids that several sets share keep theirs.
    kind = F.struct("class_a", "class_b", "n_shingles")
    single = sized.groupBy("doc_id").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).where("low = high")
    gone = stored(links.select(F.col("a").alias("doc_id")).distinct().join(single, "doc_id", "left_semi"), "gone")
    keys = _without(named, gone).mapInArrow(_keys(n, percent), "key long, doc_id long")

    def plausible(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sized.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
        return pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_plausible(percent), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
        sets = _wanted(named, ids).mapInArrow(_chosen_sets(n), "doc_id long, size long, packed binary").drop("size")
        left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("packed").alias("set_a")), "a")
        return left.join(sets.select(F.col("doc_id").alias("b"), F.col("packed").alias("set_b")), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")

    def thinned(left: DataFrame) -> DataFrame:
        """The rows without those of each document's most shared keys, as many as it can spare in each band: documents that link share
        more, in one order of keys, so the least shared of theirs stays in both."""
        spares = sized.select("doc_id", F.explode("spares").alias("spare")).groupBy("doc_id", F.col("spare").bitwiseAND(KINDS - 1).alias("kind")).agg(F.min(F.shiftright("spare", 3)).alias("spare"))
        ranked = Window.partitionBy("doc_id", "kind").orderBy(F.col("n").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
        so_far = left.withColumn("kind", F.col("key").bitwiseAND(KINDS - 1)).withColumn("so_far", F.sum("same").over(ranked))
        return so_far.join(spares, ["doc_id", "kind"], "left").where(F.col("so_far") > F.coalesce("spare", F.lit(0))).select("key", "doc_id", "same")

    def unresolved(rows: DataFrame) -> DataFrame:
        """Rows of buckets that hold documents of several components, with the bucket's pivot, which stays if rows name one; of buckets
        that hold the same documents, one of each kind of key, and how many it stands for: those of one number of rows, XOR of hashes
        (in which an id that occurs twice cancels) and sum of others (in which it doesn't)."""
        pivot = F.struct("comp", "doc_id")
        pivot = F.when(F.col("doc_id") == F.col("pivot"), pivot) if "pivot" in rows.columns else pivot
        comp = "comp" if "comp" in rows.columns else "doc_id"
        spread = rows.withColumns({"low": F.min(comp).over(per_key), "high": F.max(comp).over(per_key)}).where("low < high").drop("low", "high")
        if comp == "doc_id":  # no link is known yet: all keys are shuffled without what follows from them
            spread = spread.withColumns({"comp": F.col("doc_id"), "same": F.lit(1).cast("long")})
        first = spread.withColumns({"pivot": F.min(pivot).over(per_key), "n": F.count(F.lit(1)).over(per_key), "alike": F.expr("bit_xor(xxhash64(doc_id))").over(per_key), "weight": F.sum(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 31))).over(per_key)})
        kind = F.col("key").bitwiseAND(KINDS - 1).alias("kind")
        once = first.groupBy("n", "alike", "weight", kind, "doc_id", "comp", F.col("pivot.doc_id").alias("pivot"), F.col("pivot.comp").alias("pivot_comp")).agg(F.min("key").alias("key"), F.sum("same").alias("same"))
        return once.select("key", "doc_id", "comp", "pivot", "pivot_comp", "n", "same")

    def with_comps(rows: DataFrame, comps: DataFrame, *more: str) -> DataFrame:
        return rows.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "same", F.coalesce("component", "doc_id").alias("comp"), *more)

    def merged(comps: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components of all links so far: those known are stars, which say as much as the links that they came from."""
        return components(found.union(comps.select("id", "component") if comps is not None else links))

    # Before any link is found every document stands for itself.
    left = stored(unresolved(keys), "buckets")
    discard(gone)
    comps, tried = None, None
    for first in (True, False):
        if left.head() is None:
            break
        shared = left.where("comp <> pivot_comp").groupBy(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        if first:
            best = shared.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("inverse"))).alias("best"))
            asked = tried = stored(best.select("a", (-F.col("best.inverse")).alias("b")), "tried")
        else:
            asked = shared.select("a", "b").join(tried, ["a", "b"], "left_anti")
        pairs = stored(plausible(asked), "pairs")
        comps = merged(comps, stored(verified(pairs), "links"))
        discard(pairs)
        # The first answers leave few of the buckets that near copies share; what is shared beyond them is thinned out, once.
        older, left = left, stored(unresolved(with_comps(thinned(left), comps) if first else with_comps(left, comps, "pivot")), "left")
        discard(older)

    if left.head() is not None:

        def blocks(rows: DataFrame, members: DataFrame, size: int) -> DataFrame:
            """All rows of a key meet in blocks, in the order of doc_id."""
            rank = F.row_number().over(per_key.orderBy("doc_id")) - 1
            placed = rows.withColumn("block", F.floor(rank / size).cast("int")).withColumn("most", F.max("block").over(per_key))
            paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("most")))).select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "doc_id", "comp", "pivot", (F.col("comp") != F.col("pivot_comp")).alias("outside"))
            return paired.join(members, "doc_id").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "doc_id")

        sketches = sized.select("doc_id", F.col("n_shingles").alias("size"), F.col("sketch").alias("packed"))
        near = stored(blocks(left, sketches, SKETCHES).mapInArrow(_near_rows(percent, ("pivot", "doc_id", "outside")), "pivot long, doc_id long, outside boolean").distinct(), "near")
        ids = near.select("doc_id").union(near.select("pivot")).distinct()
        sets = stored(_wanted(named, ids).mapInArrow(_chosen_sets(n), "doc_id long, size long, packed binary").join(ids, "doc_id", "left_semi"), "sets")
        facing = near.join(sets.select("doc_id", F.col("packed").alias("set_a")), "doc_id").join(sets.select(F.col("doc_id").alias("pivot"), F.col("packed").alias("set_b")), "pivot")
        apart = stored(facing.select("doc_id", "outside", "set_a", "set_b").mapInArrow(_apart(percent), "family long, doc_id long, key long, spare long").groupBy("family", "doc_id", "key").agg(F.min("spare").alias("spare")), "apart")
        counts = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        ranked = Window.partitionBy("family", "doc_id").orderBy(F.col("n").desc(), "key")
        least = F.min("spare").over(Window.partitionBy("family", "doc_id"))
        kept = apart.join(counts, "key").withColumn("rank", F.row_number().over(ranked)).withColumn("least", least).where("rank > least AND n > 1")
        left_apart = stored(unresolved(with_comps(kept.select("key", "doc_id", F.lit(1).cast("long").alias("same")), comps)), "left")
        comps = merged(comps, stored(blocks(left_apart, sets, SETS).mapInArrow(_block_links(percent), "a long, b long"), "links"))
        discard(near, sets, apart, left_apart, left)
    if comps is None:
        comps = components(links)
    else:
        discard(tried)
    return profile.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_per_component(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without those linked, directly or not, to a smaller doc_id; with all their columns."""
    found = ngram_components(df, n, percent, id_col, text_col)
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return df.join(gone, df[id_col].cast("long") == gone["_gone"], "left_anti")
