"""Byte-level BPE encoding and decoding with a rank file, as the tiktoken library would, without its special tokens.

Spark higher-order functions fold ranked merges over byte arrays of distinct words. Slices of documents are cut into pieces by
the split pattern; a piece that is a token as a whole is that token. The other pieces go, each distinct one of a slice once, to
a bucket by their CRC, where the pieces of all slices come as a row for each distinct one of the corpus, an array of single-byte
ids. `aggregate` merges, in each piece, the adjacent pair of lowest rank until no pair has a rank. The ids go back to the slices,
which put them into the order of their documents. Decoding concatenates the tokens' bytes.

The rank map is a literal of the plan: two arrays that form a perfect hash table of all pairs (a, b) of tokens whose bytes
together are a token. A pair belongs to one of many groups of few pairs; each group has a shift such that no two pairs share
a place, which holds a << 32 | b << 16 | rank. A lookup is two reads and a XOR with the pair, which leaves the rank, or a
number beyond all ranks. (Spark looks a map literal up by scanning it.)

Scale: a piece is folded once, however many slices hold it. Distinct pieces of slices, their ids, and the order of pieces in
each slice are shuffled, packed as bytes and compressed by zstd; texts are read and cut twice instead of being shuffled. There are twice as many buckets as
input partitions, so memory is a slice's or a bucket's. A step of
the fold copies a piece's ids, so long pieces take time in the square of their length (4,000 bytes a third of a second);
pieces of over LONG bytes would take minutes to hours, so a heap merges them beforehand: the same merges in the same order.

Defined results: a null or empty text has no ids. Rows are returned as often as they occur, a null doc_id too. An empty table
gives an empty result; other columns are ignored. Ids must be below 65536.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import documents, give_back
from hindcast.llm._tokens import Pieces, spread
from hindcast.llm._words import slices, texts

#: Bytes of a slice, whose distinct pieces are sent on, and of text that is cut into pieces at once: workers keep what they have used.
SLICE, PART = 4 << 20, 1 << 20
SHORT, LONG = 40, 16_384
NONE = 1 << 16
_made: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def all_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of each pair of tokens whose bytes together are a token."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


class RankMap:
    """pairs: rank of each pair; shift: of each group of pairs; entries: a << 32 | b << 16 | rank at the pair's place, or EMPTY."""

    EMPTY = 1 << 60
    GROUP, PLACE = 7_368_787, 15_485_863

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NONE:
            raise ValueError("ids must be below 65536")
        self.pairs = all_pairs(ranks)
        size = 3 * len(self.pairs) // 2 + 101
        while not self._fill(size):
            size += 100

    def _fill(self, size: int) -> bool:
        groups: dict[int, list[tuple[int, int]]] = {}
        many = len(self.pairs) // 3 + 1
        for (a, b), rank in self.pairs.items():
            pair = a << 16 | b
            groups.setdefault(pair * self.GROUP % many, []).append((pair * self.PLACE % size, pair << 16 | rank))
        shift, entries = [0] * many, [self.EMPTY] * size
        for group in sorted(groups, key=lambda g: (-len(groups[g]), g)):
            held = groups[group]
            if len({at for at, _ in held}) < len(held):
                return False
            # Trials start at a place of the group's own, so that they don't crowd together.
            first = group * 40_503 % size
            for step in range(size):
                by = (first + step) % size
                if all(entries[(at + by) % size] == self.EMPTY for at, _ in held):
                    break
            else:
                return False
            shift[group] = by
            for at, entry in held:
                entries[(at + by) % size] = entry
        self.shift, self.entries = np.array(shift, np.int64), np.array(entries, np.int64)
        return True


def merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges in one long piece, by a heap of pairs over a linked list: n log n steps instead of n * n."""
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
    heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0 and (p := (ids[left], ids[after[left]])) in pairs:
                heapq.heappush(heap, (pairs[p], left, *p))
    return [x for x in ids if x >= 0]


def _known(path: str, what: str, make: Callable[[dict[bytes, int]], object]):
    """What is made of a rank file, made once a process and only where it is needed."""
    if path not in _made:
        _made[path] = read_ranks(path)
    if (path, what) not in _made:
        _made[path, what] = make(_made[path])
    return _made[path, what]


def _planes(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Integers, all low bytes first: they compress better so."""
    numbers = numbers.astype(kind)
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(data: bytes) -> bytes:
    """What is shuffled, its length first: a shuffle's own codec only finds repeats, this one codes bytes by their frequency too."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unpacked(data: pa.Buffer) -> pa.Buffer:
    n = int.from_bytes(data[:8].to_pybytes(), "little")
    return pa.Codec("zstd").decompress(data[8:], n) if n else pa.py_buffer(b"")


def _cut(path: str, buckets: int, orders: bool):
    """Of each slice: the distinct pieces that are no tokens, a row a bucket of them (sizes, bytes), or, with orders, a row of its
    documents, where each begins in the order of pieces, that order, and the ids of the pieces that are tokens. Pieces are
    numbered so that tokens come first, then bucket after bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, number = _known(path, "ranks", dict), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = texts(batch.column("text"))
            for low, high in slices(at, SLICE):
                first, strings, many = [np.zeros(1, np.int64)], [], 0
                for a, b in slices(at[low : high + 1], PART):
                    pieces = Pieces(data[at[low + a] : at[low + b]], at[low + a : low + b + 1] - at[low + a])
                    strings.append(pieces.strings(np.arange(len(pieces)))), first.append(pieces.first[1:] + many)
                    many += len(pieces)
                found = pa.concat_arrays(strings).dictionary_encode()
                held, order = found.dictionary, found.indices.to_numpy()
                del pieces, strings, found
                words = held.to_pylist()
                whole = np.array([ranks.get(w, -1) for w in words], np.int64)
                bucket = np.array([-1 if t >= 0 else zlib.crc32(w) % buckets for w, t in zip(words, whole.tolist(), strict=True)], np.int64)
                turn, tokens = np.argsort(bucket, kind="stable"), int((whole >= 0).sum())
                if orders:
                    place = np.empty_like(turn)
                    place[turn] = np.arange(len(turn))
                    columns = [pa.array([number]), pa.array([-1], pa.int32()), pa.array([_packed(_planes(np.concatenate(first)))]), pa.array([_packed(_planes(place[order]))]), pa.array([_packed(_planes(whole[turn[:tokens]]))]), pa.array([batch.column("doc_id")[low:high].to_pylist()], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["slice", "bucket", "counts", "packed", "tokens", "docs"])
                elif tokens < len(turn):
                    raw, bounds = texts(held)
                    sizes, ranked = np.diff(bounds), bucket[turn[tokens:]]
                    begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                    parts = np.split(turn[tokens:], begins[1:])
                    columns = [pa.array(np.full(len(parts), number)), pa.array(ranked[begins].astype(np.int32)), pa.array([_packed(_planes(sizes[x])) for x in parts]), pa.array([_packed(raw[spread(sizes, x, bounds[:-1])].tobytes()) for x in parts])]
                    yield pa.RecordBatch.from_arrays(columns, ["slice", "bucket", "counts", "packed"])
                number += 1
            give_back()

    return task


def _rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=500)


def _distinct(path: str):
    """A row for each distinct piece of the buckets here, its single-byte ids; then each row again, with its pieces by their numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, held = _known(path, "ranks", dict), [*batches]
        if not sum(b.num_rows for b in held):
            return
        single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        given = pa.Table.from_batches(held)
        del held
        sizes = [_numbers(_unpacked(x.as_buffer())) for x in given["counts"]]
        raw = b"".join(_unpacked(x.as_buffer()) for x in given["packed"])
        found = pa.Array.from_buffers(pa.large_binary(), sum(map(len, sizes)), [None, pa.py_buffer(np.r_[0, np.cumsum(np.concatenate(sizes), dtype=np.int64)]), pa.py_buffer(raw)]).dictionary_encode()
        raw, ends = texts(found.dictionary)
        ids, n = single[raw], np.diff(ends)
        long = np.flatnonzero(n > LONG)
        if len(long):  # few, if any: merged here, and marked as done by negative numbers
            parts, pairs = np.split(ids, ends[1:-1]), _known(path, "pairs", all_pairs)
            for i in long.tolist():
                parts[i] = -1 - np.array(merge_long(parts[i].tolist(), pairs), np.int32)
            ids, ends = np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
        for begin in range(0, len(n), 10_000):
            end = min(begin + 10_000, len(n))
            words = pa.ListArray.from_arrays(pa.array((ends[begin : end + 1] - ends[begin]).astype(np.int32)), pa.array(ids[ends[begin] : ends[end]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.nulls(end - begin, pa.int64()), pa.nulls(end - begin, pa.int32()), pa.nulls(end - begin, pa.binary()), words], ["slice", "bucket", "order", "word"])
        orders = np.split(found.indices.to_numpy(), np.cumsum([len(x) for x in sizes])[:-1])
        del found, raw, ids, ends, sizes, words
        give_back()
        yield from _rows(pa.table([given["slice"], given["bucket"], pa.array([_planes(x) for x in orders], pa.binary()), pa.nulls(len(orders), pa.list_(pa.int32()))], ["slice", "bucket", "order", "word"]))

    return task


def _given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's row of a bucket with the number of ids of each of its pieces, and these ids."""
    held, flat, at = [], None, None
    for batch in batches:
        row = batch.column("slice").is_valid()
        held.append(batch.column("word").filter(pa.array(~row.to_numpy(zero_copy_only=False))))
        rows = batch.filter(row)
        if not rows.num_rows:
            continue
        if flat is None:
            words = pa.concat_arrays(held)
            flat, at = words.flatten().to_numpy(), np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        n, counts, packed = np.diff(at), [], []
        for x in rows.column("order"):
            which = _numbers(x.as_buffer())
            counts.append(_packed(_planes(n[which]))), packed.append(_packed(_planes(flat[spread(n, which, at[:-1])], "<u2")))
        yield pa.RecordBatch.from_arrays([rows.column("slice"), rows.column("bucket"), pa.array(counts, pa.binary()), pa.array(packed, pa.binary())], ["slice", "bucket", "counts", "packed"])


def literal(numbers: np.ndarray, kind: str) -> Column:
    """An array literal: the optimizer folds this into one constant."""
    return F.split(F.lit(",".join(map(str, numbers.tolist()))), ",").cast(f"array<{kind}>")


def fold_merges(word: Column, rank_map: RankMap) -> Column:
    """The ids of a word from those of its bytes: the adjacent pair of lowest rank is merged, as long as there is one.

    The fold of a word of over SHORT bytes carries the ranks of adjacent pairs beside the ids: a merge takes two ids and their
    pair's rank out and looks up the two pairs that it makes new; all else is copied by whole slices, so a step costs two lookups,
    however long the word is. In shorter words it costs less to look all pairs up again.
    """
    many, size = F.lit(len(rank_map.shift)).cast("bigint"), F.lit(len(rank_map.entries)).cast("bigint")
    none = F.array().cast("array<bigint>")

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """The body with the value computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    # Bound once: every place that named the arrays would hold, and send with each task, a copy of its own.
    tables = F.struct(literal(rank_map.shift, "int").alias("shift"), literal(rank_map.entries, "bigint").alias("entries"))
    return let(tables, lambda bound: _fold(word, bound, many, size, none, let))


def _fold(word: Column, bound: Column, many: Column, size: Column, none: Column, let: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    def rank(a: Column, b: Column) -> Column:
        """The rank of a pair, or a number of at least NONE."""

        def looked_up(pair: Column) -> Column:
            at = (pair * RankMap.PLACE + F.get(bound["shift"], (pair * RankMap.GROUP % many).cast("int"))) % size
            return F.get(bound["entries"], at.cast("int")).bitwiseXOR(F.shiftleft(pair, 16))

        return let(F.shiftleft(a.cast("long"), 16).bitwiseOR(b.cast("long")), looked_up)

    def merged(state: Column, lowest: Column, p: Column) -> Column:
        """The pair of ids p and p + 1 (from 1) becomes the id that its rank is."""
        ids, ranks, new = state["ids"], state["ranks"], lowest.cast("int")
        left = F.when(p > 1, F.array(rank(F.get(ids, p - 2), new))).otherwise(none)
        right = F.when(p + 1 < F.size(ids), F.array(rank(new, F.get(ids, p + 1)))).otherwise(none)
        rest = F.size(ids)
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), p - 1), F.array(new), F.slice(ids, p + 2, rest)).alias("ids"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, rest)).alias("ranks"),
        )

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state["ranks"]), lambda lowest: F.when(lowest < NONE, let(F.array_position(state["ranks"], lowest).cast("int"), lambda p: merged(state, lowest, p))).otherwise(state))

    def short_step(ids: Column, _: Column) -> Column:
        def without(found: Column, p: Column) -> Column:
            moved = F.transform(found, lambda r, i: F.when(i < p, F.get(ids, i)).when(i > p, F.get(ids, i + 1)).otherwise(r.cast("int")))
            return F.when(F.get(found, p) < NONE, moved).otherwise(ids)

        ranks = F.transform(F.slice(ids, F.lit(1), F.size(ids) - 1), lambda a, i: rank(a, F.get(ids, i + 1)))
        return F.when(F.size(ids) < 2, ids).otherwise(let(ranks, lambda found: let(F.array_position(found, F.array_min(found)).cast("int") - 1, lambda p: without(found, p))))

    first = F.struct(word.alias("ids"), F.transform(F.slice(word, F.lit(1), F.size(word) - 1), lambda a, i: rank(a, F.get(word, i + 1))).alias("ranks"))
    steps = F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2)))
    folded = F.when(F.size(word) > SHORT, F.aggregate(steps, first, step, lambda state: state["ids"])).otherwise(F.aggregate(steps, word, short_step))
    done = F.get(word, F.lit(0)) < 0
    return F.when(done, F.transform(word, lambda x: -1 - x)).when(F.size(word) < 2, word).otherwise(folded)


def _assemble(path: str):
    """Documents again, from each slice's row of orders and its buckets' rows behind it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _known(path, "ranks", dict)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        sizes, pool = np.array([len(t) for t in tokens], np.int64), np.frombuffer(b"".join(tokens), np.uint8)
        begins = np.cumsum(sizes) - sizes

        def whole(docs: pa.Array, first: np.ndarray, order: np.ndarray, counts: list[np.ndarray], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            n, flat = np.concatenate(counts).astype(np.int64), np.concatenate(parts)
            at, ends = np.cumsum(n) - n, np.r_[0, np.cumsum(n[order])][first]
            for low in range(0, len(docs), 500):
                high = min(low + 500, len(docs))
                ids = flat[spread(n, order[first[low] : first[high]], at)]
                raw = pool[spread(sizes, ids, begins)]
                bounds = ends[low : high + 1] - ends[low]
                cut = np.r_[0, np.cumsum(sizes[ids])][bounds]
                text = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([docs[low:high], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), text], ["doc_id", "ids", "decoded"])

        now = None
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                counts, packed = (_unpacked(batch.column(c)[i].as_buffer()) for c in ("counts", "packed"))
                if bucket < 0:
                    if now:
                        yield from whole(*now)
                    alone = _numbers(_unpacked(batch.column("tokens")[i].as_buffer()))
                    now = batch.column("docs")[i].values, _numbers(counts), _numbers(packed), [np.ones(len(alone), np.int32)], [alone]
                else:
                    now[3].append(_numbers(counts)), now[4].append(_numbers(packed, "<u2").astype(np.int32))
            give_back()
        if now:
            yield from whole(*now)

    return task


def encode_decode(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, decoded (the bytes that the ids stand for)."""
    docs = documents(df, id_col=id_col, text_col=text_col)
    buckets = max(16, 2 * docs.rdd.getNumPartitions())
    kind = "slice long, bucket int, counts binary, packed binary"
    dealt = docs.mapInArrow(_cut(rank_file, buckets, False), kind).repartition(buckets, "bucket")
    cut = dealt.mapInArrow(_distinct(rank_file), "slice long, bucket int, order binary, word array<int>")
    folded = cut.select("slice", "bucket", "order", fold_merges(F.col("word"), _known(rank_file, "map", RankMap)).alias("word"))
    orders = docs.mapInArrow(_cut(rank_file, buckets, True), kind + ", tokens binary, docs array<long>")
    rows = orders.unionByName(folded.mapInArrow(_given_back, kind), allowMissingColumns=True)
    return rows.repartition(2 * buckets, "slice").sortWithinPartitions("slice", "bucket").mapInArrow(_assemble(rank_file), "doc_id long, ids array<int>, decoded binary")
