"""Token-id files: ids in blocks of their own, coded by an adaptive context-mixing range coder, in ascending doc_id order.

Order 0 predicts an id by how often the segment has it, order 1 the id that follows the last one most often in the segment: a
table of both stands before the segment's blocks. Order 2 predicts what stood last behind the same two ids of the block. So an id
is order 2's prediction, order 1's, or named by order 0. How likely each prediction holds is learnt in the block: order 2's by how
often it held behind this context and whether order 1 agrees, order 1's by how often the segment lets its id follow; each of these
chances is mixed with one of how often the order held of late, by weights that follow how well both predicted before. Products and
sums are taken one by one in IEEE numbers, and shares of counts in whole numbers, so every machine decodes alike. A block starts
anew, ends with its CRC-32, and can be decoded by itself with the segment's table; the blocks of a segment are coded in step, one
numpy lane each, an id by one narrowing of the range.

A segment is a row of a Parquet file: magic, whole documents' ids and lengths, the table (with a CRC-32) and the blocks. Documents are dealt out by
ranges of doc_id and sorted, so file order is doc_id order; the place of a document in the whole stream is the sum of what
lies in earlier files (one number a file), earlier segments and earlier documents.

Defined results: a null or empty text is its end id alone. A null doc_id comes first. Rows that repeat are written as often,
next to each other. An empty table gives an empty result; other columns are ignored. A damaged block or table raises an error.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm import _tokens
from hindcast.llm._shared import documents, give_back, shared_dir

MAGIC = b"HCTS4"
BLOCK = 2048
SEGMENT = 1 << 23
#: Pairs of ids that a block's order 2 remembers; further ones share a place.
SLOTS = 2048
#: Bits of the scale that the two predictions and order 0 share out, and most bits of the one that order 0's ids share out.
SYMBOLS, SHARES = 14, 20
#: Bits of the coder's width and of a word of output.
WIDTH, WORD = 62, 16
_LEAST, _MASK = np.uint64(1 << (WIDTH - WORD)), np.uint64((1 << WIDTH) - 1)
#: How fast chances in a context, chances of late and their weights follow what is met; what chances keep from 0 and 1.
_RATE, _LATE, _FADE, _EDGE = np.float32(0.04), np.float32(0.2), np.float32(0.02), np.float32(0.0005)
#: Chances of a block's first ids. Order 2, by how sure it is and whether order 1 agrees; order 1, by how often its id follows.
_FIRST = np.array([0.01, 0.01, 0.2, 0.4, 0.4, 0.6, 0.6, 0.8, 0.003, *(2 ** ((k - 7.5) / 1.5) for k in range(1, 8))], np.float32)
_ONE, _BITS = np.float32(1), np.float32((1 << SYMBOLS) - 128)


class _Encoder:
    """Range encoder of many lanes. A word may hold a carry for the one before it until the end."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << WIDTH, np.uint64)
        self.words = np.zeros((lanes, 2 * steps + 2), np.uint32)
        self.start = np.arange(lanes) * self.words.shape[1]
        self.at = self.start.copy()

    def narrow(self, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        part = self.range >> np.uint64(bits)
        self.low += begin * part
        self.range = part * size
        words, short = self.words.ravel(), self.range < _LEAST
        words[self.at] = self.low >> np.uint64(WIDTH - WORD)
        # No narrowing takes more than two words.
        twice = np.flatnonzero(self.range < np.uint64(1 << (WIDTH - 2 * WORD)))
        words[self.at[twice] + 1] = self.low[twice] >> np.uint64(WIDTH - 2 * WORD) & np.uint64((1 << WORD) - 1)
        moves = short.astype(np.int64)
        moves[twice] = 2
        shift = moves.view(np.uint64) << np.uint64(4)
        self.range <<= shift
        self.low = np.where(short, self.low << shift & _MASK, self.low)
        self.at += moves

    def finish(self) -> list[bytes]:
        # The range is a word's unit at least, so the next multiple of it lies inside.
        self.words.ravel()[self.at] = self.low + (_LEAST - np.uint64(1)) >> np.uint64(WIDTH - WORD)
        n = self.at - self.start + 1
        words = np.ascontiguousarray(self.words[:, : int(n.max())])
        words[np.arange(words.shape[1]) >= n[:, None]] = 0
        while (carry := words >> WORD).any():
            words &= (1 << WORD) - 1
            words[:, :-1] += carry[:, 1:]
        raw = words.astype("<u2")
        return [raw[i, :k].tobytes() for i, k in enumerate(n.tolist())]


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        lanes = len(blocks)
        words = np.zeros((lanes, max(map(len, blocks)) // 2 + 8), "<u2")
        for i, x in enumerate(blocks):
            words[i, : len(x) // 2] = np.frombuffer(x, "<u2")
        first = words[:, :4].astype(np.uint64).T
        self.code, self.range = (first[0] << np.uint64(46)) + (first[1] << np.uint64(30)) + (first[2] << np.uint64(14)) + (first[3] >> np.uint64(2)), np.full(lanes, 1 << WIDTH, np.uint64)
        # The 32 bits that may follow, from each place: the coder's width ends 14 bits into a word.
        self.next = words[:, :-2].astype(np.uint32) << 30
        self.next |= words[:, 1:-1].astype(np.uint32) << 14
        self.next |= words[:, 2:] >> 2
        self.at = np.arange(lanes) * self.next.shape[1] + 3

    def target(self, bits: int) -> np.ndarray:
        """Where the code stands on a scale of 2**bits."""
        self.part = self.range >> np.uint64(bits)
        return np.minimum(self.code // self.part, np.uint64((1 << bits) - 1))

    def narrow(self, begin: np.ndarray, size: np.ndarray) -> None:
        self.code -= begin * self.part
        self.range = self.part * size
        moves = (self.range < _LEAST).astype(np.int64)
        moves += self.range < np.uint64(1 << (WIDTH - 2 * WORD))
        shift = moves.view(np.uint64) << np.uint64(4)
        self.range <<= shift
        self.code <<= shift
        self.code += self.next.ravel().take(self.at, mode="clip") >> np.uint64(32) - shift
        self.at += moves


class _Model:
    """Adaptive predictions of many lanes, each for a block of its own."""

    def __init__(self, lanes: int, table: Table):
        self.table, self.base = table, np.arange(lanes) * SLOTS
        self.guess = np.zeros(lanes * SLOTS, np.uint32)  # id << 2 | how sure
        self.chances = np.tile(_FIRST, lanes)
        self.begin = np.arange(lanes) * len(_FIRST)
        self.where = np.empty((2, lanes), np.int64)  # chances of order 2 and of order 1 in their contexts
        self.of_late = np.full((2, lanes), 0.1, np.float32)
        self.weight = np.full((2, lanes), 0.5, np.float32)
        self.hit, self.live = np.zeros((2, lanes), np.float32), np.ones((2, lanes), np.float32)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def predict(self) -> None:
        """two, one: what orders 2 and 1 predict; their shares of the symbols' scale, and what is left to order 0."""
        # Ids have 16 bits, so these products fit 32.
        slot = self.last * np.uint32(40503)
        slot ^= self.before * np.uint32(57829)
        slot >>= 13
        slot &= SLOTS - 1
        self.slot = self.base + slot
        self.known, follows = self.guess.take(self.slot, mode="clip"), self.table.follows.take(self.last, mode="clip")
        self.two, self.one, self.sure = self.known >> 2, follows >> 3, self.known & 3
        self.agree = self.two == self.one
        np.add(self.begin, self.sure << 1 | self.agree, out=self.where[0])
        np.add(self.begin, (follows & 7) + np.uint32(8), out=self.where[1])
        self.held = self.chances.take(self.where, mode="clip")
        two, one = self.of_late + self.weight * (self.held - self.of_late)
        self.share_two = (two * _BITS).astype(np.int64)
        self.share_two += 1
        one *= _BITS
        one *= _ONE - two
        self.share_one = one.astype(np.int64)
        self.share_one += 1
        self.share_one *= ~self.agree
        self.rest = (1 << SYMBOLS) - self.share_two - self.share_one

    def span(self, ids: np.ndarray, is_two: np.ndarray, is_one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's part of the scale begins, and how large it is."""
        bits, named = self.table.bits, ~(is_two | is_one)
        begin = (self.share_two * ~is_two + self.share_one * named << bits) + self.table.begin.take(ids, mode="clip") * (self.rest * named)
        size = np.where(named, self.table.size.take(ids, mode="clip") * self.rest, np.where(is_two, self.share_two, self.share_one) << bits)
        return begin.view(np.uint64), size.view(np.uint64)

    def learn(self, ids: np.ndarray, is_two: np.ndarray, is_one: np.ndarray) -> None:
        hit, live, held, late = self.hit, self.live, self.held, self.of_late
        hit[0], hit[1] = is_two, is_one
        live[1] = ~(is_two | self.agree)  # else order 1 wasn't asked
        miss = _ONE - hit
        own = np.abs(miss - held)
        own *= self.weight
        other = np.abs(miss - late)
        other *= _ONE - self.weight
        other += own
        own /= other
        own *= _ONE - _FADE
        own += _FADE / 2
        own -= self.weight
        own *= live
        self.weight += own
        hit *= _ONE - 2 * _EDGE
        hit += _EDGE
        late += (hit - late) * (live * _LATE)
        hit -= held
        hit *= live
        hit *= _RATE
        hit += held
        self.chances[self.where] = hit
        self.guess[self.slot] = np.where(is_two, self.known + (self.sure < 3), np.where(self.sure > 1, self.known - 1, ids << 2 | 1))
        self.before, self.last = self.last, ids


class Table:
    """What a segment's blocks are coded by. Order 0: where each id's share of the scale begins and how large it is. Order 1: the id
    that follows each most often, and how often (a level of 1 to 7; 0 if none is met twice)."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, follower: np.ndarray, level: np.ndarray):
        """ids: ascending and distinct; counts: of each, at least 1."""
        self.ids, self.counts, self.follower, self.level = ids.astype(np.int64), counts.astype(np.int64), follower.astype(np.int64), level.astype(np.int64)
        self.bits = min(SHARES, len(ids).bit_length() + 7)
        self.begin, self.size, self.follows = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << self.bits, np.uint16)  # the id at each place of the scale
        if len(ids):
            share = 1 + self.counts * ((1 << self.bits) - len(ids)) // int(self.counts.sum())
            share[np.argmax(self.counts)] += (1 << self.bits) - int(share.sum())
            self.begin[self.ids], self.size[self.ids], self.follows[self.ids] = np.cumsum(share) - share, share, self.follower << 3 | self.level
            self.at[:] = np.repeat(self.ids, share)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        if len(ids) and int(ids.max()) >= 1 << 16:
            raise ValueError("ids must be below 65536")
        counts = np.bincount(ids)
        met = np.flatnonzero(counts)
        pairs = np.sort(ids[:-1].astype(np.uint32) << 16 | ids[1:].astype(np.uint32))
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
        n = np.diff(first, append=len(pairs))
        first, n = first[n > 1], n[n > 1]
        before, after = pairs[first] >> 16, pairs[first] & 0xFFFF
        order = np.lexsort((n, before))
        best = order[np.flatnonzero(np.r_[before[order][1:] != before[order][:-1], True][: len(order)])]
        follower, level = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        follower[before[best]], level[before[best]] = after[best], np.clip(np.floor(8 + 1.5 * np.log2(n[best] / counts[before[best]])), 1, 7)
        return cls(met, counts[met], follower[met], level[met])

    def packed(self) -> bytes:
        raw = np.diff(self.ids, prepend=0).astype("<u2").tobytes() + self.counts.astype("<u4").tobytes() + self.follower.astype("<u2").tobytes() + self.level.astype("u1").tobytes()
        return zlib.crc32(raw).to_bytes(4, "little") + zlib.compress(raw, 9)

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        try:
            raw = zlib.decompress(data[4:])
        except zlib.error:
            raw = b""
        n = len(raw) // 9
        if zlib.crc32(raw) != int.from_bytes(data[:4], "little") or len(raw) != 9 * n:
            raise ValueError("a table of token ids is damaged")
        return cls(np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64)), np.frombuffer(raw, "<u4", n, 2 * n), np.frombuffer(raw, "<u2", n, 6 * n), np.frombuffer(raw, "u1", n, 8 * n))


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of at most BLOCK ids, each coded by itself and followed by the CRC-32 of its ids."""
    lanes, steps = -(-len(ids) // BLOCK), min(BLOCK, len(ids))
    grid = np.full(lanes * steps, table.ids[0] if len(ids) else 0, np.uint32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    coder, model = _Encoder(lanes, steps), _Model(lanes, table)
    for now in grid:
        model.predict()
        is_two = now == model.two
        is_one = (now == model.one) & ~is_two
        coder.narrow(*model.span(now, is_two, is_one), SYMBOLS + table.bits)
        model.learn(now, is_two, is_one)
    raw = ids.astype("<u4").tobytes()
    return [x + zlib.crc32(raw[4 * BLOCK * i : 4 * BLOCK * (i + 1)]).to_bytes(4, "little") for i, x in enumerate(coder.finish())]


def decode_blocks(blocks: list[bytes], total: int, table: Table) -> np.ndarray:
    lanes, steps = len(blocks), min(BLOCK, total)
    grid = np.zeros((steps, lanes), np.uint32)
    coder, model = _Decoder([x[:-4] for x in blocks]), _Model(lanes, table)
    for now in grid:
        model.predict()
        target = coder.target(SYMBOLS + table.bits).view(np.int64)
        over = target - (model.share_two << table.bits)
        is_two = over < 0
        over -= model.share_one << table.bits
        is_one = (over < 0) & ~is_two
        # Below 2**34 by 2**14 at most: the quotient's floor is exact.
        found = table.at.take((over / model.rest).astype(np.int64), mode="clip")
        now[:] = np.where(is_two, model.two, np.where(is_one, model.one, found))
        coder.narrow(*model.span(now, is_two, is_one))
        model.learn(now, is_two, is_one)
    ids = grid.T.ravel()[:total].astype("<u4")
    for i, x in enumerate(blocks):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) != int.from_bytes(x[-4:], "little"):
            raise ValueError("a block of token ids is damaged")
    return ids


def _write(vocabulary: str, end: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            table = Table.of(ids)
            columns = [[part], [segment], [MAGIC], [docs], [[len(x) for x in held]], [table.packed()], [encode_blocks(ids, table)]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "segment", "magic", "docs", "lengths", "table", "blocks"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _tokens.encode(vocabulary, batch.column("text"), False, end), strict=True):
                docs.append(doc), held.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    yield row()
                    segment, docs, held, size = segment + 1, [], [], 0
        if docs:
            yield row()
            del docs, held
        give_back()

    return task


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part, segment, magic, docs, lengths, table, blocks = (batch.column(c)[i].as_py() for c in ("part", "segment", "magic", "docs", "lengths", "table", "blocks"))
            if magic != MAGIC:
                raise ValueError("not a file of token ids")
            raw, at = decode_blocks(blocks, sum(lengths), Table.unpacked(table)).tobytes(), np.r_[0, np.cumsum(lengths)]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = len(docs)
            del raw, blocks, table
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])


def write_tokens(df: DataFrame, vocabulary: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    docs = documents(df, id_col=id_col, text_col=text_col)
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(_write(vocabulary, end), "part int, segment int, magic binary, docs array<long>, lengths array<long>, table binary, blocks array<binary>").write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    stored = spark.read.parquet(path)
    sizes = stored.select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    inside = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # One row a file, so one task can sum them.
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    place = inside.join(earlier, "part").select("part", "segment", (F.col("before") + F.col("earlier")).alias("base"))
    rows = stored.mapInArrow(_read, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(place, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, vocabulary: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts to the shared folder and read them back."""
    path = f"{shared_dir(df.sparkSession)}/hindcast/tokens-{uuid.uuid4().hex}"
    write_tokens(df, vocabulary, path, end, id_col, text_col)
    return read_tokens(df.sparkSession, path)
