"""Best-fit packing: token pieces into as few sequences of `capacity` tokens as can be, by the sum-of-squares rule.

The rule keeps, for every gap g below the capacity, the number N(g) of open sequences with g tokens left, and places each
piece where the sum of N(g)**2 becomes smallest: into a gap it may leave another of, or into a new sequence.

Scale: only lengths matter to the rule, and there are at most `capacity` of them. So Spark counts the pieces of each length,
the rule packs a bounded number of pieces (`PLAN`) of that histogram on the driver, each placing standing for as many equal
sequences as the histogram was divided by, and what the division leaves is packed in the same way. The plan goes back as
rows (length, rank) -> (sequence, offset). Ranks within a length come from counts per (length, bucket) and a row number in
each, so the most frequent length is spread over buckets of bounded size. Pieces of the full capacity need no join.

Defined results: a null or empty text is its end id alone; a longer text than the capacity is cut into full pieces, the first
of which may be shorter. Rows that repeat are packed as often as they occur. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm import _tokens
from hindcast.llm._shared import documents, stored

PLAN = 30_000
BUCKET = 20_000


def token_pieces(df: DataFrame, vocabulary: str, end: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of each text: doc_id, piece, start, length, ids_crc32 (of little-endian 32-bit ids), ids (unless left out)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, ids in enumerate(_tokens.encode(vocabulary, batch.column("text"), True, end)):
                raw, n = ids.astype("<u4").tobytes(), len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if with_ids:
                        held.append(ids[a:b].astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int32()))] if with_ids else []), names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents(df, id_col=id_col, text_col=text_col).mapInArrow(task, kinds)


def sum_of_squares(lengths: list[int], capacity: int) -> list[list[int]]:
    """The lengths in each sequence, placed one by one."""
    open_at = np.zeros(capacity + 1, np.int64)  # by gap; a full sequence counts nowhere
    stacks: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    out = []
    for s in lengths:
        # Growth of the sum when a gap g >= s becomes g - s.
        gaps, left = open_at[s:capacity], open_at[: capacity - s]
        growth = 2 * (left - gaps) + 2
        growth[0] = 1 - 2 * gaps[0]  # closes the sequence
        growth[gaps == 0] = np.iinfo(np.int64).max
        g = s + int(np.argmin(growth)) if len(growth) else capacity
        fresh = 2 * int(open_at[capacity - s]) + 1
        if not len(growth) or growth[g - s] > fresh:
            out.append(held := [])
            g = capacity
        else:
            held = stacks[g].pop()
            open_at[g] -= 1
        held.append(s)
        if g > s:
            open_at[g - s] += 1
            stacks[g - s].append(held)
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, lengths of one sequence), together all the counted pieces."""
    total = sum(counts.values())
    if not total:
        return []
    if total > PLAN:
        by = -(-total // PLAN)
        some, rest = {s: n // by for s, n in counts.items()}, {s: n % by for s, n in counts.items()}
        return [(by * m, x) for m, x in plan(some, capacity)] + plan(rest, capacity)
    falling = np.repeat(sorted(counts, reverse=True), [counts[s] for s in sorted(counts, reverse=True)])
    mixed = np.random.default_rng(0).permutation(falling)
    found = min((sum_of_squares(x.tolist(), capacity) for x in (mixed, falling)), key=len)
    return [(1, x) for x in found]


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces: doc_id, piece, length (1 to capacity) and any more. Adds sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().toArrow().to_pylist()}
    spark, buckets = pieces.sparkSession, max(16, -(-sum(counts.values()) // BUCKET))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    here = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("here", here).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("here")).drop("bucket", "here", "before")

    full = counts.pop(capacity, 0)
    rows, sequence, used = [], full, dict.fromkeys(counts, 0)
    for many, lengths in plan(counts, capacity):
        offset = 0
        for s in lengths:
            rows.append((s, used[s], many, sequence, offset))
            used[s] += many
            offset += s
        sequence += many
    placed = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["length", "rank", "many", "sequence_id", "offset"]))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("step")
    placed = placed.select("length", "rank", "sequence_id", "offset", step).select("length", (F.col("rank") + F.col("step")).alias("rank"), (F.col("sequence_id") + F.col("step")).alias("sequence_id"), F.col("offset"))
    whole = ranked.where(F.col("length") == capacity).withColumn("sequence_id", F.col("rank").cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("rank")
    parts = ranked.where(F.col("length") < capacity).join(placed, ["length", "rank"])
    return whole.unionByName(parts.select(whole.columns))


def packed_documents(df: DataFrame, vocabulary: str, end: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids unless left out."""
    pieces = stored(token_pieces(df, vocabulary, end, capacity, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
