"""Media columns: texts as 8-bit audio, stored as content-defined chunks, each once, and put together again.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of a mono 8-bit WAVE stream. A rolling
gear hash (h = 2*h + G[byte], 32 bits, so 32 bytes of memory) cuts the samples where its upper bits are zero, between a
least and a most chunk size; equal passages are cut alike wherever they stand. Chunks are named by a 128-bit digest. Spark
joins decide the one stream that holds each chunk; the store has a row per stream with the chunks it holds, and a manifest
has the ordered list of all its chunks. Reading back takes the store's rows; streams that hold all their chunks are put
together where they lie, others fetch what is missing by a join on the digest. Every stream's samples are hashed after that,
and a mismatch with the hash taken before storing fails the job.

Scale: streams are named by the SHA-256 of their samples, so copies of a text are one stream and only their names join back.
Bytes move by name once, compressed; digests are taken in a pass before and move apart from bytes; a chunk that very many streams share is joined from the
side of the references, which Spark can split. Store and manifest are Parquet in the shared folder.

Defined results: a null or empty text is 64 zero samples. Rows are returned as often as they occur, a null doc_id too. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import documents, shared_dir, stored
from hindcast.llm._words import mix, portions, slices

UNIT = 64
LEAST, MEAN_BITS, MOST = 256, 11, 8192
RATE = 8000
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_HELD = "array<struct<ord:int,digest:binary,shared:boolean,bytes:binary>>"


def payload(text: Column) -> Column:
    """The text's bytes and the zeros behind them."""
    raw = F.encode(text, "UTF-8")
    short = F.greatest(F.ceil(F.octet_length(text) / UNIT), F.lit(1)) * UNIT - F.octet_length(text)
    return F.concat(raw, F.substring(F.lit(bytes(UNIT)), F.lit(1), short.cast("int")))


def header(n: int) -> bytes:
    """The head of a WAVE stream of n unsigned 8-bit samples, one channel (fixed format)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte: the sum of G over the last 32 bytes, shifted by age; built by doubling."""
    h, size = GEAR[data], 1
    while size < 32:
        h[size:] = h[size:] + (h[:-size] << np.uint32(size))
        size *= 2
    return h


def cuts(hits: np.ndarray, begin: int, end: int) -> list[int]:
    """Chunk ends of the samples begin..end; hits: sorted positions behind which the hash allows a cut."""
    out, at = [], begin
    while end - at > LEAST:
        i = int(np.searchsorted(hits, at + LEAST))
        at = min(int(hits[i]) if i < len(hits) else end, at + MOST, end)
        out.append(at)
    if not out or out[-1] < end:
        out.append(end)
    return out


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=6, write_checksum=False, write_content_size=True)
    for batch in portions(batches):
        packed = [squeeze.compress(memoryview(x.as_buffer())) for x in batch.column("samples")]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(packed, pa.binary())], ["name", "packed"])


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[int]]]:
    """Row number, samples and chunk ends of each stream."""
    loose = zstandard.ZstdDecompressor()
    packed = "packed" in batch.schema.names
    held = [x.as_buffer() for x in batch.column("packed" if packed else "samples")]
    sizes = np.array([zstandard.frame_content_size(x) if packed else len(x) for x in held], np.int64)
    for low, high in slices(np.r_[0, np.cumsum(sizes)]):
        parts = [loose.decompress(held[i]) if packed else held[i].to_pybytes() for i in range(low, high)]
        hits = np.flatnonzero(gear(np.frombuffer(b"".join(parts), np.uint8)) >> np.uint32(32 - MEAN_BITS) == 0) + 1
        at = 0
        for i, part in enumerate(parts, low):
            a, b = np.searchsorted(hits, [at, at + len(part)])
            yield i, part, cuts(hits[a:b] - at, 0, len(part))
            at += len(part)


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        rows, order, digests = [], [], []
        for i, samples, ends in _streams(batch):
            for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                rows.append(i), order.append(k), digests.append(_digest(samples[a:b]))
        yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(rows, pa.int64())), pa.array(order, pa.int32()), pa.array(digests, pa.binary())], ["name", "ord", "digest"])


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("digest", pa.binary()), ("shared", pa.bool_()), ("bytes", pa.binary())]))
    for batch in portions(batches):
        heads, counts, held = [], [], []
        for i, samples, ends in _streams(batch):
            here = {x["ord"]: x["shared"] for x in batch.column("own")[i].as_py() or []}
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            heads.append(header(len(samples))), counts.append(len(spans))
            held.append([{"ord": k, "digest": _digest(samples[a:b]), "shared": here[k], "bytes": samples[a:b]} for k, (a, b) in enumerate(spans) if k in here])
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(heads, pa.binary()), pa.array(counts, pa.int32()), pa.array(held, kind)], ["name", "head", "n_chunks", "held"])


def features(samples: np.ndarray) -> str:
    """Of 8-bit samples around 128: mean, root mean square, peak, crossings of the middle, and shares of eight level bands."""
    x = samples.astype(np.int32) - 128
    bands = np.bincount(samples >> 5, minlength=8)
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={np.abs(x).max()};cross={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};bands=" + ",".join(f"{v / len(x):.4f}" for v in bands)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        out = [[] for _ in range(6)]
        more = batch.column("missing") if "missing" in batch.schema.names else None
        for i in range(batch.num_rows):
            chunks = {x["ord"]: x["bytes"] for x in [*(batch.column("held")[i].as_py() or []), *((more[i].as_py() or []) if more is not None else [])]}
            samples = b"".join(chunks[k] for k in range(batch.column("n_chunks")[i].as_py()))
            digest = hashlib.sha256(samples)
            if digest.digest() != batch.column("name")[i].as_py():
                raise ValueError("stored media differ from what was written")
            stream = batch.column("head")[i].as_py() + samples
            row = len(samples), digest.hexdigest(), zlib.crc32(samples[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), features(np.frombuffer(samples, np.uint8))
            for to, value in zip(out, row, strict=True):
                to.append(value)
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
        yield pa.RecordBatch.from_arrays([batch.column("name"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["name", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


_FEATURES = "name binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(named: DataFrame, path: str) -> None:
    """named: name binary (SHA-256 of the samples), samples binary. Writes path/store and path/manifest."""
    chunks = named.mapInArrow(_index, "name binary, ord int, digest binary").distinct()
    owners = chunks.groupBy("digest").agg(F.min(F.struct("name", "ord")).alias("owner"), F.count(F.lit(1)).alias("n"))
    marked = chunks.join(owners, "digest").select("name", "ord", "digest", (F.struct("name", "ord") == F.col("owner")).alias("own"), (F.col("n") > 1).alias("shared"))
    marked.write.parquet(f"{path}/manifest")
    own = named.sparkSession.read.parquet(f"{path}/manifest").where("own").groupBy("name").agg(F.collect_list(F.struct("ord", "shared")).alias("own"))
    streams = named.mapInArrow(_compress, "name binary, packed binary").dropDuplicates(["name"])
    held = streams.join(own, "name", "left").mapInArrow(_hold, f"name binary, head binary, n_chunks int, held {_HELD}")
    held.write.option("compression", "zstd").parquet(f"{path}/store")


def read_media(spark, path: str) -> DataFrame:
    """Features of every stream, from the stored chunks."""
    store, manifest = spark.read.parquet(f"{path}/store"), spark.read.parquet(f"{path}/manifest")
    whole = F.size("held") == F.col("n_chunks")
    chunk = store.where(F.exists("held", lambda x: x.shared)).select(F.explode("held").alias("x")).where("x.shared").select("x.digest", "x.bytes")
    missing = manifest.where("NOT own").select("name", "ord", "digest").join(chunk, "digest").groupBy("name").agg(F.collect_list(F.struct("ord", "bytes")).alias("missing"))
    parts = store.where(~whole).join(missing, "name")
    return store.where(whole).mapInArrow(_read, _FEATURES).union(parts.mapInArrow(_read, _FEATURES))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hindcast/media-{uuid.uuid4().hex}"
    docs = documents(df, id_col=id_col, text_col=text_col)
    samples = payload(F.col("text"))
    name = F.unhex(F.sha2(samples, 256))
    store_media(docs.select(name.alias("name"), samples.alias("samples")), path)
    read = stored(read_media(spark, path), "features")
    ids = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), name.alias("name"))
    return ids.join(read, "name").drop("name")
