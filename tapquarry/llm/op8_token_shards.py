"""Token-ID output in training order.

Texts are encoded with a given vocabulary; a document's tokens and one end token are cut into sequences of
`length`, the last padded with end tokens. Sequences are numbered by the scan's task and their place in it.
A keyed Feistel network over the least even number of bits that holds N numbers, walked until it falls below N,
permutes the numbers to global slots. Slots are dealt by ranges, whose bounds are arithmetic; each shard holds `per_shard`
sequences of fixed stride (little-endian 16-bit ids), so sequence s is at byte s * stride and a reader resumes anywhere. A
task writes whole shards, one after another, under another name first, so that a lost executor leaves no half shard.

The encoded sequences are stored once before slots are given, so a lost executor cannot renumber them. Nulls:
a null text has only the end token; a null doc_id is kept. Rows that repeat are sequences of their own.
Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, sql_text, stored, table

U64 = np.uint64
LENGTH, PER_SHARD, PIECE = 512, 4096, 64
KEY, ROUNDS = 0x5EED, 6
ENCODED = pa.schema([("task", pa.int64()), ("number", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])
ENCODED_DDL = "task long, number long, doc_id long, seq long, n_tokens long, tokens binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(batches, path, length, end):
    """A row per sequence, tokens without the padding."""
    tokenizer, number, task = encoder(path), 0, TaskContext.get().partitionId()
    for batch in batches:
        rows, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([*tokenizer.encode_ordinary(text), end], np.uint16)
            for i, lo in enumerate(range(0, len(ids), length)):
                part = ids[lo : lo + length]
                rows.append((task, number, doc, i, len(part), part.tobytes()))
                number += 1
            size += len(ids)
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ENCODED.types, strict=True)], schema=ENCODED)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ENCODED.types, strict=True)], schema=ENCODED)


def permuted(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A bijection of 0..n-1: Feistel rounds over an even number of bits, walked until below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    x = x.astype(U64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> U64(half), x[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right + U64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) % 2**64)) & mask)
        x[todo] = (left << U64(half)) | right
        todo = todo[x[todo] >= U64(n)]
    return x.astype(np.int64)


def give_slots(batches, base, total, per_shard):
    for batch in batches:
        number = np.array([base.value[t] for t in batch.column(0).to_pylist()], np.int64) + np.asarray(batch.column(1))
        slot = permuted(number, total)
        yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), *batch.columns[2:]], names=["shard", "slot", *batch.schema.names[2:]])


def write_pieces(batches, length, end, per_shard, piece):
    """Runs of up to `piece` successive sequences of a shard, each padded to its stride."""
    schema = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("seqs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])
    held: list[tuple] = []

    def out():
        pad = np.uint16(end).tobytes()
        payload = b"".join(t + pad * (length - len(t) // 2) for *_, t in held)
        row = (held[0][0], held[0][1], [h[2] for h in held], [h[3] for h in held], [h[4] for h in held], payload)
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or row[1] // piece != held[0][1] // piece):
                yield out()
                held = []
            held.append(row)
    if held:
        yield out()


def materialise(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, end: int = 50256) -> DataFrame:
    """Pieces of shards in order: shard, first (slot), doc_ids, seqs, sizes (tokens before padding), payload."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sql_text().alias("text"))
    rows = stored(docs.mapInArrow(lambda it: encode(it, path, length, end), ENCODED_DDL), "encoded")
    counts = rows.groupBy("task").agg((F.max("number") + 1).alias("n")).orderBy("task").toArrow()  # a row per scan task
    n = np.asarray(counts.column("n"))
    base = spark.sparkContext.broadcast(dict(zip(counts.column("task").to_pylist(), (np.cumsum(n) - n).tolist(), strict=True)))
    total = int(n.sum())
    slots = rows.mapInArrow(lambda it: give_slots(it, base, total, per_shard), "shard long, slot long, doc_id long, seq long, n_tokens long, tokens binary")
    n_shards, parts = max(1, -(-total // per_shard)), partitions(spark)
    dealt = slots.repartitionById(parts, F.floor(F.col("shard") * parts / n_shards).cast("int")).sortWithinPartitions("shard", "slot")
    return dealt.mapInArrow(lambda it: write_pieces(it, length, end, per_shard, PIECE), "shard long, first long, doc_ids array<long>, seqs array<long>, sizes array<long>, payload binary")


def read_sequences(batches, length, per_shard):
    """A row per sequence, read by stride from the pieces."""
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("sha256", pa.string())])
    stride = 2 * length
    for batch in batches:
        rows = []
        for shard, first, docs, seqs, sizes, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i, (doc, seq, size) in enumerate(zip(docs, seqs, sizes, strict=True)):
                rows.append((first + i, shard, (first + i - shard * per_shard) * stride, doc, seq, size, hashlib.sha256(payload[i * stride : (i + 1) * stride]).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def sequences(pieces: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, offset (bytes in the shard), doc_id, seq, n_tokens, sha256 (of the fixed-stride bytes)."""
    return pieces.mapInArrow(lambda it: read_sequences(it, length, per_shard), "slot long, shard long, offset long, doc_id long, seq long, n_tokens long, sha256 string")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(pieces: DataFrame, folder: str) -> DataFrame:
    """Writes binary files shard-NNNNNNNN.bin to a folder that all executors share (a path, or a URI that Arrow's file systems
    open), each by the task that holds its pieces. Returns shard, first (slot), n_bytes, path, stored."""
    schema = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("n_bytes", pa.int64()), ("path", pa.string())])

    def write(batches):
        fs, at = filesystems.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (filesystems.LocalFileSystem(), folder)
        fs.create_dir(at, recursive=True)
        held, out, first, size, name = None, None, 0, 0, ""

        def done():
            out.close()
            fs.move(name, f"{at}/{shard_name(held)}")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((held, first, size, f"{folder}/{shard_name(held)}"), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for shard, start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != held:
                    if out is not None:
                        yield done()
                    held, first, size, name = shard, start, 0, f"{at}/_{shard_name(shard)}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                out.write(payload.as_buffer())
                size += len(payload.as_buffer())
        if out is not None:
            yield done()

    return stored(pieces.select("shard", "first", "payload").mapInArrow(write, "shard long, first long, n_bytes long, path string"), "shards")


def read_slots(path: str, start: int, n: int, length: int = LENGTH) -> np.ndarray:
    """Sequences start .. start + n of a shard, as a matrix of ids; one seek."""
    fs, at = filesystems.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (filesystems.LocalFileSystem(), path)
    with fs.open_input_file(at) as f:
        f.seek(start * 2 * length)
        return np.frombuffer(f.read(n * 2 * length), np.uint16).reshape(-1, length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(materialise(table(spark, sf_dir, "documents").select("doc_id", "text")))
