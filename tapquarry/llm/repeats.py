"""Windows of L symbols that start earlier elsewhere: what both substring operators share.

A window's anchor is the k-gram in it with the least hash, so equal windows have equal anchors at equal
offsets. Consecutive windows with one anchor form its context. The steps:

1. `contexts`: each scan task keeps one context of each (anchor, content) and chunk of 256 doc_ids, the earliest,
   and sends it to the anchor's bucket. An anchor with many contents in one task (a line that a third
   of all documents hold) is marked as hot, and its contexts are dealt by content.
2. `answer`: a bucket finds contexts that occur again, and anchors with several contents, and
   answers the chunks. An anchor with THIN contents is hot too, though no one task saw many of them. The rest, most of the corpus, can hold no repeated window and is done.
3. `candidates`: chunks of documents meet their answers. All copies of one content but the earliest are
   repeats; the earliest goes, with its symbols, to where windows of the same anchor meet. That is the
   operator's own part: it gives back more repeated windows.
4. `finish`: chunks of documents meet their repeated windows.

Everything is keyed by content or by chunk; no task holds a hot group, and the driver holds nothing.
Rows that repeat a doc_id (or have none) are told apart by their texts, the lesser hash first; equal rows are judged
once and answered alike. Such tables are numbered anew, so that rows of one id fall into many chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_WORDS, NULL_ID, SPACE, Rolling, buffers, concat_id, mix, partitions, slabs, sql_text, stored

U64 = np.uint64
CHUNK_BITS = 8
POSITION_BITS = 20
#: Contents of one anchor in one task from which the anchor is hot.
HOT = 64
BYTE_IN_WORD = ~SPACE
#: Entries that a task gathers before it sends them.
FLUSH = 1_000_000
SLAB = 1 << 20
ENTRY = ("u8", "u8", "i8", "u4", "u1")  # anchor, content, doc, position, flags
REPEATED, MARK, SALTED = 1, 2, 4
ANSWER = ("u8", "u1")
FIRST, SEVERAL, IS_HOT = 1, 2, 4
#: Contents of one anchor in its bucket from which it is hot.
THIN = 4096
SPAN = ("i8", "u4", "u4")  # doc, first and last start of repeated windows
CONTEXT = ("u8", "i8", "u4", "u4", "u1")  # anchor, doc, position, symbols, hot


def pack(columns, kinds) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))


def unpack(blob: bytes, kinds):
    """The columns, and the bytes that follow them."""
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out, at


def unpack_all(blobs, kinds):
    parts = [unpack(b, kinds)[0] for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def of_bytes(data, offsets):
    """Symbols' hashes, documents' offsets in symbols, and what a context carries of each symbol."""
    return BYTE_WORDS[data[offsets[0] : offsets[-1]]], offsets - offsets[0], data[offsets[0] : offsets[-1]]


def word_edges(data, offsets):
    """Starts and ends of words in data[offsets[0]:offsets[-1]]; a document's end ends its last word."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    is_word = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.concatenate([[False], is_word[:-1]]) if len(data) else is_word
    after = np.concatenate([is_word[1:], [False]]) if len(data) else is_word
    start = np.flatnonzero(is_word & (~before | begins[:-1]))
    end = np.flatnonzero(is_word & (~after | begins[1:])) + 1
    return data, offsets, start, end


def of_words(data, offsets):
    data, offsets, start, end = word_edges(data, offsets)
    h = Rolling(BYTE_WORDS[data]).spans(start, end)
    return h, np.searchsorted(start, offsets), h


def occurrences(symbols, offsets, length, k):
    """Contexts: anchor hash, content hash, document's index, first window's start in the document and in the slab, windows."""
    out, piece, sizes = [], 1 << (POSITION_BITS - 1), np.diff(offsets)
    room = np.zeros(len(symbols) + 1, np.int32)
    has = sizes >= length
    np.add.at(room, offsets[:-1][has], 1)
    np.add.at(room, (offsets[1:] - length + 1)[has], -1)
    valid = np.cumsum(room[:-1]) > 0
    for at in range(0, max(0, len(symbols) - length + 1), piece):
        rolling = Rolling(symbols[at : at + piece + length - 1])
        v = rolling.grams(k)
        key = (v & U64(2**64 - 2**POSITION_BITS)) | np.arange(len(v), dtype=U64)
        width, span = length - k + 1, 1
        while span * 2 <= width:
            key, span = np.minimum(key[:-span], key[span:]), span * 2
        if rest := width - span:
            key = np.minimum(key[:-rest], key[rest:])
        p = np.flatnonzero(valid[at : at + len(key)])
        if not len(p):
            continue
        a = (key[p] & U64(2**POSITION_BITS - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
        lo, hi, a = p[new], p[np.append(new[1:], len(p)) - 1], a[new]
        shape = ((a - lo).astype(U64) << U64(32)) | (hi - lo).astype(U64)
        out.append((v[a], rolling.spans(lo, hi + length) ^ mix(shape), lo + at, hi - lo + 1))
    if not out:
        return [np.zeros(0, k) for k in ("u8", "u8", "i8", "i8", "i8", "i8")]
    ah, ch, lo, n = (np.concatenate(x) for x in zip(*out, strict=True))
    doc = np.searchsorted(offsets, lo, "right") - 1
    return ah, ch, doc, lo - offsets[doc], lo, n


def by_bucket(bucket, columns, kinds):
    """(bucket, packed columns) of each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b, columns = bucket[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for lo, hi in zip(cut, [*cut[1:], len(b)], strict=True):
        yield int(b[lo]), pack([c[lo:hi] for c in columns], kinds)


def rows(schema, items):
    """Record batches of some MB from tuples."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x[-1]) + 40
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


KEYED = pa.schema([("key", pa.int64()), ("payload", pa.binary())])
KINDED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("payload", pa.binary())])


def to_bucket(h, n):
    return (mix(h) % U64(n)).astype(np.int64)


def send_contexts(batches, units, length, k, buckets, most):
    def packed(parts):
        ah, ch, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        chunk = doc >> CHUNK_BITS
        order = np.lexsort((pos, doc, ch, ah))  # chunk follows doc
        ah, ch, chunk, doc, pos = (x[order] for x in (ah, ch, chunk, doc, pos))
        new_a = np.concatenate([[True], ah[1:] != ah[:-1]])
        new_c = new_a | np.concatenate([[True], ch[1:] != ch[:-1]])
        new = np.flatnonzero(new_c | np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        count = np.diff(np.append(new, len(ah)))
        of_anchor = np.cumsum(new_a) - 1
        hot = (np.bincount(of_anchor, weights=new_c) >= most)[of_anchor]
        flags = np.where(count > 1, REPEATED, 0).astype(np.uint8) | np.where(hot[new], SALTED, 0).astype(np.uint8)
        mark = np.flatnonzero(new_a & hot)
        z = np.zeros(len(mark), np.int64)
        columns = [np.concatenate(x) for x in ((ah[new], ah[mark]), (ch[new], z.astype(U64)), (doc[new], z), (pos[new], z), (flags, np.full(len(mark), MARK, np.uint8)))]
        to = to_bucket(np.where(columns[4] & SALTED, columns[0] ^ mix(columns[1]), columns[0]), buckets)
        return by_bucket(to, columns, ENTRY)

    def made():
        parts, n = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            data, at = buffers(batch.column(1))
            for lo, hi in slabs(at, SLAB):
                symbols, offsets, _ = units(data, at[lo : hi + 1])
                ah, ch, doc, pos, _, _ = occurrences(symbols, offsets, length, k)
                parts.append((ah, ch, ids[lo:hi][doc], pos))
                n += len(ah)
                if n > FLUSH:
                    yield from packed(parts)
                    parts, n = [], 0
        if n:
            yield from packed(parts)

    return rows(KEYED, made())


def groups(batches):
    """(key, payloads) of a partition sorted by key."""
    key, held = None, []
    for batch in batches:
        for k, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(p.as_py())
    if held:
        yield key, held


def answer(batches):
    def made():
        for _, blobs in groups(batches):
            ah, ch, doc, pos, flags = unpack_all(blobs, ENTRY)
            order = np.lexsort((pos, doc, ch, ah))
            ah, ch, doc, pos, flags = (x[order] for x in (ah, ch, doc, pos, flags))
            new_a = np.concatenate([[True], ah[1:] != ah[:-1]])
            of_a = np.cumsum(new_a) - 1
            hot = (np.bincount(of_a, weights=(flags & (MARK | SALTED)) > 0) > 0)[of_a]
            real = (flags & MARK) == 0
            ah, ch, doc, pos, flags, hot, of_a = (x[real] for x in (ah, ch, doc, pos, flags, hot, of_a))
            if not len(ah):
                continue
            new_a = np.concatenate([[True], of_a[1:] != of_a[:-1]])
            new_c = new_a | np.concatenate([[True], ch[1:] != ch[:-1]])
            of_c = np.cumsum(new_c) - 1
            contents = np.zeros(of_a[-1] + 1)
            np.add.at(contents, of_a, new_c)
            hot |= contents[of_a] >= THIN
            several = hot | (contents[of_a] > 1)
            start = np.flatnonzero(new_c)[of_c]
            first = (doc == doc[start]) & (pos == pos[start])
            again = np.bincount(of_c, weights=1 + ((flags & REPEATED) > 0))[of_c] > 1
            need = several | again
            out = np.where(first, FIRST, 0) | np.where(several, SEVERAL, 0) | np.where(hot, IS_HOT, 0)
            yield from by_bucket(doc[need] >> CHUNK_BITS, [(ah ^ mix(ch))[need], out[need]], ANSWER)

    return rows(KEYED, made())


class Chunk:
    """What one chunk of documents has been told, and which contexts were seen first."""

    def __init__(self, blobs):
        key, flags = unpack_all(blobs, ANSWER)
        order = np.argsort(key, kind="stable")
        key, flags = key[order], flags[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key = key[new]
        self.flags = np.bitwise_or.reduceat(flags, new) if len(new) else flags
        self.doc, self.pos = np.zeros(len(new), np.int64), np.full(len(new), -1, np.int64)

    def split(self, g, doc, pos):
        """Of contexts in order: which repeat an earlier one, and which are the first of theirs and need a closer look; which are hot."""
        if not len(self.key):
            none = np.zeros(len(g), bool)
            return none, none, none
        i = np.minimum(np.searchsorted(self.key, g), len(self.key) - 1)
        hit = self.key[i] == g
        at = np.flatnonzero(hit & ((self.flags[i] & FIRST) > 0) & (self.pos[i] < 0))
        fresh, first = np.unique(i[at], return_index=True)
        self.doc[fresh], self.pos[fresh] = doc[at[first]], pos[at[first]]
        is_first = hit & ((self.flags[i] & FIRST) > 0) & (self.doc[i] == doc) & (self.pos[i] == pos)
        return hit & ~is_first, is_first & ((self.flags[i] & SEVERAL) > 0), (self.flags[i] & IS_HOT) > 0


def merged(doc, lo, hi):
    """Spans of window starts, those that touch joined; sorted by document and start."""
    if not len(doc):
        return doc.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    base = np.cumsum(new_doc) << 33  # positions are below 2^32
    reach = np.maximum.accumulate(hi + base)
    new = np.flatnonzero(np.concatenate([[True], (lo + base)[1:] > reach[:-1] + 1]))
    end = np.append(new[1:], len(doc)) - 1
    return doc[new], lo[new], reach[end] - base[end]


def with_chunks(batches):
    """(chunk, payloads, iterator of (doc_ids, data, offsets)) from rows (chunk, kind, doc_id, payload) in that order."""
    state = {"rest": None}

    def pieces():
        for b in batches:
            if not b.num_rows:
                continue
            chunk, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
            cut = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(cut, [*cut[1:], len(chunk)], strict=True):
                yield int(chunk[lo]), int(kind[lo]), b.slice(int(lo), int(hi - lo))

    it = pieces()

    def take():
        if state["rest"] is None:
            state["rest"] = next(it, None)
        return state["rest"]

    while (head := take()) is not None:
        chunk, told = head[0], []
        while (x := take()) is not None and x[0] == chunk and x[1] == 0:
            told += x[2].column(3).to_pylist()
            state["rest"] = None

        def texts(chunk=chunk):
            while (x := take()) is not None and x[0] == chunk and x[1] == 1:
                state["rest"] = None
                yield np.asarray(x[2].column(2)), *buffers(x[2].column(3))

        yield chunk, told, texts()
        for _ in texts():  # what the caller left
            pass


def find_candidates(batches, units, length, k, shards):
    def made():
        for chunk, told, texts in with_chunks(batches):
            if not told:
                continue
            state, spans, held, size = Chunk(told), [], [], 0
            for ids, data, at in texts:
                for lo, hi in slabs(at, SLAB):
                    symbols, offsets, carry = units(data, at[lo : hi + 1])
                    ah, ch, doc, pos, start, n = occurrences(symbols, offsets, length, k)
                    repeat, open_, hot = state.split(ah ^ mix(ch), ids[lo:hi][doc], pos)
                    spans.append((ids[lo:hi][doc[repeat]], pos[repeat], (pos + n - 1)[repeat]))
                    o = np.flatnonzero(open_)
                    if len(o):
                        held.append((ah[o], ids[lo:hi][doc[o]], pos[o], n[o] + length - 1, hot[o], carry, start[o]))
                        size += int((n[o] + length).sum()) * carry.itemsize
                    if size > 4 << 20:
                        yield from opened(held)
                        held, size = [], 0
            yield from opened(held)
            if spans and sum(len(x[0]) for x in spans):
                yield 0, chunk, pack(merged(*(np.concatenate(x) for x in zip(*spans, strict=True))), SPAN)

    def opened(held):
        parts = {}
        for ah, doc, pos, size, hot, carry, start in held:
            shard = to_bucket(np.where(hot, ah ^ mix(doc.astype(U64)), ah), shards)
            order = np.argsort(shard, kind="stable")
            s = shard[order]
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(s)], strict=True):
                o = order[a:b]
                text = np.concatenate([carry[start[i] : start[i] + size[i]] for i in o])
                parts.setdefault(int(s[a]), []).append(([ah[o], doc[o], pos[o], size[o], hot[o]], text))
        for shard, items in parts.items():
            columns = [np.concatenate(x) for x in zip(*(i[0] for i in items), strict=True)]
            yield 1, shard, pack(columns, CONTEXT) + np.concatenate([i[1] for i in items]).tobytes()

    return rows(KINDED, made())


def read_contexts(blobs, dtype):
    parts = [unpack(b, CONTEXT) for b in blobs]
    columns = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
    return [*columns, np.concatenate([np.frombuffer(b, dtype, offset=p[1]) for b, p in zip(blobs, parts, strict=True)])]


def joined_with(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Rows (chunk, kind, doc_id, payload): a chunk's payloads, then its documents by doc_id."""
    d = docs.select(F.shiftright("doc_id", CHUNK_BITS).alias("chunk"), F.lit(1).alias("kind"), "doc_id", F.col("text").cast("binary").alias("payload"))
    t = told.select(F.col("key").alias("chunk"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_id"), "payload")
    return t.unionByName(d).repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "doc_id")


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "key").sortWithinPartitions("key")


def documents_of(df: DataFrame) -> DataFrame:
    return df.select(concat_id().alias("doc_id"), sql_text().alias("text"))


def numbered(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents (doc_id, text) whose ids are unique, and what gives the rows back: number, doc_id, times. None where
    the ids are unique as they are."""
    docs = documents_of(df)
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        return docs, None
    named = docs.withColumn("hash", F.xxhash64("text"))
    rows = named.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("times"))
    ranged = rows.repartitionByRange(partitions(df.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    names = stored(ranged.withColumn("number", F.monotonically_increasing_id()), "names")  # grows with (doc_id, hash)
    texts = named.groupBy("doc_id", "hash").agg(F.first("text").alias("text"))
    return stored(texts.join(names, ["doc_id", "hash"]).select(F.col("number").alias("doc_id"), "text"), "numbered"), names.select("number", "doc_id", "times")


def named_again(out: DataFrame, names: DataFrame | None) -> DataFrame:
    """Results by number as rows of the table's own ids."""
    if names is None:
        return out
    back = out.withColumnRenamed("doc_id", "number").join(names, "number").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return back.select(F.when(F.col("doc_id") != F.lit(NULL_ID), F.col("doc_id")).alias("doc_id"), *out.columns[1:])


def candidates(docs: DataFrame, units, length: int, k: int, hot: int = HOT) -> DataFrame:
    """Rows (kind, key, payload), stored: kind 0 has a chunk's repeated spans, kind 1 a shard's open contexts."""
    n = 2 * partitions(docs.sparkSession)
    sent = docs.mapInArrow(lambda it: send_contexts(it, units, length, k, n, hot), "key long, payload binary")
    answers = dealt(sent).mapInArrow(answer, "key long, payload binary")
    found = joined_with(docs, answers).mapInArrow(lambda it: find_candidates(it, units, length, k, n), "kind int, key long, payload binary")
    return stored(found, "repeats")


def digests(batches, schema, of_chunk):
    """of_chunk(doc_ids, data, offsets, spans by document) gives rows' columns."""
    for _, told, texts in with_chunks(batches):
        doc, lo, hi = merged(*unpack_all(told, SPAN))
        for ids, data, at in texts:
            for a, b in slabs(at, SLAB):
                columns = of_chunk(ids[a:b], data, at[a : b + 1], doc, lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def finish(docs: DataFrame, spans: DataFrame, schema: pa.Schema, ddl: str, of_chunk) -> DataFrame:
    return joined_with(docs, spans).mapInArrow(lambda it: digests(it, schema, of_chunk), ddl)
