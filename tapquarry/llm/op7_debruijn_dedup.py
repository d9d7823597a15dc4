"""Substring dedup over words: a word is removed if a 20-word window over it starts earlier in the corpus.

Windows of the open contexts (see `repeats`) are the edges of a De Bruijn graph: each leads from the node
of its first 19 words to that of its last 19. Edges seen again are kept, and paths without branches
compact to unitigs through joins that double the pointers' reach. An occurrence of a unitig is a run of
successive windows; its source coordinates are checked against the unitig's, and each edge's least
coordinates tell the first occurrence from the repeats.

Words are runs of bytes other than space and 0x09-0x0D, unchanged. Nulls: a null text has no words; a null
doc_id comes before all others and is returned as null. Of unlike texts of one doc_id that of the lesser hash
comes first; equal rows are one document given again and answered alike. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import repeats as R
from .common import NULL_ID, Rolling, mix, table
from .op3_suffix_dedup import kept_parts

U64 = np.uint64
WINDOW, ANCHOR = 20, 5
COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
EDGE = pa.schema([("edge", pa.int64()), ("proof", pa.int64()), ("tail", pa.int64()), ("head", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64())])
EDGE_DDL = "edge long, proof long, tail long, head long, doc long, pos long"


def expand(batches, length):
    """A row for each window of the open contexts: two hashes of it, its two nodes, its coordinates."""
    for batch in batches:
        for blob in batch.column(0):
            _, doc, pos, size, _, words = R.read_contexts([blob.as_py()], np.uint64)
            size, n = size.astype(np.int64), size.astype(np.int64) - length + 1
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            owner = np.repeat(np.arange(len(doc)), n)
            off = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            s = begin[owner] + off
            a, b = Rolling(words), Rolling(mix(words + U64(7)))
            columns = (a.spans(s, s + length), b.spans(s, s + length), a.spans(s, s + length - 1), a.spans(s + 1, s + length))
            for lo in range(0, len(s), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(c[part].view(np.int64)) for c in columns] + [pa.array(doc[owner[part]]), pa.array((pos[owner[part]] + off[part]).astype(np.int64))], schema=EDGE)


def compact(spark: SparkSession, repeated: DataFrame) -> DataFrame:
    """edge -> unitig, ordinal. Nodes with one repeated edge in and one out link their edges; pointers to a path's
    start double their reach in each round. Edges of a ring without a start stay unitigs of one edge."""
    ends = repeated.select(F.col("tail").alias("node"), F.lit(None).cast("long").alias("into"), F.col("edge").alias("out"))
    ends = ends.unionByName(repeated.select(F.col("head").alias("node"), F.col("edge").alias("into"), F.lit(None).cast("long").alias("out")))
    links = ends.groupBy("node").agg(F.count("into").alias("ins"), F.count("out").alias("outs"), F.max("into").alias("at"), F.max("out").alias("edge"))
    links = links.where("ins = 1 and outs = 1 and at != edge").select("edge", "at")
    start = F.col("at").isNull()
    paths = repeated.select("edge").join(links, "edge", "left").select("edge", F.coalesce("at", "edge").alias("at"), F.when(start, 0).otherwise(1).cast("long").alias("ordinal"), start.alias("ok"))
    paths = R.stored(paths, "paths")
    for _ in range(math.ceil(math.log2(max(2, repeated.count()))) + 1):
        if not paths.where("not ok").take(1):
            break
        onward = paths.select(F.col("edge").alias("at"), F.col("at").alias("next"), F.col("ordinal").alias("more"), F.col("ok").alias("there"))
        paths = R.stored(paths.join(onward, "at").select("edge", F.col("next").alias("at"), (F.col("ordinal") + F.col("more")).alias("ordinal"), F.col("there").alias("ok")), "paths")
    return paths.selectExpr("edge", "if(ok, at, edge) as unitig", "if(ok, ordinal, 0L) as ordinal")


def to_chunks(batches):
    def made():
        for b in batches:
            doc, lo, hi = (np.asarray(b.column(i)) for i in range(3))
            yield from R.by_bucket(doc >> R.CHUNK_BITS, [doc, lo, hi], R.SPAN)

    return R.rows(R.KEYED, made())


def spans_of(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = R.HOT) -> tuple[DataFrame, DataFrame]:
    """Repeated spans by chunk (key, payload), and the long repeats found through the graph:
    unitig, doc_id, start and end word of each occurrence that is not the first."""
    found = R.candidates(docs, R.of_words, window, anchor, hot)
    edges = found.where("kind = 1").select("payload").mapInArrow(lambda it: expand(it, window), EDGE_DDL)
    repeated = edges.groupBy("edge", "proof").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("first"), F.min("tail").alias("tail"), F.min("head").alias("head"))
    repeated = R.stored(repeated.where("n > 1"), "edges")
    unitigs = compact(docs.sparkSession, repeated)
    known = repeated.select("edge", "proof", "first").join(unitigs, "edge")
    later = edges.select("edge", "proof", "doc", "pos").join(known, ["edge", "proof"]).where("doc != first.doc or pos != first.pos")
    w = Window.partitionBy("doc", "unitig", F.expr("pos - ordinal")).orderBy("pos")
    runs = later.withColumn("island", F.col("pos") - F.dense_rank().over(w))
    # on one diagonal, source coordinates and ordinals advance together; an island has no gap
    runs = runs.groupBy("doc", "unitig", F.expr("pos - ordinal").alias("diagonal"), "island").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    packed = runs.select("doc", "lo", "hi").mapInArrow(to_chunks, "key long, payload binary")
    report = runs.select("unitig", F.col("doc").alias("doc_id"), F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
    return found.where("kind = 0").select("key", "payload").unionByName(packed), report


def normal(data, at):
    """Words each followed by a space; each document's offset in words; each word's start there."""
    data, offsets, start, end = R.word_edges(data, at)
    size = end - start
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[R.BYTE_IN_WORD[data]]
    return out, np.searchsorted(start, offsets), np.concatenate([[0], np.cumsum(size + 1)])


def debruijn_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False, hot: int = R.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with `texts` also `kept`, the kept words joined by one space."""
    docs, names = R.numbered(docs)
    spans, _ = spans_of(docs, window, anchor, hot)

    def of_chunk(ids, data, at, doc, lo, hi):
        text, words_at, word = normal(data, at)
        out = [[] for _ in range(4 + texts)]
        for i, size, runs in kept_parts(ids, words_at, doc, lo, hi, window):
            begin, last, kept = int(words_at[i]), 0, []
            for s, e in [*runs, [size, size]]:
                kept.append(text[word[begin + last] : word[begin + s]].tobytes())
                last = e
            kept = b"".join(kept)[:-1]
            row = (None if ids[i] == NULL_ID else int(ids[i]), size, sum(e - s for s, e in runs), hashlib.sha256(kept).hexdigest(), kept)
            for c, x in zip(out, row, strict=False):
                c.append(x)
        return out

    schema = COLUMNS.append(pa.field("kept", pa.binary())) if texts else COLUMNS
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * texts
    return R.named_again(R.finish(docs, spans, schema, ddl, of_chunk), names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
