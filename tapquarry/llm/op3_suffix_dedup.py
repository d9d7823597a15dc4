"""Suffix-array dedup: bytes of a 100-byte string that starts earlier in the corpus are removed.

Open contexts of one anchor meet in a shard (see `repeats`). The shard's suffixes are ordered by external
induced sorting with common prefixes up to the window (`induced`); suffixes that share a window are
neighbours, and all but the earliest are repeats. A hot anchor's contexts are dealt over shards by document;
each shard drops its own repeats, and what is left meets by the window's 128-bit hash.

Nulls: a null text is empty, a null doc_id comes before all others and is returned as null. Of unlike texts of one
doc_id that of the lesser hash comes first; equal rows are one document given again and answered alike. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .common import BYTE_WORDS, NULL_ID, Rolling, mix, partitions, table
from .induced import sort_suffixes

U64 = np.uint64
WINDOW, ANCHOR = 100, 24
#: Bytes of text that are sorted at once; anchors of a shard are taken in such lots, and one anchor with more is a lot of its own.
#: Hot contexts are cut anywhere: their windows meet again by hash.
LOT = 1 << 20
WINDOW_ROW = ("u8", "u8", "i8", "u4")
COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def repeats_in(anchor, doc, pos, size, hot, text, length):
    """Documents and starts of windows that start earlier among these contexts; the same of hot windows that don't, with two hashes."""
    n = len(doc)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    # each context ends in a symbol of its own; the last of them is the least of all
    t = np.empty(len(text) + n, np.int64)
    at = begin + np.arange(n)
    where = np.ones(len(t), bool)
    ends = at + size
    where[ends] = False
    t[where] = text.astype(np.int64) + n
    t[ends] = np.arange(n)[::-1]
    with tempfile.TemporaryDirectory() as folder:
        order, prefix = sort_suffixes(t, length, folder)
    group = np.cumsum(prefix < length)
    owner = np.searchsorted(at, order, "right") - 1
    off = order - at[owner]
    whole = np.flatnonzero(off + length <= size[owner])
    group, owner, off, order = group[whole], owner[whole], off[whole], order[whole]
    d, p = doc[owner], pos[owner] + off
    rank = np.lexsort((p, d, group))
    g, d, p, owner, order = group[rank], d[rank], p[rank], owner[rank], order[rank]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = (d == d[head]) & (p == p[head])
    h = first & hot[owner].astype(bool)
    s = order[h]
    sums = [Rolling(x).spans(s, s + length) for x in (symbol_words(t, n, 0), symbol_words(t, n, 1))] if h.any() else [np.zeros(0, U64)] * 2
    return (d[~first], p[~first]), (*sums, d[h], p[h])


def symbol_words(t, n, kind):
    w = BYTE_WORDS if kind == 0 else mix(BYTE_WORDS + U64(kind))
    return np.where(t >= n, w[np.maximum(t - n, 0)], U64(0))


def lots(anchor, size):
    """Index ranges, in anchor order, of about LOT bytes; an anchor's contexts stay together."""
    order = np.argsort(anchor, kind="stable")
    a, total, lo = anchor[order], np.cumsum(size[order]), 0
    while lo < len(a):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + LOT, "right")))
        hi = int(np.searchsorted(a, a[hi - 1], "right"))
        yield order[lo:hi]
        lo = hi


def sort_shards(batches, length, buckets):
    def made():
        for _, blobs in R.groups(batches):
            anchor, doc, pos, size, hot, text = R.read_contexts(blobs, np.uint8)
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            for o in lots(np.where(hot, np.arange(len(hot), dtype=U64), anchor), size):
                part = np.concatenate([text[begin[i] : begin[i] + size[i]] for i in o])
                (d, p), (h1, h2, hd, hp) = repeats_in(anchor[o], doc[o], pos[o], size[o], hot[o], part, length)
                d, lo, hi = R.merged(d, p, p)
                yield from ((0, k, b) for k, b in R.by_bucket(d >> R.CHUNK_BITS, [d, lo, hi], R.SPAN))
                yield from ((2, k, b) for k, b in R.by_bucket(R.to_bucket(h1, buckets), [h1, h2, hd, hp], WINDOW_ROW))

    return R.rows(R.KINDED, made())


def meet_hot(batches):
    """Hot windows of all shards, by hash: all but the earliest."""

    def made():
        for _, blobs in R.groups(batches):
            a, b, doc, pos = R.unpack_all(blobs, WINDOW_ROW)
            order = np.lexsort((pos, doc, b, a))
            a, b, doc, pos = a[order], b[order], doc[order], pos[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[head]) | (pos != pos[head])
            d, lo, hi = R.merged(doc[later], pos[later], pos[later])
            yield from R.by_bucket(d >> R.CHUNK_BITS, [d, lo, hi], R.SPAN)

    return R.rows(R.KEYED, made())


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = R.HOT) -> DataFrame:
    """Rows (key, payload): a chunk's spans of starts of repeated windows."""
    found = R.candidates(docs, R.of_bytes, window, anchor, hot)
    n = 2 * partitions(docs.sparkSession)
    kinds = "kind int, key long, payload binary"
    shards = R.stored(R.dealt(found.where("kind = 1").select("key", "payload")).mapInArrow(lambda it: sort_shards(it, window, n), kinds), "suffixes")
    met = R.dealt(shards.where("kind = 2").select("key", "payload")).mapInArrow(meet_hot, "key long, payload binary")
    return found.where("kind = 0").select("key", "payload").unionByName(shards.where("kind = 0").select("key", "payload")).unionByName(met)


def kept_parts(ids, at, doc, lo, hi, length):
    """For each document, its removed runs [start, end) in symbols, clipped to its size."""
    for i, d in enumerate(ids):
        size = int(at[i + 1] - at[i])
        a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
        runs = []
        for s, e in zip(lo[a:b].tolist(), (hi[a:b] + length).tolist(), strict=True):
            e = min(e, size)
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(e, runs[-1][1])
            elif s < e:
                runs.append([s, e])
        yield i, size, runs


def suffix_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False, hot: int = R.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `texts` also `kept`, the remaining bytes."""
    docs, names = R.numbered(docs)
    spans = repeated_spans(docs, window, anchor, hot)

    def of_chunk(ids, data, at, doc, lo, hi):
        out = [[] for _ in range(5 + texts)]
        for i, size, runs in kept_parts(ids, at, doc, lo, hi, window):
            begin, last, kept = int(at[i]), 0, []
            for s, e in runs:
                kept.append(data[begin + last : begin + s])
                last = e
            kept.append(data[begin + last : begin + size])
            kept = b"".join(x.tobytes() for x in kept)
            row = (None if ids[i] == NULL_ID else int(ids[i]), size, size - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)
            for c, x in zip(out, row, strict=False):
                c.append(x)
        return out

    schema = COLUMNS.append(pa.field("kept", pa.binary())) if texts else COLUMNS
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return R.named_again(R.finish(docs, spans, schema, ddl, of_chunk), names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
