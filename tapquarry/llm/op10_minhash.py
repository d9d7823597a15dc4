"""MinHash near-dedup with tensored banding.

Two collections of `halves` half-keys are made, each half-key of three minhashes; a table's key pairs one
of the first with one of the second. So halves^2 tables of six minhashes come from 6 * halves minhashes.
A pair at the threshold s shares no table with a probability of 2 * (1 - s^3)^halves: 0.00015 at 0.85 with 10 halves.

Documents with equal shingle sets are one class first, a node of the graph. Links are confirmed on full sets of
64-bit shingle hashes, in this order:

1. Each node is compared with the least node of all its buckets (one comparison a node).
2. What is left are buckets with several components. Buckets of up to `crowded` nodes give their pairs of
   different components; each pair is compared once.
3. Nodes of larger buckets meet again by their first half-keys alone, so that a pair meets a few times and not in
   each of its tables. Nodes outside the group's largest component are a query set, compared with all of the group
   in blocks of `block` times `block` nodes. A block answers with the components that it joins, never with pairs.

So every pair that shares a table is in one component, ruled out by its sizes, or compared: nothing is capped.

Nulls: a null text has no words and links with nothing; a null doc_id comes before all others and is returned
as null. Rows that repeat a doc_id are nodes by their texts; each has its own component. Other columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .common import BYTE_WORDS, NULL_ID, Rolling, buffers, concat_id, mix, partitions, slabs, sql_text, stored, table
from .graph import components, joined

U64 = np.uint64
ROWS = 3
#: Local members of one key from which a task pairs them itself and sends only its centre.
HOT = 32
ENTRY = ("u8", "i8", "u4")  # key, doc, size of its set
PAIRED = ("u8", "i8", "u4", "i8")
#: Nodes of a bucket from which they meet in blocks, and nodes on each side of a block.
CROWDED, BLOCK = 16, 512
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SIGNATURE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.binary())])
SIGNATURE_DDL = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, keys binary"
LIVE = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("centre", pa.int64())])


def shingles(data, at, k):
    """Sorted distinct shingle hashes of all documents one after another, and offsets."""
    data, offsets, start, end = R.word_edges(LOWER[data[at[0] : at[-1]]], at - at[0])
    rolling = Rolling(Rolling(BYTE_WORDS[data]).spans(start, end))
    w = np.searchsorted(start, offsets)
    n_words = np.diff(w)
    n = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = w[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    h = rolling.spans(first, np.minimum(first + k, w[1:][doc]))
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)


def half_keys(h, offsets, halves):
    """Matrix documents x 2 * halves, for documents with shingles."""
    seeds = mix(np.arange(1, 4 * ROWS * halves + 1, dtype=U64) * U64(0xA24BAED4963EE407))
    starts, out = offsets[:-1], []
    for i in range(2 * halves):
        key = np.full(len(starts), U64(i + 1))
        for j in range(ROWS):
            s = seeds[2 * (i * ROWS + j) : 2 * (i * ROWS + j) + 2]
            key = mix(key + np.minimum.reduceat((h ^ s[0]) * (s[1] | U64(1)), starts))
        out.append(key)
    return np.stack(out, 1)


def sign(batches, k, halves):
    for batch in batches:
        ids, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        data, at = buffers(batch.column(2))
        for lo, hi in slabs(at, R.SLAB):
            h, offsets = shingles(data, at[lo : hi + 1], k)
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            s1, s2, keys = np.zeros(len(n), U64), np.zeros(len(n), U64), [b""] * len(n)
            if len(some):
                full = np.append(offsets[:-1][some], offsets[-1])
                s1[some], s2[some] = (np.add.reduceat(mix(h + U64(c)), full[:-1]) for c in (11, 13))
                for i, row in zip(some.tolist(), half_keys(h, full, halves), strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(hashes[lo:hi]), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(keys, pa.binary())], schema=SIGNATURE)


def gathered(key, doc, n, percent):
    """Entries by key and size, cut where sizes leave a gap that no link can bridge: order, start of each
    entry's part, size of the part, and its centre (the least doc; the doc itself where sizes rule a link out)."""
    order = np.lexsort((n, key))
    key, doc, n = key[order], doc[order], n[order].astype(np.int64)
    if not len(key):
        return order, np.zeros(0, np.int64), doc
    cut = np.concatenate([[True], (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])])
    start = np.flatnonzero(cut)
    part = np.cumsum(cut) - 1
    least = np.lexsort((doc, part))[start]  # parts keep their places, so the least comes first in each
    centre, m = doc[least][part], n[least][part]
    centre = np.where(100 * np.minimum(n, m) < percent * np.maximum(n, m), doc, centre)
    return order, np.diff(np.append(start, len(key)))[part], centre


def send(batches, halves, buckets, percent, most):
    """Table keys by bucket: (key, payload). The payload's first byte tells entries from pairs that a task has made itself."""

    def packed(docs, sizes, keys):
        a, b = keys[:, :halves], keys[:, halves:]
        key = mix(a[:, :, None] * U64(0x9FB21C651E98DF25) + b[:, None, :]).ravel()
        doc, n = np.repeat(docs, halves * halves), np.repeat(sizes, halves * halves)
        order, size, centre = gathered(key, doc, n, percent)
        key, doc, n = key[order], doc[order], n[order]
        mine = (size >= most) & (centre != doc)
        told = size >= most  # the centre stands with the pairs, also where no other task has its key
        for blob, to in ((R.by_bucket(R.to_bucket(key[~mine], buckets), [key[~mine], doc[~mine], n[~mine]], ENTRY), b"\0"), (R.by_bucket(R.to_bucket(key[told] ^ mix(doc[told].astype(U64)), buckets), [key[told], doc[told], n[told], centre[told]], PAIRED), b"\1")):
            for k, p in blob:
                yield k, to + p

    def made():
        docs, sizes, keys, n, lot = [], [], [], 0, 10_000
        for batch in batches:
            docs.append(np.asarray(batch.column(0)))
            sizes.append(np.asarray(batch.column(1)))
            keys.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), U64).reshape(-1, 2 * halves))
            n += len(docs[-1])
            while n >= lot:
                d, z, m = np.concatenate(docs), np.concatenate(sizes), np.concatenate(keys)
                yield from packed(d[:lot], z[:lot], m[:lot])
                docs, sizes, keys, n = [d[lot:]], [z[lot:]], [m[lot:]], n - lot
        if n:
            yield from packed(np.concatenate(docs), np.concatenate(sizes), np.concatenate(keys))

    return R.rows(R.KEYED, made())


def meet(batches, percent):
    """Entries of keys that several documents share, with the centre each is compared with first."""
    for _, blobs in R.groups(batches):
        key, doc, n = R.unpack_all([b[1:] for b in blobs if b[0] == 0], ENTRY)
        order, size, centre = gathered(key, doc, n, percent)
        made = R.unpack_all([b[1:] for b in blobs if b[0] == 1], PAIRED)
        shared = size > 1
        columns = [np.concatenate([x[shared], y]) for x, y in zip((key[order], doc[order], n[order], centre), made, strict=True)]
        for lo in range(0, len(columns[0]), 200_000):
            part = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(c[part].astype(np.int64) if c.dtype != U64 else c[part].view(np.int64)) for c in columns], schema=LIVE)


def sets_of(batches, k):
    """node and its sorted shingle hashes, from node and text."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        node = np.asarray(batch.column(0))
        data, at = buffers(batch.column(1))
        for lo, hi in slabs(at, R.SLAB):
            h, offsets = shingles(data, at[lo : hi + 1], k)
            found = [h[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi]), pa.array(found, pa.binary())], schema=schema)


def confirm(batches, percent):
    """Pairs (u, v) whose full sets reach the threshold."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            one, other = (np.frombuffer(x.as_buffer(), U64) for x in (a, b))
            at = np.minimum(np.searchsorted(one, other), len(one) - 1)
            both = int((one[at] == other).sum())
            keep[i] = 100 * both >= percent * (len(one) + len(other) - both)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], schema=schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) that are links."""
    one = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = one.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").select("u", "v", "a", "b")
    return both.mapInArrow(lambda it: confirm(it, percent), "u long, v long")


#: Products of a shingle's occurrences on both sides of a block above which it is counted by a matrix product.
FREQUENT = 4096


def common_shingles(asked, there):
    """Matrix of the sizes of all intersections of two lists of sorted sets."""
    out = np.zeros((len(asked), len(there)), np.float32)
    known = np.unique(np.concatenate(asked))
    sides = []
    for sets in (asked, there):
        owner, token = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, token), len(known) - 1)
        some = known[at] == token
        order = np.argsort(at[some], kind="stable")
        sides.append((owner[some][order], at[some][order], np.bincount(at[some], minlength=len(known))))
    (a, ta, na), (b, tb, nb) = sides
    frequent = np.flatnonzero(na * nb > FREQUENT)
    for lo in range(0, len(frequent), 1024):
        part = frequent[lo : lo + 1024]
        dense = []
        for owner, token, n in ((a, ta, len(asked)), (b, tb, len(there))):
            at = np.minimum(np.searchsorted(part, token), len(part) - 1)
            m = np.zeros((n, len(part)), np.float32)
            some = part[at] == token
            m[owner[some], at[some]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    # the others pair by pair
    start_b = np.concatenate([[0], np.cumsum(nb)])
    left = np.flatnonzero((na * nb <= FREQUENT)[ta] & (nb[ta] > 0))
    for lo in range(0, len(left), 4096):
        i = left[lo : lo + 4096]
        n = nb[ta[i]]
        row = np.repeat(a[i], n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start_b[ta[i]], n)
        np.add.at(out, (row, b[j]), 1)
    return out


def compare(batches, percent):
    """Components joined in each block: (u, v). Rows: task, asked, c (component), shingles; sorted by task."""

    def blocks():
        task, held = None, []
        for batch in batches:
            for t, asked, c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if t != task and held:
                    yield held
                    held = []
                task = t
                held.append((asked, c, np.frombuffer(x.as_py(), U64)))
        if held:
            yield held

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for held in blocks():
        (qc, q), (rc, r) = ([[h[i] for h in held if h[0] == side] for i in (1, 2)] for side in (True, False))
        if not q or not r:
            continue
        both = common_shingles(q, r).astype(np.int64)
        sizes = np.array([len(x) for x in q])[:, None] + np.array([len(x) for x in r])[None, :]
        i, j = np.nonzero(100 * both >= percent * (sizes - both))
        u, v = np.array(qc, np.int64)[i], np.array(rc, np.int64)[j]
        apart = u != v
        for b in joined(u[apart], v[apart]):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0)], schema=schema).filter(pa.array(np.asarray(b.column(0)) != np.asarray(b.column(1))))


def pairs_of_small(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components of a bucket that sizes do not rule out. mixed: key, node, n, c."""
    held = mixed.groupBy("key").agg(F.collect_list(F.struct("c", "node", "n")).alias("all")).select("all", F.explode("all").alias("x"))
    both = held.select("x", F.explode(F.filter("all", lambda y: (F.col("x.c") < y["c"]) & (100 * F.least("x.n", y["n"]) >= percent * F.greatest("x.n", y["n"])))).alias("y"))
    return both.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def blocks_of_crowded(crowd: DataFrame, classes: DataFrame, sets: DataFrame, halves: int, percent: int, block: int) -> DataFrame:
    """Components (u, v) that links between crowded nodes join. crowd: node, c, distinct."""
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring("keys", 8 * i + 1, 8).alias("half")) for i in range(halves)])).alias("g")
    there = stored(crowd.join(classes.select("node", "keys"), "node").select("node", "c", half).select("node", "c", F.xxhash64("g.i", "g.half").alias("g")), "crowd")
    sizes = there.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("g").agg(F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("most")).where("m > most.m")
    placed = there.join(sizes, "g").withColumns({"wide": F.ceil(F.col("m") / block).cast("int"), "deep": F.ceil((F.col("m") - F.col("most.m")) / block).cast("int"), "outside": F.col("c") != F.col("most.c")})
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    row, column = F.sequence(F.lit(0), F.col("deep") - 1), F.sequence(F.lit(0), F.col("wide") - 1)
    rows = placed.select("g", "node", "c", own("wide", 1).alias("x"), F.explode(row).alias("y"), F.lit(False).alias("asked"))
    asked = placed.where("outside").select("g", "node", "c", F.explode(column).alias("x"), own("deep", 2).alias("y"), F.lit(True).alias("asked"))
    sent = rows.unionByName(asked).join(sets, "node").select(F.xxhash64("g", "x", "y").alias("task"), "asked", "c", "shingles")
    return sent.repartition(partitions(crowd.sparkSession), "task").sortWithinPartitions("task").mapInArrow(lambda it: compare(it, percent), "u long, v long").distinct()


def labelled_rows(docs: DataFrame, shingle: int, percent: int, halves: int, hot: int, crowded: int, block: int) -> DataFrame:
    """A row per row of docs: doc_id (NULL_ID for null), text_hash, n_shingles, component (null without shingles), least (struct
    of the component's first doc_id and text_hash)."""
    spark = docs.sparkSession
    docs = R.documents_of(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    n = 2 * partitions(spark)
    signed = stored(docs.mapInArrow(lambda it: sign(it, shingle, halves), SIGNATURE_DDL), "signatures")
    first = F.struct("doc_id", "text_hash")
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min(first).alias("least"), F.min_by("keys", first).alias("keys"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # fixed once written
    sent = classes.select("node", "n_shingles", "keys").mapInArrow(lambda it: send(it, halves, n, percent, hot), "key long, payload binary")
    live = stored(R.dealt(sent).mapInArrow(lambda it: meet(it, percent), "key long, node long, n long, centre long"), "buckets")
    needed = live.select("node").distinct().join(classes.select("node", "least"), "node").select("node", "least.*")
    texts = docs.join(needed, ["doc_id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text"))  # rows of one node are equal
    sets = stored(texts.mapInArrow(lambda it: sets_of(it, shingle), "node long, shingles binary"), "sets")

    tested = live.where("node != centre").groupBy(F.col("node").alias("v")).agg(F.min("centre").alias("u")).select("u", "v")
    found = stored(components(stored(confirmed(tested, sets, percent), "links")), "components")
    labelled = live.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    keys = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key", "m")
    mixed = stored(labelled.join(keys, "key"), "mixed")
    more = confirmed(pairs_of_small(mixed.where(F.col("m") <= crowded), percent), sets, percent)
    crowd = mixed.where(F.col("m") > crowded).select("node", "c").distinct()
    if crowd.take(1):
        more = more.unionByName(blocks_of_crowded(crowd, classes, sets, halves, percent, block))
    more = stored(more, "links")
    if more.take(1):
        found = stored(components(more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
    of_class = classes.join(found, "node", "left").select("s1", "s2", "n_shingles", "least", F.coalesce("component", "node").alias("component"))
    of_class = of_class.withColumnRenamed("least", "own").join(of_class.groupBy("component").agg(F.min("least").alias("least")), "component")
    return signed.select("doc_id", "text_hash", "s1", "s2", "n_shingles").join(of_class.drop("own"), ["s1", "s2", "n_shingles"], "left").drop("s1", "s2")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, halves: int = 10, hot: int = HOT, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable over links), kept."""
    rows = labelled_rows(docs, shingle, percent, halves, hot, crowded, block)
    component = F.coalesce("least.doc_id", "doc_id")
    null_id = lambda c: F.when(c != NULL_ID, c)
    return rows.select(null_id(F.col("doc_id")).alias("doc_id"), "n_shingles", null_id(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, halves: int = 12, hot: int = HOT, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """One row of each component, that of the least doc_id (nulls first; of unlike texts of one doc_id, that of the least
    hash; of equal ones, the row with the least other columns). Rows without words all stay."""
    rows = labelled_rows(docs.select("doc_id", "text"), shingle, percent, halves, hot, crowded, block)
    own = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    stay = rows.where(F.col("least").isNull() | own).groupBy("doc_id", "text_hash", F.col("least").isNull().alias("wordless")).agg(F.count(F.lit(1)).alias("n"))
    stay = stored(stay.select(F.col("doc_id").alias("kept_id__"), F.col("text_hash").alias("kept_hash__"), F.when(F.col("wordless"), 1).otherwise(F.col("n")).alias("times__")), "kept")
    named = docs.withColumns({"kept_id__": concat_id(), "kept_hash__": F.xxhash64(sql_text())})
    keys = ["kept_id__", "kept_hash__"]
    out = named.join(stay.where("times__ = 1"), keys, "left_semi").select(*docs.columns)
    again = stay.where("times__ > 1")
    if again.take(1):
        each = named.join(again, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*docs.columns)).alias("row__")).select("row__.*")
        out = out.unionByName(each)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
