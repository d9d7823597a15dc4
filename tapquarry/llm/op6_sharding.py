"""Sharding by extendible hashing.

A document's hash is 60 bits of the md5 of its doc_id. The directory is indexed by the first bits; a bucket
whose bytes exceed the limit splits on its next bit, all others stay. Bytes are summed once for fine cells of the
hash, then for all their prefixes (summed before the shuffle); a bucket is a prefix that fits and whose parent does
not. The directory goes to the documents by a broadcast up to BROADCAST entries, else by a join.

A cell that does not fit is cut at all 60 bits. Rows of one hash (copies of a doc_id, null ids) that still exceed the
limit are parted by running bytes, counted in pieces that no one task holds: `part` counts from 0. Only a document
that exceeds the limit by itself is a shard over it.

Nulls: a null text has no bytes; a null doc_id hashes as 'null'. Rows that repeat are rows of their own. Columns
named like those added (shard, depth, part, n_bytes) are replaced, all others are kept. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, stored, table

BITS = 60
LIMIT = 1 << 20
#: Bits of a fine cell beyond those that equal shards would need.
SPARE = 4
#: Cells (16 bytes each) that are broadcast.
BROADCAST = 500_000


def fine_bits(total: int, limit: int) -> int:
    return min(40, max(SPARE, math.ceil(math.log2(max(1.0, total / limit))) + SPARE))


def sent(small: DataFrame):
    """With a broadcast hint if it is small enough."""
    return F.broadcast(small) if small.count() <= BROADCAST else small


def leaves(cells: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """cell, depth of the bucket that it falls into, null where even the cell exceeds the limit.

    cells: cell (the first `bits` of the hash), bytes. Depths start at `least`, whose prefixes have no parents.
    """
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    each = cells.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(bits)))).select("depth", prefix.alias("prefix"), "bytes")
    sizes = stored(each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("size")), "prefixes")
    full, fits = sizes.where(F.col("size") > limit), sizes.where(F.col("size") <= limit)
    parents = full.select((F.col("depth") + 1).alias("d"), F.col("prefix").alias("p"))
    buckets = fits.join(parents, (F.col("depth") == F.col("d")) & (F.shiftright("prefix", 1) == F.col("p")), "left_semi").unionByName(fits.where(F.col("depth") == least))
    buckets = stored(buckets.select("depth", "prefix"), "buckets")
    low, high = buckets.agg(F.min("depth"), F.max("depth")).first()
    over = full.where(F.col("depth") == bits).select(F.col("prefix").alias("cell"), F.lit(None).cast("int").alias("depth"))
    if low is None:
        return over
    # only depths that buckets have: a shallow prefix with all cells never meets
    placed = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", prefix)
    return placed.join(sent(buckets), ["depth", "prefix"]).select("cell", "depth").unionByName(over)


def parted(rows: DataFrame, own: str, limit: int) -> DataFrame:
    """rows of hashes over the limit with `part`, by running bytes: in the piece that each writing task made, after those of
    the pieces before it. Nothing but a sum per piece comes together."""
    number, piece = free_name(rows.columns, "number"), free_name(rows.columns, "piece")
    rows = stored(rows.withColumn(number, F.monotonically_increasing_id()), "parted").withColumn(piece, F.shiftright(number, 33))
    h, size = F.col(f"{own}_hash"), F.col(f"{own}_bytes")
    pieces = rows.groupBy(h.alias("h"), F.col(piece).alias("p")).agg(F.sum(size).alias("sum"), F.max(size).alias("most"))
    w = Window.partitionBy("h").orderBy("p")
    before = F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("h").alias(f"{own}h"), F.col("p").alias(f"{own}p"), before.alias(f"{own}b"), F.max("most").over(Window.partitionBy("h")).alias(f"{own}m"))
    running = F.coalesce(F.sum(size).over(Window.partitionBy(h, piece).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn(f"{own}r", running).join(pieces, (h == F.col(f"{own}h")) & (F.col(piece) == F.col(f"{own}p")))
    part = F.floor((F.col(f"{own}b") + F.col(f"{own}r")) / F.greatest(F.lit(1), F.lit(limit) - F.col(f"{own}m"))).cast("long")
    return rows.withColumn("part", part).drop(number, piece, *[f"{own}{x}" for x in "hpbmr"])


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of docs with shard (the bucket's bits), depth, part, n_bytes."""
    docs = docs.drop("shard", "depth", "part", "n_bytes")
    own, cell, deep = (free_name([*docs.columns, "shard", "depth", "part", "n_bytes"], x) for x in ("own", "cell", "deep"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept, h, size = docs.columns, F.col(f"{own}_hash"), F.col(f"{own}_bytes")
    docs = docs.withColumns({f"{own}_hash": F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"), f"{own}_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    total = docs.agg(F.sum(size)).first()[0] or 0
    bits = fine_bits(total, limit)
    cells = stored(docs.groupBy(F.shiftright(h, BITS - bits).alias("cell")).agg(F.sum(size).alias("bytes")), "cells")
    found = stored(leaves(cells, bits, 0, limit), "leaves")
    rows = docs.join(sent(found).withColumnRenamed("cell", cell), F.shiftright(h, BITS - bits) == F.col(cell)).drop(cell)
    over = found.where("depth is null").select(F.col("cell").alias(cell))
    whole = rows
    if over.take(1):  # cells over the limit, at all bits; there are none where documents are small
        whole = rows.where("depth is not null")
        rest = rows.where("depth is null").drop("depth")
        fine = rest.groupBy(h.alias("cell")).agg(F.sum(size).alias("bytes"))
        found = stored(leaves(fine, BITS, bits, limit), "leaves")
        rest = rest.join(sent(found).withColumnRenamed("cell", deep), h == F.col(deep)).drop(deep)
        whole = whole.unionByName(rest.where("depth is not null"))
        whole = whole.withColumn("part", F.lit(0).cast("long"))
        if found.where("depth is null").take(1):
            whole = whole.unionByName(parted(rest.where("depth is null").withColumn("depth", F.lit(BITS)), own, limit))
    else:
        whole = whole.withColumn("part", F.lit(0).cast("long"))
    bucket = F.expr(f"if(depth = 0, '', lpad(bin(shiftright(`{own}_hash`, {BITS} - depth)), depth, '0'))")
    return whole.withColumn("shard", bucket).withColumn("n_bytes", size).select(*kept, "shard", "depth", "part", "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard", "depth", "part")


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
bits AS (SELECT least(40, greatest({SPARE}, ceil(log2(greatest(1.0, sum(n_bytes) / {LIMIT}.0)))::INT + {SPARE})) AS f FROM docs),
cells AS (SELECT h >> ({BITS} - f) AS cell, f, sum(n_bytes) AS bytes FROM docs, bits GROUP BY ALL),
each_ AS (SELECT cell, f, bytes, d.depth, cell >> (f - d.depth)::INT AS prefix FROM cells, (SELECT unnest(generate_series(0, 40))::INT AS depth) d WHERE d.depth <= f),
fits AS (SELECT depth, prefix FROM each_ GROUP BY depth, prefix HAVING sum(bytes) <= {LIMIT}),
found AS (SELECT cell, min(each_.depth) AS depth FROM each_ JOIN fits USING (depth, prefix) GROUP BY cell)
SELECT doc_id, n_bytes,
  CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), depth, '0') END AS shard, depth::INT AS depth, 0::BIGINT AS part
FROM docs, bits JOIN found ON found.cell = h >> ({BITS} - f)
"""
