"""Mixing sources to target weights by Poisson replication.

A source's mean repetition is rate * (all bytes) * weight / (its bytes). Each document's count inverts the
Poisson distribution at a uniform number hashed from its doc_id; means above 16 are sums of parts, each
with its own number. Documents are exploded by their counts and put in the order of a second hash: that hash is uniform, so
its place among the partitions is arithmetic and needs no sample. Files in order, rows in order.

A source's mean joins its documents by a broadcast where there are at most BROADCAST sources, else over SALTS parts of each
source, so that a source with a third of all documents is no task of its own.

Sources are the values of `source`, null among them. Without given weights all sources weigh alike; weights must not be
negative. A source without bytes has the mean `rate`, and the others share the weight. Where the weights name no source
that has bytes, those sources have the mean 0. Nulls: a null text has no bytes; a null doc_id hashes as 'null'. Rows that
repeat a doc_id are each repeated as often. Columns named `copy` or `shuffle_key` are replaced; others keep their
names and values. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, partitions, stored, table

SEED, RATE = "mix-1", 1.0
PART, TERMS = 16, 90
BROADCAST, SALTS = 100_000, 64
KEY_BITS = 60


def uniform(*parts):
    """A number in [0, 1) with 52 bits, from the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u, mean):
    """How many values' cumulative probability does not exceed u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + F.when(s["cdf"] <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])


def means(docs: DataFrame, weights: dict[str, float] | None, rate: float) -> DataFrame:
    """source, mean."""
    if weights and min(weights.values()) < 0:
        raise ValueError("a weight is negative")
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("mass"))
    given = F.lit(1.0)
    if weights is not None:
        given = F.lit(0.0)
        for k, v in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(given)
    mass = mass.withColumn("weight", F.when(F.col("mass") > 0, given).otherwise(0.0))
    total = mass.agg(F.sum("mass").cast("double").alias("total"), F.sum("weight").alias("weights"))
    mean = F.when(F.col("mass") > 0, F.coalesce(F.try_divide(F.lit(rate) * F.col("total") * F.col("weight"), F.col("weights")), F.lit(0.0)) / F.col("mass")).otherwise(F.lit(rate))
    return mass.crossJoin(F.broadcast(total)).select("source", mean.alias("mean"))  # one row of totals


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = RATE, seed: str = SEED, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of docs, each as often as drawn, with `copy` (from 1) and `shuffle_key`, in the order of `shuffle_key`."""
    docs = docs.drop("copy", "shuffle_key")
    own = free_name(docs.columns, "own")  # all that is needed on the way, in one column
    key, mean, salt = (free_name([*docs.columns, own], x) for x in ("source", "mean", "salt"))
    m = stored(means(docs, weights, rate), "means").select(F.col("source").alias(key), F.col("mean").alias(mean))
    same = docs["source"].eqNullSafe(F.col(key))
    if m.count() <= broadcast:
        rows = docs.join(F.broadcast(m), same).drop(key)
    else:
        salts = m.withColumn(salt + "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        rows = salted.join(salts, same & (F.col(salt) == F.col(salt + "m"))).drop(key, salt, salt + "m")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn(own, F.struct(F.col(mean).alias("mean"), F.greatest(F.ceil(F.col(mean) / PART), F.lit(1)).cast("int").alias("parts"))).drop(mean)
    count = F.aggregate(F.sequence(F.lit(1), F.col(f"{own}.parts")), F.lit(0), lambda n, i: n + poisson(uniform(F.lit(seed), name, i.cast("string")), F.col(f"{own}.mean") / F.col(f"{own}.parts")))
    rows = rows.withColumn(own, count).where(F.col(own) > 0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(own)))).drop(own)
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col("copy").cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = rows.withColumn("shuffle_key", order)
    n = partitions(docs.sparkSession)
    place = F.floor(F.shiftright("shuffle_key", KEY_BITS - 30) * F.lit(n) / F.lit(1 << 30)).cast("int")
    return rows.repartitionById(n, place).sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE mass AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS mass FROM documents GROUP BY source),
total AS (SELECT sum(mass)::DOUBLE AS total, sum(CASE WHEN mass > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS weights FROM mass),
means AS (SELECT source, CASE WHEN mass > 0 THEN {RATE}::DOUBLE * total * 1.0::DOUBLE / weights / mass ELSE {RATE}::DOUBLE END AS mean FROM mass, total),
parts AS (SELECT source, greatest(ceil(mean / {PART}), 1)::INT AS parts, mean / greatest(ceil(mean / {PART}), 1)::INT AS mean FROM means),
cdf AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM parts
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM cdf WHERE k + 1 < {TERMS}),
cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM cdf GROUP BY source),
drawn AS (SELECT d.*, (SELECT sum(len(list_filter(c.cdfs, lambda x: x <= ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE)))
    FROM generate_series(1, p.parts) AS g(i))::INT AS n
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source),
copies AS (SELECT drawn.*, unnest(generate_series(1, n))::INT AS copy FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy,
  ('0x' || substr(md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""
