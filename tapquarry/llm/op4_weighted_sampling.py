"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words in lower case, weighted by their counts. A count is cut into levels, up to
1, 2, 4, 8 and so on; the part that falls into a level is the weight of the pair (term, level). Parts add up, in the lesser
and the greater of two counts alike, so the generalised Jaccard similarity of the parts is that of the counts.

For each of `samples` samples a pair has gamma(2,1) variables r and c and a uniform b. A weight w, seen from
the level's full width, is quantised to t = floor(ln w / r + b) and competes with ln c - r (t - b) - r. The sample
keeps the least pair's (term, level, t): two weightings keep the same with the probability of their similarity.
Likeness is the share of equal samples. A text's terms and those of its edited form share their draws.

The variables are drawn from the key that the full width gives: a = c exp(-r (1 - b)) is exponential, c - a given a is
exponential, and so is r - ln(c / a). No lesser weight of the level has a lesser key, so pairs whose a is over
`slack` / (the text's words) cannot win where a key below that is found, and are left out before the rest is drawn. A
sample without such a key (exp(-slack) of them) sends its text to a second pass without that bound.

Documents follow each other by doc_id, nulls first, rows that repeat a doc_id by a hash of the text. They are cut into
blocks at quantiles of both, as many as the bytes ask for; the first document of a block is also shown to the block
before, so that no ordering spans the whole table. Empty texts have an empty fingerprint and are alike to each
other (1) and to nothing else (0). A null text is empty. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, concat_id, partitions, sql_text, stored, table

SAMPLES = 64
#: Bytes of text in a block; blocks for each shuffle partition at least, and at most in all (their first keys pass the driver).
BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS = 32 << 20, 16, 1 << 16
#: Tasks for each shuffle partition in the stage that counts and draws.
TASKS = 4
#: exp(-SLACK) is the share of samples that need the second pass.
SLACK = 25.0
#: A draw is one number: its key (over -124, under 4) in steps of 2^-32 above CODE bits of the hash of (term, level, t).
CODE, ABOVE = 24, 124
UNIT = float(1 << 53)


def uniform(h):
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(UNIT)


def order_key():
    """(doc_id, hash of the text) as text that sorts alike."""
    flipped = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")
    return F.concat(flipped(F.col("doc_id")), flipped(F.xxhash64("text")))


def starts_of(docs: DataFrame, blocks: int) -> list[str]:
    """The first key of each block, in order. docs: doc_id, key."""
    cut = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 20 * blocks).alias("q")).first()["q"] if blocks > 1 else []
    ids = [x + 2**63 for x in cut or []]
    # an id over several quantiles is cut by its texts' hashes
    bounds = sorted({f"{x:016X}{(2**64 // ids.count(x)) * i:016X}" for x in set(ids) for i in range(ids.count(x))})
    starts = docs.groupBy(place(bounds).alias("at")).agg(F.min("key").alias("start"))  # a row per block
    return sorted(r["start"] for r in starts.collect())


def place(bounds: list[str]):
    """How many of the sorted bounds do not exceed `key`: by whole stretches, then inside one."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    stretches = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col("key")))
    top = below(F.split(F.lit(",".join(x[0] for x in stretches)), ","))
    inner = F.split(F.get(F.split(F.lit(";".join(",".join(x) for x in stretches)), ";"), top - 1), ",")
    return F.when(top == 0, 0).otherwise((top - 1) * width + below(inner))


def ordered(docs: DataFrame, blocks: int | None) -> DataFrame:
    """block, rn (place in the block), doc_id, text, next_text, guest (a document shown to the block before)."""
    spark = docs.sparkSession
    docs = docs.select(concat_id().alias("doc_id"), sql_text().alias("text")).withColumn("key", order_key())
    if blocks is None:
        total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        blocks = max(LEAST_BLOCKS * partitions(spark), min(MOST_BLOCKS, total // BLOCK_BYTES))
    starts = starts_of(docs.select("doc_id", "key"), blocks)
    last = max(0, len(starts) - 1)
    here = lambda block, turn, guest: F.struct(block.cast("int").alias("block"), F.lit(turn).alias("turn"), F.lit(guest).alias("guest"))
    at = F.greatest(place(starts) - 1, F.lit(0))
    is_start = F.array_contains(F.split(F.lit(",".join(starts)), ","), F.col("key")) if len(starts) < 64 else F.get(F.split(F.lit(",".join(starts)), ","), F.col("at")) == F.col("key")
    placed = docs.withColumn("at", at).withColumn("is_start", is_start)
    places = [F.array(here(F.col("at"), 0, False)), F.when(F.col("is_start") & (F.col("at") > 0), F.array(here(F.col("at") - 1, 0, True))).otherwise(F.array())]
    places.append(F.when(F.col("is_start") & (F.col("at") == 0), F.array(here(F.lit(last), 1, True))).otherwise(F.array()))
    placed = placed.select("text", "key", F.explode(F.concat(*places)).alias("p")).select("p.block", "p.turn", "p.guest", "text", "key")
    placed = placed.repartition(TASKS * partitions(spark), "block")  # all that follows needs the same columns, so one exchange serves all
    w = Window.partitionBy("block").orderBy("turn", "key", "guest")
    doc_id = (F.conv(F.substring("key", 1, 16), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")
    return placed.withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w)).withColumn("doc_id", doc_id).drop("turn", "key")


def signatures(rows: DataFrame, samples: int, slack: float | None) -> DataFrame:
    """rows: block, rn, own, edited. block, rn, own_slots, edited_slots (arrays of slot and code in one number), sure (all samples are the least ones)."""
    kinds = (0, 1)
    split = lambda c: F.array_remove(F.split(F.translate(F.lower(c), "\t\n\x0b\f\r", "     "), " "), "")
    texts = rows.select("block", "rn", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), split(c).alias("words")) for k, c in zip(kinds, ("own", "edited"), strict=True)])).alias("v"))
    texts = texts.select("block", "rn", "v.kind", F.size("v.words").alias("size"), F.explode("v.words").alias("word"))
    of = lambda k, c: F.when(F.col("kind") == k, c)
    counts = [F.count(of(k, F.lit(1))).alias(f"n{k}") for k in kinds] + [F.max(of(k, F.col("size"))).alias(f"size{k}") for k in kinds]
    terms = texts.select("block", "rn", "kind", "size", F.xxhash64("word").alias("term")).groupBy("block", "rn", "term").agg(*counts)
    levels = terms.withColumn("level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest("n0", "n1"))).cast("int"))))
    levels = levels.withColumn("base", F.when(F.col("level") == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("level") - 1))).withColumn("width", F.greatest("base", F.lit(1.0)))
    levels = levels.withColumns({f"w{k}": F.when(F.col(f"n{k}") > F.col("base"), F.least(F.col(f"n{k}") - F.col("base"), F.col("width")) / F.col("width")) for k in kinds})
    if slack is None:
        levels = levels.withColumn("bound", F.lit(1 << 53))
    else:
        reach = F.greatest(*[F.when(F.col(f"w{k}").isNotNull(), F.lit(slack) / F.col(f"size{k}")) for k in kinds]) * F.col("width")
        levels = levels.withColumn("bound", F.ceil(-F.expm1(-reach) * F.lit(UNIT)).cast("long"))
    levels = levels.select("block", "rn", "term", "level", "bound", F.log("width").alias("log_width"), *[F.log(f"w{k}").alias(f"w{k}") for k in kinds], *[F.col(f"size{k}") for k in kinds])
    drawn = levels.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("h", F.xxhash64("term", "level", "slot"))
    drawn = drawn.where(F.shiftrightunsigned("h", 11) < F.col("bound"))
    drawn = drawn.withColumn("a", -F.log1p(-uniform(F.col("h"))))
    drawn = drawn.withColumn("c", F.col("a") - F.log(uniform(F.xxhash64("h", F.lit(1))))).withColumn("q", F.log(F.col("c") / F.col("a")))
    drawn = drawn.withColumn("r", F.col("q") - F.log(uniform(F.xxhash64("h", F.lit(2))))).withColumn("b", 1 - F.col("q") / F.col("r"))
    drawn = drawn.withColumns({f"t{k}": F.floor(F.col(f"w{k}") / F.col("r") + F.col("b")) for k in kinds})

    def key(k):
        return F.log("c") - F.col("r") * (F.col(f"t{k}") - F.col("b") + 1) - F.col("log_width")

    def draw(k):
        place = F.floor((key(k) + F.lit(float(ABOVE))) * F.lit(float(1 << 32))).cast("long")
        return F.shiftleft(place, CODE).bitwiseOR(F.xxhash64("h", F.col(f"t{k}")).bitwiseAND(F.lit((1 << CODE) - 1).cast("long")))

    # a pair that a text lacks has no weight, and so no draw
    draws = [F.when(F.col(f"w{k}").isNotNull(), draw(k)).alias(f"v{k}") for k in kinds]
    least = drawn.select("block", "rn", "slot", *draws, *[F.col(f"size{k}") for k in kinds]).groupBy("block", "rn", "slot").agg(*[F.min(f"v{k}").alias(f"v{k}") for k in kinds], *[F.max(f"size{k}").alias(f"size{k}") for k in kinds])

    def code(k):
        v = F.col(f"v{k}")
        return F.when(v.isNotNull(), F.shiftleft("slot", CODE).bitwiseOR(v.bitwiseAND(F.lit((1 << CODE) - 1).cast("long")).cast("int")))

    def sure(k):
        """Whether the least key is below the bound; half a unit covers the steps."""
        bound = F.floor((F.log(F.lit(slack) / F.col(f"size{k}")) + F.lit(float(ABOVE))) * F.lit(float(1 << 32))).cast("long") - 1
        return F.col(f"size{k}").isNull() | F.coalesce(F.shiftright(f"v{k}", CODE) < bound, F.lit(False))

    slots = [F.sort_array(F.collect_list(code(k))).alias(n) for k, n in zip(kinds, ("own_slots", "edited_slots"), strict=True)]
    if slack is None:
        return least.groupBy("block", "rn").agg(*slots, F.lit(True).alias("sure"))
    found = least.withColumn("sure", sure(0) & sure(1))
    out = found.groupBy("block", "rn").agg(*slots, F.min("sure").alias("sure"), *[F.max(f"size{k}").alias(f"size{k}") for k in kinds])
    whole = lambda k, n: F.col(f"size{k}").isNull() | (F.size(n) == samples)
    return out.select("block", "rn", "own_slots", "edited_slots", (F.col("sure") & whole(0, "own_slots") & whole(1, "edited_slots")).alias("sure"))


def likeness(a, b):
    """Share of equal samples; a text without words has none."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def fingerprints(docs: DataFrame, samples: int = SAMPLES, blocks: int | None = None, slack: float = SLACK) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = ordered(docs, blocks)
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    edited = F.when(F.col("guest"), F.lit("")).otherwise(F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)))
    rows = rows.select("block", "rn", "doc_id", "guest", n.cast("long").alias("n_chars"), F.col("text").alias("own"), edited.alias("edited"))
    none = F.array().cast("array<int>")
    facts = rows.select("block", "rn", "doc_id", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # every row takes part, so that the next one's fingerprint is the next row's
    both = facts.join(signatures(rows, samples, slack), ["block", "rn"], "left").withColumns({c: F.coalesce(c, none) for c in ("own_slots", "edited_slots")})
    both = stored(both, "fingerprints")
    unsure = both.where("not sure").select("block", "rn")
    if unsure.take(1):
        again = signatures(rows.join(unsure, ["block", "rn"], "left_semi"), samples, None).select("block", "rn", F.col("own_slots").alias("own_again"), F.col("edited_slots").alias("edited_again"))
        both = both.join(again, ["block", "rn"], "left").withColumns({"own_slots": F.coalesce("own_again", "own_slots"), "edited_slots": F.coalesce("edited_again", "edited_slots")})
    both = both.withColumn("next_slots", F.lead("own_slots").over(Window.partitionBy("block").orderBy("rn"))).where(~F.col("guest"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), " ")
    return both.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", text("own_slots").alias("fingerprint"), text("edited_slots").alias("edited_fingerprint"), likeness(F.col("own_slots"), F.col("edited_slots")).alias("near_edited"), likeness(F.col("own_slots"), F.col("next_slots")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
