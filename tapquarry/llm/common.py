"""Helpers that the training-data operators share: shared storage, Arrow text access, rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Stands for a null doc_id wherever documents have to be ordered: nulls come first.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and there is but this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tapquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken, name: str) -> str:
    """The name, with as many underscores as it takes until no other column starts with it."""
    known = [x.lower() for x in taken]
    while any(x.startswith(name.lower()) for x in known):
        name += "_"
    return name


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slabs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `most` bytes; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser), on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Hashes of any span of a sequence from prefix sums: sum of symbol * base^i, shifted to start at power 0."""

    base = U64(0x9E3779B97F4A7C15 | 1)
    inverse = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
    _up = _down = np.ones(1, U64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Rolling._up) < n + 1:
            size = max(n + 1, 1 << 16)
            Rolling._up, Rolling._down = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, x, U64), dtype=U64)]) for x in (self.base, self.inverse))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * Rolling._up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling._down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * Rolling._down[:n]) if n > 0 else np.zeros(0, U64)


#: A random word for each byte, from a fixed rule.
BYTE_WORDS = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no space, tab, line feed, vertical tab, form feed or return."""
    is_word = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    return edge[::2], edge[1::2]


def concat_id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def sql_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
