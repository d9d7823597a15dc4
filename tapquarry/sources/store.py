"""Append-only sinks of evidence, one row per (trip_ts, trace_id): Parquet by day of the trip, or in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
KEY = ["trip_ts", "trace_id"]


class DuplicateEvidence(ValueError):
    """A key occurs twice, in the rows to append or with those of the store."""


def duplicates(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class EvidenceSink:
    """What both sinks share: put, range, len. There is no update or delete."""

    def _all(self) -> DataFrame | None:
        raise NotImplementedError

    def _append(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def put(self, rows: DataFrame) -> None:
        """Appends; refuses the whole batch if a key is taken."""
        rows = rows.withColumn("day", F.floor(F.col("trip_ts") / DAY_NS))
        if duplicates(rows).take(1):
            raise DuplicateEvidence("a key occurs twice in the batch")
        known = self._all()
        if known is not None and rows.select("day", *KEY).join(known.select("day", *KEY), ["day", *KEY], "left_semi").take(1):
            raise DuplicateEvidence("a key is in the store")
        self._append(rows)

    def range(self, start: int, end: int) -> DataFrame | None:
        """Rows with start <= trip_ts < end in order of (trip_ts, trace_id); none if the bounds are inverted. Days are pruned."""
        known = self._all()
        if known is None:
            return None
        days = (F.col("day") >= start // DAY_NS) & (F.col("day") <= max(start, end - 1) // DAY_NS)
        return known.where(days & (F.col("trip_ts") >= start) & (F.col("trip_ts") < end)).drop("day").orderBy(*KEY)

    def __len__(self) -> int:
        known = self._all()
        return 0 if known is None else known.count()

    def is_empty(self) -> bool:
        known = self._all()
        return known is None or not known.take(1)


class EvidenceStore(EvidenceSink):
    """Parquet under a path, by day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self.path) if fs.exists(where) else None

    def _append(self, rows: DataFrame) -> None:
        rows.repartition("day").write.partitionBy("day").mode("append").parquet(self.path)


class EvidenceMemory(EvidenceSink):
    """A sink that lives as long as the session: cached rows, one DataFrame for each batch put."""

    def __init__(self):
        self.batches: list[DataFrame] = []

    def _all(self) -> DataFrame | None:
        out = None
        for rows in self.batches:
            out = rows if out is None else out.unionByName(rows)
        return out

    def _append(self, rows: DataFrame) -> None:
        self.batches.append(rows.persist())

    def clear(self) -> None:
        for rows in self.batches:
            rows.unpersist()
        self.batches = []
