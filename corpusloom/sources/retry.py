"""A durable lane for rows whose write failed: kept with their attempts, tried again with the next batch, given up after so many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import States, _drop, _names, key_of


class RetryLane:
    """Pending rows of a sink, one folder for each batch; a batch starts from what the one before it left, so a replay adds no attempt.

    `attempts` retries fail before a row goes; beyond `most` pending rows the oldest go (`most` bounds what one batch carries on, not what it writes).
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 10_000, attempts: int = 10):
        self.spark, self.path, self.most, self.attempts = spark, path.rstrip("/"), most, attempts
        self.states = States(spark, f"{self.path}/states")

    def pending(self, before: int | None = None) -> DataFrame | None:
        """Rows that wait, with `_attempts` (failed retries), `_since` (the batch they first failed in) and `_place` in it."""
        state = self.states.before(before)
        return self.spark.read.parquet(f"{self.path}/rows/{state['rows']}") if state and state["n"] else None

    def step(self, rows: DataFrame, number: int, write: Callable[[DataFrame], DataFrame | None]) -> DataFrame | None:
        """Write a batch and the rows that wait. `write` returns the rows that failed, None for none, or raises: then all failed.

        The rows that wait go first, so a newer row of a key counts after an older. Return the rows that were given up, which also stay in a folder of their own.
        """
        fresh = rows.withColumn("_attempts", F.lit(-1)).withColumn("_since", F.lit(number).cast("long")).withColumn("_place", F.monotonically_increasing_id())
        waiting = self.pending(number)
        every = (fresh if waiting is None else waiting.unionByName(fresh)).persist()
        try:
            try:
                bad, whole = write(every.orderBy("_since", "_place").drop("_attempts", "_since", "_place")), False
            except Exception as problem:  # noqa: BLE001  whatever the sink says, its rows are kept
                print(f"batch {number}: a write failed and waits: {str(problem).splitlines()[0] if str(problem) else type(problem).__name__}")
                bad, whole = None, True
            failed = every if whole else None
            if bad is not None:
                names = bad.select(key_of(rows.columns).alias("_key")).distinct()
                failed = every.withColumn("_key", key_of(rows.columns)).join(names, "_key", "left_semi").drop("_key")
            n, gone = 0, None
            if failed is not None:
                counted = failed.withColumn("_attempts", F.col("_attempts") + 1)
                left = counted.filter(F.col("_attempts") < self.attempts).orderBy(F.desc("_since"), F.desc("_place")).limit(self.most)
                left.write.mode("overwrite").parquet(f"{self.path}/rows/{number}")
                n = self.spark.read.parquet(f"{self.path}/rows/{number}").count()
                counted.filter(F.col("_attempts") >= self.attempts).write.mode("overwrite").parquet(f"{self.path}/given_up/{number}")
                gone = self.spark.read.parquet(f"{self.path}/given_up/{number}")
            stay = self.states.write(number, {"rows": str(number), "n": n})
            for name in set(_names(self.spark, f"{self.path}/rows")) - {s["rows"] for s in stay}:
                _drop(self.spark, f"{self.path}/rows/{name}")
            return gone
        finally:
            every.unpersist()
