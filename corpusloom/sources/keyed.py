"""Tables by key that grow by batches: a set of keys in sorted runs, and a table whose files are replaced bucket by bucket.

Both name their files in a small state file for each batch. A batch starts from the state of the batch before it and writes its own, so a replayed batch does
the same again, and readers of an earlier state keep their files until two later batches are done. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _whole(spark: SparkSession, path: str) -> str:
    """The path as Hadoop resolves it, so that a table's place does not depend on the warehouse."""
    p, fs = _fs(spark, path.rstrip("/"))
    return fs.makeQualified(p).toString()


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _drop(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


class States:
    """Numbered JSON files in a folder; the last few stay."""

    def __init__(self, spark: SparkSession, path: str, stay: int = 3):
        self.spark, self.path, self.stay = spark, path, stay

    def numbers(self) -> list[int]:
        return [int(n.split(".")[0]) for n in _names(self.spark, self.path) if n.endswith(".json")]

    def read(self, number: int) -> dict:
        p, fs = _fs(self.spark, f"{self.path}/{number:012d}.json")
        lines, stream = [], fs.open(p)
        reader = self.spark.sparkContext._jvm.java.io.BufferedReader(self.spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            while (line := reader.readLine()) is not None:
                lines.append(line)
        finally:
            reader.close()
        return json.loads("\n".join(lines))

    def before(self, number: int | None) -> dict | None:
        """The last state below a number, or the last of all."""
        known = [n for n in self.numbers() if number is None or n < number]
        return self.read(known[-1]) if known else None

    def write(self, number: int, state: dict) -> list[dict]:
        """Write a state under a name of its own and move it into place, forget the oldest, and return those that stay."""
        p, fs = _fs(self.spark, f"{self.path}/{number:012d}.json")
        part, _ = _fs(self.spark, f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        fs.delete(p, False)
        if not fs.rename(part, p):
            raise OSError(f"cannot write {p}")
        known = [n for n in self.numbers() if n <= number]
        for old in known[: -self.stay]:
            _drop(self.spark, f"{self.path}/{old:012d}.json")
        return [self.read(n) for n in known[-self.stay :]]


def key_of(columns: list[str]) -> Column:
    """SHA-256 of the values of some columns as text; nulls count as equal."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


class KeyIndex:
    """A set of keys that outlives sessions, in runs bucketed and sorted by key.

    A batch's keys are shuffled into the runs' buckets once and meet each run where it lies: the runs are neither shuffled nor sorted.
    A batch of at most `FEW` keys reads, by its keys as literals, only their buckets and the row groups that may hold them. Runs of a level
    are merged into one of the next as soon as there are `fanout`, so each key is rewritten once a level and a batch meets few runs.
    """

    FEW = 512

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 8):
        self.spark, self.path, self.fanout, self.tables = spark, _whole(spark, path), fanout, {}
        self.states = States(spark, f"{self.path}/states")
        self.wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def state(self, before: int | None = None) -> dict:
        return self.states.before(before) or {"buckets": self.wanted, "runs": []}

    def run(self, name: str, buckets: int) -> DataFrame:
        """A run as a table of this session, known by its place alone."""
        if name not in self.tables:
            table = f"corpusloom_keys_{uuid.uuid4().hex}"
            place = f"{self.path}/runs/{name}".replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} (key STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'")
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def _write(self, keys: DataFrame, buckets: int) -> str:
        name = uuid.uuid4().hex
        table = f"corpusloom_keys_{name}"
        keys.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", f"{self.path}/runs/{name}").saveAsTable(table)
        self.tables[name] = table
        return name

    def hits(self, rows: DataFrame, columns: list[str], before: int | None = None) -> DataFrame:
        """(key) of the rows whose key is in the set, as it was before a batch, each once."""
        state = self.state(before)
        wanted = rows.select(key_of(columns).alias("key"))
        if not state["runs"]:
            return wanted.limit(0)
        runs = [self.run(r["name"], state["buckets"]) for r in state["runs"]]
        few = [r["key"] for r in wanted.distinct().limit(self.FEW + 1).collect()]
        if len(few) <= self.FEW:
            found = [run.filter(F.col("key").isin(few)) for run in runs] if few else [wanted.limit(0)]
        else:
            probe = wanted.repartition(state["buckets"], "key").distinct()
            found = [run.join(probe.hint("shuffle_hash"), "key", "left_semi") for run in runs]
        return reduce(DataFrame.union, found).dropDuplicates(["key"])

    def unseen(self, rows: DataFrame, columns: list[str], before: int | None = None) -> DataFrame:
        """The rows whose key is not in the set; repeats among them stay."""
        known = self.hits(rows, columns, before)
        return rows.withColumn("_key", key_of(columns)).join(known.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")

    def add(self, rows: DataFrame, columns: list[str], number: int) -> None:
        """Add the keys of the rows as batch `number`, in place of what an earlier attempt of this batch added."""
        state = self.state(number)
        buckets, runs = state["buckets"], list(state["runs"])
        keys = rows.select(key_of(columns).alias("key")).repartition(buckets, "key").distinct()
        if not rows.isEmpty():  # a batch without keys leaves no run
            runs.append({"name": self._write(keys, buckets), "level": 0})
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fanout:
            merged = reduce(DataFrame.union, [self.run(r["name"], buckets) for r in full]).repartition(buckets, "key").distinct()
            runs = [r for r in runs if r["level"] != level] + [{"name": self._write(merged, buckets), "level": level + 1}]
            level += 1
        stay = self.states.write(number, {"buckets": buckets, "runs": runs})
        needed = {r["name"] for s in stay for r in s["runs"]}
        for name in set(_names(self.spark, f"{self.path}/runs")) - needed:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            _drop(self.spark, f"{self.path}/runs/{name}")

    def close(self) -> None:
        """Forget the session's tables; the runs stay in their folder, and frames that were not yet evaluated are void."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}


    def drop(self) -> None:
        self.close()
        _drop(self.spark, self.path)


class BucketTable:
    """A table whose rows lie in folders by a hash of their key; a version names the folder of each bucket.

    A merge reads and rewrites only the buckets that the new rows fall in; the version after it names the other buckets' folders as they are.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.wanted = spark, _whole(spark, path), key, buckets
        self.states = States(spark, f"{self.path}/versions")

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return bool(_names(spark, f"{path.rstrip('/')}/versions"))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(buckets)).cast("int")

    def version(self, before: int | None = None) -> dict | None:
        return self.states.before(before)

    def _read(self, version: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        own = [at for b, at in version["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{at}" for at in own]) if own else self.spark.createDataFrame([], schema)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The rows of the last version, or of the last one before a number."""
        version = self.version(before)
        return None if version is None else self._read(version)

    def merge(self, new: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None, empty: DataFrame | None = None) -> list[int]:
        """Make the next version, by `rule` of the old rows and the new ones; return the buckets that were rewritten.

        `rule` must treat keys apart and keep the key columns. `empty` has the table's columns, for a first version whose rows have more than the
        table. A merge under a number replaces what an earlier attempt under it made.
        """
        version = self.version(number)
        if number is None:
            number = (self.states.numbers() or [-1])[-1] + 1
        buckets = version["buckets"] if version else self.wanted
        hit = sorted(r[0] for r in new.select(self._bucket(buckets)).distinct().collect())  # at most one row a bucket
        old = self._read(version, hit) if version else (empty if empty is not None else new).limit(0)
        made = uuid.uuid4().hex
        rows = rule(old, new)
        folders = dict(version["folders"]) if version else {}
        if hit:
            dealt = rows.withColumn("_bucket", self._bucket(buckets))
            dealt.repartition(len(hit), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{made}")
            written = {n.split("=")[1] for n in _names(self.spark, f"{self.path}/data/{made}") if n.startswith("_bucket=")}
            for b in map(str, hit):
                folders.pop(b, None)
                if b in written:
                    folders[b] = f"{made}/_bucket={b}"
        stay = self.states.write(number, {"buckets": buckets, "folders": folders, "schema": rows.schema.jsonValue()})
        self._sweep({at for s in stay for at in s["folders"].values()})
        return hit

    def _sweep(self, needed: set[str]) -> None:
        """Delete folders that no version names any more."""
        for made in _names(self.spark, f"{self.path}/data"):
            inside = [n for n in _names(self.spark, f"{self.path}/data/{made}") if n.startswith("_bucket=")]
            unused = [n for n in inside if f"{made}/{n}" not in needed]
            if len(unused) == len(inside):
                _drop(self.spark, f"{self.path}/data/{made}")
            else:
                for n in unused:
                    _drop(self.spark, f"{self.path}/data/{made}/{n}")

    def rebucket(self, buckets: int) -> None:
        """The same rows in another number of buckets, as the next version; for a table that has outgrown its buckets."""
        version = self.version()
        if version is None:
            self.wanted = buckets
            return
        made = uuid.uuid4().hex
        rows = self._read(version)
        rows.withColumn("_bucket", self._bucket(buckets)).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{made}")
        folders = {n.split("=")[1]: f"{made}/{n}" for n in _names(self.spark, f"{self.path}/data/{made}") if n.startswith("_bucket=")}
        stay = self.states.write(self.states.numbers()[-1] + 1, {"buckets": buckets, "folders": folders, "schema": rows.schema.jsonValue()})
        self._sweep({at for s in stay for at in s["folders"].values()})

    def drop(self) -> None:
        _drop(self.spark, self.path)
