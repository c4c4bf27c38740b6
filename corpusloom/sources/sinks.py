"""Writes: versioned tables, partitioned artifacts, single-file exports."""

from __future__ import annotations

import os
import re
import uuid

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_artifact_path
from ..operators.reports import PAGE_CSV, attribution_lines, page_csv_line, summary_json
from .keyed import BucketTable


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def exists(spark: SparkSession, path: str) -> bool:
    p, fs, _ = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs, _ = _fs(spark, path)
    fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str | bytes) -> None:
    p, fs, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode() if isinstance(text, str) else text))
    finally:
        out.close()


def current(spark: SparkSession, table: str) -> str | None:
    """Path of the table's current version."""
    p, fs, jvm = _fs(spark, f"{table}/_current")
    if not fs.exists(p):
        return None
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p)))
    try:
        return f"{table}/{reader.readLine()}"
    finally:
        reader.close()


def publish(rows: DataFrame, table: str, partition_by: list[str] | None = None) -> str:
    """Write a new version beside the old one, then move the pointer; readers never see half a version.

    The version before stays for those who still read it; older ones are deleted.
    """
    spark, name = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    before = current(spark, table)
    rows.write.partitionBy(*(partition_by or [])).parquet(f"{table}/{name}")
    put_text(spark, f"{table}/_current", name)
    p, fs, _ = _fs(spark, table)
    for status in fs.listStatus(p):
        other = status.getPath().getName()
        if other.startswith("v-") and other != name and f"{table}/{other}" != before:
            fs.delete(status.getPath(), True)
    return f"{table}/{name}"


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The current version of a published table or of one by buckets, or all batches of one that grows by batches; None where there is none."""
    if BucketTable.exists(spark, table):
        return BucketTable(spark, table, []).read()
    path = current(spark, table)
    if path:
        return spark.read.parquet(path)
    return read_batches(spark, table)


def write_batch(rows: DataFrame, table: str, number: int) -> None:
    """Rows of one batch beside those of the others; a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{table}/batch={number}")


def append_batch(rows: DataFrame, table: str) -> int:
    """Rows as the next batch of a table that grows by batches; a table of published versions goes on with its current one as its first batch. One writer at a time."""
    spark = rows.sparkSession
    p, fs, _ = _fs(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    if not numbers and (path := current(spark, table)):
        write_batch(spark.read.parquet(path), table, 0)
        numbers = [0]
        for n in names:
            fs.delete(_fs(spark, f"{table}/{n}")[0], True)
    write_batch(rows, table, max(numbers, default=-1) + 1)
    return max(numbers, default=-1) + 1


def read_batches(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """Rows of all batches, or of those before a number."""
    p, fs, _ = _fs(spark, table)
    if not fs.exists(p):
        return None
    rows = spark.read.parquet(table)
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def page_artifacts(pages: DataFrame, folder: str) -> DataFrame:
    """(path, content) of raw pages by domain and hash; equal bytes of a domain are one artifact."""
    named = pages.withColumn("sha256", F.sha2("body", 256)).withColumn("path", page_artifact_path(folder, F.col("domain"), F.col("sha256")))
    return named.dropDuplicates(["path"]).select("path", "sha256", F.col("body").alias("content"))


def published(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Messages as files of JSON lines, nulls included: tasks, results and edges in the form that `tables.messages` and `crawl.edges` read."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, as Hadoop resolves it: the same place for the driver and every task."""
    p, fs, _ = _fs(spark, path)
    whole = fs.makeQualified(p).toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def store_objects(objects: DataFrame, root: str) -> DataFrame:
    """Write (path, content) below `root`, one file for each path that is not there yet; return (path, object_path, bytes, written).

    `root` is resolved once, by Hadoop, and tasks write to that very file system, each file under a name of its own first and then renamed,
    so that readers see whole files and a repeated task changes nothing. Shared storage is up to the caller: `root` must be a place that all executors see.
    """
    base = root.rstrip("/")
    wanted = objects.dropDuplicates(["path"]).withColumn("object_path", F.concat(F.lit(base + "/"), "path"))
    kind = "path string, object_path string, bytes long, written boolean"
    return wanted.select("path", "object_path", "content").mapInPandas(_writer(qualified(objects.sparkSession, base)), kind)


def stored_objects(paths: DataFrame, root: str) -> DataFrame:
    """(path, object_path, stored): whether each path below `root` holds a file; each is asked for by itself, in tasks, and nothing is listed."""
    base = root.rstrip("/")
    top = qualified(paths.sparkSession, base)

    @F.pandas_udf("boolean")
    def there(names: pd.Series) -> pd.Series:
        system, place = pafs.FileSystem.from_uri(top)
        found = system.get_file_info([f"{place}/{n}" for n in names])
        return pd.Series([f.type == pafs.FileType.File for f in found], dtype=bool)

    return paths.select("path", F.concat(F.lit(base + "/"), "path").alias("object_path"), there("path").alias("stored"))


def _writer(top: str):
    def run(batches):
        system, place = pafs.FileSystem.from_uri(top)
        for rows in batches:
            done = []
            for path, target, content in rows.itertuples(index=False):
                name = f"{place}/{path}"
                fresh = system.get_file_info(name).type != pafs.FileType.File
                if fresh:
                    part = f"{name}.{uuid.uuid4().hex}.part"
                    system.create_dir(os.path.dirname(name), recursive=True)
                    with system.open_output_stream(part) as out:
                        out.write(bytes(content))
                    system.move(part, name)
                done.append((path, target, len(content), fresh))
            yield pd.DataFrame(done, columns=["path", "object_path", "bytes", "written"])

    return run


def new_objects(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """Objects whose path is not stored yet, one per path."""
    return objects.dropDuplicates(["path"]).join(stored.select("path"), "path", "left_anti")


def quarantine(rejected: DataFrame, folder: str) -> None:
    rejected.write.mode("append").partitionBy("reason").parquet(folder)


#: Rows of a part of a single-file export.
PART_ROWS = 200_000


def write_ordered(lines: DataFrame, order: list[str], path: str, head: str = "", between: str = "\n", tail: str = "\n", compressed: bool = False) -> int:
    """One file of the column `line` in order; return the number of rows.

    Rows are dealt by ranges of the order, and each task writes its range as a part beside the target. The file system lays the parts
    end to end, or else Hadoop copies their bytes; no row comes to the driver. With `compressed` each part is a zstandard frame of its own (level 3), and frames
    may follow one another; then every line ends with a line feed, and there is no head.
    """
    spark = lines.sparkSession
    n = lines.count()
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    _fs(spark, folder)[1].mkdirs(_fs(spark, folder)[0])
    dealt = lines.repartitionByRange(max(1, -(-n // PART_ROWS)), *order).sortWithinPartitions(*order).select("line")
    done = dealt.mapInArrow(_part_writer(qualified(spark, folder), between, compressed), "part long, rows long").collect()  # one row a part
    parts = [f"{folder}/{r['part']:08d}" for r in sorted(done, key=lambda r: r["part"])]
    _laid_together(spark, parts, path, *(("", "", "") if compressed else (head, between, tail if parts or head else "")))
    _fs(spark, folder)[1].delete(_fs(spark, folder)[0], True)
    return sum(r["rows"] for r in done)


def _part_writer(folder: str, between: str, compressed: bool):
    def run(batches):
        import contextlib

        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        number, n = TaskContext.get().partitionId(), 0
        system, place = pafs.FileSystem.from_uri(folder)
        name, own = f"{place}/{number:08d}", f"{place}/{number:08d}.{uuid.uuid4().hex}"
        with contextlib.ExitStack() as stack:
            out = None
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    if out is None:
                        out = stack.enter_context(system.open_output_stream(own))
                        out = stack.enter_context(zstandard.ZstdCompressor(level=3).stream_writer(out, closefd=False)) if compressed else out
                    elif not compressed:
                        out.write(between.encode())
                    out.write(line.encode() + (b"\n" if compressed else b""))
                    n += 1
        if n:
            system.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int64()), "rows": pa.array([n], pa.int64())})

    return run


def _laid_together(spark: SparkSession, parts: list[str], path: str, head: str, between: str, tail: str) -> None:
    """The parts' bytes one after the other, under a name of its own until whole."""
    p, fs, jvm = _fs(spark, path)
    part, _, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    places = [_fs(spark, x)[0] for x in parts]
    if not head + between + tail and len(places) > 1 and fs.getScheme() == "hdfs":
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(places) - 1)
        for i, x in enumerate(places[1:]):
            array[i] = x
        fs.concat(places[0], array)  # moves blocks, no bytes
        fs.rename(places[0], part)
    else:
        out = fs.create(part, True)
        try:
            out.write(bytearray(head.encode()))
            for i, x in enumerate(places):
                out.write(bytearray((between if i else "").encode()))
                source = fs.open(x)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def write_manifest(tracks: DataFrame, path: str) -> int:
    """One JSON row per line, zstandard level 3, in (source, source_id) order; return the number of rows."""
    lines = tracks.select("source", "source_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    return write_ordered(lines, ["source", "source_id"], path, compressed=True)


def write_manifest_parts(tracks: DataFrame, path: str) -> None:
    """The same rows as many gzip files, for manifests too large for one writer."""
    tracks.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.option("compression", "gzip").text(path)


def write_attribution(tracks: DataFrame, path: str) -> None:
    """The attribution text in order."""
    write_ordered(attribution_lines(tracks), ["section", "license", "rank"], path)


def write_summary(tracks: DataFrame, path: str, source: str, total_rows: int, generated_at) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(summary_json(tracks, source, total_rows, generated_at).first()["summary"] + "\n")


def export_pages(pages: DataFrame, output: str, fmt: str) -> str:
    """One JSON array or CSV file; the extension is added where missing; other formats are an error."""
    kind = fmt.lower()
    if kind not in ("json", "csv"):
        raise ValueError(f"Unsupported format '{fmt}'. Supported formats: json, csv")
    path, order = output if output.endswith(f".{kind}") else f"{output}.{kind}", ["domain", "job_id", "url"]
    rows = pages.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    if kind == "csv":
        write_ordered(rows.select(*keys, page_csv_line().alias("line")), keys, path, head=",".join(PAGE_CSV) + "\n")
    else:
        write_ordered(rows.select(*keys, F.to_json(F.struct(*PAGE_CSV), {"pretty": "true", "ignoreNullFields": "false"}).alias("line")), keys, path, head="[\n", between=",\n", tail="\n]\n")
    return path
