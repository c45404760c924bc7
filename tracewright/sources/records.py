"""Readers of JSON events, host observations, snapshots and evidence files; and a writer of many small files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "timestamp STRING, source STRING, host STRING, hostname STRING, category STRING, severity STRING, actor STRING, target STRING, action STRING, event_type STRING, raw STRING, case_id STRING, metadata MAP<STRING,STRING>"
CHUNK = 1 << 20
OBSERVATION = "case_id STRING, collected_at STRING, platform STRING, observations MAP<STRING,STRING>"


def read_events(spark: SparkSession, path: str, *, schema: str = EVENT, lines: bool = True) -> DataFrame:
    """JSON lines, or files that hold an array, one object, or an object with events, timeline or items."""
    if lines:
        return spark.read.schema(schema).json(path)
    inner = f"ARRAY<STRUCT<{schema.replace(' STRING', ': STRING').replace(' MAP<', ': MAP<')}>>"
    rows = spark.read.option("multiLine", True).schema(f"{schema}, events {inner}, timeline {inner}, items {inner}").json(path)
    names = [f.name for f in rows.schema if f.name not in ("events", "timeline", "items")]
    nested = F.coalesce("events", "timeline", "items")
    own = F.array(F.struct(*names))
    return rows.select(F.explode(F.coalesce(nested, own)).alias("e")).select("e.*")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """One row per case, platform and observation."""
    return exploded(spark.read.schema(OBSERVATION).json(path))


def exploded(records: DataFrame) -> DataFrame:
    return records.select("case_id", "collected_at", "platform", F.explode("observations").alias("key", "value")).where("value is not null")


def read_snapshot(spark: SparkSession, path: str, schema: str, field: str = "processes", *, lines: bool = False) -> DataFrame:
    """A table in Parquet or JSON lines, or JSON files of an object that holds the rows in a field; with lines an object a line."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    inner = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)
    rows = spark.read.option("multiLine", not lines).schema(f"{schema}, {field} ARRAY<STRUCT<{inner}>>").json(path)
    return rows.select(F.explode(F.coalesce(field, F.array(F.struct(*(c for c in rows.columns if c != field))))).alias("r")).select("r.*")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a name and its path there; names are as Spark lists them, with nothing escaped."""
    local = re.match("(?:file:)?/+(.*)", uri)
    return (fs.LocalFileSystem(), f"/{local[1]}") if local else fs.FileSystem.from_uri(quote(uri, safe="/:@"))


def sha256_of(uri: str) -> str:
    """The hash of one file, read a MiB at a time."""
    system, path = _opened(uri)
    digest = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def write_files(files: DataFrame, root: str) -> None:
    """A file below the root for each row (path, content as text), written by the tasks; one that runs again writes the same.

    Spark's own writers make a file a task and folder, and the driver moves them one by one. The store is one that pyarrow opens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, written = set(), 0
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = _opened(f"{root.rstrip('/')}/{path}")
                if (folder := name.rpartition("/")[0]) not in known:
                    system.create_dir(folder, recursive=True)
                    known.add(folder)
                with system.open_output_stream(name) as stream:
                    stream.write((content or "").encode())
                written += 1
        yield pa.record_batch([pa.array([written], pa.int64())], ["written"])

    files.select("path", "content").mapInArrow(run, "written long").agg(F.sum("written")).collect()


def evidence(spark: SparkSession, root: str, *, skip: str = "integrity_manifest.json", most: int = 1 << 26) -> DataFrame:
    """path (from the root) and sha256 of every file below it but the manifest, whatever its size.

    Files of up to ``most`` bytes are read whole by Spark. Larger ones, such as images of disks and memory, go to tasks by
    name, which hash them in chunks of a MiB; their store has to be one that pyarrow opens (local or shared folders, HDFS
    with its native library, S3, GCS). A hash runs through its file in order, so one file is one task.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    below = F.lit(len(re.sub("^[a-z]+:/+", "/", root).rstrip("/")) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([uri]), pa.array([sha256_of(uri)])], ["path", "sha256"])

    small = listed.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("sha256"))
    large = listed.where(F.col("length") > most).select("path").repartition("path").mapInArrow(run, "path string, sha256 string")
    # a scan passes over files without bytes; their names are known from the listing that Spark holds anyway
    names = spark.createDataFrame([(unquote(re.sub("^file:/+", "file:/", x)),) for x in listed.inputFiles()], "path string")
    empty = names.join(listed.select("path"), "path", "left_anti").withColumn("sha256", F.lit(hashlib.sha256().hexdigest()))
    both = small.unionByName(large).unionByName(empty).select(F.substr(path, below).alias("path"), "sha256")
    return both.where(F.col("path") != skip)
