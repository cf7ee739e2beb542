"""Files under names of their own, logs that batches are appended to, and a cache of answers by key.

Spark's writers name their files themselves. ``publish`` lets Spark write each document into a folder of its own and then moves it to its name, which is one
step of the file system: a name shows the old file, or none, until the new one is whole. ``append`` and ``Cache`` keep batches in
folders; a batch shows once it is whole, and writing it again replaces it, so that a job that is repeated adds nothing twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.sources.scratch import materialise, new_path
from tracegrain.sources.sinks import PACKED, clean


def _system(spark: SparkSession, path: str):
    """The file system of a path, and what makes paths for it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in the order of its names; nothing if it is missing."""
    fs, path = _system(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []


def publish(docs: DataFrame, folder: str, packed: bool = False) -> list[str]:
    """Write each row (file, text) as the file of that name, ``packed`` with gzip and ``.gz`` behind it; a file of that name that is there already, packed or
    not, is replaced. The names, of which the driver holds one for each document, not the documents. These go to their files from the tasks that make them, without a shuffle."""
    spark = docs.sparkSession
    staged = new_path(spark, "staged")
    # A file holds one document, so that those that share a name show as files of one folder, whichever tasks wrote them.
    docs.select("text", F.col("file").alias("name")).write.option("maxRecordsPerFile", 1).option("compression", "gzip" if packed else "none").partitionBy("name").text(staged)
    fs, path = _system(spark, staged)
    done = [x.removeprefix("name=") for x in names(spark, staged) if x.startswith("name=")]
    parts = {x: [y for y in names(spark, f"{staged}/name={x}") if y.startswith("part-")] for x in done}
    if bad := [x for x in done if not _NAME.fullmatch(x) or x.endswith(PACKED) or len(parts[x]) > 1]:
        raise ValueError(f"not the names of one document each: {bad[:5]}")
    fs.mkdirs(path(folder))
    there = set(names(spark, folder))
    for name in done:
        for old in {name, f"{name}{PACKED}"} & there:
            fs.delete(path(f"{folder}/{old}"), False)
        if not fs.rename(path(f"{staged}/name={name}/{parts[name][0]}"), path(f"{folder}/{name}{PACKED if packed else ''}")):
            raise OSError(f"could not move {name} into {folder}")
    fs.delete(path(staged), True)
    return done


def _batch(rows: DataFrame, folder: str, name: str, write) -> None:
    """Write a batch beside its place and move it there."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not the name of a batch: {name}")
    spark = rows.sparkSession
    staged, place = new_path(spark, "batch"), f"{folder}/batch={name}"
    write(rows, staged)
    fs, path = _system(spark, staged)
    fs.mkdirs(path(folder))
    fs.delete(path(place), True)
    if not fs.rename(path(staged), path(place)):
        raise OSError(f"could not move batch {name} into {folder}")


def append(rows: DataFrame, folder: str, batch: str) -> None:
    """Append rows to a log of JSON lines, as a batch of that name. A batch that is there already is replaced: appending again what a failed job
    may have appended is safe. Batches are read in the order of their names."""
    _batch(rows, folder, batch, lambda r, path: clean(r).write.json(path))


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """The batches that are there now. They are read by their own paths: Spark takes two reads of one folder for the same, whatever has been added between them."""
    return [f"{folder}/{x}" for x in names(spark, folder) if x.startswith("batch=")]


CORRUPT = "_corrupt_record"


def read_log(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of a log with their ``batch``; blank lines are skipped, and a line that can't be read is a row of nulls with the line in
    ``_corrupt_record``. A missing log has no rows."""
    own = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    own = T.StructType([*own.fields, T.StructField("batch", T.StringType())])
    there = _batches(spark, folder)
    if not there:
        return spark.createDataFrame([], own)
    return spark.read.schema(own).option("columnNameOfCorruptRecord", CORRUPT).option("basePath", folder).json(there)


@dataclass(frozen=True)
class Cache:
    """Answers by key in a folder: one row (key, and the columns of ``answer``) for each key that has been asked."""

    folder: str
    answer: T.StructType

    def read(self, spark: SparkSession) -> DataFrame:
        """One answer for each key. Where runs side by side have asked the same, the batch with the first name counts for all readers."""
        whole = T.StructType([T.StructField("key", T.StringType()), *self.answer.fields])
        there = _batches(spark, self.folder)
        if not there:
            return spark.createDataFrame([], whole)
        rows = spark.read.schema(T.StructType([*whole.fields, T.StructField("batch", T.StringType())])).option("basePath", self.folder).parquet(*there)
        own = F.struct(*(F.col(f.name) for f in self.answer))
        return rows.groupBy("key").agg(F.min(F.struct("batch", own.alias("a")))["a"].alias("a")).select("key", "a.*")

    def ask(self, requests: DataFrame, key: Column, send, batch: str) -> DataFrame:
        """``requests`` with ``key``, the columns of the answer, and ``sent`` (asked in this run, not read).

        ``send`` is given one request of each key that the cache lacks, with all its columns, and returns (key, and the answer's columns). What it returns is added
        as one batch before it is used. Requests with the same content are sent once, in a run and over all runs; a key without an answer stays unasked."""
        spark = requests.sparkSession
        keyed = requests.withColumn("key", key)
        # Of the requests with a key one is sent: they agree in all that goes into it.
        fields = [c for c in keyed.columns if c != "key"]
        one = keyed.groupBy("key").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in fields))).alias("r")).select("key", "r.*")
        known = self.read(spark)
        fresh = send(one.join(known, "key", "left_anti")).select("key", *(f.name for f in self.answer))
        fresh = materialise(fresh, "answers")
        if fresh.limit(1).count():
            # Nothing that is there is ever written over: a run of the same name adds a batch of its own.
            there = sum(x == f"batch={batch}" or x.startswith(f"batch={batch}.") for x in names(spark, self.folder))
            _batch(fresh, self.folder, f"{batch}.{there}" if there else batch, lambda r, path: r.write.parquet(path))
        answers = known.withColumn("sent", F.lit(False)).unionByName(fresh.withColumn("sent", F.lit(True)))
        return keyed.join(answers, "key", "left")
