"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = str(Path(__file__).resolve().parents[2])


def ship_code(spark: SparkSession) -> None:
    """Get a session ready for this package's tasks: the Python workers of a session on this machine can import the package wherever they were started.
    A cluster gets it like any other package (installed on its machines, or as an archive in ``--py-files``)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


@cache
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-scratch-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may leave it unset, as tests do: its workers see a temporary
    folder of this machine; those of a cluster don't."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or _own_scratch()


#: Tables of the job that this thread is in.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def job() -> Iterator[list[str]]:
    """What this thread writes inside belongs to the job, in order; jobs in other threads have lists of their own. A job inside a job is one of its own."""
    own: list[str] = []
    token = _made.set(own)
    try:
        yield own
    finally:
        _made.reset(token)


def new_path(spark: SparkSession, tag: str) -> str:
    """A place for one more table."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    own = _made.get()
    if own is not None:
        own.append(path)
    return path


def materialise(df: DataFrame, tag: str, share: int = 1, of: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts the lineage
    for good: a lost executor costs no more than the tasks that read the table.

    A table that is far smaller than what it comes from (links, labels) is written by one task for each ``share`` partitions (of the session's number, or ``of``
    if that is larger), so that it isn't a heap of tiny files. Such tables stay, as checkpoints do, for what reads them later; ``discard`` deletes those of a job that is done."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if share > 1:
        df = df.coalesce(max(1, max(of, int(spark.conf.get("spark.sql.shuffle.partitions"))) // share))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that are sent to all tasks at once.
SENT = 4 << 20


def by_text(rows: DataFrame, made: Callable[[DataFrame], DataFrame], *text: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``made`` finds in these columns alone: worked out once for each different text, however many rows hold it.

    ``made`` gets the texts and returns them, or some, with more columns. They are written and measured: up to ``SENT`` bytes of text are sent to the rows, more meet
    them in a shuffle. (By the size of a compressed file Spark would send the driver far more.)"""
    found = materialise(made(rows.select(*text).distinct()), "texts")
    size = found.agg(F.sum(F.octet_length(F.to_json(F.struct(*text))))).first()[0] or 0
    return rows.join(F.broadcast(found) if size <= SENT else found.hint("merge"), list(text), how)


def discard(spark: SparkSession, own: list[str]) -> None:
    """Delete the tables of a job, but for the last."""
    for name in own[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del own[:-1]
