"""Running outcome rates over an append-only record log (beyond what batch files offer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegrain.operators.gates import scored


def record_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def running_counts(records: DataFrame) -> DataFrame:
    """Counts by system over records seen once; a record that arrives again within the input's watermark changes nothing.

    The input has an event time with a watermark, which bounds the memory of what was seen."""
    once = records.dropDuplicatesWithinWatermark(["model", "record_id"])
    rows = scored(once).where("gated")
    n_of = lambda x: F.count(F.when(F.col("outcome") == x, 1))
    return rows.groupBy("model").agg(F.count("*").alias("n"), n_of("F").alias("follow"), n_of("R").alias("restore"), n_of("D").alias("derail"))
