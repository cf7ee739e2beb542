"""Where results go: LaTeX tables, JSON, JSON lines, CSV sheets; and what reads them back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.functions.equality import finite


def latex_rows(rows: DataFrame, name: str, whole: list[str], rates: list[str]) -> DataFrame:
    """One line of a tabular for each row: three decimals, a dash for null, underscores escaped."""
    cells = [F.replace(F.col(name), F.lit("_"), F.lit("\\_")), *(F.col(c).cast("string") for c in whole), *(F.when(F.col(c).isNull(), "--").otherwise(F.format_string("%.3f", c)) for c in rates)]
    return rows.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def _clean(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return finite(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _clean(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(_clean(x[f.name], f.dataType).alias(f.name) for f in kind)))
    return x


def clean(rows: DataFrame) -> DataFrame:
    """NaN and infinities as null, which JSON can hold, however deep they lie in structs, arrays and map values."""
    return rows.select(*(_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema))


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; Spark's commit protocol keeps a half-written result out of sight."""
    clean(rows).write.mode(mode).json(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """An audit sheet whose cells may hold line breaks and quotes."""
    rows.write.csv(path, header=True, quoteAll=True, escape='"')


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


ANSWERS = T.StructType([T.StructField(a, T.DoubleType()) for a in ("control", "treat", "placebo", "copyable", "legacy")])
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "problem_id", "dataset", "question", "trace", "status")]
    + [T.StructField("seed", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("gold", "den_clean", "den_treat", "den_placebo", "den_copyable", "competent_answer")]
    + [T.StructField("answers", ANSWERS), T.StructField("outputs", T.MapType(T.StringType(), T.StringType())), T.StructField("conditions", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(n, T.BooleanType()) for n in ("competent", "parsed", "self_consistent", "grammar_normalized")]
    + [T.StructField("treatment_step_idx", T.LongType()), T.StructField("trace_length", T.LongType())]
)
STATE = T.StructType([T.StructField(n, T.StringType()) for n in ("model", "access_date", "started_at", "completed_at", "interventional_completed_at", "output_tag")] + [T.StructField("grammar_normalized", T.BooleanType()), T.StructField("on_policy_complete", T.BooleanType()), T.StructField("records", T.ArrayType(RECORD))])


TAG = "_grammar"
#: What the file of a packed document ends with; no part of the document's name.
PACKED = ".gz"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each state file: file, damaged, model, access_date, completed_at, on_policy_complete, records. A file that is no whole JSON document is ``damaged`` and has nothing else.
    Packed documents go by their names without the ending; one whose
    stream is itself cut short is not told but makes the read fail."""
    schema = T.StructType([*STATE.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    damaged = F.col("_corrupt_record").isNotNull() | F.col("model").isNull()
    own = lambda c: F.when(~damaged, F.col(c)).alias(c)
    file = F.regexp_replace("_metadata.file_name", f"{re.escape(PACKED)}$", "")
    return raw.select(file.alias("file"), damaged.alias("damaged"), *map(own, ("model", "access_date", "completed_at", "on_policy_complete", "records")))


def read_states(spark: SparkSession, path: str, drop_tagged: bool = True) -> DataFrame:
    """Collected records, one row each, from one JSON document a run: model, file and the record's fields; damaged files have none.

    Two files of one model would clobber each other: with ``drop_tagged`` files whose name has a tag are left out,
    and of what is left ``last_file`` or ``canonical`` choose."""
    runs = read_runs(spark, path).where("not damaged")
    return (runs.where(~F.col("file").contains(TAG)) if drop_tagged else runs).select("model", "file", "access_date", F.inline("records"))


def canonical(states: DataFrame, names: list[str] | None = None, tag: str = TAG) -> DataFrame:
    """Runs whose file is named (any, if no names are given) and carries no tag."""
    keep = ~F.col("file").contains(tag)
    return states.where(keep & F.col("file").isin(names) if names else keep)


def last_file(states: DataFrame) -> DataFrame:
    """Of several files of one model the last by name counts; ``n_files`` tells how many claimed it."""
    per = states.groupBy("model").agg(F.max("file").alias("file"), F.countDistinct("file").alias("n_files"))
    return states.join(per, ["model", "file"])


def complete(wanted: DataFrame, runs: DataFrame, on_policy: bool) -> DataFrame:
    """``wanted`` (file) with ``complete``: the file is there, is whole and says when it was completed, and, where asked for, that its own samples are too."""
    done = F.col("completed_at").isNotNull() & (F.coalesce("on_policy_complete", F.lit(False)) if on_policy else F.lit(True))
    return wanted.join(runs.select("file", (~F.col("damaged") & done).alias("complete")), "file", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def one_file_each(records: DataFrame) -> DataFrame:
    """Models that more than one file claims."""
    return records.groupBy("model").agg(F.array_sort(F.collect_set("file")).alias("files")).where(F.size("files") > 1)
