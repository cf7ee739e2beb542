"""Intervals and tests: exact binomial bounds, cluster resampling from sufficient statistics, sign flips, step-down adjustment."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracegrain.sources.scratch import ship_code


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction; work does not grow with a and b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def binomial_upper(c: int, n: int, alpha: float = 0.05) -> float:
    """The exact one-sided upper limit of a rate, c of n seen."""
    if n <= 0 or c >= n:
        return 1.0
    if c <= 0:
        return 1 - alpha ** (1 / n)
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_share(n - c, c + 1, 1 - mid) > alpha else (lo, mid)
    return (lo + hi) / 2


def binomial_lower(c: int, n: int, alpha: float = 0.05) -> float:
    return 0.0 if c <= 0 or n <= 0 else 1 - binomial_upper(n - c, n, alpha)


def _bound(f):
    @F.pandas_udf(DoubleType())
    def bound(c: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for key in zip(c, n, alpha, strict=True):
            if pd.isna(key[0]) or pd.isna(key[1]):
                out.append(None)
                continue
            if key not in seen:
                seen[key] = f(int(key[0]), int(key[1]), float(key[2]))
            out.append(seen[key])
        return pd.Series(out, dtype="float64")

    return lambda c, n, alpha=0.05: bound(F.col(c) if isinstance(c, str) else c, F.col(n) if isinstance(n, str) else n, F.lit(alpha) if isinstance(alpha, float) else alpha)


def binomial_draw(uniform: Column, n: Column, p: Column, most: int) -> Column:
    """A binomial number (n up to ``most`` trials, 0 < p < 1) from a uniform 32-bit one: how many k < n have a distribution function at or below it."""

    @F.pandas_udf("long")
    def draw(u: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        out = np.zeros(len(u), np.int64)
        for (size, rate), rows in pd.DataFrame({"n": n, "p": p}).groupby(["n", "p"]).indices.items():
            mass = [math.exp(math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) + k * math.log(rate) + (size - k) * math.log1p(-rate)) for k in range(min(int(size), most))]
            out[rows] = np.searchsorted(np.floor(np.cumsum(mass) * 2**32).astype(np.int64), u.to_numpy()[rows], "right")
        return pd.Series(out)

    return draw(uniform, n, p)


upper = _bound(binomial_upper)
lower = _bound(binomial_lower)


def upper_sql(source: str, alpha: str = "0.05") -> str:
    """CTEs that give ``bound(c, n, up)`` for the pairs (c, n) of a table: sixty bisections of the tail, in logarithms."""
    return f"""
bound_in AS (SELECT DISTINCT c::BIGINT AS c, n::BIGINT AS n FROM {source}),
bound_step AS (
  SELECT c, n, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0 AS i FROM bound_in WHERE c > 0 AND c < n
  UNION ALL
  SELECT c, n, CASE WHEN t > {alpha} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t > {alpha} THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum(list_transform(range(0, c + 1), lambda k: exp(lgamma(n + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - lgamma(n - k + 1) + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))) AS t
        FROM bound_step WHERE i < 60)),
bound AS (
  SELECT c, n, CASE WHEN n <= 0 OR c >= n THEN 1.0::DOUBLE ELSE 1 - pow({alpha}::DOUBLE, 1.0::DOUBLE / n) END AS up FROM bound_in WHERE c <= 0 OR c >= n
  UNION ALL SELECT c, n, (lo + hi) / 2 FROM bound_step WHERE i = 60)
"""


def audit_size(g: Column, alpha: Column) -> Column:
    """The least n without a derailment that certifies a margin g: 1 - alpha**(1/n) < g."""
    n = F.floor(F.log(alpha) / F.log(1 - g)).cast("bigint") + 1
    ok = lambda k: 1 - F.pow(alpha, F.lit(1.0) / k) < g
    return F.when(g <= 0, None).when(g >= 1, F.lit(1)).when((n > 1) & ok(F.greatest(n - 1, F.lit(1))), n - 1).when(ok(n), n).otherwise(n + 1).cast("bigint")


def audit_size_sql(g: str, alpha: str) -> str:
    """The same from the logarithms alone."""
    return f"(CASE WHEN {g} >= 1 THEN 1 ELSE floor(ln({alpha}) / ln(1 - {g})) + 1 END)::BIGINT"


def cluster_sums(rows: DataFrame, group: str, cluster: str, sums: dict[str, Column]) -> DataFrame:
    """The sums that a statistic needs, once for each cluster."""
    return rows.groupBy(group, cluster).agg(*(F.sum(c).alias(k) for k, c in sums.items()))


#: Draws that one row stands for while they are spread over tasks.
SPREAD = 100


def each_draw(rows: DataFrame, draws: int, name: str, *by: str) -> DataFrame:
    """Every row once for each draw 0 .. draws - 1, dealt out by draws and ``by``: few rows, such as clusters, fill all tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last, start = F.lit(draws - 1), F.col("_start")
    dealt = rows.withColumn("_start", F.explode(F.sequence(F.lit(0), last, F.lit(SPREAD)))).repartition(n, "_start", *by)
    return dealt.withColumn(name, F.explode(F.sequence(start, F.least(last, start + (SPREAD - 1))))).drop("_start")


#: A draw weighs each cluster by a Poisson number with mean 1, a hash of salt, group, cluster and draw: where 32 random bits reach the k-th of these, the
#: weight is k or more. Four draws share an MD5 sum.
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k))) for k in range(1, 13)]
_FOUR, _FLIPS = 4, 128
#: Groups whose sums a task holds, and clusters that it weighs at once.
_GROUPS, _CLUSTERS = 64, 128


def _numbers(salt: str, group: str, cluster: str, blocks: int) -> np.ndarray:
    """Four 32-bit numbers for each block, from the MD5 sum of salt:group:cluster:block."""
    head = hashlib.md5(f"{salt}:{group}:{cluster}:".encode(), usedforsecurity=False)
    out = bytearray()
    for block in range(blocks):
        own = head.copy()
        own.update(str(block).encode())
        out += own.digest()
    return np.frombuffer(bytes(out), ">u4")


def _poisson(salt: str, draws: int):
    steps = np.array(POISSON, np.uint64)
    return lambda group, cluster: np.searchsorted(steps, _numbers(salt, group, cluster, -(-draws // _FOUR))[:draws], "right")


def _signs(salt: str, draws: int):
    bit = np.arange(32, dtype=np.uint32)
    return lambda group, cluster: 1 - 2 * ((_numbers(salt, group, cluster, -(-draws // _FLIPS)).astype(np.uint32)[:, None] >> bit) & 1).reshape(-1)[:draws].astype(np.int64)


def _weighed(group: str, cluster: str, sums: list[str], draws: int, weights):
    """Sums of weighted clusters for each draw, a row for each group and draw that leaves the task."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def given(names):
            for name in names:
                total = held.pop(name)
                yield pa.RecordBatch.from_arrays([pa.array([name] * draws, pa.string()), pa.array(np.arange(draws, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(len(sums)))], names=[group, "b", *sums])

        for batch in batches:
            groups, clusters = batch.column(group).to_pylist(), batch.column(cluster).to_pylist()
            values = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in sums], axis=1)
            order = sorted(range(len(groups)), key=groups.__getitem__)
            i = 0
            while i < len(order):
                name = groups[order[i]]
                j = i
                while j < len(order) and j - i < _CLUSTERS and groups[order[j]] == name:
                    j += 1
                some = order[i:j]
                w = np.stack([weights(name, clusters[k]) for k in some], axis=1).astype(np.float64)
                held[name] = held.get(name, 0) + w @ values[some]
                i = j
                if len(held) > _GROUPS:
                    yield from given([x for x in held if x != name])
        yield from given(list(held))

    return run


def _draws(clusters: DataFrame, group: str, cluster: str, sums: list[str], draws: int, weights) -> DataFrame:
    spark = clusters.sparkSession
    ship_code(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Few rows with much work each: dealt out one by one.
    rows = clusters.select(F.col(group).cast("string").alias(group), F.col(cluster).cast("string").alias(cluster), *sums).repartition(n, group, cluster)
    schema = f"`{group}` string, b int, " + ", ".join(f"`{c}` double" for c in sums)
    return rows.mapInArrow(_weighed(group, cluster, sums, draws, weights), schema).groupBy(group, "b").agg(*(F.sum(c).alias(c) for c in sums))


def resample(clusters: DataFrame, group: str, cluster: str, sums: list[str], draws: int, salt: str) -> DataFrame:
    """(group, b, sums): the sums of each of ``draws`` resamples of whole clusters, for any statistic of sums.

    A draw's weights are made where the cluster lies: nothing is broadcast or joined, and a task gives one row for each group and draw, however many clusters it has."""
    return _draws(clusters, group, cluster, sums, draws, _poisson(salt, draws))


def bootstrap(rows: DataFrame, group: str, cluster: str, statistic: dict[str, Callable[[Column], Column]], draws: int, salt: str) -> DataFrame:
    """(group, b, statistics): any aggregates of the rows, resampled by whole clusters; each is a function from the column of weights to an aggregate.

    Every row stands once for each draw with a weight above 0: pre-aggregate rows that are alike, and take ``resample`` where sums will do. What is no
    finite number in a draw is null there, and counts in no percentile."""
    blocks = -(-draws // _FOUR)
    key = F.md5(F.concat_ws(":", F.lit(salt), F.col(group).cast("string"), F.col(cluster).cast("string"), F.col("_block").cast("string")))
    dealt = each_draw(rows, blocks, "_block", group, cluster).withColumn("_key", key)
    number = lambda i: F.conv(F.substring("_key", 8 * i + 1, 8), 16, 10).cast("bigint")
    drawn = dealt.select("*", F.inline(F.array(*(F.struct((F.col("_block") * _FOUR + i).alias("b"), number(i).alias("_u")) for i in range(_FOUR))))).where(F.col("b") < draws)
    weight = sum((F.when(F.col("_u") >= t, 1).otherwise(0) for t in POISSON), F.lit(0))
    weighed = drawn.withColumn("_w", weight).where("_w > 0")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    out = weighed.groupBy(group, "b").agg(*(f(F.col("_w")).cast("double").alias(k) for k, f in statistic.items()))
    return out.select(group, "b", *(finite(F.col(k)).alias(k) for k in statistic))


def weights_sql(clusters: str, group: str, cluster: str, draws: int, salt: str, columns: str = "c.*") -> str:
    """The same weights as SQL: the columns of a table of clusters, b and w."""
    steps = " + ".join(f"(u >= {t})::INT" for t in POISSON)
    return f"""
SELECT * EXCLUDE (u), {steps} AS w FROM (
  SELECT * EXCLUDE (key, block, i), 4 * block + i AS b, ('0x' || substr(key, 8 * i + 1, 8))::BIGINT AS u FROM (
    SELECT {columns}, block, md5(concat_ws(':', {salt!r}, CAST(c.{group} AS VARCHAR), CAST(c.{cluster} AS VARCHAR), CAST(block AS VARCHAR))) AS key FROM {clusters} c, range(0, {-(-draws // _FOUR)}) r(block)), range(0, 4) q(i))
WHERE b < {draws}
"""


def resample_sql(clusters: str, group: str, cluster: str, sums: list[str], draws: int, salt: str) -> str:
    """The draws as SQL over a table with group, cluster and the sums."""
    return f"SELECT {group}, b, {', '.join(f'sum(w * {s})::DOUBLE AS {s}' for s in sums)} FROM ({weights_sql(clusters, group, cluster, draws, salt)}) GROUP BY {group}, b"


def percentile_ci(value: Column, alpha: float = 0.05) -> list[Column]:
    """Linear interpolation between order statistics."""
    return [F.round(F.percentile(value, q), 9) for q in (alpha / 2, 1 - alpha / 2)]


def sign_flips(clusters: DataFrame, group: str, cluster: str, total: str, draws: int, salt: str) -> DataFrame:
    """Two-sided sign-flip test over clusters: (group, p), p = (1 + draws at least as large) / (draws + 1). An MD5 sum holds the signs of 128 draws."""
    sums = _draws(clusters, group, cluster, [total], draws, _signs(salt, draws))
    null = sums.select(F.col(group), F.round(F.abs(total), 9).alias("v"))
    seen = clusters.groupBy(F.col(group).cast("string").alias(group)).agg(F.round(F.abs(F.sum(total)), 9).alias("seen"))
    return null.join(seen, group).groupBy(group).agg(((1 + F.count(F.when(F.col("v") >= F.col("seen"), 1))) / F.lit(draws + 1)).alias("p"))


def sign_flips_sql(clusters: str, group: str, cluster: str, total: str, draws: int, salt: str) -> str:
    return f"""
SELECT n.{group}, (1 + count(*) FILTER (WHERE v >= seen))::DOUBLE / {draws + 1} AS p
FROM (SELECT {group}, b, round(abs(sum(CASE WHEN (u >> (b % 32)) & 1 = 0 THEN 1 ELSE -1 END * {total})), 9) AS v FROM (
    SELECT {group}, {total}, 128 * block + k AS b, ('0x' || substr(key, 8 * (k // 32) + 1, 8))::BIGINT AS u FROM (
      SELECT {group}, {total}, block, md5(concat_ws(':', {salt!r}, CAST({group} AS VARCHAR), CAST({cluster} AS VARCHAR), CAST(block AS VARCHAR))) AS key FROM {clusters}, range(0, {-(-draws // _FLIPS)}) r(block)), range(0, 128) q(k)) WHERE b < {draws} GROUP BY {group}, b) n
JOIN (SELECT {group}, round(abs(sum({total})), 9) AS seen FROM {clusters} GROUP BY {group}) s ON s.{group} = n.{group} GROUP BY n.{group}
"""


def holm(rows: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Adds ``holm_p``: step-down adjusted, over the few rows of a table of comparisons; null p-values stay null."""
    ranked = rows.where(F.col(p).isNotNull())
    w = Window.orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    step = ranked.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    done = step.withColumn("holm_p", F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")
    return done.unionByName(rows.where(F.col(p).isNull()).withColumn("holm_p", F.lit(None).cast("double")))
