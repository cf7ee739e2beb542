"""Collecting answers: arms of items go to a model and its replies are read. A model is any object with ``reply``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.portable import h
from tracegrain.functions.trace import extract_answer
from tracegrain.sources.scratch import materialise


class Model(Protocol):
    def reply(self, arm: Column, item: dict[str, Column]) -> Column:
        """The text that continues an item's arm."""


@dataclass(frozen=True)
class MockModel:
    """Follows, derails or restores at planted rates (percent by arm), by a hash of the item; a column expression, so a
    test of the loop needs no Python on the executors."""

    follow: dict[str, float] = field(default_factory=dict)
    derail: dict[str, float] = field(default_factory=dict)
    salt: str = "mock"

    def reply(self, arm: Column, item: dict[str, Column]) -> Column:
        u = h(self.salt, item["model"], item["record_id"], arm) * 100 / F.lit(4294967296.0)
        rate = lambda table: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), arm), F.lit(0.0)) if table else F.lit(0.0)
        follow, derail = rate(self.follow), rate(self.derail)
        value = F.when(u < follow, item["den_treat"]).when(u < follow + derail, item["den_clean"] + 11).otherwise(item["den_clean"])
        return F.concat(F.lit("So the final answer is "), value.cast("bigint").cast("string"), F.lit("."))


def collect(items: DataFrame, model: Model, done: DataFrame | None = None) -> DataFrame:
    """One row for each arm of each item: model, record_id, arm, den_clean, den_treat, output, answer.

    Arms in ``done`` (model, record_id, arm) are not asked again."""
    arms = F.explode(F.when(F.col("den_placebo").isNotNull(), F.array(F.lit("treat"), F.lit("placebo"))).otherwise(F.array(F.lit("treat"))))
    rows = items.select("model", "record_id", "den_clean", "den_treat", arms.alias("arm"))
    if done is not None:
        rows = rows.join(done, ["model", "record_id", "arm"], "left_anti")
    own = {c: F.col(c) for c in ("model", "record_id", "den_clean", "den_treat")}
    return rows.withColumn("output", model.reply(F.col("arm"), own)).withColumn("answer", extract_answer("output"))


def ask_again(rows: DataFrame, keys: list[str], answer: str, ask: Callable[[DataFrame, int], DataFrame], tries: int = 3) -> DataFrame:
    """``rows`` with missing answers filled in, and ``tries``: 0 where there was one, the round that found it, null where none did.

    ``ask`` is given the rows still open and the round (its seed), and adds a column ``new``. Each round asks only what the ones before have left
    open, and none is begun when nothing is; a new answer replaces only what was missing."""
    left, found = rows.where(F.col(answer).isNull()), None
    for seed in range(1, tries + 1):
        if not left.limit(1).count():
            break
        got = materialise(ask(left, seed), f"round-{seed}")
        new = got.where("new is not null").select(*keys, "new", F.lit(seed).alias("tries"))
        found = new if found is None else found.unionByName(new)
        left = got.where("new is null").drop("new")
    if found is None:
        return rows.withColumn("tries", F.when(F.col(answer).isNotNull(), 0))
    out = rows.join(found, keys, "left").withColumn("tries", F.when(F.col(answer).isNotNull(), 0).otherwise(F.col("tries")))
    return out.withColumn(answer, F.coalesce(answer, "new")).drop("new")


def answer_pending(rows: DataFrame, keys: list[str], arm: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (keys, status, and maps ``conditions``, ``outputs`` and ``answers`` by arm) with the arm's missing answers filled in, and ``asked``.

    Built records that have the arm's text and no answer to it are asked, once a key however often its row is repeated; a record that lacks a part of its key is left
    as it is. ``ask`` is given (keys, prompt) and adds ``said``, null where the call failed. What was said stays among the outputs
    even if no answer can be read from it; what other arms have is not touched. Replies are written before they are used: a lost executor asks nothing twice."""
    due = (F.col("status") == "built") & F.map_contains_key("conditions", F.lit(arm)) & F.try_element_at("answers", F.lit(arm)).isNull()
    for k in keys:
        due &= F.col(k).isNotNull()
    rows = rows.withColumn("asked", F.coalesce(due, F.lit(False)))
    prompts = rows.where("asked").groupBy(*keys).agg(F.min(F.try_element_at("conditions", F.lit(arm))).alias("prompt"))
    said = materialise(ask(prompts).select(*keys, "said", F.lit(True).alias("asked")), f"{arm}-replies")

    def put(into: str, value: Column) -> Column:
        old = F.map_filter(F.coalesce(into, F.from_json(F.lit("{}"), rows.schema[into].dataType)), lambda k, _: k != arm)
        return F.when(F.col("said").isNotNull(), F.map_concat(old, F.create_map(F.lit(arm), value))).otherwise(F.col(into))

    # A record that was not asked meets no reply, even if another row of its key was.
    out = rows.join(said, [*keys, "asked"], "left")
    return out.withColumn("outputs", put("outputs", F.col("said"))).withColumn("answers", put("answers", extract_answer("said"))).drop("said")


def seed_coverage(records: DataFrame, seeds: list[int], n_problems: int) -> DataFrame:
    """(model, seed, n_problems, complete) of every system and wanted seed, also of those without a record. A seed is complete when as many
    problems were attempted as the panel has: some records are not enough, as a run that broke off leaves them too."""
    if not seeds:
        raise ValueError("no seeds are wanted")
    wanted = records.where("model is not null").select("model").distinct().select("model", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    have = records.where(F.col("seed").isin(seeds)).groupBy("model", "seed").agg(F.countDistinct("problem_id").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return wanted.join(have, ["model", "seed"], "left").select("model", "seed", n.alias("n_problems"), (n >= n_problems).alias("complete"))


def lacking(records: DataFrame, panel: DataFrame, seeds: list[int]) -> DataFrame:
    """(model, seed, problem_id) that a seed not yet complete still lacks. The driver holds one row a system and seed; problems are met by their keys."""
    panel = panel.select("problem_id").where("problem_id is not null").distinct()
    still = seed_coverage(records, seeds, panel.count()).where("not complete").select("model", "seed").collect()
    if not still:
        return panel.select(F.lit("").alias("model"), F.lit(0).alias("seed"), "problem_id").where("false")
    slots = F.array(*(F.struct(F.lit(r.model).alias("model"), F.lit(r.seed).alias("seed")) for r in still))
    return panel.select(F.inline(slots), "problem_id").join(records.select("model", "seed", "problem_id"), ["model", "seed", "problem_id"], "left_anti")


def replicate(records: DataFrame, panel: DataFrame, seeds: list[int], ask: Callable[[DataFrame, int], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Records (model, seed, problem_id, ...) with those that the seeds lack, and a log (round, model, seed, n_sent, n_problems, complete).

    Each round asks for what is lacking only and writes what it gets; ``ask`` is given (model, seed, problem_id) and the round, and returns rows like
    ``records``, fewer where calls fail. None is begun when nothing is lacking: what an earlier run has collected is never asked again."""
    panel = materialise(panel.select("problem_id").where("problem_id is not null").distinct(), "panel")
    n, log = panel.count(), None
    # Coverage needs keys only: they are worked out once, and each round adds its own.
    have = materialise(records.select("model", "seed", "problem_id").distinct(), "collected-0")
    for i in range(1, rounds + 1):
        todo = materialise(lacking(have, panel, seeds), f"lacking-{i}")
        if not todo.limit(1).count():
            break
        new = materialise(ask(todo, i).select(*records.columns), f"collected-{i}")
        records, have = records.unionByName(new), have.unionByName(new.select(*have.columns))
        sent = todo.groupBy("model", "seed").agg(F.count("*").alias("n_sent"))
        own = seed_coverage(have, seeds, n).join(sent, ["model", "seed"], "left").select(F.lit(i).alias("round"), "model", "seed", F.coalesce("n_sent", F.lit(0).cast("long")).alias("n_sent"), "n_problems", "complete")
        log = own if log is None else log.unionByName(own)
    if log is None:
        log = seed_coverage(have, seeds, n).select(F.lit(0).alias("round"), "model", "seed", F.lit(0).cast("long").alias("n_sent"), "n_problems", "complete")
    return records, log
