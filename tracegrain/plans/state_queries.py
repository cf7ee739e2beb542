"""State files, logs, sheets and caches: written, read back and counted."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.functions.portable import h, h_sql
from tracegrain.operators.collect import answer_pending, ask_again, replicate
from tracegrain.operators.gates import scored
from tracegrain.operators.rates import share
from tracegrain.plans.rate_queries import items, with_conditions
from tracegrain.plans.registry import query
from tracegrain.plans.trace_queries import verdict
from tracegrain.sources import files, sinks
from tracegrain.sources.fixtures import view
from tracegrain.sources.scratch import new_path

#: Slots of a run's records: they grow with the orders, so that no document does.
SLOTS = 64
DAMAGED = "full_sys9_0_0000.json"


def state_files(spark, sf) -> str:
    """A folder of state documents, one for each system, seed and stretch of slots, each a file of its own name; those of seed 1 carry a tag, and one more is cut short."""
    part = lambda third: F.lpad(F.floor(third.cast("int") / SLOTS).cast("string"), 4, "0")
    # The rows of a document lie in one task from the first shuffle on: neither records nor texts are shuffled.
    rows = view(spark, sf, "items", run=lambda third: F.xxhash64("m", "seed", part(third))).withColumn("part", part(F.split("record_id", ":")[2]))
    record = F.struct("record_id", "problem_id", "status", F.col("seed").cast("bigint").alias("seed"), "gold", "den_clean", "den_treat", F.struct(F.col("ans_control").alias("control"), F.coalesce("ans_treat", F.lit(float("nan"))).alias("treat")).alias("answers"))
    runs = sinks.clean(rows.groupBy("run", "model", "seed", "part").agg(F.sort_array(F.collect_list(record)).alias("records")))
    # Runs of seed 2 are under way; systems of even number have all their own samples.
    runs = runs.withColumn("completed_at", F.when(F.col("seed") < 2, F.concat(F.lit("2026-01-01T00:00:0"), F.col("seed").cast("string")))).withColumn("on_policy_complete", F.when(F.substring("model", 4, 9).cast("int") % 2 == 0, True))
    name = F.concat(F.lit("full_"), F.col("model"), F.lit("_"), F.col("seed").cast("string"), F.lit("_"), F.col("part"), F.when(F.col("seed") == 1, sinks.TAG).otherwise(""), F.lit(".json"))
    docs = runs.select(name.alias("file"), F.to_json(F.struct("model", "completed_at", "on_policy_complete", "records"), {"pretty": "true"}).alias("text"))
    folder = new_path(spark, "states")
    files.publish(docs, folder, packed=True)
    whole = spark.read.text(f"{folder}/full_sys0_0_0000.json{sinks.PACKED}", wholetext=True)
    files.publish(whole.select(F.lit(DAMAGED).alias("file"), F.expr("substr(value, 1, length(value) div 2)").alias("text")), folder, packed=True)
    return folder


_FILE = f"concat('full_', model, '_', seed, '_', lpad(CAST(CAST(split_part(record_id, ':', 3) AS INT) // {SLOTS} AS VARCHAR), 4, '0'), CASE WHEN seed = 1 THEN '{sinks.TAG}' ELSE '' END, '.json')"


@query(
    f"""SELECT model, {_FILE} AS file, false AS damaged, count(*) AS n, count(ans_treat) AS n_answered, count(*) FILTER (WHERE status = 'built') AS n_built, sum(den_clean) AS total FROM items GROUP BY ALL
UNION ALL SELECT NULL, '{DAMAGED}', true, 0, 0, 0, NULL""",
    "items",
)
def s01_read_states(spark, sf):
    """Records of all state files, and the files that can't be read; an answer that was no number comes back as missing."""
    folder = state_files(spark, sf)
    r = sinks.read_states(spark, folder, drop_tagged=False).groupBy("model", "file").agg(F.count("*").alias("n"), F.count("answers.treat").alias("n_answered"), F.count(F.when(F.col("status") == "built", 1)).alias("n_built"), F.sum("den_clean").alias("total"))
    runs = sinks.read_runs(spark, folder).select("file", "damaged")
    none = F.lit(0).cast("long")
    return runs.join(r, "file", "left").select("model", "file", "damaged", *(F.coalesce(c, none).alias(c) for c in ("n", "n_answered", "n_built")), "total")


_WANTED = ["full_sys1_0_0000.json", "full_sys3_1_0000_grammar.json", "full_sys3_2_0000.json", "full_sys4_2_9999.json", DAMAGED]


@query(f"SELECT model, count(*) AS n, count(DISTINCT problem_id) AS n_problems FROM items WHERE {_FILE} IN ({', '.join(map(repr, _WANTED))}) AND seed <> 1 GROUP BY model", "items")
def s02_canonical(spark, sf):
    """Records of whitelisted files; tagged files are left out even if they are named, and missing or damaged ones have none."""
    runs = sinks.canonical(sinks.read_runs(spark, state_files(spark, sf)), _WANTED)
    return runs.where("not damaged").select("model", F.inline("records")).groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("problem_id").alias("n_problems"))


@query(f"WITH f AS (SELECT *, {_FILE} AS file FROM items WHERE seed <> 1), l AS (SELECT model, max(file) AS file, count(DISTINCT file) AS n_files FROM f GROUP BY model) SELECT f.model, l.file, any_value(n_files) AS n_files, count(*) AS n_kept FROM f JOIN l ON l.model = f.model AND l.file = f.file GROUP BY f.model, l.file", "items")
def s03_last_run(spark, sf):
    """Several files of one system: the last by name counts, and how many there were is told."""
    runs = sinks.canonical(sinks.read_runs(spark, state_files(spark, sf)).where("not damaged"))
    kept = sinks.last_file(runs.select("model", "file", F.size("records").alias("n")))
    return kept.groupBy("model", "file").agg(F.max("n_files").alias("n_files"), F.sum("n").alias("n_kept"))


@query("SELECT record_id, md5(trace) AS trace, concat('he said \"', problem_id, '\", twice') AS note, '' AS agree FROM traces", "traces")
def s04_sheet(spark, sf):
    """An audit sheet written and read back: cells with line breaks, commas and quotes, and an empty one to be filled in."""
    t = view(spark, sf, "traces").select("record_id", "trace", F.concat(F.lit('he said "'), F.col("problem_id"), F.lit('", twice')).alias("note"), F.lit("").alias("agree"))
    path = new_path(spark, "sheet")
    sinks.write_sheet(t, path)
    return sinks.read_sheet(spark, path).select("record_id", F.md5("trace").alias("trace"), "note", F.coalesce("agree", F.lit("")).alias("agree"))


@query(
    f"""WITH f AS (SELECT DISTINCT {_FILE} AS file, seed, substr(model, 4)::INT AS m FROM items)
SELECT file, seed < 2 AS complete, seed < 2 AND m % 2 = 0 AS with_samples FROM f UNION ALL SELECT unnest(['{DAMAGED}', 'full_sys7_0_0000.json']), false, false""",
    "items",
)
def f11_runs_complete(spark, sf):
    """Which runs need not be made again: files that say when they were completed, with and without their own samples; one is damaged and one was never written."""
    runs = sinks.read_runs(spark, state_files(spark, sf))
    wanted = runs.select("file").unionByName(spark.createDataFrame([("full_sys7_0_0000.json",)], "file string"))
    return sinks.complete(sinks.complete(wanted, runs, True).withColumnRenamed("complete", "with_samples"), runs, False).select("file", "complete", "with_samples")


_LOG = T.StructType([T.StructField("task_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("event", T.StringType()), T.StructField("seconds", T.DoubleType())])


@query("SELECT task_id, count(*) AS n, count(*) FILTER (WHERE seq % 5 <> 0) AS n_timed, arg_max(event, (seq % 3, seq)) AS last_event, max(seq % 3)::INT AS last_batch FROM task_log GROUP BY task_id", "task_log")
def s05_append_log(spark, sf):
    """A log of three batches, two of which are appended twice, as jobs that were repeated do; read in the order of batches. What is no number is written as missing."""
    log = view(spark, sf, "task_log").select("task_id", "seq", "event", F.when(F.col("seq") % 5 == 0, float("nan")).otherwise(F.col("seq") / 2).alias("seconds"))
    folder = new_path(spark, "log")
    for batch in (0, 1, 0, 2, 2):
        files.append(log.where(F.col("seq") % 3 == batch), folder, f"b{batch}")
    rows = files.read_log(spark, folder, _LOG).where(f"{files.CORRUPT} is null")
    last = F.max(F.struct("batch", "seq", "event"))
    return rows.groupBy("task_id").agg(F.count("*").alias("n"), F.count("seconds").alias("n_timed"), last["event"].alias("last_event"), F.substring(last["batch"], 2, 9).cast("int").alias("last_batch"))


_KEY = "sha256(concat(model, '|', problem_id, '|', CAST(den_treat AS BIGINT)))"
_RUNS = {"first": "seed = 0", "second": "true", "third": "true"}


@query(
    f"""WITH r AS (SELECT model, seed, den_treat, {_KEY} AS key FROM items WHERE status = 'built'), old AS (SELECT DISTINCT key FROM r WHERE seed = 0)
SELECT 'first' AS run, model, count(*) AS n_requests, count(DISTINCT key) AS n_keys, count(DISTINCT key) AS n_sent, sum(den_treat + 1)::BIGINT AS total FROM r WHERE seed = 0 GROUP BY model
UNION ALL SELECT 'second', model, count(*), count(DISTINCT key), count(DISTINCT key) FILTER (WHERE key NOT IN (SELECT key FROM old)), sum(den_treat + 1)::BIGINT FROM r GROUP BY model
UNION ALL SELECT 'third', model, count(*), count(DISTINCT key), 0, sum(den_treat + 1)::BIGINT FROM r GROUP BY model""",
    "items",
)
def m04_cache(spark, sf):
    """Three runs over one cache: requests with the same content are sent once, what an earlier run has asked is read, and a run that is repeated sends nothing."""
    rows = items(spark, sf).where("status = 'built'").select("model", "problem_id", "seed", F.col("den_treat").cast("bigint").alias("value"))
    key = F.sha2(F.concat_ws("|", "model", "problem_id", F.col("value").cast("string")), 256)
    cache = files.Cache(new_path(spark, "cache"), T.StructType([T.StructField("answer", T.LongType())]))
    out = None
    for run, where in _RUNS.items():
        got = cache.ask(rows.where(where).select("model", "problem_id", "value"), key, lambda r: r.withColumn("answer", F.col("value") + 1), run)
        part = got.groupBy("model").agg(F.count("answer").alias("n_requests"), F.countDistinct("key").alias("n_keys"), F.countDistinct(F.when(F.col("sent"), F.col("key"))).alias("n_sent"), F.sum("answer").alias("total")).withColumn("run", F.lit(run))
        out = part if out is None else out.unionByName(part)
    return out


_ROUND = [f"{h_sql(repr(f'again{r}'), 'model', 'record_id')} % 2 = 0" for r in (1, 2, 3)]


@query(
    f"""SELECT model, record_id, coalesce(ans_treat, CASE WHEN {" OR ".join(_ROUND)} THEN den_clean END) AS ans_treat,
CASE WHEN ans_treat IS NOT NULL THEN 0 {" ".join(f"WHEN {x} THEN {r}" for r, x in enumerate(_ROUND, 1))} END AS tries FROM items WHERE status = 'built'""",
    "items",
)
def m07_rerun(spark, sf):
    """Missing answers asked again, three times at most, each time with another seed; a new answer replaces only what was missing."""
    rows = items(spark, sf).where("status = 'built'").select("model", "record_id", "den_clean", "ans_treat")
    ask = lambda left, seed: left.withColumn("new", F.when(h(f"again{seed}", F.col("model"), F.col("record_id")) % 2 == 0, F.col("den_clean")))
    return ask_again(rows, ["model", "record_id"], "ans_treat", ask).select("model", "record_id", "ans_treat", "tries")


_TOLD = f"{h_sql("'legacy'", 'model', 'record_id')} % 10"


@query(
    f"""WITH r AS (SELECT *, seed <> 2 AND gold IS NULL AS asked, {_TOLD} AS u FROM items WHERE status = 'built'), s AS (SELECT *, CASE WHEN asked AND u = 0 THEN NULL WHEN asked AND u = 1 THEN 'I can not tell.' WHEN asked THEN concat('The final answer is ', CAST(CASE WHEN u % 2 = 0 THEN den_clean ELSE den_treat END AS BIGINT), '.') END AS said FROM r)
SELECT model, record_id, asked, said, CASE WHEN asked AND u >= 2 THEN CASE WHEN u % 2 = 0 THEN den_clean ELSE den_treat END WHEN gold IS NOT NULL THEN ans_legacy END AS legacy, ans_treat AS treat, CASE WHEN said IS NULL THEN 0 ELSE 1 END AS n_outputs FROM s""",
    "items",
)
def m07_legacy(spark, sf):
    """The legacy arm asked where its text was made and no answer is there: some calls fail, some replies have no answer; other arms keep theirs."""
    rows = with_conditions(items(spark, sf).where("status = 'built'")).withColumn("outputs", F.expr("cast(map() as map<string, string>)"))
    rows = rows.withColumn("conditions", F.transform_values("conditions", lambda k, v: F.when(k == "legacy", F.concat_ws("|", "model", "record_id", F.col("den_clean").cast("bigint"), F.col("den_treat").cast("bigint"))).otherwise(v)))

    def ask(r):
        # A planted model: it reads both values off the prompt.
        u, part = h("legacy", F.col("model"), F.col("record_id")) % 10, F.split("prompt", r"\|")
        return r.withColumn("said", F.when(u == 0, None).when(u == 1, "I can not tell.").otherwise(F.concat(F.lit("The final answer is "), F.when(u % 2 == 0, part[2]).otherwise(part[3]), F.lit("."))))

    t = answer_pending(rows, ["model", "record_id"], "legacy", ask)
    at = lambda c, arm: F.try_element_at(c, F.lit(arm))
    return t.select("model", "record_id", "asked", at("outputs", "legacy").alias("said"), at("answers", "legacy").alias("legacy"), at("answers", "treat").alias("treat"), F.size("outputs").alias("n_outputs"))


#: Seed 1 is nearly whole, seed 2 of one system is thin, seed 3 was never collected.
SEEDS = [1, 2, 3]
_CALL = [f"{h_sql(repr(f'call{i}'), 's.model', 's.seed', 's.problem_id')} % 4 <> 0" for i in (1, 2, 3)]


@query(
    f"""WITH panel AS (SELECT DISTINCT problem_id FROM items), had AS (SELECT DISTINCT model, seed, problem_id FROM items),
slot AS (SELECT model, seed, problem_id FROM (SELECT DISTINCT model FROM items), (SELECT unnest({SEEDS})::INT AS seed), panel),
met AS (SELECT s.model, s.seed, CASE WHEN h.model IS NOT NULL THEN 0 {" ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(_CALL, 1))} ELSE 9 END AS won FROM slot s LEFT JOIN had h ON h.model = s.model AND h.seed = s.seed AND h.problem_id = s.problem_id),
whole AS (SELECT r::INT AS round, model, seed, count(*) FILTER (WHERE won >= r) AS n_sent, count(*) FILTER (WHERE won <= r) AS n_problems, bool_and(won <= r) AS complete FROM met, range(1, 4) q(r) GROUP BY ALL)
SELECT *, bool_and(complete) OVER (PARTITION BY round, model) AS completed FROM whole WHERE round = 1 OR (SELECT sum(n_sent) FROM whole w WHERE w.round = whole.round) > 0""",
    "items",
)
def m07_seeds(spark, sf):
    """Seeds collected until each has every problem of the panel, in rounds that ask for what is lacking only; a quarter of the calls fails."""
    rows = items(spark, sf).select("model", "seed", "problem_id")
    ask = lambda todo, i: todo.where(h(f"call{i}", F.col("model"), F.col("seed"), F.col("problem_id")) % 4 != 0)
    _, log = replicate(rows, rows, SEEDS, ask)
    return log.withColumn("completed", F.min("complete").over(Window.partitionBy("round", "model")))


def judge(rows, cache: files.Cache, ask, batch: str):
    """``rows`` (prompt) with a verdict: prompts go through the cache, so that the same prompt is judged once, and what the judge says is read
    for the last of FOLLOW and IGNORE it names."""
    said = cache.ask(rows, F.sha2("prompt", 256), lambda r: r.withColumn("said", ask(r)), batch)
    return said.withColumn("verdict", verdict(F.col("said")))


_SAID = f"{h_sql("'said'", 'sha256(prompt)')} % 4"


@query(
    f"""WITH asked AS (SELECT model, outcome, concat('Reasoning:', chr(10), problem_id, chr(10), 'The edited value is ', CAST(den_treat AS BIGINT), ', the answer ', CAST(ans_treat AS BIGINT), '. Does the answer use it?') AS prompt FROM scored WHERE recount AND ans_treat IS NOT NULL),
said AS (SELECT model, outcome, prompt, CASE {_SAID} WHEN 0 THEN NULL WHEN 1 THEN 'IGNORES' ELSE CASE WHEN outcome = 'F' THEN 'FOLLOWS' ELSE 'IGNORES' END END AS verdict FROM asked)
SELECT model, count(*) AS n, count(DISTINCT prompt) AS n_prompts, count(verdict) AS n_scored, count(*) FILTER (WHERE verdict = 'FOLLOWS')::DOUBLE / count(verdict) AS judge_follow, count(*) FILTER (WHERE outcome = 'F')::DOUBLE / count(*) AS phi,
  count(*) FILTER (WHERE verdict IS NOT NULL AND (verdict = 'FOLLOWS') = (outcome = 'F'))::DOUBLE / count(verdict) AS agreement FROM said GROUP BY model""",
    "scored",
)
def m08_judge(spark, sf):
    """A judge asked about every answer: prompts, replies through the cache, verdicts and their agreement with the outcomes. Prompts that agree are judged once."""
    rows = scored(items(spark, sf)).where("recount and ans_treat is not null")
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    prompt = F.concat(F.lit("Reasoning:\n"), "problem_id", F.lit("\nThe edited value is "), whole("den_treat"), F.lit(", the answer "), whole("ans_treat"), F.lit(". Does the answer use it?"))

    def ask(r):
        # A planted judge: it reads both numbers off the prompt, and is at times unclear or contrary.
        number = lambda p: F.regexp_extract("prompt", p, 1)
        own = F.when(number("value is (-?[0-9]+)") == number("answer (-?[0-9]+)"), "It seems to IGNORE the text at first, but it FOLLOWS it.").otherwise("It could follow, yet it ignores it.")
        u = h("said", F.sha2("prompt", 256)) % 4
        return F.when(u == 0, "unclear").when(u == 1, "IGNORES").otherwise(own)

    cache = files.Cache(new_path(spark, "judge"), T.StructType([T.StructField("said", T.StringType())]))
    t = judge(rows.select("model", "outcome", prompt.alias("prompt")), cache, ask, "judge")
    n_of = lambda c: F.count(F.when(c, 1))
    follows, v = F.col("outcome") == "F", F.col("verdict")
    return t.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("prompt").alias("n_prompts"), F.count("verdict").alias("n_scored"), (n_of(v == "FOLLOWS") / F.count("verdict")).alias("judge_follow"), share(follows).alias("phi"), (n_of((v == "FOLLOWS") == follows) / F.count("verdict")).alias("agreement"))
