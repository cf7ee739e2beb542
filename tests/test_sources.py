"""Files in and out, collection, joins, streaming."""

import gzip
import json
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.operators.collect import MockModel, ask_again, collect
from tracegrain.plans import state_queries
from tracegrain.sources import files, sinks
from tracegrain.sources.fixtures import VIEWS, numbered, numbered_by_run, table, view


def test_states(spark, tmp_path):
    record = {"record_id": "p:0:1", "problem_id": "p", "status": "built", "den_clean": 26.0, "den_treat": 29.0, "answers": {"control": 26.0, "treat": None}, "conditions": {"treat": "x"}, "seed": 0}
    for name, model in (("full_a.json", "a"), ("full_a_grammar.json", "a"), ("full_b.json", "b")):
        (tmp_path / name).write_text(json.dumps({"model": model, "records": [record]}, indent=1))
    got = sinks.read_states(spark, str(tmp_path / "full_*.json"))
    assert sorted(r.model for r in got.collect()) == ["a", "b"]
    assert got.first().answers.control == 26.0 and got.first().answers.treat is None
    everything = sinks.read_states(spark, str(tmp_path / "full_*.json"), drop_tagged=False)
    assert [r.files for r in sinks.one_file_each(everything).collect()] == [["full_a.json", "full_a_grammar.json"]]


def test_damaged_states(spark, tmp_path):
    """A file that is cut short, an empty one and one that is no object are told; the others are read."""
    whole = json.dumps({"model": "a", "records": [{"record_id": "r", "answers": {"treat": 1.0}}]}, indent=1)
    for name, body in (("full_a.json", whole), ("full_b.json", whole[:40]), ("full_c.json", "[1, 2]")):
        (tmp_path / name).write_text(body)
    runs = sinks.read_runs(spark, str(tmp_path))
    assert {r.file: (r.damaged, r.model) for r in runs.collect()} == {"full_a.json": (False, "a"), "full_b.json": (True, None), "full_c.json": (True, None)}
    assert [(r.file, r.record_id) for r in sinks.read_states(spark, str(tmp_path)).collect()] == [("full_a.json", "r")]


def test_publish(spark, tmp_path):
    docs = spark.createDataFrame([("a.json", "one\ntwo"), ("b.json", "three")], "file string, text string")
    folder = str(tmp_path / "out")
    assert files.publish(docs, folder) == ["a.json", "b.json"] and (tmp_path / "out" / "a.json").read_text() == "one\ntwo\n"
    assert files.publish(docs.where("file = 'a.json'").withColumn("text", F.lit("new")), folder) == ["a.json"]
    assert files.names(spark, folder) == ["a.json", "b.json"] and (tmp_path / "out" / "a.json").read_text() == "new\n"
    for bad in (docs.withColumn("file", F.lit("same.json")), docs.withColumn("file", F.lit("../x"))):
        with pytest.raises(ValueError):
            files.publish(bad, folder)
    assert files.names(spark, folder) == ["a.json", "b.json"] and files.names(spark, str(tmp_path / "none")) == []


def test_publish_packed(spark, tmp_path):
    """Packed documents replace plain ones of their names and the other way round; a name that two documents share is told, from one task or from two."""
    docs = spark.createDataFrame([("a.json", '{"model": "a",\n "records": []}'), ("b.json", '{"model": ')], "file string, text string")
    folder = str(tmp_path / "out")
    assert files.publish(docs, folder) == files.publish(docs, folder, packed=True) == ["a.json", "b.json"]
    assert files.names(spark, folder) == ["a.json.gz", "b.json.gz"] and gzip.open(tmp_path / "out" / "a.json.gz", "rt").read() == '{"model": "a",\n "records": []}\n'
    assert {(r.file, r.damaged, r.model) for r in sinks.read_runs(spark, folder).collect()} == {("a.json", False, "a"), ("b.json", True, None)}
    files.publish(docs.where("file = 'a.json'"), folder)
    assert files.names(spark, folder) == ["a.json", "b.json.gz"] and sinks.read_runs(spark, folder).count() == 2
    for bad in (docs.coalesce(1).withColumn("file", F.lit("c.json")), docs.repartition(2, "file").withColumn("file", F.lit("c.json")), docs.withColumn("file", F.concat("file", F.lit(".gz")))):
        with pytest.raises(ValueError):
            files.publish(bad, folder)
    assert files.names(spark, folder) == ["a.json", "b.json.gz"]


def test_state_files_are_small(spark, monkeypatch):
    """Line items are shuffled once, for their numbers, and what is made of them not again; documents lie on disk in a few hundredths of their size."""
    plans, publish = [], files.publish
    monkeypatch.setattr(files, "publish", lambda docs, *a, **b: plans.append(docs._jdf.queryExecution().executedPlan().toString()) or publish(docs, *a, **b))
    folder = state_queries.state_files(spark, SF)
    assert plans[0].index("ObjectHashAggregate") < plans[0].index("Window") < plans[0].index("Exchange")
    size, there = spark.read.text(folder, wholetext=True).agg(F.sum(F.octet_length("value"))).first()[0], Path(folder.removeprefix("file://"))
    assert sum(x.stat().st_size for x in there.glob("full_*")) < size / 8 and len(list(there.glob("full_*"))) > 10


def test_runs_lie_together(spark):
    """Line items numbered with their runs have the numbers that they have without, whatever keys are missing; a run is that of the third piece of the record's id, and lies in one partition."""
    key = lambda c, n: F.when(F.xxhash64(F.lit(c), "l_orderkey", "l_linenumber") % n != 0, F.col(c)).alias(c)
    rows = table(spark, SF, "lineitem").withColumn("l_orderkey", F.col("l_orderkey") * 40)
    rows = rows.select(*(key(c, n) for c, n in (("l_orderkey", 3), ("l_partkey", 3), ("l_suppkey", 50), ("l_linenumber", 50), ("l_quantity", 50))))
    rows = rows.unionByName(rows.limit(500)).localCheckpoint()
    third = lambda x: F.concat_ws("_", "m", "seed", x)
    got = numbered_by_run(rows, third).withColumn("place", F.spark_partition_id()).cache()
    five = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    want = numbered(rows)
    assert sorted(map(repr, got.select(*five, "rn").collect())) == sorted(map(repr, want.select(*five, "rn").collect()))
    assert got.groupBy("run").agg(F.countDistinct("place").alias("n")).where("n > 1").count() == 0 and got.select("run").distinct().count() > 100
    odd = got.where("l_partkey is null or l_orderkey is null")
    assert 0 < odd.count() == odd.where("substring_index(run, '_', -1) = cast(rn as string)").count() and odd.where("rn > 5").count()
    assert got.where("l_partkey is not null and l_orderkey is not null and substring_index(run, '_', -1) <> cast(floor(l_orderkey / 900) as string)").count() == 0


def test_log(spark, tmp_path):
    """Batches appended again replace themselves; lines that can't be read, and blank ones, don't hide the others."""
    folder, schema = str(tmp_path / "log"), T.StructType.fromDDL("k string, v double")
    assert files.read_log(spark, folder, schema).count() == 0
    for batch, rows in (("1", [("a", 1.0)]), ("2", [("b", float("inf"))]), ("1", [("c", 3.0)])):
        files.append(spark.createDataFrame(rows, "k string, v double"), folder, batch)
    (tmp_path / "log" / "batch=3").mkdir()
    (tmp_path / "log" / "batch=3" / "x.json").write_text('{"k": "d", "v": 4}\n\n{"k": "e", "v\n')
    got = {(r.batch, r.k, r.v, bool(r[files.CORRUPT])) for r in files.read_log(spark, folder, schema).collect()}
    assert got == {("1", "c", 3.0, False), ("2", "b", None, False), ("3", "d", 4.0, False), ("3", None, None, True)}
    with pytest.raises(ValueError):
        files.append(spark.range(1), folder, "a/b")


def test_cache(spark, tmp_path):
    """One row a key over all runs; a second run sends nothing, one with more sends the rest, and a key that had no answer is asked again."""
    cache, sent = files.Cache(str(tmp_path / "cache"), T.StructType.fromDDL("reply string")), []

    def send(rows):
        some = rows.collect()
        sent.append(sorted(r.q for r in some))
        return spark.createDataFrame([(r.key, None if r.q == "no" else r.q.upper()) for r in some], "key string, reply string").where("reply is not null")

    ask = lambda qs, run: sorted((r.q, r.reply, r.sent) for r in cache.ask(spark.createDataFrame([(q, i) for i, q in enumerate(qs)], "q string, i int"), F.sha2("q", 256), send, run).collect())
    assert ask(["a", "b", "a", "a"], "x") == [("a", "A", True)] * 3 + [("b", "B", True)]
    assert ask(["a", "b"], "x") == [("a", "A", False), ("b", "B", False)]
    assert ask(["a", "c", "no"], "x") == [("a", "A", False), ("c", "C", True), ("no", None, None)]
    assert ask(["no", "c"], "y") == [("c", "C", False), ("no", None, None)]
    assert sent == [["a", "b"], [], ["c", "no"], ["no"]] and cache.read(spark).count() == 3
    # Two runs side by side have asked the same: all readers see the same one.
    for batch, reply in (("p", "first"), ("q", "second")):
        files._batch(spark.createDataFrame([("k", reply)], "key string, reply string"), cache.folder, batch, lambda r, path: r.write.parquet(path))
    assert [r.reply for r in cache.read(spark).where("key = 'k'").collect()] == ["first"] and cache.read(spark).count() == 4


def test_ask_again(spark):
    """Each round asks what is still open; none is begun when nothing is."""
    asked = []

    def ask(left, seed):
        asked.append((seed, left.count()))
        return left.withColumn("new", F.when(F.col("id") % (seed + 1) == 0, F.lit(float(seed))))

    rows = spark.range(12).select("id", F.when(F.col("id") < 2, -1.0).alias("a"))
    got = {r.id: (r.a, r.tries) for r in ask_again(rows, ["id"], "a", ask).collect()}
    assert asked == [(1, 10), (2, 5), (3, 3)]
    assert got == {i: (-1.0, 0) if i < 2 else (1.0, 1) if i % 2 == 0 else (2.0, 2) if i % 3 == 0 else (None, None) for i in range(12)}
    asked.clear()
    assert ask_again(rows.where("id in (0, 2, 3)"), ["id"], "a", ask, 5).where("tries is null").count() == 0 and [s for s, _ in asked] == [1, 2]
    asked.clear()
    assert ask_again(rows.where("id < 2"), ["id"], "a", ask).columns == ["id", "a", "tries"] and not asked


def test_sheet(spark, tmp_path):
    rows = [("r1", 'a "quoted" line\nand another', "yes"), ("r2", "x, y", None)]
    sinks.write_sheet(spark.createDataFrame(rows, "id string, trace string, agree string"), str(tmp_path / "s"))
    got = sinks.read_sheet(spark, str(tmp_path / "s"))
    assert sorted((r.id, r.trace) for r in got.collect()) == [r[:2] for r in rows]


def test_json(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([("a", float("nan")), ("b", 1.0), ("c", float("inf"))], "k string, v double"), str(tmp_path / "j"))
    assert {r.k: r.v for r in spark.read.json(str(tmp_path / "j")).collect() if r.k == "b"} == {"b": 1.0}
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_collection_resumes(spark):
    items = view(spark, SF, "items").where("status = 'built'").limit(50).cache()
    model = MockModel(follow={"treat": 100.0})
    first = collect(items, model)
    assert first.where("arm = 'treat' and answer <> den_treat").count() == 0
    assert collect(items, model, first.select("model", "record_id", "arm")).count() == 0


def test_stream(spark, tmp_path):
    from tracegrain.streaming.running import record_stream, running_counts

    items = view(spark, SF, "items").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    for i in range(2):
        items.write.mode("append").parquet(str(tmp_path / "in"))  # every record comes twice
    records = record_stream(spark, str(tmp_path / "in"), items.schema).withWatermark("at", "1 hour")
    q = running_counts(records).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got = {r.model: r.n for r in spark.table("running").collect()}
    from tracegrain.operators.gates import scored

    assert got == {r.model: r.n for r in scored(items).where("gated").groupBy("model").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_by_text(spark, monkeypatch, sent):
    """Each different text is worked out once; texts without a result keep or lose their rows, as the join says, and so do missing texts."""
    from tracegrain.sources import scratch
    from tracegrain.sources.scratch import by_text

    monkeypatch.setattr(scratch, "SENT", sent)
    rows = spark.createDataFrame([(i, (None, "a", "bb", "ccc")[i % 4]) for i in range(400)], "id int, text string").repartition(7)
    seen = []

    def made(texts):
        seen.append(texts.count())
        return texts.where("text <> 'a'").select("text", F.length("text").alias("n"))

    assert sorted(by_text(rows, made, "text").groupBy("text", "n").count().collect()) == [("bb", 2, 100), ("ccc", 3, 100)]
    kept = {(r["text"], r["n"]): r["count"] for r in by_text(rows, made, "text", how="left").groupBy("text", "n").count().collect()}
    assert kept == {(None, None): 100, ("a", None): 100, ("bb", 2): 100, ("ccc", 3): 100} and seen == [4, 4]


def test_attempts_are_numbered_on_narrow_rows(spark, tmp_path):
    """Missing and negative keys, ties and repeated rows get the numbers of the SQL; no more than seven columns are sorted for them."""
    keys = [(o, p, s, k, q) for o in (None, -901, -1, 0, 5, 900) for p in (None, -5, 5, 205, 350) for s in (None, -3, 3, 9) for k in (None, 1, 2, 5) for q in (None, 3.0, 3.7, 50.0)]
    odd = spark.createDataFrame(keys + keys[::3], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    odd.write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("traces", "items", "attempts"):
        got, want = view(spark, str(tmp_path), name), spark.sql(VIEWS[name], lineitem=odd)
        assert got.schema.simpleString() == want.schema.simpleString()
        count = lambda t: t.groupBy(*t.columns).count()
        assert count(got).exceptAll(count(want)).isEmpty() and count(want).exceptAll(count(got)).isEmpty()
    node = view(spark, str(tmp_path), "traces")._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().apply(0)
    assert node.children().apply(0).output().size() <= 7
