"""Ordered folds over streams: any order of batches, restarts, late events, state that ends."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from framequarry.operators import jobs
from framequarry.streaming import ordered, vendors

CALLS = "vendor string, seq long, ts timestamp, at double, limited boolean, retry_after double"
BASE = 1_700_000_000


def files(spark, rows, schema: str, folder, name: str) -> None:
    """One more file of a stream's folder."""
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis((F.col("at_ms")).cast("long"))).drop("at_ms").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, stream, folder) -> None:
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()


def test_any_order_of_batches_and_a_restart_give_the_ordered_fold(spark, tmp_path):
    rng = random.Random(4)
    calls = [(v, k, (BASE + k) * 1000, float(k), rng.random() < 0.15, rng.choice([None, 2.0, 300.0])) for v in ("a", "b", None) for k in range(60)]
    schema = "vendor string, seq long, at_ms long, at double, limited boolean, retry_after double"
    shuffled = rng.sample(calls, len(calls))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("vendor string, seq long, at double, limited boolean, retry_after double, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    made = vendors.paused(stream, "10 days")
    for part in range(3):  # a run for each file: the state is taken up where it was
        files(spark, shuffled[part::3], schema, f"file://{tmp_path}/in", f"f{part}")
        run(spark, made, f"file://{tmp_path}")
    assert spark.read.schema(made.schema).parquet(f"file://{tmp_path}/out").count() == 0  # all may still be preceded
    files(spark, [("z", -1, (BASE + 30 * 86_400) * 1000, 0.0, False, None)], schema, f"file://{tmp_path}/in", "later")
    run(spark, made, f"file://{tmp_path}")
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    table = spark.createDataFrame([(v, k, at, limited, wait) for v, k, _, at, limited, wait in calls if v], "vendor string, seq long, at double, limited boolean, retry_after double")
    assert got == sorted(tuple(r) for r in jobs.governed_calls(table).select("vendor", "seq", "allowed", "resume_at", "events").collect())


def test_a_job_stops_at_its_ceiling_or_when_asked(spark, tmp_path):
    uploads = [("a", k, (BASE + k) * 1000, 0.5) for k in range(8)] + [("b", k, (BASE + k) * 1000, 0.1) for k in range(6)] + [("c", k, (BASE + k) * 1000, None) for k in range(3)]
    control = [("b", (BASE + 3) * 1000), ("b", (BASE + 5) * 1000), ("nobody", BASE * 1000)]
    later = (BASE + 3 * 86_400) * 1000
    files(spark, uploads[::2], "job string, seq long, at_ms long, cost double", f"file://{tmp_path}/up", "one")
    files(spark, control, "job string, at_ms long", f"file://{tmp_path}/ask", "one")
    of = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/{name}")
    made = vendors.running(of("up", "job string, seq long, cost double, ts timestamp"), of("ask", "job string, ts timestamp"), 2.0, 0.25, "1 day")
    run(spark, made, f"file://{tmp_path}")
    files(spark, uploads[1::2], "job string, seq long, at_ms long, cost double", f"file://{tmp_path}/up", "two")
    run(spark, made, f"file://{tmp_path}")
    files(spark, [("z", 0, later, 0.0)], "job string, seq long, at_ms long, cost double", f"file://{tmp_path}/up", "three")
    files(spark, [("z", later)], "job string, at_ms long", f"file://{tmp_path}/ask", "three")
    run(spark, made, f"file://{tmp_path}")
    got = {(r.job, r.seq): (r.action, r.reason) for r in spark.read.parquet(f"file://{tmp_path}/out").where("job <> 'z'").collect()}
    assert got == {
        **{("a", k): ("run", None) if k < 4 else ("skip", "budget") for k in range(8)}, **{("b", k): ("run", None) if k < 3 else ("skip", "cancelled") for k in range(6)}, **{("c", k): ("run", None) for k in range(3)},
    }


def test_state_ends_when_a_key_is_idle(spark, tmp_path):
    """Counts events; a key that was silent for longer than its hour starts again."""
    (tmp_path / "in").mkdir()
    of = "key string, seq long, at_ms long"
    stream = spark.readStream.schema("key string, seq long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    made = ordered.folded(stream, "key", "seq", {"seq": "long"}, (0,), "n long", lambda state, seq: ((state[0] + 1,), (state[0] + 1,)), "n long", "1 second", 3600.0)
    for k, rows in enumerate(([("k", 1, 0), ("k", 2, 10)], [("other", 1, 60)], [("k", 3, 600)], [("other", 2, 9_000)], [("other", 3, 9_600)], [("k", 4, 10_000)], [("other", 4, 20_000)])):
        files(spark, [(key, seq, (BASE + s) * 1000) for key, seq, s in rows], of, f"file://{tmp_path}/in", f"f{k}")
        run(spark, made, f"file://{tmp_path}")
    got = {(r.key, r.seq): r.n for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert {k: n for k, n in got.items() if k[0] == "k"} == {("k", 1): 1, ("k", 2): 2, ("k", 3): 3, ("k", 4): 1}
