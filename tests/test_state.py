"""Bucketed tables, state that expires, and the queue."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators import state
from gleaner.operators.buckets import BucketTable, pull
from gleaner.streaming import jobs, queue

SCHEMA = "k long, v string"


def last_wins(old, new):
    return state.last_wins(old, new, ["k"])


def changes(spark, rows):
    return spark.createDataFrame([(k, v, at) for at, (k, v) in enumerate(rows)], "k long, v string, arrival long")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(table, version=None):
    return {r["k"]: r["v"] for r in table.read(version).collect()}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=8)
    assert t.read().count() == 0 and t.version() == 0 and t.mark() is None
    assert t.merge(changes(spark, [(k, "a") for k in range(100)]), last_wins)
    before = t.manifest()["folders"]
    assert t.merge(changes(spark, [(5, "b"), (5, "c"), (None, "n")]), last_wins)
    after = t.manifest()["folders"]
    assert len({b for b in after if after[b] != before.get(b)}) <= 2 and len(before) == 8
    assert rows_of(t) == {k: "a" for k in range(100)} | {5: "c", None: "n"} and rows_of(t, 1)[5] == "a"
    for n in range(3):
        t.merge(changes(spark, [(5, str(n))]), last_wins)
    assert [v for v in (1, 2, 3, 4, 5) if os.path.exists(f"{tmp_path}/t/manifest/{v}.json")] == [4, 5]
    named = {f for v in (4, 5) for f in t.manifest(v)["folders"].values()}
    assert {os.path.relpath(os.path.dirname(f), f"{tmp_path}/t") for f in files(f"{tmp_path}/t")} == named


def test_batches_count_once_and_lost_writes_not_at_all(spark, tmp_path, monkeypatch):
    t = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    assert t.merge(changes(spark, [(1, "a")]), last_wins, batch=0, stream="s") and not t.merge(changes(spark, [(1, "x")]), last_wins, batch=0, stream="s")
    assert t.merge(changes(spark, [(1, "b")]), last_wins, batch=0, stream="other") and rows_of(t) == {1: "b"}

    def crash(manifest):
        raise OSError("lost")

    monkeypatch.setattr(t, "_commit", crash)
    with pytest.raises(OSError):
        t.merge(changes(spark, [(1, "c")]), last_wins, batch=1, stream="s")
    again = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    assert rows_of(again) == {1: "b"} and again.merge(changes(spark, [(1, "c")]), last_wins, batch=1, stream="s") and rows_of(again) == {1: "c"}
    stale = again.manifest()
    with pytest.raises(RuntimeError):
        again._commit(stale)  # another writer was first


def test_buckets_that_become_empty(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", "k long, seen long", ["k"], buckets=4)
    t.merge(spark.createDataFrame([(k, k) for k in range(40)], "k long, seen long"), lambda old, new: old.union(new))
    rewritten = t.prune(F.col("seen") != 7)
    assert rewritten == 1 and t.read().count() == 39 and t.prune(F.col("seen") != 7) == 0
    t.merge(spark.createDataFrame([(k, 0) for k in range(40)], "k long, seen long"), lambda old, new: old.where("false"))
    assert t.read().count() == 0 and t.manifest()["folders"] == {}
    assert t.replace(spark.createDataFrame([(1, 1)], "k long, seen long")) == 4 and t.read().count() == 1


def test_pull_resumes_at_the_mark(spark, tmp_path):
    votes = [(k, "v", 100 + k // 2) for k in range(10)]
    asked = []

    def fetch(since, upto):
        asked.append(since)
        return spark.createDataFrame([(k, v, at, at) for k, v, at in votes if since <= at <= upto], "k long, v string, at long, arrival long")

    schema = "k long, v string, at long"
    rule = lambda old, new: state.last_wins(old, new, ["k"])
    t = BucketTable(spark, f"file://{tmp_path}/t", schema, ["k"], buckets=2)
    assert pull(t, lambda s: fetch(s, 102), rule) == 6
    later = BucketTable(spark, f"file://{tmp_path}/t", schema, ["k"], buckets=2)  # a new process
    assert pull(later, lambda s: fetch(s, 200), rule) == 6 and asked == [0, 102] and later.read().count() == 10
    assert pull(later, lambda s: fetch(999, 0), rule) == 0 and later.version() == 2


def write(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long")
    df = df.select("event_id", F.timestamp_seconds(F.col("t") + 1_704_067_200).alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_state_goes_when_it_can_no_longer_matter(spark, tmp_path):
    day = 86_400
    shown = []
    for k, rows in enumerate([[(0, 0, 1), (1, 5, 2), (2, day, 1)], [(3, 20 * day, 3), (4, 31 * day, 1)], [(5, 45 * day, 2), (6, 46 * day, 9)], [(7, 80 * day, 10)]]):
        write(spark, f"{tmp_path}/events", rows)
        stream = jobs.repeat_after(jobs.read_events(spark, f"{tmp_path}/events"), 30)
        shown = jobs.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/check").collect()
        kept = spark.read.format("statestore").load(f"{tmp_path}/check").count()
        assert kept == (2, 3, 4, 1)[k]  # users 1, 2; with 3; with 9; only 10, all others are past their days
    assert sorted(r["event_id"] for r in shown) == [0, 1, 3, 4, 5, 6, 7]


def test_one_call_takes_many_keys(spark, tmp_path, monkeypatch):
    """Users and items are dealt to parts; a call of the function and a row of state are a part's, not a key's."""
    monkeypatch.setattr(jobs, "PARTS", 2)
    write(spark, f"{tmp_path}/events", [(i, i // 2, i % 50) for i in range(200)])
    stream = jobs.repeat_after(jobs.read_events(spark, f"{tmp_path}/events"), 30)
    shown = jobs.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/check").collect()
    assert sorted((r["event_id"], r["user_id"]) for r in shown) == [(i, i) for i in range(50)]
    assert spark.read.format("statestore").load(f"{tmp_path}/check").count() == 2


def plain_queue(operations, lease, pause, most):
    log, tasks, end = [], {}, 1 << 60

    def give_back(at):
        for t in sorted([t for t, x in tasks.items() if x["worker"] is not None and x["lease"] <= at], key=lambda t: (tasks[t]["lease"], t)):
            x = tasks[t]
            log.append((x["lease"], t, "returned", x["worker"], x["attempts"]))
            x.update(after=x["lease"], worker=None)

    for at, _, op, task, worker, ok in sorted(operations, key=lambda o: o[:2]):
        give_back(at)
        if op == "add":
            tasks.setdefault(task, {"after": at, "attempts": 0, "worker": None})
        elif op == "claim":
            due = [t for t, x in tasks.items() if x["worker"] is None and x["after"] <= at]
            if due:
                tasks[min(due)].update(worker=worker, lease=at + lease)
                log.append((at, min(due), "claimed", worker, tasks[min(due)]["attempts"]))
        else:
            for t in [t for t, x in tasks.items() if x["worker"] == worker]:
                x = tasks[t]
                x["attempts"] += not ok
                kind = "done" if ok else "failed" if x["attempts"] >= most else "again"
                log.append((at, t, kind, worker, x["attempts"]))
                if kind == "again":
                    x.update(after=at + pause * x["attempts"], worker=None)
                else:
                    del tasks[t]
    give_back(end)
    return log


def test_queue_equals_one_worker_list(spark, tmp_path):
    rng = random.Random(6)
    second, rows, want = 1_000_000, [], {}
    for q in range(2):
        ops = []
        for k in range(90):
            at = 1_700_000_000 * second + rng.randrange(3_000) * second
            ops.append((at, 10 * k, "add", k, None, None))
        for w in range(150):
            at = 1_700_000_000 * second + rng.randrange(4_000) * second
            ops.append((at, 10 * w + 1, "claim", None, w, None))
            if rng.random() < 0.7:  # the others crash
                ops.append((at + rng.randrange(1, 200) * second, 10 * w + 2, "finish", None, w, rng.random() < 0.5))
        want[q] = plain_queue(ops, 100 * second, 30 * second, 2)
        rows += [(q, *o) for o in ops]
    rows.sort(key=lambda r: r[1])
    kinds = {kind for log in want.values() for _, _, kind, *_ in log}
    assert kinds == {"claimed", "returned", "done", "again", "failed"}
    last = [(7, rows[-1][1] + 10_000 * second, 0, "add", 0, None, None)]
    half = len(rows) // 2
    for part in (rows[:half], rows[half:] + last):
        df = spark.createDataFrame(part, queue.OPERATIONS).withColumn("ts", F.timestamp_micros("at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
        stream = spark.readStream.schema(queue.OPERATIONS + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ops")
        log = jobs.run_stateful(queue.run_queue(stream, 100 * second, 30 * second, 2), f"{tmp_path}/log", f"{tmp_path}/check")
    got = {}
    for r in log.collect():
        got.setdefault(r["queue"], []).append(tuple(r)[1:])
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}


def test_waiting_operations_are_packed():
    """A waiting operation takes 33 bytes in the state and when it is read, whatever is null in it."""
    batch = pd.DataFrame({"at": [5, 6, 7], "seq": [1, 2, 3], "op": ["add", "claim", "finish"], "task": [9, None, None], "worker": [None, 4, 4], "ok": [None, None, True]})
    packed = queue._packed(queue._pack(batch))
    assert [len(p) for (p,) in packed] == [3 * 33]
    none = queue._NONE
    assert np.frombuffer(packed[0][0], queue._OPERATION).tolist() == [(5, 1, 9, none, 0), (6, 2, none, 4, 1), (7, 3, none, 4, 3)]
