"""Queries of state that lasts: bucketed tables that take batches, the queue, and streams that remember keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import state
from .operators.buckets import BucketTable, pull
from .queries import Query, _read, _stream
from .streaming import jobs, queue
from .tables import Scratch

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


@query(
    """SELECT user_id, event_type, arg_max(value, event_id % 4 * 1000000000000 + event_id) AS value, arg_min(event_id, event_id % 4 * 1000000000000 + event_id) AS first_id
    FROM events GROUP BY ALL"""
)
def votes_in_four_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, ST-08: four batches into a bucketed table, last wins but for the first id; each batch comes a second time, as after
    a crash, and changes nothing."""
    scratch = Scratch(spark, "votes")
    table = BucketTable(spark, scratch.folder("table"), "user_id long, event_type string, value double, first_id long", ["user_id", "event_type"], 8)
    votes = _read(spark, sf_dir, "events").select("user_id", "event_type", "value", c("event_id").alias("first_id"), c("event_id").alias("arrival"))
    for k in (0, 1, 1, 2, 0, 3, 3):
        table.merge(votes.where(c("arrival") % 4 == k), lambda old, new: state.last_wins(old, new, table.keys, ["first_id"]), batch=k)
    return table.read()


@query("SELECT user_id, event_type, arg_max(value, (epoch_us(ts), event_id)) AS value, max(epoch_us(ts)) AS at FROM events GROUP BY ALL")
def votes_pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-26: votes of a source that has had a third, two thirds and all of them, pulled from the mark of the last pull on."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.unix_micros(c("ts").cast("timestamp")).alias("at"), "event_id")
    path, schema = Scratch(spark, "pulls").folder("table"), "user_id long, event_type string, value double, at long"
    ends = e.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    for k in (1, 2, 3):
        upto = (ends["a"] or 0) + ((ends["b"] or 0) - (ends["a"] or 0)) * k // 3
        table = BucketTable(spark, path, schema, ["user_id", "event_type"], 8)  # a new process each time
        there = e.where(c("at") <= upto)
        ordered = lambda since: there.where(c("at") >= since).withColumn("arrival", F.struct("at", "event_id")).drop("event_id")  # noqa: B023, E731
        pull(table, ordered, lambda old, new: _latest(old, new))
    return table.read()


def _latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last wins by the votes' own order; what was there stands where nothing newer came."""
    both = old.withColumn("arrival", F.struct("at", F.lit(-1).cast("long").alias("event_id"))).unionByName(new)
    return both.groupBy("user_id", "event_type").agg(F.max_by("value", "arrival").alias("value"), F.max("at").alias("at")).select(old.columns)


@query(
    """WITH s AS (SELECT user_id, event_type, max(epoch_us(ts)) AS seen, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, seen FROM s WHERE seen >= (SELECT max(seen) FROM s) - 3 * 86400000000"""
)
def id_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-05: keys are remembered for three days after they were last seen; only buckets with forgotten keys are rewritten."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(c("ts").cast("timestamp")).alias("seen"), "event_id")
    table = BucketTable(spark, Scratch(spark, "memory").folder("table"), "user_id long, event_type string, seen long", ["user_id", "event_type"], 8)
    newest = lambda old, new: old.unionByName(new.drop("event_id")).groupBy("user_id", "event_type").agg(F.max("seen").alias("seen"))
    for k in range(2):
        table.merge(e.where(c("event_id") % 2 == k), newest)
    now = table.read().agg(F.max("seen")).first()[0] or 0
    table.prune(c("seen") >= now - 3 * 86_400_000_000)
    return table.read()


@query("SELECT DISTINCT user_id, event_type FROM events")
def once_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-04: each key once, as a stream."""
    scratch = Scratch(spark, "stream")
    stream = jobs.once_ever(_stream(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])
    return jobs.run_to_files(stream, scratch.folder("keys"), scratch.folder("checkpoint"))


_HOUR = 3_600_000_000


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id % 8 AS queue, epoch_us(ts) AS m, event_id AS i, event_type IN ('view', 'click') AS adds FROM events),
    o AS (SELECT queue, m, i * 2 AS seq, CASE WHEN adds THEN 'add' ELSE 'claim' END AS op, CASE WHEN adds THEN i END AS task, CASE WHEN NOT adds THEN i END AS w, NULL::BOOLEAN AS ok FROM e
          UNION ALL SELECT queue, m + i % 5 * {_HOUR // 2}, i * 2 + 1, 'finish', NULL, i, i % 3 <> 0 FROM e WHERE NOT adds AND i % 4 <> 0
          UNION ALL SELECT DISTINCT queue, (SELECT max(m) FROM e) + {100 * _HOUR}, 0, 'end', NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY m, seq) AS n FROM o),
    r AS (
        SELECT DISTINCT queue, 0::BIGINT AS n, []::STRUCT(task BIGINT, run_after BIGINT, attempts BIGINT, worker BIGINT, lease BIGINT)[] AS tasks,
               []::STRUCT(m BIGINT, task BIGINT, kind VARCHAR, worker BIGINT, attempts BIGINT)[] AS log FROM n
        UNION ALL
        SELECT queue, n,
               CASE WHEN op = 'add' THEN list_append(t, {{task: task, run_after: m, attempts: 0::BIGINT, worker: NULL::BIGINT, lease: NULL::BIGINT}})
                    WHEN op = 'claim' THEN list_transform(t, lambda x: CASE WHEN x.task = pick THEN {{task: x.task, run_after: x.run_after, attempts: x.attempts, worker: w, lease: m + {2 * _HOUR}}} ELSE x END)
                    WHEN op = 'finish' AND (ok OR held.attempts + 1 >= 3) THEN list_filter(t, lambda x: x.worker IS DISTINCT FROM w)
                    WHEN op = 'finish' THEN list_transform(t, lambda x: CASE WHEN x.worker = w
                         THEN {{task: x.task, run_after: m + {_HOUR} * (x.attempts + 1), attempts: x.attempts + 1, worker: NULL::BIGINT, lease: NULL::BIGINT}} ELSE x END)
                    ELSE t END,
               list_concat(list_transform(back, lambda x: {{m: x.lease, task: x.task, kind: 'returned', worker: x.worker, attempts: x.attempts}}),
                    CASE WHEN op = 'claim' AND pick IS NOT NULL THEN [{{m: m, task: pick, kind: 'claimed', worker: w, attempts: list_filter(t, lambda x: x.task = pick)[1].attempts}}]
                         WHEN op = 'finish' AND held IS NOT NULL THEN [{{m: m, task: held.task, kind: CASE WHEN ok THEN 'done' WHEN held.attempts + 1 >= 3 THEN 'failed' ELSE 'again' END,
                                                                        worker: w, attempts: held.attempts + (NOT ok)::BIGINT}}]
                         ELSE [] END)
        FROM (SELECT *, list_min(list_transform(list_filter(t, lambda x: x.worker IS NULL AND x.run_after <= m), lambda x: x.task)) AS pick, list_filter(t, lambda x: x.worker = w)[1] AS held
              FROM (SELECT n.*, list_filter(r.tasks, lambda x: x.lease <= n.m) AS back,
                           list_transform(r.tasks, lambda x: CASE WHEN x.lease <= n.m
                                THEN {{task: x.task, run_after: x.lease, attempts: x.attempts, worker: NULL::BIGINT, lease: NULL::BIGINT}} ELSE x END) AS t
                    FROM r JOIN n ON n.queue = r.queue AND n.n = r.n + 1)))
    SELECT queue, l.m AS "at", l.task AS task, l.kind AS kind, l.worker AS worker, l.attempts::INT AS attempts FROM (SELECT queue, unnest(log) AS l FROM r)"""
)
def task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-06: views and clicks are tasks in eight queues, other events are workers that claim one for two hours. A quarter of them
    crash, others finish too late or fail; a task is tried three times, an hour later each time."""
    scratch = Scratch(spark, "queue")
    i, adds = c("event_id"), c("event_type").isin("view", "click")
    e = _read(spark, sf_dir, "events").select((c("user_id") % 8).alias("queue"), F.unix_micros(c("ts").cast("timestamp")).alias("at"), "event_id", adds.alias("adds"))
    first = e.select("queue", "at", (i * 2).alias("seq"), F.when(c("adds"), "add").otherwise("claim").alias("op"), F.when(c("adds"), i).alias("task"), F.when(~c("adds"), i).alias("worker"), F.lit(None).cast("boolean").alias("ok"))
    then = e.where(~c("adds") & (i % 4 != 0)).select("queue", c("at") + i % 5 * (_HOUR // 2), i * 2 + 1, F.lit("finish"), F.lit(None).cast("long"), i, i % 3 != 0)
    end = e.groupBy().agg(F.max("at").alias("at")).where("at is not null").selectExpr("-1L as queue", f"at + {100 * _HOUR} as at", "0L as seq", "'add' as op", "0L as task", "null as worker", "null as ok")
    operations = scratch.table(first.union(then).union(end).withColumn("ts", F.timestamp_micros("at")), "operations")
    stream = spark.readStream.schema(operations.schema).parquet(operations.inputFiles()[0].rsplit("/", 1)[0])
    return jobs.run_stateful(queue.run_queue(stream, 2 * _HOUR, _HOUR, 3), scratch.folder("log"), scratch.folder("checkpoint"))
