"""Rules of keyed state: ``new = f(old, changes)``, for ``buckets.BucketTable`` and for whole tables.

Spark's file tables have no merge, so each rule below maps the old rows and the changes to the new rows in one shuffle on the
key. Changes carry an ``arrival`` column, ascending within a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(old: DataFrame, changes: DataFrame) -> DataFrame:
    before = old.withColumn("_new", F.lit(0)).withColumn("arrival", F.lit(-1).cast("long"))
    return before.unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)


def last_wins(old: DataFrame, changes: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """DML-01: the latest change overwrites, but for columns that keep the first value."""
    rest = [c for c in old.columns if c not in keys and c not in keep_first]
    at = F.struct("_new", "arrival")
    firsts = [F.min_by(c, at).alias(c) for c in keep_first]
    latest = F.max_by(F.struct(*rest), at).alias("_v") if rest else F.lit(0).alias("_v")
    out = _both(old, changes).groupBy(*keys).agg(*firsts, latest)
    return out.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in old.columns])


def guarded(old: DataFrame, changes: DataFrame, keys: Sequence[str], origin: str = "origin", strong: str = "you", keep_first: Sequence[str] = ()) -> DataFrame:
    """DML-02: last wins, but a row of the strong origin is only overwritten by its own kind."""
    rest = [c for c in old.columns if c not in keys and c not in keep_first]
    at = F.struct("_new", "arrival")
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(origin) == strong, F.lit(False)), "_new", "arrival")).alias("_v")
    out = _both(old, changes).groupBy(*keys).agg(*[F.min_by(c, at).alias(c) for c in keep_first], best)
    return out.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in old.columns])


def fill_if_empty(old: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """DML-03: known rows only take values for their empty columns, from the first change that has one."""
    rest = [c for c in old.columns if c not in keys and c not in columns]
    at = F.struct("_new", "arrival")
    fill = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c) for c in columns]
    out = _both(old, changes).groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_v"), *fill)
    return out.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in old.columns])


def preserve_first(old: DataFrame, changes: DataFrame, keys: Sequence[str], first: Sequence[str], sticky: Sequence[str] = ()) -> DataFrame:
    """DML-04: ``first`` keeps its earliest value, ``sticky`` its latest that isn't null, all else the latest."""
    rest = [c for c in old.columns if c not in (*keys, *first, *sticky)]
    at = F.struct("_new", "arrival")
    out = (
        _both(old, changes)
        .groupBy(*keys)
        .agg(
            *[F.min_by(c, at).alias(c) for c in first],
            *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in sticky],
            F.max_by(F.struct(*rest), at).alias("_v"),
        )
    )
    return out.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DML-06: rows with new keys, the first of each."""
    fresh = changes.join(old.select(*keys), list(keys), "left_anti")
    rest = [c for c in old.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), "arrival").alias("_v"))
    return old.unionByName(first.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest]))


def replace_rows(old: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DML-07: rows with a key of the fresh ones go, the fresh ones come."""
    return old.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def prune(rows: DataFrame, seen: Column, now: Column, keep: Column) -> DataFrame:
    """DML-08: rows that were last seen too long ago go; a row without a time stays."""
    return rows.where(F.coalesce(seen >= now - keep, F.lit(True)))


def cascade(children: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """DML-09: children of deleted parents go."""
    gone = deleted.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(gone, child_key, "left_anti")


def set_once(first: Column, last: Column, now: Column) -> tuple[Column, Column]:
    """DML-11."""
    return F.coalesce(first, now), now


def step_tasks(tasks: DataFrame, outcomes: DataFrame, now: Column, max_attempts: int = 5, base: int = 60) -> DataFrame:
    """DML-10: running tasks become done, pending again with a doubled pause, or failed; ``outcomes``: task_id, ok."""
    t = tasks.join(outcomes.select("task_id", "ok"), "task_id", "left")
    over = F.col("attempts") >= max_attempts
    live = (F.col("status") == "running") & F.col("ok").isNotNull()
    status = F.when(live & F.col("ok"), "done").when(live & over, "failed").when(live, "pending").otherwise(F.col("status"))
    pause = F.make_dt_interval(secs=(base * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("decimal(18,6)"))
    after = F.when(live & ~F.col("ok") & ~over, now + pause).otherwise(F.col("run_after"))
    return t.withColumns({"status": status, "run_after": after}).drop("ok")


def count_with_guard(events: DataFrame, key: str, ts: str, most: int) -> DataFrame:
    """DML-05: daily counts of a key; a day's keys beyond the first ``most`` to arrive aren't counted."""
    daily = events.groupBy(F.to_date(ts).alias("day"), key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(ts, "event_id")).alias("first"))
    order = F.row_number().over(Window.partitionBy("day").orderBy("first"))
    return daily.withColumn("_k", order).where(F.col("_k") <= most).drop("_k", "first")
