"""Streaming forms of the stateful behaviour: daily counters, rate limits, repeat windows, id memory."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import values as V
from ..operators import state
from ..operators.buckets import BucketTable

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def daily_counts(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """ST-01: counts by day and key; days older than the watermark are final. The watermark bounds the state."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), key)
    return days.agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), key, "n")


#: Rows of a batch that a stateful function returns at once.
ROWS = 50_000


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``event_id`` and microseconds of one key's rows in a micro-batch, in order of time, in chunks. Only these two numbers of
    each row are held, and a micro-batch bounds their count (``files_per_batch``)."""
    parts = [(b["event_id"].to_numpy(np.int64), b["at"].to_numpy("datetime64[us]").astype(np.int64)) for b in batches]
    ids, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, times))
    for at in range(0, len(order), ROWS):
        yield ids[order[at : at + ROWS]], times[order[at : at + ROWS]]


def _expire(held: GroupState, at: int) -> None:
    """State is dropped when the watermark reaches this time (in microseconds)."""
    due = -(-at // 1000)
    if due > held.getCurrentWatermarkMs():
        held.setTimeoutTimestamp(due)
    else:
        held.remove()


def _limit(most: int, seconds: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        recent = deque(held.get[0] if held.exists else [])
        for ids, times in _in_order(batches):
            allowed = []
            for t in times.tolist():
                while recent and recent[0] <= t - seconds * 1_000_000:
                    recent.popleft()
                allowed.append(len(recent) < most)
                if allowed[-1]:
                    recent.append(t)
            yield pd.DataFrame({"event_id": ids, "user_id": key[0], "ts": times.astype("datetime64[us]"), "allowed": allowed})
        held.update((list(recent),))
        _expire(held, (recent[-1] if recent else 0) + seconds * 1_000_000)

    return run


def _timed(events: DataFrame, late: str, *columns: str) -> DataFrame:
    """The columns with ``at``, the event's time without a zone; the watermark stays on ``ts``."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.select("event_id", *columns, "ts", F.col("ts").cast("timestamp_ntz").alias("at"))


def rate_limit(events: DataFrame, most: int = 5, seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """ST-02: at most so many hits in a sliding window of each user; rejected hits aren't recorded. Stream form; hits of one
    micro-batch are taken in order of time, micro-batches as they come: files should come in order of time. A user's state
    holds the last hits only, and goes when the watermark (``late`` behind the newest event) has left them behind."""
    return _timed(events, late, "user_id").groupBy("user_id").applyInPandasWithState(
        _limit(most, seconds), "event_id long, user_id long, ts timestamp_ntz, allowed boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


#: Parts of the keys whose state is held together in ``repeat_after``. A stream keeps the number it began with.
PARTS = 1024


def _repeat(days: int):
    pause = days * 86_400_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(zip(held.get[0], held.get[1], strict=True), held.get[2], strict=True)) if held.exists else {}
        if not held.hasTimedOut:
            kinds: dict[str | None, int] = {}
            parts = [
                (b["event_id"].to_numpy(np.int64), b["at"].to_numpy("datetime64[us]").astype(np.int64), b["user_id"].to_numpy(), np.array([kinds.setdefault(x, len(kinds)) for x in b["event_type"]], np.int32))
                for b in batches
            ]
            ids, times, users, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
            names, order = list(kinds), np.lexsort((ids, times))
            for at in range(0, len(order), ROWS):
                some, shown = order[at : at + ROWS], []
                for k, t, user, code in zip(some.tolist(), times[some].tolist(), users[some].tolist(), codes[some].tolist(), strict=True):
                    item = (None if user != user else user, names[code])
                    if (before := last.get(item)) is None or before <= t - pause:
                        shown.append(k)
                        last[item] = t
                yield pd.DataFrame({"event_id": ids[shown], "user_id": users[shown], "event_type": [names[x] for x in codes[shown]], "ts": times[shown].astype("datetime64[us]")})
        mark = held.getCurrentWatermarkMs() * 1000
        last = {k: t for k, t in last.items() if -(-(t + pause) // 1000) * 1000 > mark}
        if last:
            held.update(([u for u, _ in last], [n for _, n in last], list(last.values())))
            held.setTimeoutTimestamp(-(-(min(last.values()) + pause) // 1000))
        elif held.exists:
            held.remove()

    return run


def repeat_after(events: DataFrame, days: int = V.REPEAT_DAYS, late: str = "1 day") -> DataFrame:
    """ST-03: an item is shown to a user again only so many days after it was last shown. Order as in ``rate_limit``.

    The state of a user and item goes when the watermark is so many days past the last showing: whatever comes then may be
    shown anyway, so nothing is lost, and what is kept grows with what was shown in that time, not with all that ever was.
    Keys are dealt to ``PARTS`` groups, so that a call of the function does many keys' work.
    """
    timed = _timed(events, late, "user_id", "event_type").withColumn("part", F.pmod(F.xxhash64("user_id", "event_type"), F.lit(PARTS)))
    return timed.groupBy("part").applyInPandasWithState(
        _repeat(days), "event_id long, user_id long, event_type string, ts timestamp_ntz", "users array<long>, types array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def once_ever(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """ST-04: the first event of each key. Once ever means that every key is kept for ever; with a watermark, keys are forgotten
    after it and may come again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def upsert_stream(changes: DataFrame, table: BucketTable, checkpoint: str, keep_first: tuple[str, ...] = (), name: str = "upserts"):
    """ST-05/08: changes into a bucketed table, last wins. Only buckets that a micro-batch touches are rewritten; the batch's
    number is in the commit, so a batch that is repeated after a crash changes nothing. ``name`` tells streams into one table
    apart and goes with the checkpoint: a new checkpoint needs a new name."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, lambda old, new: state.last_wins(old, new, table.keys, keep_first), batch_id, name)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str, complete: bool = False) -> DataFrame:
    """Run a stream over what is there now into Parquet files, and read them. With ``complete``, each micro-batch holds the whole
    result and replaces the one before. The driver sees none of the rows."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if complete:
        writer = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        writer.start().awaitTermination()
    else:
        writer.format("parquet").option("path", path).outputMode("append").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_stateful(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """``run_to_files`` for streams with timers and state variables, which need the RocksDB state store; the session's own setting
    is put back."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_to_files(stream, path, checkpoint)
    finally:
        conf.set(name, before)
