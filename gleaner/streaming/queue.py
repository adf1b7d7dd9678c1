"""ST-06: a durable queue as a stream: tasks are claimed in order, claims are leases, and what fails waits before it comes again."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``op`` is ``add`` (of ``task``), ``claim`` or ``finish`` (by ``worker``, with ``ok``); ``at`` is in microseconds.
OPERATIONS = "queue long, at long, seq long, op string, task long, worker long, ok boolean"
LOG = "queue long, at long, task long, kind string, worker long, attempts int"
_WAITING = "packed binary"
#: An operation as it waits: 33 bytes instead of a tuple of objects. ``op``: add, claim, finish without and with success; NONE is null.
_OPERATION = np.dtype([("at", "<i8"), ("seq", "<i8"), ("task", "<i8"), ("worker", "<i8"), ("op", "i1")])
_NONE = np.iinfo(np.int64).min
#: Operations that are unpacked, and log rows that are returned, at once.
ROWS = 50_000


def _pack(batch: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(batch), _OPERATION)
    for name in ("at", "seq", "task", "worker"):
        out[name] = [_NONE if pd.isna(x) else int(x) for x in batch[name].tolist()]
    ok = [not pd.isna(x) and bool(x) for x in batch["ok"].tolist()]
    out["op"] = [{"add": 0, "claim": 1}.get(op, 2 + k) for op, k in zip(batch["op"].tolist(), ok, strict=True)]
    return out


def _packed(operations: np.ndarray) -> list[tuple[bytes]]:
    return [(operations[k : k + ROWS].tobytes(),) for k in range(0, len(operations), ROWS)]


_TASKS = "task long, run_after long, attempts int, worker long, lease long"


class _Tasks:
    """Tasks by what they wait for: a worker, a time, or the end of a lease; time only goes forward. Heaps may hold entries that
    no longer count."""

    def __init__(self, rows: Iterator[tuple]):
        self.log: list[tuple] = []
        self.attempts: dict[int, int] = {}
        self.after: dict[int, int] = {}
        self.held: dict[int, tuple[int, int]] = {}  # task: worker, end of the lease
        self.by_worker: dict[int, int] = {}
        self.due: list[int] = []
        self.later: list[tuple[int, int]] = []
        self.leases: list[tuple[int, int]] = []
        for task, after, attempts, worker, lease in rows:
            self.attempts[task] = attempts
            if worker is None:
                self._wait(task, after)
            else:
                self.after[task] = after
                self._hold(task, worker, lease)

    def _wait(self, task: int, after: int) -> None:
        self.after[task] = after
        heappush(self.later, (after, task))

    def _hold(self, task: int, worker: int, lease: int) -> None:
        self.held[task], self.by_worker[worker] = (worker, lease), task
        heappush(self.leases, (lease, task))

    def give_back(self, at: int) -> None:
        while self.leases and self.leases[0][0] <= at:
            lease, task = heappop(self.leases)
            if self.held.get(task, (None, None))[1] == lease:
                worker = self._drop(task)
                self.log.append((lease, task, "returned", worker, self.attempts[task]))
                self._wait(task, lease)

    def _drop(self, task: int) -> int:
        worker = self.held.pop(task)[0]
        if self.by_worker.get(worker) == task:
            del self.by_worker[worker]
        return worker

    def add(self, task: int, at: int) -> None:
        if task not in self.attempts:
            self.attempts[task] = 0
            self._wait(task, at)

    def claim(self, worker: int, at: int, lease: int) -> None:
        while self.later and self.later[0][0] <= at:
            heappush(self.due, heappop(self.later)[1])
        if self.due and worker not in self.by_worker:
            task = heappop(self.due)
            self._hold(task, worker, at + lease)
            self.log.append((at, task, "claimed", worker, self.attempts[task]))

    def finish(self, worker: int, at: int, ok: bool | None, pause: int, most: int) -> None:
        if (task := self.by_worker.get(worker)) is None:
            return
        self._drop(task)
        self.attempts[task] += not ok
        kind = "done" if ok else "failed" if self.attempts[task] >= most else "again"
        self.log.append((at, task, kind, worker, self.attempts[task]))
        if kind == "again":
            self._wait(task, at + pause * self.attempts[task])
        else:
            del self.attempts[task], self.after[task]

    def rows(self) -> list[tuple]:
        return [(t, self.after[t], n, *self.held.get(t, (None, None))) for t, n in self.attempts.items()]


class TaskQueue(StatefulProcessor):
    """The state of one queue: operations that the watermark hasn't reached, and tasks that aren't done.

    Operations are taken in order of ``(at, seq)``, once the watermark has passed them, so arrival in other orders (within the
    watermark's delay) gives the same result. A claim takes the due task with the smallest number. A worker that crashes
    never finishes; when its lease runs out, the task is back as it was. A failed attempt waits ``pause`` longer each time and
    is the last after ``most``. A worker has one task at a time: a claim by one that holds a task gets none, and a finish by one
    whose lease has run out changes nothing.
    """

    def __init__(self, lease: int, pause: int, most: int):
        self.lease, self.pause, self.most = lease, pause, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.tasks = handle.getListState("tasks", _TASKS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                found = _pack(batch)
                self.waiting.appendList(_packed(found))
                first = min([int(found["at"].min())] + ([] if first is None else [first]))
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def _wake(self, at: int, watermark: int) -> None:
        """One timer a queue, at the earliest time anything is due: the millisecond after it."""
        due = max(at // 1000 + 1, watermark + 1)
        known = [t for (t,) in (x if isinstance(x, tuple) else (x,) for x in self.handle.listTimers())]
        if not known or due < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        upto = watermark * 1000
        parts = [np.frombuffer(packed, _OPERATION) for (packed,) in self.waiting.get()]
        operations = np.concatenate(parts) if parts else np.empty(0, _OPERATION)
        del parts
        order = np.lexsort((operations["seq"], operations["at"]))
        n = int(np.searchsorted(operations["at"], upto, sorter=order))
        tasks = _Tasks(self.tasks.get())
        for k in range(0, n, ROWS):
            for at, _, task, worker, op in operations[order[k : min(k + ROWS, n)]].tolist():
                task, worker = None if task == _NONE else task, None if worker == _NONE else worker
                tasks.give_back(at)
                if op == 0:
                    tasks.add(task, at)
                elif op == 1:
                    tasks.claim(worker, at, self.lease)
                else:
                    tasks.finish(worker, at, op == 3, self.pause, self.most)
            if len(tasks.log) >= ROWS:
                yield self._told(key, tasks)
        tasks.give_back(upto - 1)
        left, rows = operations[order[n:]], tasks.rows()
        self.waiting.put(_packed(left)) if len(left) else self.waiting.clear()
        self.tasks.put(rows) if rows else self.tasks.clear()
        due = [int(left["at"][0])] if len(left) else []
        due += [t[4] for t in rows if t[3] is not None]
        if due:
            self.handle.registerTimer(max(min(due) // 1000 + 1, watermark + 1))
        if tasks.log:
            yield self._told(key, tasks)

    def _told(self, key, tasks: _Tasks) -> pd.DataFrame:
        log, tasks.log = tasks.log, []
        return pd.DataFrame([(key[0], *row) for row in log], columns=[c.split()[0] for c in LOG.split(", ")])

    def close(self) -> None:
        pass


def run_queue(operations: DataFrame, lease: int, pause: int, most: int = 5, late: str = "0 seconds") -> DataFrame:
    """The log of what happens in queues, as a stream: rows of ``LOG`` from rows of ``OPERATIONS`` with a timestamp ``ts``. Times
    are in microseconds. A queue's operations depend on each other, so a queue is one task's work: deal tasks to as many
    queues as there should be tasks. Times before 1970 aren't supported."""
    rows = operations.withWatermark("ts", late).select(*[c.split()[0] for c in OPERATIONS.split(", ")], "ts")
    return rows.groupBy("queue").transformWithStateInPandas(TaskQueue(lease, pause, most), LOG, "Append", "EventTime")
