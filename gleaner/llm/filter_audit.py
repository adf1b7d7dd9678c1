"""Filter interaction audit: what each of several filters removes alone, in every order, and on average over all orders.

Every filter keeps, for each part and range of ids, the ascending list of the documents that fail it. Unions of lists and
what a list adds to a union are computed by merges that gallop through the longer list; only their sizes leave a range, and
sizes are summed over ranges. Texts are read once; nothing but digests, ids and flags is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heapreplace
from itertools import chain, combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch

#: Ids of one range; a range's lists meet in one task.
RANGE_IDS = 1 << 16

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, r"[#$%&*|]"

FILTERS = "ABCDE"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters that look at one text: too few words, too few different words, too many capitals, signs of markup."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SIGNS),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, A, B, C, D, E`` of every row: whether it fails each filter. E asks for the same text under a smaller id;
    texts meet by their SHA-256 digests, and a text that a third of all rows share is a skewed join that Spark splits."""
    scratch = Scratch(docs.sparkSession, "failures")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", SPACES), lambda x: x != ""))
    flags = [c.alias(f) for f, c in text_failures(F.col("t"), F.col("w")).items()]
    read = scratch.table(rows.select("doc_id", "part", *flags, F.unhex(F.sha2("t", 256)).alias("digest")), "flags")
    copies = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    copies = scratch.table(copies, "copies")
    return read.join(copies, "digest", "left").select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def _gallop(ids: Sequence[int], x: int, at: int) -> int:
    """The first position from ``at`` on whose id isn't below ``x``, by doubling steps and a search within the last one."""
    step, end = 1, len(ids)
    upto = at
    while upto < end and ids[upto] < x:
        at = upto + 1
        upto += step
        step += step
    return bisect_left(ids, x, at, min(upto, end))


def union(*lists: Sequence[int]) -> list[int]:
    """The ids of any list, ascending: runs of the list with the smallest head are copied up to the next list's head."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if len(ids)]
    heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        _, k, at = heads[0]
        ids = lists[k]
        bound = min(h[0] for h in heads[1:3])
        upto = _gallop(ids, bound, at)
        out += ids[at:upto]
        if upto < len(ids) and ids[upto] == bound:  # the other list brings it
            upto += 1
        if upto < len(ids):
            heapreplace(heads, (ids[upto], k, upto))
        else:
            heappop(heads)
    for _, k, at in heads:
        out += lists[k][at:]
    return out


def difference(ids: Sequence[int], other: Sequence[int]) -> list[int]:
    """The ids of the first list that the second doesn't hold, ascending; both sides gallop to the other's head."""
    out: list[int] = []
    i = j = 0
    while i < len(ids):
        j = _gallop(other, ids[i], j)
        if j == len(other):
            out += ids[i:]
            break
        if other[j] == ids[i]:
            i += 1
            continue
        upto = _gallop(ids, other[j], i)
        out += ids[i:upto]
        i = upto
    return out


def _subsets(filters: str) -> list[tuple[int, ...]]:
    return list(chain.from_iterable(combinations(range(len(filters)), k) for k in range(len(filters) + 1)))


def _sizes(failing: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """For each set of earlier filters, as bits, and each other filter: the summed weights (a row of them a document) of those
    that the filter removes behind the set, and of those it fails at all where the set is empty."""
    lists = [np.flatnonzero(f).tolist() for f in failing]
    unions: dict[tuple[int, ...], list[int]] = {(): []}
    for before in _subsets("x" * len(lists)):
        if before not in unions:
            unions[before] = union(unions[before[:-1]], lists[before[-1]])
        for f, ids in enumerate(lists):
            if f not in before:
                gone = difference(ids, unions[before])
                yield sum(1 << b for b in before), f, weights[gone].sum(axis=0).tolist()


def removal_counts(failing: DataFrame, labels: DataFrame, filters: str = FILTERS, id_col: str = "doc_id", range_ids: int = RANGE_IDS) -> DataFrame:
    """``part, before, filter, n, good, toxic``: documents that ``filter`` (a position) removes behind the filters ``before``
    (bits), and how many of them are labelled good or toxic; ``filter`` is -1 for the size of the part.

    Rows with one id, part and outcome are one entry with a weight, so a range holds at most so many entries as ids and
    outcomes, whatever repeats. Null ids share no range: they are spread by outcome, of which there are few.
    """
    marked = labels.groupBy(F.col(id_col).alias("l_id")).agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    rows = failing.join(marked, F.col("doc_id") == F.col("l_id"), "left")
    rows = rows.select("doc_id", "part", *filters, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    rows = rows.groupBy(rows.columns).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("doc_id", *filters, "n", "good", "toxic")
    ranges = rows.groupBy("part", F.floor(F.col("doc_id") / range_ids).alias("ids")).agg(F.sort_array(F.collect_list(entry)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, before, at, counts = [], [], [], []
            for part, entries in zip(batch.column("part").to_pylist(), batch.column("rows"), strict=True):
                columns = entries.values
                flags = [columns.field(f).to_numpy(zero_copy_only=False) for f in filters]
                n = columns.field("n").to_numpy(zero_copy_only=False)
                weights = np.stack([n, *(n * columns.field(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))], axis=1)
                for b, f, total in chain([(0, -1, weights.sum(axis=0).tolist())], _sizes(np.stack(flags), weights)):
                    parts.append(part)
                    before.append(b)
                    at.append(f)
                    counts.append(total)
            sums = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(before, pa.int32()), pa.array(at, pa.int32()), *sums], ["part", "before", "filter", "n", "good", "toxic"])

    sized = ranges.select("part", "rows").mapInArrow(run, "part string, before int, filter int, n long, good long, toxic long")
    return sized.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``.

    A null text counts as empty (it fails A only, and E behind a smaller id); a null part is the empty string. Rows that
    repeat an id all count, and don't make each other fail E; a null id is never behind another one and has no label. Of
    labels that repeat an id the largest value counts, a null label is none. An empty table gives an empty result. Extra
    columns are ignored.
    """
    counts = Scratch(docs.sparkSession, "audit").table(removal_counts(failures(docs, id_col, text_col, part_col), labels, id_col=id_col), "counts")
    return order_steps(counts, docs)


def order_steps(counts: DataFrame, docs: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of all orders from ``removal_counts``: a table of parts times orders, whatever the size of the parts."""
    orders = ["".join(o) for o in permutations(filters)]
    steps = [
        (order, k + 1, sum(1 << filters.index(x) for x in order[:k]), filters.index(f), (1 << len(filters)) - 1 - (1 << filters.index(f)))
        for order in orders
        for k, f in enumerate(order)
    ]
    plan = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int, others int")
    size = counts.where("filter = -1").select("part", F.col("n").alias("size"))
    alone = counts.where("filter >= 0 and before = 0").select("part", "filter", F.col("n").alias("fails"))
    last = counts.where("filter >= 0").select("part", "filter", F.col("before").alias("others"), F.col("n").alias("unique_fails"))
    found = F.broadcast(plan).join(counts.where("filter >= 0"), ["before", "filter"])  # 600 rows, whatever the tables hold
    rows = found.join(size, "part").join(alone, ["part", "filter"]).join(last, ["part", "filter", "others"])
    rows = rows.withColumn("gone", F.expr("sum(n) over (partition by part, filter_order order by step)"))
    return rows.select(
        "part", "filter_order", "step", (F.col("size") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.expr("sum(n) over (partition by part, filter)").alias("shapley"),
    )
