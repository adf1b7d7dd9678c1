"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch

#: Permitted sequence lengths in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: Share of the attention term in a sequence's cost; the rest is linear in its length.
ATTENTION = 0.25
#: Tokens that one task packs; bins never span tasks. A piece counts as at least so many tokens there, so rows are bounded too.
SHARD_TOKENS = 8_000_000
LEAST_TOKENS = 64


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null and empty have 0."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.translate(trimmed, " ", "")) + 1).cast("long")


def sequence_cost(capacity: int, attention: float = ATTENTION, unit: int = 1024) -> float:
    """Cost of one sequence: a linear and a quadratic (attention) term."""
    return capacity * ((1 - attention) + attention * capacity / unit)


def pack_shard(items: Sequence[tuple[object, int, int]], capacities: Sequence[int], attention: float = ATTENTION) -> list[tuple[object, int, int, int, int, int]]:
    """Best-fit decreasing over bins of several sizes: (id, piece, n) -> (id, piece, n, bin, offset, capacity).

    Items go in order of size, largest first, into the open bin that leaves the least room. If none fits, a bin opens with
    the size that is cheapest for what it can be expected to hold: of the permitted sizes that take the item, the one with
    the least cost per token when the room beyond the item is filled from the smaller items that are still to come.
    Where only items of length 0 are left, that is the smallest size.
    Each bin is at last shrunk to the smallest permitted size that holds its contents.
    """
    sizes = sorted(set(capacities))
    order = sorted(items, key=lambda x: (-x[2], x[0] is None, x[0], x[1]))
    to_come = sum(n for _, _, n in order)
    room: list[tuple[int, int]] = []  # of open bins: (free, bin), ascending
    used: list[int] = []
    placed = []
    for i, piece, n in order:
        to_come -= n
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            cost = lambda c: sequence_cost(c, attention) / min(c, max(1, n + to_come))
            free = min((c for c in sizes if c >= n), key=lambda c: (cost(c), c))
            b = len(used)
            used.append(0)
        placed.append((i, piece, n, b, used[b]))
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    fitted = [sizes[bisect_left(sizes, u)] for u in used]
    return [(i, piece, n, b, at, fitted[b]) for i, piece, n, b, at in placed]


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Callable[[Column], Column] = word_count,
    capacities: Sequence[int] = CAPACITIES,
    attention: float = ATTENTION,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity``.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest, so nothing is dropped.
    Pieces are dealt by a hash of document and piece into shards of about ``shard_tokens`` tokens and each shard is packed
    by itself, with ids and lengths only; ``bin_id`` is ``shard-bin``. A piece counts as ``LEAST_TOKENS`` at least in the number
    of shards, and null ids are dealt by a number of their row, so that many short texts or null ids don't make one large shard.

    Null and empty texts have no tokens and give one piece of length 0, which takes no room; if no open
    bin has room, it opens one of the smallest capacity. Ties go by id, then piece; rows that repeat an id are packed each.
    Null ids are packed like others, last among equals. An empty table gives an empty result. Extra columns are ignored.
    """
    top, sizes = max(capacities), tuple(sorted(set(capacities)))
    lengths = docs.select(F.col(id_col).alias("doc_id"), length(F.col(text_col)).cast("long").alias("n"))
    lengths = lengths.withColumn("salt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    lengths = Scratch(docs.sparkSession, "packing").table(lengths, "lengths")  # texts are read once, for the total and the pieces
    pieces = lengths.select(
        "doc_id", "n", "salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / top) - 1).cast("int"))).alias("piece")
    ).select("doc_id", "salt", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).alias("n_tokens"))
    total = lengths.agg(F.sum(F.greatest("n", F.lit(LEAST_TOKENS)))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    kind = docs.schema[id_col].dataType.simpleString()

    names = ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "capacity"]

    def pack(shard: pa.Table) -> pa.Table:
        items = zip(*(shard.column(c).to_pylist() for c in ("doc_id", "piece", "n_tokens")), strict=True)
        label = shard.column("shard")[0].as_py()
        rows = [(i, p, p * top, n, f"{label}-{b}", at, c) for i, p, n, b, at, c in pack_shard(list(items), sizes, attention)]
        kinds = [shard.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    key = F.when(F.col("doc_id").isNull(), F.xxhash64("salt", "piece")).otherwise(F.xxhash64("doc_id", "piece"))
    dealt = pieces.withColumn("shard", F.pmod(key, F.lit(shards))).drop("salt")
    return dealt.groupBy("shard").applyInArrow(
        pack, f"doc_id {kind}, piece int, start long, n_tokens long, bin_id string, bin_offset long, capacity int"
    )
