"""MinHash near-dedup with tensored banding: table keys are pairs of entries of two small hash collections.

A document is the set of its distinct 5-word shingles. Two collections of ``TABLES`` entries are computed, each entry a hash
of ``ROWS`` minimum hashes. Every pair (left entry, right entry) is the key of one table, so TABLES x TABLES tables cost only
2 x TABLES x ROWS minimum hashes. Two sets of similarity s meet in some table with probability
(1 - (1 - s**ROWS)**TABLES)**2: 0.9999 at the threshold 0.75, more above it.

Candidates that meet are confirmed on the full sets. A bucket is never expanded into pairs: each member is compared with the
bucket's pivot (its smallest id), which is linear. Only members that the pivot doesn't reach can still hide links among
themselves or to others; these are compared in blocks of bounded size inside tasks, which emit no more than a spanning
forest of the links found. So no partner is capped and no link that the tables expose is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

SHINGLE = 5
THRESHOLD = 75  # per cent
TABLES = 12
ROWS = 2
#: Members of one side of a block in the exact comparison.
BLOCK = 400
#: Rows that small pivot groups are packed into, for one call each.
PACK = 2000

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as the longest text so far needs."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(4096, 2 * n)
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.n, b)))) for b in (_BASE, _UNBASE))
        return self.up, self.down


_POWERS = _Powers()


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles: spans of the text with single spaces, hashed by prefix sums.

    A-Z are lower-cased. With fewer than k words, the whole sequence is the one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _POWERS.upto(len(joined))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
    gaps = np.flatnonzero(joined == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    k = min(k, len(words))
    s, e = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(_mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))


def tensor_halves(hashes: np.ndarray, tables: int = TABLES, rows: int = ROWS) -> np.ndarray:
    """The 2 x tables entries of the two collections; an entry's lowest bit tells its collection."""
    n = 2 * tables * rows
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _BASE)
    xor, odd = seeds[:n, None], seeds[n:, None] | np.uint64(1)
    low = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 8192):
        x = (hashes[None, at : at + 8192] ^ xor) * odd
        x ^= x >> np.uint64(32)
        x *= _MIX1
        np.minimum(low, x.min(axis=1), out=low)
    entry = np.arange(2 * tables, dtype=np.uint64) * _MIX2
    for row in low.reshape(2 * tables, rows).T:
        entry = _mix(entry * _BASE + row)
    side = np.repeat(np.array([0, 1], np.uint64), tables)
    return ((entry & ~np.uint64(1)) | side).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, digests, halves = batch.column("doc_id"), [], [], []
        for i, text in zip(ids, batch.column("text"), strict=True):
            s = shingle_set(text.as_py())
            linked = len(s) > 0 and i.is_valid
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if linked else None)
            halves.append(tensor_halves(s) if linked else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(halves, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "halves"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py()).view(np.int64) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])


def _overlaps(queries: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by one inverted index over the queries; memory is bounded by chunks of members."""
    flat = np.concatenate(queries)
    owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    order = np.argsort(flat, kind="stable")
    keys, first, lens = np.unique(flat[order], return_index=True, return_counts=True)
    owner = owner[order]
    out = np.zeros((len(members), len(queries)), np.int32)
    for j, m in enumerate(members):
        at = np.searchsorted(keys, m)
        at[at == len(keys)] = 0
        hit = at[keys[at] == m]
        n = lens[hit]
        if len(n):
            ends = np.cumsum(n)
            where = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[hit], n)
            out[j] = np.bincount(owner[where], minlength=len(queries))
    return out


def _forest(pdf: pd.DataFrame, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join different components, between the queries and the members of one block; no more than a forest."""
    q, m = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
    if q.empty or m.empty:
        return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    qs, ms = list(q["hashes"]), list(m["hashes"])
    both = _overlaps(qs, ms)
    union = np.array([len(x) for x in ms])[:, None] + np.array([len(x) for x in qs])[None, :] - both
    q_id, q_comp, m_id, m_comp = (x.tolist() for x in (q["id"], q["component"], m["id"], m["component"]))
    out = []
    for j, i in np.argwhere(100 * both.astype(np.int64) >= threshold * union):
        a, b = find(q_comp[i]), find(m_comp[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((q_id[i], m_id[j]))
    return out


def _link_packs(pdf: pd.DataFrame) -> pd.DataFrame:
    links = [x for _, block in pdf.groupby(["pivot", "bq", "bm"], sort=False) for x in _forest(block)]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |intersection| >= 75 * |union| of their shingle sets; ``component_id`` is the smallest id
    that links reach. Equal sets are one class before any table is built, so copies cost one row.

    Null, empty and wordless texts have the empty set and link with nothing. Rows with a null id link with nothing, have a
    null component and are kept. Rows that repeat an id are one node of the link
    graph: what any of their texts is linked with is in their component. Each row has the set size of its own text. An empty table
    gives an empty result. Extra columns are ignored. Ids are integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = scratch.table(source.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, halves array<long>"), "sketches")

    classes = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    classes = scratch.table(classes.where("n > 1").drop("n"), "copies")  # written, so that Spark can split the hot side of the join
    member = scratch.table(
        sketches.join(classes, "digest", "left").select(
            "doc_id",
            "n_shingles",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.when(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.col("halves")).alias("halves"),
        ),
        "classes",
    )
    scratch.discard(sketches)
    # an id with several texts is one node: it links the classes of all of them
    several = member.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("doc_id")
    same_id = member.join(scratch.table(several, "several"), "doc_id", "left_semi").where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    links = _star_and_rest(source, member, scratch).union(same_id)
    labels = components(links, scratch).withColumnRenamed("node", "class_id")
    return member.join(labels, "class_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "class_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "class_id")).alias("kept"),
    )


def _star_and_rest(source: DataFrame, member: DataFrame, scratch: Scratch) -> DataFrame:
    heads = member.where("halves is not null").select(F.col("class_id").alias("id"), F.col("n_shingles").alias("n"), "halves")
    entries = scratch.table(heads.select("id", "n", F.explode("halves").alias("entry")), "entries")
    met = scratch.table(entries.groupBy("entry").count().where("count > 1").select("entry"), "met")
    live = entries.join(met, "entry", "left_semi").groupBy("id", "n").agg(F.collect_set("entry").alias("e"))
    left = F.filter("e", lambda x: x.bitwiseAND(F.lit(1)) == 0)
    right = F.filter("e", lambda x: x.bitwiseAND(F.lit(1)) == 1)
    keys = (
        live.select("id", "n", F.explode(left).alias("l"), right.alias("right"))
        .select("id", "n", "l", F.explode("right").alias("r"))
        .select("id", "n", F.xxhash64("l", "r").alias("key"))
    )
    keys = scratch.table(keys, "keys")
    pivots = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pivots = scratch.table(pivots.select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("n_pivot")), "pivots")
    pairs = scratch.table(keys.join(pivots, "key").where("id <> pivot").select("id", "pivot", "n", "n_pivot").distinct(), "pairs")
    scratch.discard(entries, keys, met, pivots)

    involved = pairs.select("id").union(pairs.select("pivot")).distinct()
    # a sort-merge join at every size: texts are shuffled once, whether the ids would fit a broadcast or not
    texts = source.join(involved.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi")
    sets = scratch.table(texts.mapInArrow(_sets, "id long, hashes array<long>"), "sets")

    near = pairs.where("100 * least(n, n_pivot) >= 75 * greatest(n, n_pivot)")
    near = near.join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("hashes").alias("p_hashes")), "pivot")
    near = near.select("id", "pivot", "n", "n_pivot", F.size(F.array_intersect("hashes", "p_hashes")).cast("long").alias("both"))
    star = scratch.table(
        near.where(f"100 * both >= {THRESHOLD} * (n + n_pivot - both)").select(F.col("id").alias("a"), F.col("pivot").alias("b")), "star"
    )
    labels = components(star, scratch)

    # what a pivot shares a bucket with, by component; members outside the pivot's component are still to be compared
    label = labels.select(F.col("node").alias("id"), "component")
    group = pairs.join(label, "id", "left").select("pivot", "id", F.coalesce("component", "id").alias("component"))
    of_pivot = labels.select(F.col("node").alias("pivot"), F.col("component").alias("p_component"))
    group = group.join(of_pivot, "pivot", "left").select(
        "pivot", "id", "component", (F.col("component") != F.coalesce("p_component", "pivot")).alias("apart")
    )
    group = scratch.table(group, "groups")
    sizes = (
        group.groupBy("pivot")
        .agg(F.count(F.lit(1)).alias("m"), F.count_if("apart").alias("q"))
        .where("m > 1 and q > 0")
        .select("pivot", F.ceil(F.col("q") / BLOCK).cast("int").alias("nq"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nm"), "m", "q")
    )
    rest = group.join(sizes, "pivot")
    index = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = rest.where("apart").select(
        "pivot", "id", "component", "nq", "nm", F.lit(True).alias("is_query"), index("nq", 1).alias("bq"), F.explode(every("nm")).alias("bm")
    )
    there = rest.select(
        "pivot", "id", "component", "nq", "nm", F.lit(False).alias("is_query"), F.explode(every("nq")).alias("bq"), index("nm", 2).alias("bm")
    )
    total = sizes.agg(F.sum(F.expr("m * nq + q * nm"))).first()[0] or 0
    packs = max(1, -(-total // PACK))
    small = (F.col("nq") == 1) & (F.col("nm") == 1)
    pack = F.when(small, F.pmod(F.xxhash64("pivot"), F.lit(packs))).otherwise(F.xxhash64("pivot", "bq", "bm"))
    blocks = asked.unionByName(there).withColumn("pack", pack).join(sets, "id")
    found = blocks.groupBy("pack").applyInPandas(_link_packs, "a long, b long")
    return star.union(scratch.table(found, "rest"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which one of each component stays (the smallest id), all columns as they are."""
    result = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(result, docs[id_col].cast("long").eqNullSafe(result["__keep"]), "left_semi")
