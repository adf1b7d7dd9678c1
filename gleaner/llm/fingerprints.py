"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences, in DataFrame functions only.

Sections lie between empty lines, paragraphs between line feeds; a paragraph's leaves are its sentences, long ones in pieces
of ``PIECE`` code points. No character is lost between leaves, so equal roots mean equal texts. The fingerprint is
``root:branches``: the root in hex, then sections joined by ``;``, paragraphs by ``/``, and of each leaf the first eight digits
of its hash. Roots test equality; where they differ, differing branches locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PIECE = 200
_LEAF = rf"(?s)[^.!?|]{{0,{PIECE}}}+[.!?|]+|[^.!?|]{{1,{PIECE}}}+"
#: Ids that one range of the id order holds, about.
RANGE_ROWS = 500_000


def merkle_tree(text: Column) -> Column:
    """Leaf hashes as sections of paragraphs of leaves; null counts as empty."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), leaves))


def fingerprint(tree: Column) -> Column:
    node = lambda hashes: F.sha2(F.array_join(hashes, ""), 256)
    root = node(F.transform(tree, lambda s: node(F.transform(s, node))))
    short = lambda p: F.array_join(F.transform(p, lambda x: F.left(x, F.lit(8))), "")
    return F.concat(root, F.lit(":"), F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, short), "/")), ";"))


def leaf_codes(print_: Column) -> Column:
    """The distinct leaf codes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column, codes_a: Column, codes_b: Column) -> Column:
    """1 for equal roots, else twice the shared leaf codes over all leaf codes."""
    total = F.size(codes_a) + F.size(codes_b)
    share = F.try_divide(2.0 * F.size(F.array_intersect(codes_a, codes_b)), total)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def changed_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: an array of (section, paragraph), both from 0, by the position in either tree."""
    sections = lambda p: F.transform(F.split(F.substring_index(p, ":", -1), ";", -1), lambda s: F.split(s, "/", -1))

    def inside(pair: Column, i: Column) -> Column:
        both = F.arrays_zip(F.coalesce(pair["x"], F.array()).alias("x"), F.coalesce(pair["y"], F.array()).alias("y"))
        marks = F.transform(both, lambda q, j: F.when(~q["x"].eqNullSafe(q["y"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.filter(marks, lambda m: m.isNotNull())

    zipped = F.arrays_zip(sections(a).alias("x"), sections(b).alias("y"))
    return F.flatten(F.transform(zipped, inside))


def next_ids(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, next_id`` over the distinct ids, ascending; after the last comes the first.

    Ids alone are sorted by ranges; only the first id of each range is looked at across ranges, a table as long as there are
    ranges.
    """
    ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null")
    ranges = max(1, -(-ids.count() // RANGE_ROWS))
    dealt = scratch.table(ids.distinct().repartitionByRange(ranges, "doc_id").withColumn("r", F.spark_partition_id()), "ids")
    firsts = dealt.groupBy("r").agg(F.min("doc_id").alias("first_id"))
    lowest = firsts.agg(F.min("first_id")).first()[0]
    after = firsts.select("r", F.lead("first_id", 1, lowest).over(Window.orderBy("r")).alias("after"))
    inner = dealt.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("r").orderBy("doc_id")))
    return inner.join(F.broadcast(after), "r").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    The edit replaces the last quarter of the code points (rounded down) by as many first ones of the next document.

    Null counts as empty; the empty text has one empty leafless paragraph and likeness 1 with another empty text, 0 with any
    other. Where an id repeats, each row is compared with the next distinct id, of whose texts the smallest counts. A null id
    has no next document: the next text is empty. An empty table gives an empty result. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # renamed columns keep the plan alike on both sides of the join below, so that texts are shuffled once
    base = rows.where("doc_id is not null").select(F.col("doc_id").alias("key"), F.col("text").alias("body"))
    order = scratch.table(next_ids(docs, scratch, id_col), "order")
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"))
    size = scratch.table(rows.where("doc_id is not null").select("doc_id", F.floor(F.length("text") / 4).cast("int").alias("k")), "sizes")
    wanted = wanted.join(size.groupBy(F.col("doc_id").alias("prev_id")).agg(F.max("k").alias("k")), "prev_id")
    following = (
        base.join(wanted, F.col("key") == F.col("doc_id"))
        .select("prev_id", F.substring("body", F.lit(1), F.col("k")).alias("head"), fingerprint(merkle_tree(F.col("body"))).alias("next_print"))
        .groupBy("prev_id")
        .agg(F.min(F.struct("head", "next_print")).alias("f"))
    )
    both = base.join(following, F.col("key") == F.col("prev_id")).select(F.col("key").alias("doc_id"), F.col("body").alias("text"), "f")
    alone = rows.where("doc_id is null").withColumn("f", F.lit(None).cast(following.schema["f"].dataType))
    return _compare(both).union(_compare(alone))


def _compare(both: DataFrame) -> DataFrame:
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("f.head", F.lit("")), F.lit(1), cut))
    empty = fingerprint(merkle_tree(F.lit("")))
    prints = both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        fingerprint(merkle_tree(F.col("text"))).alias("fingerprint"),
        fingerprint(merkle_tree(edited)).alias("edited_fingerprint"),
        F.coalesce("f.next_print", empty).alias("next_print"),
    )
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_print")
    prints = prints.select("*", leaf_codes(a).alias("x"), leaf_codes(b).alias("y"), leaf_codes(c).alias("z"))
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(a, b, F.col("x"), F.col("y")).alias("near_edited"),
        likeness(a, c, F.col("x"), F.col("z")).alias("near_next"),
    )
