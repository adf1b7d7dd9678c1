"""Exact dedup: groups by a 128-bit content hash, the smallest id stays, bytes are compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeeze


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same after white space is squeezed; null counts as empty. The grouping key is the
    content hash together with the normalised bytes, so two texts that merely collide in ``digest`` stay apart, and a group
    of copies shrinks to one row per task before the shuffle. Only (digest, sha256, id) of each document moves a second
    time, to meet its group; a group that holds a third of the rows is a skewed join that Spark splits.

    Ties and repeated rows: rows that repeat the smallest id all count in ``group_size`` and are all kept. A null id never
    wins against another id; among null ids only, all stay. An empty table gives an empty result. Extra columns are ignored.
    """
    text = squeeze(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    groups = (
        rows.groupBy(digest(F.col("__text")).alias("__h"), "__text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("__h", F.sha2("__text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", digest(F.col("__text")).alias("__h"), F.sha2("__text", 256).alias("text_sha256"))
    return members.join(groups, ["__h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """The documents of which each text stays once, all columns as they are; edge cases as in ``exact_groups``.

    The smallest id of each group is enough to keep its rows, so digests don't meet the documents again, but for null ids.
    """
    text = squeeze(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    groups = rows.groupBy(digest(F.col("__text")).alias("__h"), "__text").agg(F.min("doc_id").alias("__keep"))
    kept = groups.select("__keep", F.when(F.col("__keep").isNull(), F.col("__h")).alias("__of")).distinct()
    same_text = F.when(F.col(id_col).isNull(), digest(text)).eqNullSafe(kept["__of"])
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"]) & same_text, "left_semi")
