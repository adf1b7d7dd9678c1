"""Ranking with caps: digests, pages, triage and report sections. All caps are row numbers in a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..tables import Scratch


def top_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int | Column, rank: str | None = None, most: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group; with ``rank``, their number. Where ``n`` is a column, ``most`` says how much it can be:
    a number lets Spark keep so many rows of a group in each task before the shuffle, a column doesn't."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= (n if most is None else most))
    out = out if most is None else out.where(F.col(name) <= n)
    return out if rank else out.drop(name)


def not_sent(matches: DataFrame, sent: DataFrame, keys: str = "all_keys") -> DataFrame:
    """JN-08: matches of which no key was sent to the search before."""
    seen = matches.select("search_id", "seq", F.explode(keys).alias("job_key")).join(sent.select("search_id", "job_key"), ["search_id", "job_key"], "left_semi")
    return matches.join(seen.select("search_id", "seq").distinct(), ["search_id", "seq"], "left_anti")


def digest(
    matches: DataFrame, cap: int = V.DIGEST_WEEKLY, per_company: int = V.DIGEST_PER_COMPANY, min_score: int = V.DIGEST_MIN_SCORE, alive: DataFrame | None = None
) -> DataFrame:
    """RK-01: of each search the best postings, at most so many a company; caps per company are independent, so the greedy
    choice is two row numbers. ``alive`` holds addresses that answered; employers' own and partners' postings pass."""
    good = matches.where(F.col("score") >= min_score)
    if alive is not None:
        checked = good.join(alive.select("url").distinct().withColumn("_ok", F.lit(True)), "url", "left")
        good = checked.where(F.col("_ok") | F.col("direct") | (F.col("partner") != "")).drop("_ok")
    order = [F.desc("score"), F.desc("direct"), F.col("seq")]
    return top_per(top_per(good, ["search_id", F.lower("company")], order, per_company), ["search_id"], order, cap, "rank")


def insert_sponsored(picks: DataFrame, sponsored: DataFrame, at: int = 2) -> DataFrame:
    """A search's sponsored posting at position min(2, n), counted from 0; later ranks move by one."""
    n = picks.groupBy("search_id").agg(F.count(F.lit(1)).alias("n"))
    place = sponsored.join(n, "search_id", "left").withColumn("slot", F.least(F.lit(at), F.coalesce("n", F.lit(0))) + 1)
    moved = picks.join(place.select("search_id", "slot"), "search_id", "left")
    moved = moved.withColumn("rank", F.when(F.col("rank") >= F.col("slot"), F.col("rank") + 1).otherwise(F.col("rank"))).drop("slot")
    return moved.unionByName(place.withColumn("rank", F.col("slot")).drop("n", "slot"), allowMissingColumns=True)


def page(postings: DataFrame, per_company: int = V.PAGE_PER_COMPANY, limit: int = V.PAGE_LIMIT, keys: Sequence[str] = ("page",)) -> DataFrame:
    """RK-02: the newest postings of a page, at most so many a company; no date is the oldest."""
    order = [F.coalesce("posted", F.timestamp_seconds(F.lit(0))).desc(), F.col("seq")]
    return top_per(top_per(postings, [*keys, F.lower("company")], order, per_company), list(keys), order, limit, "rank")


def triage(postings: DataFrame, liked_companies: Sequence[str], limit: int = 25, keys: Sequence[str] = ("profile",)) -> DataFrame:
    """RK-03: liked company, own board, local, newest."""
    liked = F.col("company_id").isin(*liked_companies) if liked_companies else F.lit(False)
    newest = F.coalesce("posted", F.timestamp_seconds(F.lit(0))).desc()
    return top_per(postings, list(keys), [liked.desc(), F.desc("direct"), (F.col("loc_class") == "local").desc(), newest, F.col("seq")], limit, "rank")


def capped_sections(judged: DataFrame, caps: dict[str, int], keys: Sequence[str] = ("profile",)) -> DataFrame:
    """RK-04: the best of each status, with a cap for each."""
    cap = F.coalesce(*[F.when(F.col("status") == k, n) for k, n in caps.items()], F.lit(0))
    return top_per(judged.where(F.col("status").isin(*caps)), [*keys, "status"], [F.desc("total"), F.col("seq")], cap, "rank", max(caps.values(), default=0))


def notable_rejects(judged: DataFrame, possible_min: int, n: int = 5, keys: Sequence[str] = ("profile",)) -> DataFrame:
    """RK-05: rejected postings that nearly passed."""
    near = judged.where((F.col("status") == "rejected") & (F.col("total") >= possible_min - 15))
    return top_per(near, list(keys), [F.desc("total"), F.col("seq")], n, "rank")


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """RK-12: numbers of batches of bounded size within a group, in order.

    Rows are sorted by range over all groups, numbered within each range, and moved by how many rows of their group earlier
    ranges hold; so a group that holds much of the table is shared by many tasks.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "batches").table(ranged, "ranged")  # one partitioning for both uses
    counts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return ranged.join(offsets, [*keys, "__part"]).withColumn("batch", F.floor((at - 1) / size).cast("int")).drop("__part", "__before")
