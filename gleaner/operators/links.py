"""SRC-27: whether links still work: remembered answers first, and a bounded number of questions a host for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import host, is_public_url
from ..tables import Scratch
from .buckets import BucketTable
from .ranking import top_per
from .rules import page_is_dead

#: The remembered answers, by address.
SCHEMA = "url string, alive boolean, checked long"


def due_links(urls: DataFrame, known: DataFrame, now: int, keep: int, per_host: int) -> DataFrame:
    """``url, host``: addresses without an answer of the last ``keep`` seconds, of each host the first ``per_host``; those that
    were never asked come first, then the oldest answers. Addresses that aren't public are never asked."""
    asked = urls.select("url").where(is_public_url(F.col("url"))).distinct()
    rest = asked.join(known.select("url", "checked"), "url", "left").where(F.coalesce(F.col("checked") < now - keep, F.lit(True)))
    return top_per(rest.withColumn("host", host(F.col("url"))), ["host"], [F.col("checked").asc_nulls_first(), F.col("url")], per_host).select("url", "host")


def check_links(urls: DataFrame, table: BucketTable, fetch: Callable[[DataFrame], DataFrame], now: int, keep: int = 86_400, per_host: int = 1_000) -> int:
    """Ask what is due and remember the answers; returns how many were asked.

    ``fetch`` gets ``url, host`` in partitions by host, so that a host is asked by one task, at the pace that the caller's client
    keeps; it returns ``url, status, body`` with a null status where nothing answered. Answers are merged into the buckets
    they belong to; what a lost run had asked is asked again.
    """
    due = Scratch(urls.sparkSession, "links").table(due_links(urls, table.read(), now, keep, per_host), "due")
    asked = due.count()
    if asked:
        answers = fetch(due.repartition("host")).select("url", (~page_is_dead(F.col("status"), F.col("body"))).alias("alive"), F.lit(now).cast("long").alias("checked"))
        answers = Scratch(urls.sparkSession, "links").table(answers.dropDuplicates(["url"]), "answers")
        table.merge(answers, lambda old, new: old.join(new.select("url"), "url", "left_anti").unionByName(new))
    return asked


def with_alive(postings: DataFrame, known: DataFrame) -> DataFrame:
    """Postings with ``alive``: true for employers' own and partners' postings, else the remembered answer; without one, null."""
    sure = F.col("direct") | (F.col("partner") != "")
    return postings.join(known.select("url", F.col("alive").alias("__alive")), "url", "left").withColumn(
        "alive", F.when(sure, F.lit(True)).when(~is_public_url(F.col("url")), F.lit(False)).otherwise(F.col("__alive"))
    ).drop("__alive")
