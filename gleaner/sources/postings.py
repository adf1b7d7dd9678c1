"""The canonical posting table, and its adapter over the star-schema test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "seq long, source string, company string, title string, url string, location string, remote boolean, text string, posted timestamp, "
    "employment_type string, salary_min double, salary_max double, currency string, direct boolean, partner string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def conform(df: DataFrame) -> DataFrame:
    """Canonical columns and types: missing text is empty, missing flags are false."""
    out = []
    for column in SCHEMA.split(", "):
        name, kind = column.split()
        c = (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        empty = {"string": "", "boolean": False}.get(kind)
        out.append((c if name == "currency" or empty is None else F.coalesce(c, F.lit(empty))).alias(name))
    return df.select(*out)


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """SRC-18: all sources, of which only postings with a web address and a company count."""
    whole = reduce(DataFrame.unionByName, [conform(f) for f in frames.values()])
    return whole.where(F.col("url").rlike("^https?://") & (F.trim("company") != ""))


def source_counts(postings: DataFrame) -> DataFrame:
    """AGG-08."""
    return postings.groupBy("source").agg(F.count(F.lit(1)).alias("postings"))


def from_star_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting for each document: company by supplier, title by part, place by nation and region.

    Three documents in a row have one supplier and part, so openings repeat at every scale; all suppliers and parts are used in
    turn, as far as there are documents.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    opening = F.floor(F.col("doc_id") / 3).cast("long")
    d = read("documents").select("doc_id", F.col("source").alias("src"), "text")
    i = F.col("doc_id")
    rows = (
        d.join(read("supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == opening % read("supplier").count())
        .join(read("part").select("p_partkey", "p_name", "p_retailprice"), F.col("p_partkey") == opening % read("part").count())
        .join(read("nation"), F.col("n_nationkey") == i % 25)
        .join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % n + 1).cast("int"))
    level = F.when(i % 5 == 0, "Senior ").when(i % 5 == 1, "Junior ").otherwise("")
    return conform(
        rows.select(
            i.alias("seq"),
            F.col("src").alias("source"),
            F.concat("s_name", pick(4, "", " GmbH", " Ltd", " Labs")).alias("company"),
            F.concat(level, "p_name", pick(3, " (m/w/d)", " - Remote", "")).alias("title"),
            F.concat(F.lit("https://"), "src", F.lit(".example/"), i.cast("string")).alias("url"),
            F.concat_ws(", ", "n_name", "r_name").alias("location"),
            (i % 2 == 0).alias("remote"),
            "text",
            F.when(i % 11 != 0, F.timestamp_add("DAY", (i % 90).cast("int"), F.lit("2024-01-01").cast("timestamp"))).alias("posted"),
            pick(4, "permanent", "contract", "freelance", "").alias("employment_type"),
            F.when(i % 6 != 0, F.col("p_retailprice").cast("double") * 40).alias("salary_max"),
            pick(4, "EUR", "USD", "GBP", "XXX").alias("currency"),
            (i % 3 == 0).alias("direct"),
            F.when((i % 7 == 0) & (i % 3 != 0), "Jooble").otherwise("").alias("partner"),
        )
    )


#: The adapter for DuckDB, as a common table expression.
STAR_SQL = """p AS (
    SELECT doc_id AS seq, d.source AS source, s_name || (CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Ltd' ELSE ' Labs' END) AS company,
           (CASE doc_id % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' ELSE '' END) || p_name
             || (CASE doc_id % 3 WHEN 0 THEN ' (m/w/d)' WHEN 1 THEN ' - Remote' ELSE '' END) AS title,
           'https://' || d.source || '.example/' || doc_id AS url, n_name || ', ' || r_name AS location, doc_id % 2 = 0 AS remote, coalesce(text, '') AS text,
           CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 90) END AS posted,
           CASE doc_id % 4 WHEN 0 THEN 'permanent' WHEN 1 THEN 'contract' WHEN 2 THEN 'freelance' ELSE '' END AS employment_type,
           CAST(NULL AS DOUBLE) AS salary_min, CASE WHEN doc_id % 6 <> 0 THEN CAST(p_retailprice AS DOUBLE) * 40 END AS salary_max,
           CASE doc_id % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'XXX' END AS currency,
           doc_id % 3 = 0 AS direct, CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 THEN 'Jooble' ELSE '' END AS partner
    FROM documents d JOIN supplier ON s_suppkey = doc_id // 3 % (SELECT count(*) FROM supplier) JOIN part ON p_partkey = doc_id // 3 % (SELECT count(*) FROM part)
         JOIN nation ON n_nationkey = doc_id % 25 JOIN region ON r_regionkey = n_regionkey)"""
