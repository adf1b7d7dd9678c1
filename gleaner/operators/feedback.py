"""What votes, clicks and visits tell: counts, signals and rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def counter_report(daily: DataFrame, keys: Sequence[str], sums: Sequence[str], since: Column) -> DataFrame:
    """AGG-01/02: sums over the last days, largest first."""
    out = daily.where(F.col("day") >= since).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return out.orderBy(F.desc(sums[0]), *keys)


def rate(part: Column, whole: Column) -> Column:
    """AGG-03: null where there is no whole."""
    return F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0)).cast("double"))


def sponsored_stats(sent: DataFrame) -> DataFrame:
    """AGG-04: how often each sponsor was shown and liked; the sum over no votes is null."""
    liked = F.sum(F.when(F.col("feedback").isNotNull(), (F.col("feedback") == "up").cast("int")))
    return sent.where("sponsor is not null").groupBy("sponsor").agg(F.count(F.lit(1)).alias("shown"), liked.alias("liked"))


def signals(votes: DataFrame, key: str = "search_id") -> DataFrame:
    """AGG-05: one row of matching signals for each person with votes.

    Columns in: key, ``feedback, feedback_reason, company, matched_role, title, location``.
    """
    c = F.col
    up = c("feedback") == "up"
    reason = F.coalesce(F.when(~up, c("feedback_reason")), F.lit(""))
    says = lambda s: reason.contains(s)
    some = lambda x: F.coalesce(c(x), F.lit("")) != ""
    title_words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-zà-ÿ0-9+#]+"), F.lit(0))
    rows = votes.where("feedback is not null")
    roles = rows.where(some("matched_role")).groupBy(key, "matched_role").agg(
        F.count_if(up).cast("int").alias("u"), F.count_if(~up & says("not my field")).cast("int").alias("d")
    )
    entries = lambda n: F.map_from_entries(F.array_sort(F.collect_list(F.when(c(n) > 0, F.struct("matched_role", n)))))
    maps = roles.groupBy(key).agg(entries("u").alias("role_up"), entries("d").alias("role_down"))
    flat = rows.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(says("not this company") & some("company"), F.lower("company")))).alias("excluded_companies"),
        F.bool_or(says("too junior")).alias("too_junior"),
        F.bool_or(says("too senior")).alias("too_senior"),
        F.array_sort(F.collect_set(F.when(says("wrong location") & some("location"), T.first_place(c("location"))))).alias("bad_places"),
        F.bool_or(says("salary too low")).alias("salary_strict"),
    )
    # distinct before they are gathered: a search holds as many words as there are, however many votes it has
    liked = rows.where(up).select(key, F.explode(F.filter(title_words, lambda w: F.length(w) > 2)).alias("word")).distinct()
    liked = liked.groupBy(key).agg(F.array_sort(F.collect_list("word")).alias("liked_words"))
    none = F.create_map().cast("map<string,int>")
    out = flat.join(liked, key, "left").join(maps, key, "left")
    out = out.withColumn("liked_words", F.coalesce("liked_words", F.array().cast("array<string>")))
    return out.withColumn("role_up", F.coalesce("role_up", none)).withColumn("role_down", F.coalesce("role_down", none))


def summary(votes: DataFrame, key: str = "search_id") -> DataFrame:
    """AGG-06: the votes as rows, each with its person's counts; sorting by ``feedback_at`` is left to who shows one person's."""
    given = votes.where("feedback is not null")
    counts = given.groupBy(key).agg(*[F.count_if(F.col("feedback") == v).alias(v) for v in ("up", "down")])
    return given.join(counts, key)


def recent(votes: DataFrame, key: str, at: str, tie: str, n: int = 30) -> DataFrame:
    """RK-07."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rules_from_votes(votes: DataFrame, title_reasons: Sequence[str], company_reason: str, key: str = "profile") -> DataFrame:
    """AGG-07: titles and companies that votes block or like; a block beats a like.

    The reasons of a vote are joined by ``; ``: titles go by whole reasons, companies by text within.
    """
    up, down = F.col("vote") == "up", F.col("vote") == "down"
    reasons = F.split(F.coalesce("reason", F.lit("")), "; ")
    title, company = T.title_norm(F.col("title")), T.company_key(F.col("company"))
    kind = F.arrays_overlap(reasons, T.lit_array(title_reasons))
    sets = votes.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(down & kind, title))).alias("blocked_titles"),
        F.array_sort(F.collect_set(F.when(up, title))).alias("liked_titles"),
        F.array_sort(F.collect_set(F.when(down & F.coalesce("reason", F.lit("")).contains(company_reason), company))).alias("blocked_companies"),
        F.array_sort(F.collect_set(F.when(up & (company != ""), company))).alias("liked"),
    )
    return sets.withColumn("liked_companies", F.array_except("liked", "blocked_companies")).drop("liked")


def titles_of_companies(postings: DataFrame, first: int = 3) -> DataFrame:
    """AGG-16: the first titles of each company in order of ``seq``, without repeats, joined."""
    w = Window.partitionBy("company").orderBy("seq")
    few = postings.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
    listed = F.array_sort(F.collect_list(F.struct("seq", "title")))
    return few.groupBy("company").agg(F.array_join(F.array_distinct(F.transform(listed, lambda s: s["title"])), "; ").alias("titles"))


def classify(a: Column, contract: Column, strong_min: int = 75, possible_min: int = 60) -> Column:
    """FLT-16: status and reason of an assessment struct, by the first rule that holds."""
    out = lambda s, r="": F.struct(F.lit(s).alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    total = a["total"]
    low = out("rejected", F.concat(F.lit("score "), total.cast("string")))
    hired = a["job_type"].isin("contract", "interim", "freelance") | contract
    return (
        F.when(F.coalesce(a["exclusion_reason"], F.lit("")) != "", out("rejected", a["exclusion_reason"]))
        .when(~F.coalesce(a["employer_identified"], F.lit(True)), out("rejected", "employer not identified"))
        .when(~F.coalesce(a["is_specific_job"], F.lit(True)), out("rejected", "not a specific job posting"))
        .when(a["location_eligibility"] == "ineligible", out("rejected", "location not eligible"))
        .when(F.coalesce(hired, F.lit(False)), F.when(total >= possible_min, out("contract")).otherwise(low))
        .when((total >= strong_min) & (a["location_eligibility"] == "explicit"), out("strong"))
        .when(total >= possible_min, out("possible"))
        .otherwise(low)
    )


def rubric_total(scores: Column, points: dict[str, int], penalties: Column, costs: dict[str, int]) -> Column:
    """FN-33: per cent of the points after penalties, not below 0, halves to even; repeated penalties count again."""
    got = sum((F.greatest(F.lit(0), F.least(F.lit(p), F.coalesce(F.try_element_at(scores, F.lit(c)).try_cast("int"), F.lit(0)))) for c, p in points.items()), F.lit(0))
    known = F.transform(penalties, lambda n: F.coalesce(*[F.when(n == k, v) for k, v in costs.items()], F.lit(0)))
    lost = F.aggregate(known, F.lit(0), lambda x, y: x + y)
    whole = sum(points.values())
    return F.greatest(F.lit(0), F.bround(100.0 * (got - lost) / whole, 0).cast("int")) if whole else F.lit(0)


def negotiate(header: Column, supported: Sequence[str], default: str = "en") -> Column:
    """FN-35: the supported language an Accept-Language header likes best; the first of equals."""

    def one(part: Column, i: Column) -> Column:
        pattern = r"^\s*([a-zA-Z]{1,8})(?:-[\w-]*)?\s*(?:;\s*q=([\d.]+))?"
        q = F.regexp_extract(part, pattern, 2)
        value = F.when(q == "", 1.0).otherwise(F.coalesce(q.try_cast("double"), F.lit(0.0)))
        return F.struct((-value).alias("q"), i.alias("i"), F.lower(F.regexp_extract(part, pattern, 1)).alias("lang"))

    ranked = F.array_sort(F.transform(F.split(F.coalesce(header, F.lit("")), ","), one))
    fit = F.filter(ranked, lambda r: (r["q"] < 0) & r["lang"].isin(*supported))
    return F.coalesce(F.try_element_at(fit, F.lit(1))["lang"], F.lit(default))
