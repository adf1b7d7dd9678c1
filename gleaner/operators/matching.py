"""Scores of postings for saved searches: role, place, keywords and feedback.

A search is one row with the columns of ``SEARCH_SCHEMA``, its feedback one with those of ``SIGNALS_SCHEMA``. Candidate pairs
come from an equi-join on the word that makes a role, which every posting that can score has in its title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions.money import top_salary

SEARCH_SCHEMA = (
    "search_id long, target_roles array<string>, seniority array<string>, locations array<struct<place:string,country:string>>, "
    "remote_regions array<string>, work_modes array<string>, keywords array<string>, skills array<string>, industries_preferred array<string>, "
    "industries_excluded array<string>, deal_breakers array<string>, employment_types array<string>, salary struct<minimum:double,currency:string,period:string>"
)
SIGNALS_SCHEMA = (
    "excluded_companies array<string>, role_up map<string,int>, role_down map<string,int>, liked_words array<string>, "
    "too_junior boolean, too_senior boolean, bad_places array<string>, salary_strict boolean"
)
_WIDE = ("worldwide", "anywhere", "global", "international")


def no_signals() -> list[Column]:
    """Columns of a person without feedback."""
    return [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ", 1) for c in SIGNALS_SCHEMA.split(", "))]


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _votes(name: str, role: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(name), role), F.lit(0))


def blocked_role(role: Column) -> Column:
    """FLT-11: two votes against a role that those for it don't outweigh."""
    return (_votes("role_down", role) >= 2) & (_votes("role_up", role) < _votes("role_down", role))


def role_bonus(role: Column) -> Column:
    """SC-04."""
    return F.least(F.lit(0.15), 0.05 * _votes("role_up", role)) - 0.1 * _votes("role_down", role)


def role_match(title: Column, roles: Column) -> Column:
    """SC-01: struct of the best share and its role; the first of equals; null if no role scores above 0."""

    def best(mine: Column) -> Column:
        def rate(role: Column, i: Column) -> Column:
            own = T.role_words(role)
            hit = F.size(F.filter(own, lambda w: F.array_contains(mine, w))) / F.size(own)
            share = F.when(F.array_contains(mine, T.role_head(role)), hit).otherwise(hit * 0.4) - 0.02 * i
            return F.when(F.size(own) > 0, F.struct(share.alias("share"), (-i).alias("first"), role.alias("role")))

        return F.array_max(F.filter(F.transform(roles, rate), lambda r: r["share"] > 0))

    return T.let(T.words(title), best)


def location_match(location: Column, title: Column, text: Column, remote: Column) -> Column:
    """SC-02: struct of kind ('local', 'remote', 'any' or '') and the place or region, for the search's columns."""
    loc = F.lower(location)
    one = lambda p, k: F.coalesce(p[k], F.lit(""))
    places = F.flatten(F.transform(F.coalesce(F.col("locations"), F.array()), lambda p: F.array(one(p, "place"), one(p, "country"))))
    places = F.filter(places, lambda p: p != "")
    regions = F.filter(_list("remote_regions"), lambda r: r != "")
    modes = F.array_distinct(_list("work_modes"))
    is_remote = remote | location.rlike(T.I + V.REMOTE) | title.rlike(T.I + V.REMOTE)
    alias = lambda r: F.when(F.lower(r) == "europe", "eu").otherwise(r)
    named_in = lambda t: F.try_element_at(F.filter(regions, lambda r: T.has_phrase(t, r) | T.has_phrase(t, alias(r))), F.lit(1))
    local = F.try_element_at(F.filter(places, lambda p: T.has_phrase(loc, p)), F.lit(1))
    wide = F.exists(regions, lambda r: F.lower(r).isin(*_WIDE))
    open_ = is_remote & ((F.size(regions) > 0) | F.array_contains(modes, "remote") | (F.size(places) == 0))
    bare = (F.btrim(loc, F.lit(" ,;")) == "") | loc.rlike(r"(?U)^\W*(remote|anywhere|worldwide|fully remote)\W*$")
    anywhere = loc.rlike(r"(?U)\b(worldwide|anywhere|global)\b")
    nothing = (F.size(places) == 0) & (F.size(regions) == 0) & (F.size(modes) == 0)
    kind = lambda k, where: F.struct(F.lit(k).alias("kind"), where.alias("place"))
    no, world = kind("", F.lit("")), kind("remote", F.lit("worldwide"))
    in_text = named_in(F.lower(text))
    only_remote = (F.size(modes) == 1) & F.array_contains(modes, "remote")
    return (
        F.when(only_remote & ~is_remote, no)
        .when(local.isNotNull(), kind("local", local))
        .when(open_ & named_in(loc).isNotNull(), kind("remote", named_in(loc)))
        .when(open_ & bare & wide, world)
        .when(open_ & bare, F.when(in_text.isNotNull(), kind("remote", in_text)).otherwise(no))
        .when(open_ & wide & anywhere, world)
        .when(nothing, kind("any", F.lit("")))
        .otherwise(no)
    )


def salary_ok(low: Column, high: Column, currency: Column) -> Column:
    """FLT-10: only yearly floors count, unconverted, with a tenth of tolerance."""
    floor, period = F.col("salary.minimum"), F.coalesce(F.nullif(F.col("salary.period"), F.lit("")), F.lit("year"))
    top = top_salary(low, high, currency)
    return F.coalesce((F.coalesce(floor, F.lit(0.0)) == 0) | (period != "year") | (top < 1000) | (top >= floor * 0.9), F.lit(True))


def excluded(title_l: Column, company_l: Column, text_l: Column) -> Column:
    """FLT-09: hard rules, any of which rules a posting out."""
    title = F.col("title")
    level = F.array_distinct(_list("seniority"))
    low = ("entry", "junior")
    young = title.rlike(T.I + V.JUNIOR) & ~F.arrays_overlap(level, T.lit_array((*low, "any")))
    grown = title.rlike(T.I + V.SENIOR_TITLE) & (F.size(level) > 0) & F.forall(level, lambda x: x.isin(*low))
    voted = (F.coalesce(F.col("too_junior"), F.lit(False)) & title.rlike(T.I + V.LOWER_LEVEL)) | (
        F.coalesce(F.col("too_senior"), F.lit(False)) & title.rlike(T.I + V.HIGHER_LEVEL)
    )
    away = F.array_contains(_list("bad_places"), T.first_place(F.col("location"))) & ~F.col("remote")
    breakers = F.concat(_list("deal_breakers"), _list("industries_excluded"))
    several = lambda p: F.size(F.split(F.trim(p), r"(?U)\s+")) > 1
    broken = F.exists(breakers, lambda p: T.has_phrase(title_l, p) | T.has_phrase(company_l, p) | (several(p) & T.has_phrase(text_l, p)))
    no_job = title.rlike(T.I + V.NOT_A_JOB) | F.left(text_l, F.lit(1500)).rlike(T.I + V.NOT_A_JOB)
    company = (company_l != "") & F.array_contains(_list("excluded_companies"), company_l)
    return company | no_job | young | grown | voted | away | broken | ~salary_ok(F.col("salary_min"), F.col("salary_max"), F.col("currency"))


def score(df: DataFrame) -> DataFrame:
    """SC-03: rows of posting, search and feedback columns with ``score, why, role, loc_kind, place, hits``; rows that a hard
    rule or threshold rules out are gone."""
    c = F.col
    title_l, company_l, text_l = F.lower("title"), F.lower("company"), F.left(F.lower("text"), F.lit(6000))
    df = df.withColumn("_t", title_l).withColumn("_c", company_l).withColumn("_x", text_l)
    df = df.where(~excluded(c("_t"), c("_c"), c("_x")))
    roles = F.filter(_list("target_roles"), lambda r: ~blocked_role(r))
    df = df.withColumn("_r", role_match(c("title"), roles)).where(c("_r.share") >= V.ROLE_MIN)
    df = df.withColumn("_l", location_match(c("location"), c("title"), c("text"), c("remote")))
    df = df.where((c("_l.kind") != "") & ((c("_l.kind") != "any") | c("remote") | c("location").rlike(T.I + V.REMOTE)))
    lower = lambda a: F.transform(a, F.lower)
    one = lambda p, k: F.lower(F.coalesce(p[k], F.lit("")))
    places = F.flatten(F.transform(F.coalesce(c("locations"), F.array()), lambda p: F.array(one(p, "place"), one(p, "country"))))
    places = F.concat(places, lower(_list("remote_regions")))
    wanted = F.concat(_list("keywords"), _list("skills"), _list("industries_preferred"))
    wanted = F.filter(wanted, lambda k: (F.length(k) > 2) & ~F.lower(k).isin(*V.GENERIC) & ~F.array_contains(places, F.lower(k)))
    df = df.withColumn("_w", wanted)
    whole = F.concat_ws(" ", c("_x"), c("_t"))
    hits = T.let(whole, lambda t: F.array_distinct(F.filter(c("_w"), lambda k: T.has_phrase(t, k))))
    by_name = F.transform(F.array_sort(F.transform(hits, lambda k: F.struct(F.lower(k).alias("l"), k.alias("k")))), lambda s: s["k"])
    df = df.withColumn("_h", by_name).where((F.size("_w") == 0) | (F.size("_h") > 0) | (F.length("text") < V.FULL_TEXT))
    liked = F.array_except(F.array_intersect(_list("liked_words"), T.words(c("title"))), T.lit_array(V.GENERIC))
    single = F.filter(_list("deal_breakers"), lambda p: (F.size(F.split(F.trim(p), r"(?U)\s+")) == 1) & T.has_phrase(c("_x"), p))
    types, kind = _list("employment_types"), F.lower(F.coalesce("employment_type", F.lit("")))
    both = (F.size(types) > 0) & (kind != "")
    part = both & F.array_contains(types, "part-time") & kind.contains("full") & ~F.array_contains(types, "permanent")
    perm = both & F.forall(types, lambda t: t == "permanent") & kind.rlike(T.I + r"\b(contract|temporary|freelance)\b")
    unpaid = F.coalesce("salary_strict", F.lit(False)) & (F.coalesce(c("salary.minimum"), F.lit(0.0)) != 0)
    unpaid = unpaid & (F.coalesce("salary_min", F.lit(0.0)) == 0) & (F.coalesce("salary_max", F.lit(0.0)) == 0)
    num = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    points = (
        55 * F.least(F.lit(1.0), c("_r.share") + role_bonus(c("_r.role")))
        + F.when(c("_l.kind") == "local", 20).when(c("_l.kind") == "remote", 18).otherwise(8)
        + F.least(F.lit(15), 4 * F.size("_h"))
        + F.least(F.lit(9), 3 * F.size(liked))
        - 20 * F.size(single)
        - num(part, 10)
        - num(perm, 10)
        - num(unpaid, 10)
        + num(c("direct"), 5)
    )
    top = F.slice("_h", 1, 3)
    where = F.when(c("_l.kind") == "remote", F.concat(F.lit("remote ("), c("_l.place"), F.lit(")"))).otherwise(c("_l.place"))
    why = F.concat_ws(
        " · ",
        F.concat(F.lit("matches “"), c("_r.role"), F.lit("”")),
        F.when(c("_l.place") != "", where),
        F.when(F.size(top) > 0, F.concat(F.lit("mentions "), F.array_join(top, ", "))),
    )
    df = df.withColumns(
        {
            "score": F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points))).cast("int"),
            "why": why,
            "role": c("_r.role"),
            "loc_kind": c("_l.kind"),
            "place": c("_l.place"),
            "hits": top,
        }
    )
    return df.drop("_t", "_c", "_x", "_r", "_l", "_w", "_h")


def candidates(postings: DataFrame, searches: DataFrame) -> DataFrame:
    """JN-06/07: pairs (``seq, search_id``) whose title has the word that makes one of the search's roles."""
    title = postings.select("seq", F.explode(F.array_distinct(T.words(F.col("title")))).alias("word"))
    heads = searches.select("search_id", F.explode("target_roles").alias("role")).select("search_id", T.role_head(F.col("role")).alias("word")).distinct()
    return title.join(heads, "word").select("seq", "search_id").distinct()


def match(postings: DataFrame, searches: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Every scoring (posting, search), by way of the candidates."""
    pairs = candidates(postings, searches).join(postings, "seq").join(searches, "search_id")
    if signals is None:
        return score(pairs.select("*", *no_signals()))
    return score(pairs.join(signals, "search_id", "left"))
