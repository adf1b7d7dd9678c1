"""Board links on career pages, and companies that no source covers yet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.address import host
from ..tables import Scratch
from .ranking import top_per

# Addresses of boards, with the part that names one, and parts that name none.
BOARD_LINKS = {
    "greenhouse": r"(?:job-)?boards(?:\.eu)?\.greenhouse\.io/(?:embed/job_board(?:/js)?\?for=)?([a-z0-9_-]+)",
    "lever": r"jobs\.lever\.co/([a-z0-9_.-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([a-z0-9_.%-]+)",
    "smartrecruiters": r"(?:jobs|careers)\.smartrecruiters\.com/([a-z0-9_-]+)",
    "personio": r"([a-z0-9-]+)\.jobs\.personio\.(?:de|com)",
    "recruitee": r"([a-z0-9-]+)\.recruitee\.com",
    "workable": r"apply\.workable\.com/([a-z0-9_-]+)",
    "workday": r"([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[a-z]{2}/)?([a-z0-9_-]+)",
}
NOT_SLUGS = "embed j api jobs job v1 apply static assets wday www careers".split()


def board_links(html: Column) -> Column:
    """FN-25: array of (ats, slug) linked from a page, by board, in order of appearance, without repeats."""
    found = []
    for ats, pattern in BOARD_LINKS.items():
        parts = [F.regexp_extract_all(html, F.lit(f"(?i){pattern}"), F.lit(k)) for k in ((1, 2, 3) if ats == "workday" else (1,))]
        slugs = parts[0] if len(parts) == 1 else F.transform(F.arrays_zip(*[p.alias(f"p{k}") for k, p in enumerate(parts)]), lambda z: F.concat_ws("/", z["p0"], z["p1"], z["p2"]))
        good = F.filter(slugs, lambda s: ~F.lower(F.substring_index(s, "/", -1)).isin(*NOT_SLUGS))
        found.append(_pairs(good, ats))
    return F.array_distinct(F.concat(*found))


def _pairs(slugs: Column, ats: str) -> Column:
    return F.transform(slugs, lambda s: F.struct(F.lit(ats).alias("ats"), s.alias("slug")))


def links(html: Column) -> Column:
    """Addresses of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"'#]+)"""), F.lit(1))


def uncovered(companies: DataFrame, *known: DataFrame, key: str = "company_id") -> DataFrame:
    """JN-12: companies in none of the known sets."""
    return reduce(lambda left, right: left.join(right.select(key), key, "left_anti"), known, companies)


def companies_of(postings: DataFrame) -> DataFrame:
    """One row a company, with the name that comes first."""
    rows = postings.withColumn("company_id", T.company_key(F.col("company")))
    return rows.where("company_id <> ''").groupBy("company_id").agg(F.min_by("company", "seq").alias("company"), F.count(F.lit(1)).alias("postings"))


def pick_board(candidates: DataFrame, probed: DataFrame) -> DataFrame:
    """UX-09: of each company the first candidate board that answered with a matching name; guesses need an opening too.

    ``candidates``: company_id, pos, ats, slug, guessed; ``probed``: ats, slug, ok, jobs, name_matches.
    """
    ok = candidates.join(probed, ["ats", "slug"]).where("ok and (not guessed or (jobs > 0 and name_matches))")
    return ok.groupBy("company_id").agg(F.min_by(F.struct("ats", "slug"), "pos").alias("b")).select("company_id", "b.ats", "b.slug")


#: Pages that are read of one site.
CRAWL_PAGES = 8


def join_url(source: Column, href: Column) -> Column:
    """The address that a link of a page means; null for other schemes. Dot segments stay as they are written."""
    root = F.regexp_extract(source, r"^((?i:https?)://[^/?#]+)", 1)
    folder = F.regexp_extract(source, r"^((?i:https?)://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike("^(?i:https?)://"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(source, "//", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, href))
    )


def crawl(starts: DataFrame, fetch: Callable[[DataFrame], DataFrame], budget: int = CRAWL_PAGES) -> DataFrame:
    """SRC-29: ``site, place, url, html``: the pages that are read of each site, in order, at most ``budget`` of each.

    ``starts``: ``site, base, url`` with the host without www. as ``base``. A page's new links to hosts of the site or to boards are
    lined up behind the pages that wait already: boards first, then other hosts of the site, few slashes. Each round reads one
    page of every site, so there are at most ``budget`` rounds; ``fetch`` gets ``site, base, url`` and adds ``html``, null where
    nothing answers. Waiting pages and addresses that were seen are tables of their own; what was read is written once.
    """
    scratch = Scratch(starts.sparkSession, "crawl")
    first = starts.groupBy("site").agg(F.min_by("base", "url").alias("base"), F.min("url").alias("url"))
    waiting = scratch.table(first.select("site", "base", "url", F.lit(0).alias("place")), "waiting")
    seen, done = waiting.select("site", "url"), None
    is_board = reduce(lambda a, b: a | b, [F.col("url").rlike(f"(?i){p}") for p in BOARD_LINKS.values()])
    for k in range(budget):
        now = waiting.where(F.col("place") == k)
        if now.isEmpty():
            break
        read = scratch.table(fetch(now.select("site", "base", "url")).select("site", "base", "url", "html"), "read")
        page = read.select("site", F.lit(k).alias("place"), "url", "html")
        done = page if done is None else done.unionByName(page)
        found = read.where("html is not null").select("site", "base", F.col("url").alias("source"), F.explode(links(F.col("html"))).alias("href"))
        found = found.select("site", "base", join_url(F.col("source"), F.col("href")).alias("url")).distinct()
        own, board = host(F.col("url")), is_board
        found = found.withColumns({"board": board, "host": own}).where(F.col("board") | F.endswith(F.col("host"), F.col("base")))
        fresh = scratch.table(found.join(seen, ["site", "url"], "left_anti"), "fresh")
        taken = waiting.groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("taken"))
        slashes = F.length("url") - F.length(F.translate("url", "/", ""))
        order = [~F.col("board"), F.regexp_replace("host", r"^www\.", "") == F.col("base"), slashes, F.col("url")]
        next_ones = top_per(fresh.join(taken, "site"), ["site"], order, F.lit(budget) - F.col("taken"), "rank", budget)
        seen = scratch.table(seen.unionByName(fresh.select("site", "url")), "seen")
        waiting = scratch.table(waiting.unionByName(next_ones.select("site", "base", "url", (F.col("taken") + F.col("rank") - 1).alias("place"))), "waiting")
    return waiting.selectExpr("site", "place", "url", "cast(null as string) AS html").where("false") if done is None else done


def first_boards(read: DataFrame) -> DataFrame:
    """``site, ats, slug``: the first board that the pages of a site link to, in order."""
    each = read.select("site", "place", F.posexplode(board_links(F.coalesce("html", F.lit("")))).alias("k", "b"))
    return each.groupBy("site").agg(F.min_by("b", F.struct("place", "k")).alias("b")).select("site", "b.ats", "b.slug")
