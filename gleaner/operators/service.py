"""Who is due for what: digests, sponsored places, page snapshots, open tasks, votes since, companies to look up; and how it shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import Scratch
from .ranking import top_per

# Clients that aren't people, and thresholds.
BOTS = r"(?i)bot|crawl|spider|slurp|preview|inspectiontool|lighthouse|headless|curl|wget|python|http"
DAILY_SECONDS, WEEKLY_SECONDS = 20 * 3600, 6 * 86400
PAGE_MAX_DAYS, PAGE_MIN_COUNT, CRAWL_PAGES, RETRY_DAYS, NEW_VOTES = 3, 5, 8, 30, 5
OPEN = ("pending", "running")

c = F.col


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


# ---------------------------------------------------------------- digests


def due(first_at: Column, last_at: Column, frequency: Column, now: Column, weekly_day: int = 0, force: bool = False) -> Column:
    """FLT-12: whether a digest is due; times in seconds since 1970, 0 or null for never, days of the week from Monday."""
    since = F.unix_timestamp(now) - F.coalesce(last_at, F.lit(0))
    weekly = (F.weekday(now) == weekly_day) & (since > WEEKLY_SECONDS)
    return F.lit(force) | (F.coalesce(first_at, F.lit(0)) == 0) | F.when(frequency == "daily", since > DAILY_SECONDS).otherwise(weekly)


def recipients(people: DataFrame, now: Column, skip: DataFrame | None = None, only: str | None = None, force: bool = False) -> DataFrame:
    """FLT-13: confirmed people who aren't paused, have a derived search and are due; ``skip`` holds addresses (``email``)."""
    out = people.where("confirmed_at is not null and not coalesce(paused, false) and derived is not null")
    out = out.where(due(c("first_digest_at"), c("last_digest_at"), c("frequency"), now, force=force))
    if only:
        out = out.where(F.lower("email") == only.lower())
    if skip is not None:
        out = out.join(skip.select(F.lower("email").alias("__skip")), F.lower("email") == c("__skip"), "left_anti")
    return out


def active_campaigns(campaigns: DataFrame, today: Column) -> DataFrame:
    """SRC-23: campaigns that have started and haven't ended; without an end they go on."""
    return campaigns.where((F.coalesce("starts", F.lit("")) <= today) & (today <= F.coalesce("ends", F.lit("9999"))))


def sponsored_choice(scored: DataFrame, sent: DataFrame, least: int = 70) -> DataFrame:
    """SC-05: of each search the campaign with the best score that it hasn't seen, the earlier of equals.

    ``scored``: search_id, campaign, job_key, score; ``sent``: search_id, job_key.
    """
    new = scored.where(c("score") >= least).join(sent.select("search_id", "job_key").distinct(), ["search_id", "job_key"], "left_anti")
    return top_per(new, ["search_id"], [F.desc("score"), c("campaign")], 1)


def without_words(postings: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """FLT-15: no partner postings, and no title with an excluded word."""
    return postings.where(_blank(c("partner")) & ~F.arrays_overlap(T.words(c("title")), T.lit_array(excluded)))


def snapshot(pages: DataFrame, now: Column, max_days: int = PAGE_MAX_DAYS, least: int = PAGE_MIN_COUNT) -> DataFrame:
    """SRC-31: pages that are fresh enough and list enough; ``pages``: path, saved_at, count."""
    return pages.where((c("saved_at") >= now - F.make_dt_interval(F.lit(max_days))) & (c("count") >= least))


# ---------------------------------------------------------------- tasks and votes


def latest_task(tasks: DataFrame, kind: str) -> DataFrame:
    """RK-09: the newest task of a kind of each sign-up."""
    newest = F.max_by(F.struct("task_id", "status", "attempts"), "task_id")
    return tasks.where(c("kind") == kind).groupBy("signup_id").agg(newest.alias("t")).select("signup_id", "t.*")


def next_tasks(tasks: DataFrame, signups: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """JN-01: the oldest due tasks whose sign-up is still there, with its columns."""
    ready = tasks.where((c("status") == "pending") & (c("run_after") <= now))
    return ready.join(signups, "signup_id").orderBy("task_id").limit(n)


def to_derive(signups: DataFrame, tasks: DataFrame, version: str, kind: str = "extract") -> DataFrame:
    """JN-17: confirmed sign-ups that this version hasn't derived, without an open task."""
    by = F.coalesce("derived_by", F.lit(""))
    current = by.endswith(f":v{version}") | by.contains(f":v{version}:")
    open_tasks = tasks.where((c("kind") == kind) & c("status").isin(*OPEN)).select("signup_id")
    return signups.where(c("confirmed_at").isNotNull() & ~current).join(open_tasks, "signup_id", "left_anti")


def to_rederive(votes: DataFrame, signups: DataFrame, tasks: DataFrame, least: int = NEW_VOTES, kind: str = "extract") -> DataFrame:
    """JN-18, ST-07: sign-ups with enough votes since they were derived and no open task, with the number of votes."""
    given = votes.where("feedback_at is not null").join(signups.select("signup_id", "derived_at"), "signup_id")
    new = given.where(c("feedback_at") >= F.coalesce("derived_at", F.lit(0))).groupBy("signup_id").agg(F.count(F.lit(1)).alias("new_votes"))
    open_tasks = tasks.where((c("kind") == kind) & c("status").isin(*OPEN)).select("signup_id")
    return new.where(c("new_votes") >= least).join(open_tasks, "signup_id", "left_anti")


def open_counts(tasks: DataFrame, now: Column) -> DataFrame:
    """AGG-12: pending tasks that may run now, and all that are open."""
    return tasks.agg(F.count_if((c("status") == "pending") & (c("run_after") <= now)).alias("due"), F.count_if(c("status").isin(*OPEN)).alias("open"))


def recent_pending(signups: DataFrame, now: Column, seconds: int) -> DataFrame:
    """AGG-12: unconfirmed sign-ups of the last seconds for each address."""
    young = c("confirmed_at").isNull() & (c("created_at") > now - seconds)
    return signups.where(young).groupBy("email_hash").agg(F.count(F.lit(1)).alias("pending"))


def with_votes(emailed: DataFrame, votes: DataFrame, keys: Sequence[str] = ("profile", "key")) -> DataFrame:
    """JN-19: what was sent, with the vote if there is one."""
    return emailed.join(votes.select(*keys, "vote", "reason"), list(keys), "left")


def liked_companies(verdicts: DataFrame, boards: DataFrame) -> DataFrame:
    """JN-19: companies that fit, with their board if one is known."""
    return verdicts.where("fits").join(boards.select("company_id", "ats", "slug"), "company_id", "left")


def find_short(matches: DataFrame, short: str) -> DataFrame:
    """JN-20: the judged posting that a digest's short id stands for."""
    return matches.where(T.short_hash(F.concat_ws("|", "profile", "key")) == short)


def votes_since(votes: DataFrame, at: Column) -> DataFrame:
    """RK-10: votes from a time on, oldest first."""
    return votes.where(c("at") >= at).orderBy("at", "vote_id")


def high_water(votes: DataFrame) -> DataFrame:
    """AGG-13: the time up to which votes were taken, '' for none."""
    return votes.agg(F.coalesce(F.max("at"), F.lit("")).alias("at"))


# ---------------------------------------------------------------- companies, boards and feeds


def companies_due(companies: DataFrame, wanted: DataFrame, covered: DataFrame, now: Column, days: int = RETRY_DAYS) -> DataFrame:
    """JN-13, ST-09: wanted companies that weren't looked up, or not found some time ago, and that no source covers."""
    old = F.coalesce(c("checked_at") < now - F.make_dt_interval(F.lit(days)), F.lit(True))
    open_ones = companies.where((c("status") == "pending") | ((c("status") == "none") & old))
    return open_ones.join(wanted.select("company_id"), "company_id", "left_semi").join(covered.select("company_id"), "company_id", "left_anti")


def frontier(links: DataFrame, read: DataFrame, most: int = CRAWL_PAGES) -> DataFrame:
    """RK-11, SRC-29: the next pages of each site within its budget: board links, other hosts, few slashes first.

    ``links``: site, url, board, own_host; ``read``: site, url of pages that were read and count against the budget.
    """
    new = links.join(read.select("site", "url"), ["site", "url"], "left_anti").dropDuplicates(["site", "url"])
    spent = read.groupBy("site").agg(F.count(F.lit(1)).alias("spent"))
    slashes = F.length("url") - F.length(F.translate("url", "/", ""))
    left = new.join(spent, "site", "left").withColumn("left", F.greatest(F.lit(0), F.lit(most) - F.coalesce("spent", F.lit(0))))
    return top_per(left, ["site"], [~c("board"), c("own_host"), slashes, c("url")], c("left"), "rank", most).drop("left", "spent")


def active_feeds(feeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC-21: feeds of which every setting that they need is there; ``feeds``: name, needs (array)."""
    return feeds.where(F.size(F.array_except("needs", T.lit_array(keys))) == 0)


def found_sources(companies: DataFrame) -> DataFrame:
    """AGG-10: boards that were found, as sorted lists by kind."""
    return companies.where("status = 'found'").groupBy("ats").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))


def unknown_titles(postings: DataFrame, known: DataFrame) -> DataFrame:
    """AGG-17: normalised titles without a verdict, with the first shown title and how many postings have it."""
    keyed = postings.withColumn("title_key", T.title_norm(c("title"))).join(known.select("title_key"), "title_key", "left_anti")
    return keyed.groupBy("title_key").agg(F.min_by("title", "seq").alias("title"), F.count(F.lit(1)).alias("postings"))


def union_of_lists(profiles: DataFrame, column: str) -> DataFrame:
    """AGG-20: what the lists of all profiles hold, each once."""
    return profiles.select(F.explode(column).alias(column)).distinct().orderBy(column)


def total_size(df: DataFrame, column: str) -> DataFrame:
    """AGG-19: the summed length of lists."""
    return df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("total"))


def mark(df: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """DML-12: set a column of the rows with these keys."""
    marked = df.join(keys.select(c(key), F.lit(True).alias("__marked")).distinct(), key, "left")
    return marked.withColumn(column, F.when(c("__marked"), value).otherwise(c(column))).drop("__marked")


def log_run(runs: DataFrame, path: str) -> None:
    """SNK-07: append rows about runs."""
    runs.write.mode("append").parquet(path)


def export(df: DataFrame, key: str) -> DataFrame:
    """SNK-08: a JSON document of each person's row."""
    return df.select(key, F.to_json(F.struct(*[n for n in df.columns if n != key])).alias("document"))


# ---------------------------------------------------------------- how it shows


def is_bot(agent: Column) -> Column:
    """FN-41: no user agent is one of a bot."""
    return F.coalesce(F.nullif(agent, F.lit("")), F.lit("bot")).rlike(BOTS)


def snippet(text: Column, n: int = 200) -> Column:
    """FN-37."""
    return F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), F.lit(n))


def salary_text(low: Column, high: Column, currency: Column, kind: Column, confidence: Column) -> Column:
    """FN-37: '1,000–2,000 EUR (type, confidence)', or 'unknown'."""
    shown = lambda x: F.when(F.coalesce(x, F.lit(0)) != 0, F.format_number(F.floor(x), 0))
    text = lambda x: F.coalesce(x, F.lit(""))
    pay = F.concat_ws("–", shown(low), shown(high))
    return F.when(pay == "", "unknown").otherwise(F.concat(pay, F.lit(" "), text(currency), F.lit(" ("), text(kind), F.lit(", "), text(confidence), F.lit(")")))


def why(role: Column, place: Column, remote: Column, hits: Column, said: dict[str, str]) -> Column:
    """FN-38: why a posting matches; ``said`` has the person's words for role, remote, worldwide and mentions, with {} in them."""
    put = lambda key, x: F.replace(F.lit(said[key]), F.lit("{}"), x)
    where = F.when(place == "worldwide", F.lit(said["worldwide"])).otherwise(place)
    parts = [put("role", role), F.when(~_blank(place), F.when(remote, put("remote", where)).otherwise(where)), F.when(F.size(hits) > 0, put("mentions", F.array_join(hits, ", ")))]
    return F.concat_ws(" · ", *parts)


def click_source(sponsor: Column, partner: Column, source: Column) -> Column:
    """FN-38: what a click is counted under: a sponsor before a partner before the source."""
    kind = F.when(~_blank(sponsor), "sponsored").when(~_blank(partner), "partner").otherwise("job")
    return F.struct(kind.alias("kind"), F.when(~_blank(sponsor), sponsor).when(~_blank(partner), partner).otherwise(source).alias("name"))


def subject(n: Column, none: str, one: str, many: str) -> Column:
    """FN-38: the subject for so many postings; ``many`` has {} for the number."""
    return F.when(n == 0, none).when(n == 1, one).otherwise(F.replace(F.lit(many), F.lit("{}"), n.cast("string")))


def vote_payload(profile: Column, key: Column, title: Column, company: Column) -> Column:
    """FN-39: what a vote link says, shortened, in base64 for addresses without padding; the caller signs it."""
    said = F.to_json(F.struct(profile.alias("p"), key.alias("k"), F.left(title, F.lit(100)).alias("t"), F.left(company, F.lit(60)).alias("c")))
    return F.rtrim(F.translate(F.regexp_replace(F.base64(said.cast("binary")), r"\s", ""), "+/", "-_"), F.lit("="))


def flat_strings(strings: DataFrame) -> DataFrame:
    """FN-36: ``lang, key, value`` of nested JSON objects (``lang, document``), keys with dots between their parts; one round a
    level, until no value is an object."""
    scratch = Scratch(strings.sparkSession, "strings")
    left = scratch.table(strings.select("lang", F.lit("").alias("key"), c("document").alias("value")), "level")
    done = left.where("false")
    while not left.isEmpty():
        inner = left.select("lang", "key", F.explode(F.from_json("value", "map<string,string>")).alias("k", "value"))
        level = scratch.table(inner.select("lang", F.when(c("key") == "", c("k")).otherwise(F.concat_ws(".", "key", "k")).alias("key"), "value"), "level")
        done = done.unionByName(level.where(~F.startswith("value", F.lit("{"))))
        left = level.where(F.startswith("value", F.lit("{")))
    return done


def translated(flat: DataFrame, langs: Sequence[str], fallback: str = "en") -> DataFrame:
    """JN-21: every key of the fallback in each language, in the fallback's words where a language has none."""
    wanted = flat.where(c("lang") == fallback).select("key", c("value").alias("__base"), F.explode(T.lit_array(langs)).alias("lang"))
    return wanted.join(flat, ["lang", "key"], "left").select("lang", "key", F.coalesce("value", "__base").alias("value"))


# ---------------------------------------------------------------- derived searches

DERIVED = "target_roles array<string>, fields array<string>, questions array<string>, clarity int"


def validate(answer: Column) -> Column:
    """FN-34: a model's answer in the schema of a search: missing lists are empty; null if it isn't an object."""
    parsed = F.from_json(answer, DERIVED)
    some = lambda n: F.coalesce(parsed[n], F.array().cast("array<string>")).alias(n)
    made = F.struct(some("target_roles"), some("fields"), some("questions"), F.coalesce(parsed["clarity"], F.lit(3)).alias("clarity"))
    return F.when(F.trim(answer).startswith("{") & T.is_json(answer), made)


def searchable(derived: Column) -> Column:
    """FN-34."""
    return (F.size(derived["target_roles"]) > 0) | (F.size(derived["fields"]) > 0)


def needs_help(derived: Column) -> Column:
    """FN-34: whether the next mail asks for more: a vague or unsearchable text, and something to ask."""
    can = searchable(derived)
    return derived.isNotNull() & ((derived["clarity"] <= 3) | ~can) & ((F.size(derived["questions"]) > 0) | ~can)
