"""Ordered rule filters of a saved search; the first rule that fails names the reason."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions.money import top_salary


@dataclass(frozen=True)
class Profile:
    """A saved search; patterns are regular expressions, matched without regard to case."""

    title_include: tuple[str, ...] = ()
    title_exclude: tuple[str, ...] = ()
    blocked_titles: tuple[str, ...] = ()
    liked_titles: tuple[str, ...] = ()
    blocked_companies: tuple[str, ...] = ()
    home: tuple[str, ...] = ()
    remote_ok: tuple[str, ...] = ()
    max_age_days: int = V.MAX_AGE_DAYS
    direct_ignores_age: bool = True
    floor: float = 0.0
    hard_exclude: tuple[str, ...] = ()
    require_any: tuple[str, ...] = ()
    require_written_in: tuple[str, ...] = ()
    learn_titles: bool = True
    learned: dict[str, bool] = field(default_factory=dict)


def _found(column: Column, patterns) -> Column:
    return column.rlike(T.any_of(patterns)) if patterns else F.lit(False)


def title_ok(p: Profile, title: Column) -> Column:
    """FLT-02."""
    key = T.title_norm(title)
    accepted = [t for t, fits in p.learned.items() if fits] + list(p.liked_titles)
    bad = (key.isin(*p.blocked_titles) if p.blocked_titles else F.lit(False)) | _found(title, p.title_exclude)
    good = _found(title, p.title_include) | (key.isin(*accepted) if accepted else F.lit(False))
    return ~bad & good


def location_class(p: Profile, location: Column, text: Column, remote: Column) -> Column:
    """FN-23: 'local', 'remote' or ''."""
    place = F.trim(F.coalesce(location, F.lit("")))
    home = place.rlike(T.places_pattern(p.home)) if p.home else F.lit(False)
    region = (lambda c: c.rlike(T.places_pattern(p.remote_ok))) if p.remote_ok else (lambda c: F.lit(False))
    is_remote = remote | place.rlike(T.I + V.REMOTE)
    bare = (place == "") | place.rlike(T.I + r"^\W*(remote|anywhere|fully remote)\W*$")
    named = bare & region(F.left(text, F.lit(4000))) & ~text.rlike(T.I + V.US_ONLY)
    return F.when(home, "local").when(is_remote & (region(place) | named), "remote").otherwise("")


def is_contract(title: Column, employment_type: Column) -> Column:
    """FN-22."""
    return title.rlike(T.I + V.CONTRACT) | F.coalesce(employment_type, F.lit("")).rlike(T.I + V.CONTRACT)


def too_old(p: Profile, posted: Column, direct: Column, now: Column) -> Column:
    """FLT-03: no date is never too old."""
    old = F.coalesce(posted < now - F.make_dt_interval(F.lit(p.max_age_days)), F.lit(False))
    return old & ~direct if p.direct_ignores_age else old


def below_floor(p: Profile, low: Column, high: Column, currency: Column) -> Column:
    """FLT-04: amounts under 1000 are no yearly salaries."""
    top = top_salary(low, high, currency)
    return F.coalesce((top >= 1000) & (top < p.floor), F.lit(False)) if p.floor else F.lit(False)


def hard_excluded(p: Profile, text: Column) -> Column:
    """FLT-05: the snippet that the first matching pattern finds, or ''."""
    hits = [F.nullif(F.left(F.regexp_extract(text, f"{T.I}{x}", 0), F.lit(80)), F.lit("")) for x in p.hard_exclude]
    return F.coalesce(*hits, F.lit(""))


def requirement_missing(p: Profile, text: Column) -> Column:
    """FLT-06."""
    if not p.require_any and not p.require_written_in:
        return F.lit(False)
    spoken = T.written_in(text).isin(*p.require_written_in) if p.require_written_in else F.lit(False)
    return ~_found(text, p.require_any) & ~spoken


def prefilter(p: Profile, now: Column, check_title: bool = True) -> Column:
    """FLT-01: '' for a posting that passes, else the reason of the first rule that fails."""
    c = F.col
    place = location_class(p, c("location"), c("text"), c("remote"))
    hit = hard_excluded(p, c("text"))
    rules = [(T.company_key(c("company")).isin(*p.blocked_companies), F.lit("company"))] if p.blocked_companies else []
    if check_title:
        rules.append((~title_ok(p, c("title")), F.lit("title")))
    rules += [
        ((place == "") & ~is_contract(c("title"), c("employment_type")), F.lit("location")),
        (too_old(p, c("posted"), c("direct"), now), F.lit("too old")),
        (below_floor(p, c("salary_min"), c("salary_max"), c("currency")), F.lit("stated salary below floor")),
        (hit != "", F.concat(F.lit("excluded: “"), hit, F.lit("”"))),
        (requirement_missing(p, c("text")), F.lit("requirement not met")),
    ]
    return F.coalesce(*[F.when(test, reason) for test, reason in rules], F.lit(""))


def worth_asking(p: Profile, now: Column) -> Column:
    """FLT-07: undecided titles of postings that pass all other rules, or that only lack their text."""
    if not p.learn_titles:
        return F.lit(False)
    title, key = F.col("title"), T.title_norm(F.col("title"))
    known = tuple(p.learned) + p.blocked_titles
    reason = prefilter(p, now, check_title=False)
    bare = (reason == "") | (reason == "requirement not met") | ((reason == "location") & (F.col("location") == ""))
    open_ = (~key.isin(*known) if known else F.lit(True)) & ~_found(title, p.title_exclude)
    return open_ & F.when(F.col("text") == "", bare).otherwise(reason == "")


def page_is_dead(status: Column, body: Column) -> Column:
    """SRC-27: an error status or a phrase of closed postings."""
    return (F.coalesce(status, F.lit(599)) >= 400) | F.lower(F.coalesce(body, F.lit(""))).rlike("|".join(V.DEAD_PAGE))
