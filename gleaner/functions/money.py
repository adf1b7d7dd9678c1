"""Salaries, dates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V


def lookup(table: dict, key: Column) -> Column:
    """A literal map's value, null where the key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def to_eur(amount: Column, currency: Column) -> Column:
    """FN-19: euro by fixed rates; an unknown currency counts as euro; null if the amount is no number."""
    rate = lookup(V.FX, F.upper(F.coalesce(F.nullif(currency, F.lit("")), F.lit("EUR"))))
    return amount.try_cast("double") * F.coalesce(rate, F.lit(1.0))


def top_salary(low: Column, high: Column, currency: Column) -> Column:
    """The stated maximum, else minimum, in euro; 0 counts as not stated."""
    return to_eur(F.coalesce(F.nullif(high, F.lit(0.0)), low), currency)


def source_kind(partner: Column, direct: Column) -> Column:
    return F.when(F.coalesce(partner, F.lit("")) != "", "partner").when(direct, "direct").otherwise("source")


def source_label(source: Column, partner: Column, direct: Column) -> Column:
    """FN-20: the attribution of a posting."""
    kind = source_kind(partner, direct)
    named = F.concat(F.lit("source: "), F.coalesce(lookup(V.SOURCE_NAMES, source), source))
    return F.when(kind == "partner", F.concat(F.lit("via "), partner)).when(kind == "direct", "employer's career page").otherwise(named)


def parse_time(v: Column) -> Column:
    """FN-04: epoch seconds or milliseconds, or ISO 8601; null if it is neither."""
    number = v.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    return F.when(v.rlike(r"^\d+(\.\d+)?$"), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(F.nullif(v, F.lit(""))))


def parse_mail_date(v: Column) -> Column:
    """FN-05: an RFC 822 date; the name of the day is dropped, hours may have one digit."""
    plain = F.regexp_replace(v, "^[A-Za-z]{3}, *", "")
    zone = F.regexp_replace(plain, " (GMT|UTC|UT|Z)$", " +0000")
    return F.try_to_timestamp(zone, F.lit("d MMM yyyy H:mm:ss Z"))


def parse_days_ago(v: Column, now: Column) -> Column:
    """FN-06: 'Posted Today', 'Posted Yesterday', 'Posted 30+ Days Ago' relative to ``now``."""
    s = F.lower(F.coalesce(v, F.lit("")))
    days = F.when(s.contains("today"), 0).when(s.contains("yesterday"), 1).otherwise(F.nullif(F.regexp_extract(s, r"(\d+)\+?\s*days?", 1), F.lit("")).try_cast("int"))
    return F.when(days.isNotNull(), now - F.make_dt_interval(days))


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """FN-40: doubling pauses up to a cap."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
