"""A catalog of other sites, and which of them fit a saved search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import lookup
from .ranking import top_per

# Regions that stand for countries, and names of languages.
REGIONS = {"dach": ["germany", "austria", "switzerland"], "uk": ["united kingdom"], "great britain": ["united kingdom"]}
LANGUAGES = {
    "german": "german", "deutsch": "german", "de": "german", "english": "english", "englisch": "english", "en": "english", "spanish": "spanish",
    "español": "spanish", "castellano": "spanish", "spanisch": "spanish", "es": "spanish", "french": "french", "français": "french",
    "französisch": "french", "fr": "french",
}

CATALOG_SCHEMA = "pos int, id string, name string, search string, search_where string, countries array<string>, languages array<string>, types array<string>, topics array<string>"


def countries(names: Column) -> Column:
    """FN-27: lower-case countries, regions expanded."""
    plain = F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: n != "")
    expand = lambda n: F.coalesce(*[F.when(n == k, T.lit_array(v)) for k, v in REGIONS.items()], F.array(n))
    return F.array_distinct(F.flatten(F.transform(plain, expand)))


def languages(names: Column, of_mail: Column | None = None) -> Column:
    """FN-27: known languages among the words of the names, and that of the mail."""
    words = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(F.lower(n), F.lit("[a-zà-ÿ]+"), F.lit(0))))
    if of_mail is not None:
        words = F.concat(words, F.array(F.lower(of_mail)))
    known = F.filter(F.transform(words, lambda n: lookup(LANGUAGES, n)), lambda n: n.isNotNull())
    return F.array_sort(F.array_distinct(known))


def place(places: Column, remote_only: Column) -> Column:
    """FN-27: the first place that is named, unless only remote work is wanted."""
    first = F.get(F.filter(places, lambda p: F.trim(p) != ""), 0)
    return F.when(remote_only, "").otherwise(F.coalesce(F.trim(first), F.lit("")))


def partner_requests(searches: DataFrame, most_queries: int = 3, most_countries: int = 2) -> DataFrame:
    """SRC-22: ``query, country`` of the requests that searches need, each once: the first queries of each, squeezed, for its
    first countries. ``searches``: search_queries, countries (arrays)."""
    asked = searches.select(F.explode(F.slice("search_queries", 1, most_queries)).alias("q"), F.slice("countries", 1, most_countries).alias("cs"))
    asked = asked.select(F.lower(F.trim(F.regexp_replace("q", r"\s+", " "))).alias("query"), F.explode("cs").alias("c"))
    return asked.select("query", F.lower("c").alias("country")).where("query <> ''").distinct()


def fits(site_list: str, own: Column) -> Column:
    """FLT-14: an empty criterion fits all, another needs something in common."""
    return F.coalesce(F.size(site_list) == 0, F.lit(True)) | F.arrays_overlap(site_list, own)


def suggest(searches: DataFrame, catalog: DataFrame, n: int | None = None) -> DataFrame:
    """RK-08: the sites that fit a search, those with topics first, each with a prepared address.

    ``searches``: search_id, query, place, countries, languages, types (arrays), blob (lower-case text). Sites meet searches
    by a country that both name, or that the site leaves open, so a search isn't compared with sites of other countries.
    Without ``n`` all that fit are returned.
    """
    open_to = F.when(F.coalesce(F.size("countries") == 0, F.lit(True)), F.array(F.lit("*"))).otherwise(F.col("countries"))
    catalog = catalog.withColumn("country", F.explode(F.array_distinct(open_to)))
    s = searches.where(F.col("query") != "").withColumnsRenamed({"countries": "own_countries", "languages": "own_languages", "types": "own_types"})
    topic = F.coalesce(F.size("topics") == 0, F.lit(True)) | F.exists("topics", lambda t: T.has_phrase(F.col("blob"), t))
    s = s.withColumn("country", F.explode(F.array_distinct(F.concat(F.array(F.lit("*")), F.coalesce("own_countries", F.array())))))
    rows = s.join(catalog, "country").where(fits("languages", F.col("own_languages")) & fits("types", F.col("own_types")) & topic)
    rows = rows.dropDuplicates(["search_id", "pos", "id"])  # a site may share two countries with a search
    placed = (F.col("place") != "") & (F.coalesce("search_where", F.lit("")) != "")
    plus = lambda c: F.url_encode(c)
    url = F.when(placed, F.col("search_where")).otherwise(F.col("search"))
    for key, value in (("{q}", plus(F.col("query"))), ("{q_slug}", T.slug(F.col("query"))), ("{where}", plus(F.col("place"))), ("{where_slug}", T.slug(F.col("place")))):
        url = F.replace(url, F.lit(key), value)
    order = [(F.coalesce(F.size("topics"), F.lit(0)) > 0).desc(), F.col("pos")]
    rows = rows.select("search_id", "pos", "topics", "id", "name", url.alias("url"), F.when(placed, F.col("place")).otherwise("").alias("where"))
    if n is None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("search_id").orderBy(*order))).drop("topics", "pos")
    return top_per(rows, ["search_id"], order, n, "rank").drop("topics", "pos")


def not_shown(suggestions: DataFrame, shown: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """JN-16: suggestions that weren't shown to the search within the last days."""
    late = shown.where(F.col("shown_at") > now - F.make_dt_interval(F.lit(days))).select("search_id", "url")
    return suggestions.join(late, ["search_id", "url"], "left_anti")
