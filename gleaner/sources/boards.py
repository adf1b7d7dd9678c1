"""Connectors: captured payloads of job boards, aggregators and partner feeds to canonical postings.

Payloads land as files (one JSON document or XML feed each) and are read with a fixed schema; a connector is one projection.
``owner`` is the board, company or account that a payload was asked for, taken from a column of the landing table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions.money import lookup, parse_days_ago, parse_mail_date, parse_time
from ..functions.text import I, strip_html, unescape_html
from .postings import conform, union_sources

c = F.col


def _or(*columns) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(x if isinstance(x, Column) else c(x), F.lit("")) for x in columns], F.lit(""))


def _list(*columns, sep: str = ", ") -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(x if isinstance(x, Column) else c(x), F.lit("")) for x in columns]), lambda x: x != ""), sep)


def _country(code: Column) -> Column:
    return F.coalesce(lookup(V.COUNTRIES, F.upper(code)), code)


def _said(pattern: str, *columns) -> Column:
    return F.concat(*[F.coalesce(x if isinstance(x, Column) else c(x), F.lit("")) for x in columns]).rlike(I + pattern)


def _json(schema: str, rows: str | None, payloads: DataFrame) -> DataFrame:
    """Rows of the payloads' array ``rows`` (of a root array if None) as ``j``, next to ``owner`` and the root as ``root``."""
    root = payloads.select("owner", F.from_json("payload", schema).alias("root"))
    return root.select("owner", "root", F.explode(c("root") if rows is None else c(f"root.{rows}")).alias("j"))


def greenhouse(payloads: DataFrame) -> DataFrame:
    j = _json(
        "jobs array<struct<company_name:string,title:string,absolute_url:string,location:struct<name:string>,content:string,first_published:string,updated_at:string>>",
        "jobs",
        payloads,
    )
    return j.select(
        F.lit("greenhouse").alias("source"), _or("j.company_name", "owner").alias("company"), c("j.title"), c("j.absolute_url").alias("url"),
        c("j.location.name").alias("location"), strip_html(c("j.content")).alias("text"), parse_time(_or("j.first_published", "j.updated_at")).alias("posted"), F.lit(True).alias("direct"),
    )


def lever(payloads: DataFrame) -> DataFrame:
    j = _json(
        "array<struct<text:string,hostedUrl:string,categories:struct<location:string,allLocations:array<string>,commitment:string>,country:string,descriptionPlain:string,"
        "lists:array<struct<text:string,content:string>>,additionalPlain:string,workplaceType:string,createdAt:string,salaryRange:struct<min:double,max:double,currency:string>>>",
        None,
        payloads,
    )
    places = F.when(F.size("j.categories.allLocations") > 0, F.array_join(F.filter("j.categories.allLocations", lambda x: x != ""), "; "))
    place = F.coalesce(places, "j.categories.location", F.lit(""))
    country = lookup(V.COUNTRIES, c("j.country"))
    # each list's content is text on its own, but references are decoded for all at once
    lists = F.array_join(F.transform(F.coalesce("j.lists", F.array()), lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n"), F.coalesce(x["content"], F.lit("")))), "\n")
    return j.select(
        F.lit("lever").alias("source"), c("owner").alias("company"), c("j.text").alias("title"), c("j.hostedUrl").alias("url"),
        F.concat(place, F.coalesce(F.concat(F.lit("; "), country), F.lit(""))).alias("location"), (c("j.workplaceType") == "remote").alias("remote"),
        _list("j.descriptionPlain", strip_html(lists), "j.additionalPlain", sep="\n").alias("text"), parse_time(c("j.createdAt")).alias("posted"),
        c("j.categories.commitment").alias("employment_type"), c("j.salaryRange.min").alias("salary_min"), c("j.salaryRange.max").alias("salary_max"),
        c("j.salaryRange.currency").alias("currency"), F.lit(True).alias("direct"),
    )


def ashby(payloads: DataFrame) -> DataFrame:
    j = _json(
        "jobs array<struct<title:string,jobUrl:string,isListed:boolean,location:string,secondaryLocations:array<struct<location:string>>,address:struct<postalAddress:struct<addressCountry:string>>,"
        "isRemote:boolean,workplaceType:string,descriptionPlain:string,publishedAt:string,employmentType:string,"
        "compensation:struct<summaryComponents:array<struct<compensationType:string,minValue:double,maxValue:double,currencyCode:string>>>>>",
        "jobs",
        payloads,
    ).where("j.isListed is null or j.isListed")
    pay = F.try_element_at(F.filter("j.compensation.summaryComponents", lambda x: x["compensationType"] == "Salary"), F.lit(1))
    places = F.concat(F.array("j.location"), F.coalesce(F.col("j.secondaryLocations.location"), F.array()), F.array("j.address.postalAddress.addressCountry"))
    return j.select(
        F.lit("ashby").alias("source"), c("owner").alias("company"), c("j.title"), c("j.jobUrl").alias("url"),
        F.array_join(F.filter(places, lambda x: x != ""), "; ").alias("location"), (F.coalesce("j.isRemote", F.lit(False)) | F.coalesce(c("j.workplaceType") == "Remote", F.lit(False))).alias("remote"),
        c("j.descriptionPlain").alias("text"), parse_time(c("j.publishedAt")).alias("posted"), c("j.employmentType").alias("employment_type"),
        pay["minValue"].alias("salary_min"), pay["maxValue"].alias("salary_max"), pay["currencyCode"].alias("currency"), F.lit(True).alias("direct"),
    )


def smartrecruiters(payloads: DataFrame) -> DataFrame:
    j = _json(
        "content array<struct<id:string,name:string,company:struct<name:string>,location:struct<city:string,region:string,country:string,remote:boolean>,releasedDate:string,typeOfEmployment:struct<label:string>>>",
        "content",
        payloads,
    )
    return j.select(
        F.lit("smartrecruiters").alias("source"), _or("j.company.name", "owner").alias("company"), c("j.name").alias("title"),
        F.concat(F.lit("https://jobs.smartrecruiters.com/"), "owner", F.lit("/"), "j.id").alias("url"),
        _list("j.location.city", "j.location.region", _country(c("j.location.country"))).alias("location"), c("j.location.remote").alias("remote"),
        parse_time(c("j.releasedDate")).alias("posted"), c("j.typeOfEmployment.label").alias("employment_type"), F.lit(True).alias("direct"),
    )


def personio(positions: DataFrame) -> DataFrame:
    """``position`` rows of the XML feed, read by ``read_xml``."""
    g = lambda n: F.trim(F.coalesce(n, F.lit("")))
    offices = F.array_join(F.filter(F.concat(F.array(g("office")), F.coalesce("additionalOffices.additionalOffice", F.array())), lambda x: x != ""), ", ")
    text = F.array_join(F.transform(F.coalesce("jobDescriptions.jobDescription", F.array()), lambda d: F.coalesce(d["value"], F.lit(""))), "\n")
    return positions.select(
        F.lit("personio").alias("source"), _or(g("subcompany"), "owner").alias("company"), g("name").alias("title"),
        F.concat(F.lit("https://"), "owner", F.lit(".jobs.personio.de/job/"), g("id")).alias("url"), offices.alias("location"),
        F.lower(F.concat(offices, g("name"))).contains("remote").alias("remote"), strip_html(text).alias("text"), parse_time(g("createdAt")).alias("posted"),
        F.trim(F.concat_ws(" ", g("employmentType"), g("schedule"))).alias("employment_type"), F.lit(True).alias("direct"),
    )


PERSONIO_SCHEMA = (
    "id string, subcompany string, office string, additionalOffices struct<additionalOffice:array<string>>, name string, employmentType string, schedule string, "
    "createdAt string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
)
RSS_SCHEMA = "title string, link string, description string, pubDate string"


def recruitee(payloads: DataFrame) -> DataFrame:
    j = _json(
        "offers array<struct<company_name:string,title:string,careers_url:string,url:string,city:string,country:string,remote:boolean,description:string,requirements:string,"
        "published_at:string,created_at:string,employment_type_code:string,salary:struct<min:double,max:double,currency:string>>>",
        "offers",
        payloads,
    )
    html = F.concat(F.coalesce("j.description", F.lit("")), F.lit("\n"), F.coalesce("j.requirements", F.lit("")))
    return j.select(
        F.lit("recruitee").alias("source"), _or("j.company_name", "owner").alias("company"), c("j.title"), _or("j.careers_url", "j.url").alias("url"),
        _list("j.city", "j.country").alias("location"), c("j.remote"), strip_html(html).alias("text"), parse_time(_or("j.published_at", "j.created_at")).alias("posted"),
        c("j.employment_type_code").alias("employment_type"), c("j.salary.min").alias("salary_min"), c("j.salary.max").alias("salary_max"), c("j.salary.currency").alias("currency"), F.lit(True).alias("direct"),
    )


def workable(payloads: DataFrame) -> DataFrame:
    j = _json(
        "name string, jobs array<struct<title:string,url:string,shortlink:string,city:string,state:string,country:string,telecommuting:string,description:string,published_on:string,created_at:string,employment_type:string>>",
        "jobs",
        payloads,
    )
    return j.select(
        F.lit("workable").alias("source"), _or("root.name", "owner").alias("company"), c("j.title"), _or("j.url", "j.shortlink").alias("url"),
        _list("j.city", "j.state", "j.country").alias("location"), (F.lower("j.telecommuting") == "true").alias("remote"), strip_html(c("j.description")).alias("text"),
        parse_time(_or("j.published_on", "j.created_at")).alias("posted"), c("j.employment_type"), F.lit(True).alias("direct"),
    )


def successfactors(items: DataFrame) -> DataFrame:
    """``item`` rows of the RSS feed: 'Title (City, CC, ZIP)'; parts with digits go, country codes become names."""
    raw = F.trim(F.coalesce("title", F.lit("")))
    pattern = r"^(.*?)\s*\(([^()]*,[^()]*)\)\s*$"
    placed = raw.rlike(pattern)
    parts = F.filter(F.transform(F.split(F.regexp_extract(raw, pattern, 2), ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"\d"))
    host = F.split("owner", r"\.")
    return items.select(
        F.lit("successfactors").alias("source"), F.when(F.size(host) > 1, F.try_element_at(host, F.lit(-2))).otherwise(c("owner")).alias("company"),
        F.when(placed, F.regexp_extract(raw, pattern, 1)).otherwise(raw).alias("title"), F.split(F.coalesce("link", F.lit("")), r"\?")[0].alias("url"),
        F.array_join(F.transform(parts, lambda x: F.coalesce(lookup(V.COUNTRIES, x), x)), ", ").alias("location"), _said("remote", raw).alias("remote"),
        strip_html(c("description")).alias("text"), parse_mail_date(c("pubDate")).alias("posted"), F.lit(True).alias("direct"),
    )


def workday(payloads: DataFrame, now: Column | None = None) -> DataFrame:
    """``owner`` is 'tenant/wdN/Site'."""
    j = _json("jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", "jobPostings", payloads)
    part = F.split("owner", "/")
    host = F.concat(F.lit("https://"), part[0], F.lit("."), part[1], F.lit(".myworkdayjobs.com/"), part[2])
    place = F.coalesce("j.locationsText", F.lit(""))
    return j.select(
        F.lit("workday").alias("source"), part[0].alias("company"), c("j.title"), F.concat(host, "j.externalPath").alias("url"),
        F.when(place.rlike(r"^\d+ Locations?$"), "").otherwise(place).alias("location"), _said("remote", place).alias("remote"),
        parse_days_ago(c("j.postedOn"), now if now is not None else F.current_timestamp()).alias("posted"), F.lit(True).alias("direct"),
    )


def remotive(payloads: DataFrame) -> DataFrame:
    j = _json("jobs array<struct<company_name:string,title:string,url:string,candidate_required_location:string,description:string,publication_date:string,job_type:string>>", "jobs", payloads)
    return j.select(
        F.lit("remotive").alias("source"), c("j.company_name").alias("company"), c("j.title"), c("j.url"), c("j.candidate_required_location").alias("location"), F.lit(True).alias("remote"),
        strip_html(c("j.description")).alias("text"), parse_time(c("j.publication_date")).alias("posted"), c("j.job_type").alias("employment_type"),
    )


def remoteok(payloads: DataFrame) -> DataFrame:
    """The first element of the root array is a notice."""
    root = payloads.select(F.from_json("payload", "array<struct<company:string,position:string,url:string,location:string,description:string,epoch:string,salary_min:double,salary_max:double>>").alias("r"))
    j = root.select(F.explode(F.slice("r", F.lit(2), F.greatest(F.lit(0), F.size("r") - 1))).alias("j")).where("coalesce(j.position, '') <> ''")
    zero = lambda n: F.nullif(c(n), F.lit(0.0))
    return j.select(
        F.lit("remoteok").alias("source"), c("j.company"), c("j.position").alias("title"), c("j.url"), c("j.location"), F.lit(True).alias("remote"), strip_html(c("j.description")).alias("text"),
        parse_time(c("j.epoch")).alias("posted"), zero("j.salary_min").alias("salary_min"), zero("j.salary_max").alias("salary_max"), F.lit("USD").alias("currency"),
    )


def arbeitnow(payloads: DataFrame) -> DataFrame:
    j = _json("data array<struct<company_name:string,title:string,url:string,location:string,remote:boolean,description:string,created_at:string,job_types:array<string>>>", "data", payloads)
    return j.select(
        F.lit("arbeitnow").alias("source"), c("j.company_name").alias("company"), c("j.title"), c("j.url"), c("j.location"), c("j.remote"), strip_html(c("j.description")).alias("text"),
        parse_time(c("j.created_at")).alias("posted"), F.array_join("j.job_types", " ").alias("employment_type"),
    )


def himalayas(payloads: DataFrame) -> DataFrame:
    j = _json(
        "jobs array<struct<companyName:string,title:string,applicationLink:string,guid:string,locationRestrictions:array<string>,description:string,pubDate:string,employmentType:string,minSalary:double,maxSalary:double,currency:string>>",
        "jobs",
        payloads,
    )
    place = F.coalesce(F.nullif(F.array_join("j.locationRestrictions", "; "), F.lit("")), F.lit("Anywhere"))
    return j.select(
        F.lit("himalayas").alias("source"), c("j.companyName").alias("company"), c("j.title"), _or("j.applicationLink", "j.guid").alias("url"), place.alias("location"), F.lit(True).alias("remote"),
        strip_html(c("j.description")).alias("text"), parse_time(c("j.pubDate")).alias("posted"), c("j.employmentType").alias("employment_type"), c("j.minSalary").alias("salary_min"), c("j.maxSalary").alias("salary_max"), c("j.currency"),
    )


def jobicy(payloads: DataFrame) -> DataFrame:
    j = _json(
        "jobs array<struct<companyName:string,jobTitle:string,url:string,jobGeo:string,jobDescription:string,pubDate:string,jobType:array<string>,salaryMin:double,salaryMax:double,salaryCurrency:string>>", "jobs", payloads
    )
    return j.select(
        F.lit("jobicy").alias("source"), c("j.companyName").alias("company"), unescape_html(c("j.jobTitle")).alias("title"), c("j.url"), c("j.jobGeo").alias("location"), F.lit(True).alias("remote"),
        strip_html(c("j.jobDescription")).alias("text"), parse_time(c("j.pubDate")).alias("posted"), F.array_join("j.jobType", " ").alias("employment_type"),
        c("j.salaryMin").alias("salary_min"), c("j.salaryMax").alias("salary_max"), c("j.salaryCurrency").alias("currency"),
    )


def adzuna(payloads: DataFrame) -> DataFrame:
    """``owner`` is the country code of the request."""
    j = _json(
        "results array<struct<company:struct<display_name:string>,title:string,redirect_url:string,location:struct<display_name:string>,description:string,created:string,contract_type:string,contract_time:string,salary_min:double,salary_max:double>>",
        "results",
        payloads,
    )
    money = F.when(c("owner") == "gb", "GBP").when(c("owner") == "us", "USD").otherwise("EUR")
    return j.select(
        F.lit("adzuna").alias("source"), c("j.company.display_name").alias("company"), strip_html(c("j.title")).alias("title"), c("j.redirect_url").alias("url"), c("j.location.display_name").alias("location"),
        _said("remote", "j.title", "j.description").alias("remote"), strip_html(c("j.description")).alias("text"), parse_time(c("j.created")).alias("posted"),
        F.trim(F.concat_ws(" ", "j.contract_type", "j.contract_time")).alias("employment_type"), c("j.salary_min"), c("j.salary_max"), money.alias("currency"), F.lit("Adzuna").alias("partner"),
    )


def jooble(payloads: DataFrame) -> DataFrame:
    j = _json("jobs array<struct<company:string,title:string,link:string,location:string,snippet:string,updated:string,type:string>>", "jobs", payloads)
    return j.select(
        F.lit("jooble").alias("source"), c("j.company"), strip_html(c("j.title")).alias("title"), c("j.link").alias("url"), c("j.location"), _said("remote", "j.title", "j.snippet").alias("remote"),
        strip_html(c("j.snippet")).alias("text"), parse_time(c("j.updated")).alias("posted"), c("j.type").alias("employment_type"), F.lit("Jooble").alias("partner"),
    )


def careerjet(payloads: DataFrame) -> DataFrame:
    j = _json("jobs array<struct<company:string,title:string,url:string,locations:string,description:string,date:string,salary_min:double,salary_max:double,salary_currency_code:string>>", "jobs", payloads)
    return j.select(
        F.lit("careerjet").alias("source"), c("j.company"), strip_html(c("j.title")).alias("title"), c("j.url"), c("j.locations").alias("location"), _said("remote", "j.title", "j.description").alias("remote"),
        strip_html(c("j.description")).alias("text"), F.coalesce(parse_time(c("j.date")), parse_mail_date(c("j.date"))).alias("posted"), c("j.salary_min"), c("j.salary_max"), c("j.salary_currency_code").alias("currency"), F.lit("Careerjet").alias("partner"),
    )


#: UX-01: connectors by name; those of ``XML`` read feeds with the row tag and schema given.
JSON: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (greenhouse, lever, ashby, smartrecruiters, recruitee, workable, workday, remotive, remoteok, arbeitnow, himalayas, jobicy, adzuna, jooble, careerjet)
}
XML = {"personio": (personio, "position", PERSONIO_SCHEMA), "successfactors": (successfactors, "item", RSS_SCHEMA)}


def _owner(depth: int = 2) -> Column:
    """The folder of a payload file names its owner, with or without ``owner=``; ``,`` stands for ``/``."""
    folder = F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -depth))
    return F.replace(F.regexp_replace(folder, "^owner=", ""), F.lit(","), F.lit("/"))


def read_source(spark: SparkSession, name: str, path: str, lines: bool = False) -> DataFrame:
    """Postings of one source from ``path/owner/file``, a JSON or XML payload each, or with ``lines`` many, one a line. A JSON
    payload that can't be parsed has no postings; ``broken_payloads`` counts them."""
    if name in XML:
        connector, tag, schema = XML[name]
        if lines:
            each = F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))).alias("row")
            rows = spark.read.text(f"{path}/*/*").select(_owner().alias("owner"), each)
            return connector(rows.select("owner", F.from_xml("row", schema).alias("r")).select("r.*", "owner"))
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(f"{path}/*/*")
        return connector(rows.withColumn("owner", _owner()))
    return JSON[name](payloads(spark, path, lines))


def payloads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``owner, payload`` of JSON files, or with ``lines`` of their lines; whatever isn't JSON is null."""
    raw = spark.read.text(f"{path}/*/*", wholetext=not lines).select(_owner().alias("owner"), F.col("value").alias("payload"))
    return raw.withColumn("payload", F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")))


def broken_payloads(spark: SparkSession, root: str, names, lines: bool = False) -> DataFrame:
    """SRC-18: ``source, payloads, broken`` of JSON sources: how many payloads each has, and how many aren't JSON."""
    frames = [payloads(spark, f"{root}/{n}", lines).agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("payloads"), F.count_if(c("payload").isNull()).alias("broken")) for n in names]
    return reduce(DataFrame.unionByName, frames)


def read_all(spark: SparkSession, root: str, names, lines: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """SRC-18: the union of sources under ``root/name``, and what went wrong with those that can't be read."""
    frames, errors = {}, {}
    for name in names:
        try:
            frames[name] = conform(read_source(spark, name, f"{root}/{name}", lines))
            frames[name].schema  # noqa: B018  a missing path shows here
        except Exception as e:  # noqa: BLE001  one source must not stop the others
            frames.pop(name, None)
            errors[name] = f"error: {str(e).splitlines()[0][:200]}"
    return (union_sources(frames) if frames else conform(spark.createDataFrame([], "url string"))), errors


def enrich(postings: DataFrame, details: DataFrame) -> DataFrame:
    """SRC-20: text, place and type from a details table (by ``url``) for postings that lack their text. Join after the
    title filter, so that details are only needed for what passes."""
    d = details.select("url", *[F.col(x).alias(f"_{x}") for x in ("text", "location", "employment_type")])
    bare = F.col("text") == ""
    fill = lambda n: F.when(bare, F.coalesce(F.nullif(F.col(f"_{n}"), F.lit("")), F.col(n))).otherwise(F.col(n))
    out = postings.join(d, "url", "left")
    return out.select(*[fill(n).alias(n) if n in ("text", "location", "employment_type") else F.col(n) for n in postings.columns])


def merge_specs(specs: DataFrame) -> DataFrame:
    """SRC-19: ``name, owners`` of many source lists (``name, owners`` arrays), as sorted sets."""
    return specs.select("name", F.explode("owners").alias("o")).groupBy("name").agg(F.array_sort(F.collect_set("o")).alias("owners"))
