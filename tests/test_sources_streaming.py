"""Connectors over captured payloads, board links, streams and model calls."""

import json
import random

from pyspark.sql import functions as F

from gleaner import source_queries
from gleaner.model.client import chat, judge_titles
from gleaner.operators import catalog, discovery
from gleaner.operators.buckets import BucketTable
from gleaner.sources import boards
from gleaner.streaming import jobs
from test_operators import postings

PAYLOADS = {
    "greenhouse": ("acme", {"jobs": [{"title": "T", "absolute_url": "https://g/1", "location": {"name": "Berlin"}, "content": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;", "updated_at": "2024-01-02T00:00:00Z"}]}),
    "lever": ("acme", [{"text": "T", "hostedUrl": "https://l/1", "categories": {"allLocations": ["X", "Y"], "commitment": "Full"}, "country": "DE", "descriptionPlain": "d", "lists": [{"text": "L", "content": "<li>i</li>"}], "workplaceType": "remote", "createdAt": 1700000000000, "salaryRange": {"min": 1, "max": 2, "currency": "EUR"}}]),
    "ashby": ("acme", {"jobs": [{"title": "T", "jobUrl": "https://a/1", "isListed": False}, {"title": "U", "jobUrl": "https://a/2", "location": "P", "secondaryLocations": [{"location": "Q"}], "address": {"postalAddress": {"addressCountry": "R"}}, "isRemote": True, "compensation": {"summaryComponents": [{"compensationType": "Equity"}, {"compensationType": "Salary", "minValue": 5, "maxValue": 6, "currencyCode": "USD"}]}}]}),
    "smartrecruiters": ("acme", {"content": [{"id": "9", "name": "T", "location": {"city": "Wien", "country": "at", "remote": True}, "releasedDate": "2024-01-01T00:00:00.000Z"}]}),
    "recruitee": ("acme", {"offers": [{"title": "T", "url": "https://r/1", "city": "Porto", "country": "Portugal", "description": "<b>x</b>", "requirements": "y"}]}),
    "workable": ("acme", {"name": "Acme Inc", "jobs": [{"title": "T", "shortlink": "https://w/1", "city": "A", "country": "B", "telecommuting": True}]}),
    "workday": ("acme,wd5,Site", {"jobPostings": [{"title": "T", "externalPath": "/job/1", "locationsText": "3 Locations", "postedOn": "Posted Today"}]}),
    "remotive": ("all", {"jobs": [{"company_name": "C", "title": "T", "url": "https://m/1", "description": "x"}]}),
    "remoteok": ("all", [{"legal": "x"}, {"company": "C", "position": "T", "url": "https://k/1", "epoch": 1700000000, "salary_min": 0, "salary_max": 9}, {"company": "C"}]),
    "arbeitnow": ("all", {"data": [{"company_name": "C", "title": "T", "url": "https://n/1", "remote": True, "job_types": ["a", "b"]}]}),
    "himalayas": ("all", {"jobs": [{"companyName": "C", "title": "T", "guid": "https://h/1", "locationRestrictions": []}]}),
    "jobicy": ("all", {"jobs": [{"companyName": "C", "jobTitle": "R&amp;D", "url": "https://j/1", "jobType": ["full"]}]}),
    "adzuna": ("gb", {"results": [{"company": {"display_name": "C"}, "title": "<b>T</b> remote", "redirect_url": "https://z/1", "contract_time": "full_time", "salary_max": 7.5}]}),
    "jooble": ("all", {"jobs": [{"company": "C", "title": "T", "link": "https://o/1", "snippet": "s"}]}),
    "careerjet": ("all", {"jobs": [{"company": "", "title": "T", "url": "https://c/1"}]}),
}
PERSONIO = "<workzag-jobs><position><id>7</id><office>Bonn</office><additionalOffices><additionalOffice>Remote</additionalOffice></additionalOffices><name>T</name><employmentType>permanent</employmentType><schedule>full</schedule><jobDescriptions><jobDescription><name>n</name><value>&lt;p&gt;v&lt;/p&gt;</value></jobDescription></jobDescriptions></position></workzag-jobs>"
RSS = "<rss><channel><item><title>Data Engineer (Warszawa, PL, 00-839)</title><link>https://s/1?x=1</link><description>d</description><pubDate>Mon, 02 Jun 2025 0:00:00 GMT</pubDate></item></channel></rss>"


def test_all_sources(spark, tmp_path):
    for name, (owner, payload) in PAYLOADS.items():
        (folder := tmp_path / name / owner).mkdir(parents=True)
        (folder / "1.json").write_text(json.dumps(payload))
    for name, owner, xml in (("personio", "acme", PERSONIO), ("successfactors", "jobs.gft.com", RSS)):
        (folder := tmp_path / name / owner).mkdir(parents=True)
        (folder / "1.xml").write_text(xml)
    df, errors = boards.read_all(spark, f"file://{tmp_path}", [*PAYLOADS, "personio", "successfactors", "jobs_of_nobody", "missing"])
    assert set(errors) == {"jobs_of_nobody", "missing"}
    got = {r["source"]: r for r in df.collect()}
    assert set(got) == {*PAYLOADS, "personio", "successfactors"} - {"careerjet"}  # no company
    assert got["greenhouse"]["text"] == "a & b" and got["greenhouse"]["company"] == "acme" and got["greenhouse"]["direct"]
    assert got["lever"]["location"] == "X; Y; Germany" and got["lever"]["text"] == "d\nL\n i" and got["lever"]["remote"]
    assert (got["ashby"]["title"], got["ashby"]["location"], got["ashby"]["salary_min"]) == ("U", "P; Q; R", 5.0)
    assert got["smartrecruiters"]["location"] == "Wien, Austria" and got["smartrecruiters"]["url"].endswith("/acme/9")
    assert got["workable"]["company"] == "Acme Inc" and got["workable"]["remote"]
    assert got["workday"]["url"] == "https://acme.wd5.myworkdayjobs.com/Site/job/1" and got["workday"]["location"] == "" and got["workday"]["posted"]
    assert got["remoteok"]["salary_min"] is None and got["remoteok"]["salary_max"] == 9.0
    assert got["himalayas"]["location"] == "Anywhere" and got["jobicy"]["title"] == "R&D"
    assert got["adzuna"]["currency"] == "GBP" and got["adzuna"]["remote"] and got["adzuna"]["employment_type"] == "full_time"
    assert got["personio"]["location"] == "Bonn, Remote" and got["personio"]["text"] == "v" and got["personio"]["remote"]
    s = got["successfactors"]
    assert (s["title"], s["location"], s["url"], s["company"]) == ("Data Engineer", "Warszawa, Poland", "https://s/1", "gft")
    assert str(s["posted"]) == "2025-06-02 00:00:00"
    details = spark.createDataFrame([(got["workday"]["url"], "long text", "Bonn", "full")], "url string, text string, location string, employment_type string")
    rich = boards.enrich(df, details).where("source = 'workday'").first()
    assert (rich["text"], rich["location"]) == ("long text", "Bonn")


def test_board_links(spark):
    html = '<a href="https://boards.greenhouse.io/embed/job_board?for=acme">x</a> https://jobs.lever.co/Beta-1/x acme.wd3.myworkdayjobs.com/en-US/Careers2 jobs.lever.co/Beta-1 apply.workable.com/api https://careers.smartrecruiters.com/Z'
    df = spark.createDataFrame([(html,), ("",)], "h string").select(discovery.board_links(F.col("h")).alias("l"))
    got = [[(x["ats"], x["slug"]) for x in r["l"]] for r in df.collect()]
    assert got == [[("greenhouse", "acme"), ("lever", "Beta-1"), ("smartrecruiters", "Z"), ("workday", "acme/wd3/Careers2")], []]


def test_pick_board(spark):
    c = spark.createDataFrame([("x", 0, "lever", "a", True), ("x", 1, "ashby", "b", False), ("y", 0, "lever", "a", True)], "company_id string, pos int, ats string, slug string, guessed boolean")
    p = spark.createDataFrame([("lever", "a", True, 3, False), ("ashby", "b", True, 0, False)], "ats string, slug string, ok boolean, jobs int, name_matches boolean")
    assert [tuple(r) for r in discovery.pick_board(c, p).collect()] == [("x", "ashby", "b")]


def test_not_shown(spark):
    s = spark.createDataFrame([(1, "u"), (1, "v")], "search_id long, url string")
    shown = spark.createDataFrame([(1, "u", "2024-01-20"), (1, "v", "2023-11-01")], "search_id long, url string, at string").withColumn("shown_at", F.col("at").cast("timestamp"))
    assert [r["url"] for r in catalog.not_shown(s, shown, F.lit("2024-02-01").cast("timestamp")).collect()] == ["v"]


def events(spark, tmp_path, n=300):
    rng = random.Random(13)
    rows = sorted((rng.randrange(86_400 * 2), rng.randrange(5)) for _ in range(n))
    df = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(rows)], "event_id long, t long, user_id long")
    df = df.select("event_id", F.timestamp_seconds(F.col("t") + 1_704_067_200).alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    df.orderBy("event_id").coalesce(1).write.parquet(f"{tmp_path}/events")
    return rows, jobs.read_events(spark, f"{tmp_path}/events")


def test_rate_limit_equals_a_queue(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    out = jobs.run_to_files(jobs.rate_limit(stream, 2, 3600), f"{tmp_path}/o1", f"{tmp_path}/c1").collect()
    held, want = {}, {}
    for i, (t, u) in enumerate(rows):
        q = [x for x in held.get(u, []) if x > t - 3600]
        want[i] = len(q) < 2
        held[u] = q + [t] * want[i]
    assert {r["event_id"]: r["allowed"] for r in out} == want and False in want.values()


def test_repeats_and_counts(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    shown = jobs.run_to_files(jobs.repeat_after(stream, 1), f"{tmp_path}/o1", f"{tmp_path}/c1").collect()
    last, want = {}, []
    for i, (t, u) in enumerate(rows):
        if u not in last or last[u] <= t - 86_400:
            last[u] = t
            want.append(i)
    assert sorted(r["event_id"] for r in shown) == want
    daily = jobs.run_to_files(jobs.daily_counts(stream, "user_id"), f"{tmp_path}/o2", f"{tmp_path}/c2", complete=True)
    assert daily.agg(F.sum("n")).first()[0] == len(rows)
    once = jobs.run_to_files(jobs.once_ever(stream, ["user_id"]), f"{tmp_path}/o3", f"{tmp_path}/c3")
    assert once.count() == 5


def test_upsert_stream(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    table = BucketTable(spark, f"file://{tmp_path}/state", "user_id long, event_id long", ["user_id"], 4)
    changes = stream.select("user_id", "event_id", F.col("event_id").alias("arrival"))
    for _ in range(2):  # the second run finds nothing new
        jobs.upsert_stream(changes, table, f"{tmp_path}/c4").awaitTermination()
    want = spark.read.parquet(f"{tmp_path}/events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert {tuple(r) for r in table.read().collect()} == {tuple(r) for r in want.collect()} and table.version() == 1


def test_model_calls(spark):
    def make_client():  # local, so that it travels with the task
        def client(system, prompt):
            if "bad" in prompt:
                raise ValueError("no answer")
            return 'thinking {"fits": [1, "2"]}'

        return client

    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")
    got = {r["id"]: (r["answer"], r["error"]) for r in chat(prompts, make_client, "s").collect()}
    assert got == {1: ('{"fits": [1, "2"]}', None), 2: (None, "ValueError: no answer")}
    titles = spark.createDataFrame([("p", t) for t in ("a", "b", "c", "bad")], "profile string, title string")
    judged = {r["title"]: r["fits"] for r in judge_titles(titles, make_client, "s", size=2).collect()}
    assert judged == {"a": True, "b": True}  # of the call with "bad" in it nothing is decided


def test_payloads_as_lines(spark, tmp_path):
    """Many payloads a file, one a line, give what a file each gives, from files whose number doesn't grow with them."""
    p = postings(spark, [{"company": "Acme", "title": f"Ring & bolt {i}".replace("&", "und")} for i in range(300)]).coalesce(1)
    for name in ("jooble", "personio"):
        for kind, lines in (("files", False), ("lines", True)):
            source_queries.write_payloads(p, name, f"{tmp_path}/{kind}/{name}", lines)
        each, many = (boards.read_source(spark, name, f"{tmp_path}/{kind}/{name}", lines) for kind, lines in (("files", False), ("lines", True)))
        assert sorted(map(tuple, each.drop("posted").collect()), key=str) == sorted(map(tuple, many.drop("posted").collect()), key=str) and many.count() == 300
