"""Digests, look-ups, display and model calls where a query with SQL doesn't reach."""

from pyspark.sql import functions as F

from gleaner import service_queries as queries
from gleaner.model import client
from gleaner.operators import catalog, ranking, service
from gleaner.sources import boards
from test_operators import postings


def only(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_due_on_the_day_only(spark):
    monday, tuesday = (F.lit(d).cast("timestamp") for d in ("2024-01-29", "2024-01-30"))
    week = F.unix_timestamp(monday) - 7 * 86400
    due = lambda first, last, kind, now, **o: only(spark, service.due(F.lit(first), last, F.lit(kind), now, **o))
    assert due(1, week, "weekly", monday) and not due(1, week, "weekly", tuesday) and due(1, week, "weekly", tuesday, force=True)
    assert not due(1, F.unix_timestamp(monday) - 3600, "daily", monday) and due(0, F.lit(None).cast("long"), "weekly", tuesday)


def test_seconds_are_the_nearest(spark, tmp_path):
    """Half a second before a limit counts as the limit, as in the SQL of these queries; exactly half goes to the even second."""
    times = [(1, "2024-01-28 03:59:59.4"), (2, "2024-01-28 03:59:59.6"), (3, "2024-01-28 04:00:00"), (4, "2024-01-28 03:59:59.5"), (5, "2024-01-19 00:00:00.6"), (10, "2024-01-19 00:00:00.5"), (15, "2024-01-19 00:00:00.4")]
    df = spark.createDataFrame([(2 * i if i < 5 else i, t, i, "view", 0.0, "{}") for i, t in times], "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", df["ts"].cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    due = {r["id"] for r in queries.digest_due(spark, str(tmp_path)).where("due").collect()}
    assert due & {2, 4, 6, 8} == {2}
    assert {r["id"] for r in queries.digest_recipients(spark, str(tmp_path)).collect()} & {2, 4, 6, 8} == {2}
    assert {r["email_hash"]: r["pending"] for r in queries.recent_pending(spark, str(tmp_path)).collect()} == {"h5": 1}


def test_unknown_times_are_as_in_sql(spark, tmp_path):
    """Who had a digest at an unknown time (2, 4) isn't a recipient, who never had one (26) is."""
    df = spark.createDataFrame([(i, None, i, "view", 0.0, "{}") for i in (2, 4, 26)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    assert {r["id"]: r["due"] for r in queries.digest_due(spark, str(tmp_path)).collect()} == {2: None, 4: None, 26: True}
    assert [r["id"] for r in queries.digest_recipients(spark, str(tmp_path)).collect()] == [26]


def test_recipients_by_address(spark):
    people = spark.createDataFrame([(1, "A@x", 1, False, "{}", None, None, "daily"), (2, "b@x", 1, None, "{}", None, None, "daily"), (3, "c@x", None, False, "{}", None, None, "daily")],
                                   "id int, email string, confirmed_at int, paused boolean, derived string, first_digest_at long, last_digest_at long, frequency string")
    now = F.lit("2024-01-29").cast("timestamp")
    assert [r["id"] for r in service.recipients(people, now).collect()] == [1, 2]
    assert [r["id"] for r in service.recipients(people, now, only="a@X").collect()] == [1]
    skip = spark.createDataFrame([("a@x",)], "email string")
    assert [r["id"] for r in service.recipients(people, now, skip).collect()] == [2]


def test_languages_are_known_words(spark):
    names = F.array(F.lit("German (native)"), F.lit("Klingon"), F.lit("ES"))
    assert only(spark, catalog.languages(names)) == ["german", "spanish"]
    assert only(spark, catalog.languages(names, F.lit("fr"))) == ["french", "german", "spanish"]
    places = F.array(F.lit(" "), F.lit("Bonn "), F.lit("Wien"))
    assert only(spark, catalog.place(places, F.lit(False))) == "Bonn" and only(spark, catalog.place(places, F.lit(True))) == ""


def test_display(spark):
    null = F.lit(None)
    pay = lambda a, b: only(spark, service.salary_text(F.lit(a), F.lit(b), F.lit("EUR"), F.lit("base"), null))
    assert pay(1000.9, 25000) == "1,000–25,000 EUR (base, )" and pay(None, 900) == "900 EUR (base, )" and pay(0, None) == "unknown"
    assert only(spark, service.snippet(F.lit("a\n\n b" + " c" * 200))).startswith("a b c c") and only(spark, service.snippet(null)) == ""
    assert only(spark, service.subject(F.lit(3), "-", "one", "{} jobs")) == "3 jobs"


def test_broken_payloads_are_counted(spark, tmp_path):
    (folder := tmp_path / "jooble" / "all").mkdir(parents=True)
    (folder / "1.json").write_text('{"jobs": [{"company": "C", "title": "T", "link": "https://o/1"}]}')
    (folder / "2.json").write_text('{"jobs": [')
    df, errors = boards.read_all(spark, f"file://{tmp_path}", ["jooble"])
    assert df.count() == 1 and not errors
    assert tuple(boards.broken_payloads(spark, f"file://{tmp_path}", ["jooble"]).first()) == ("jooble", 2, 1)


def test_batches_over_a_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 100 == 0).alias("k"), "id")
    got = ranking.batches(df, ["k"], [F.desc("id")], 7).collect()
    for k in (True, False):
        rows = sorted((r for r in got if r["k"] == k), key=lambda r: -r["id"])
        assert [r["batch"] for r in rows] == [n // 7 for n in range(len(rows))]


def test_ratings_of_failed_calls_stay_open(spark):
    def make():
        def answer(system, prompt):
            if "Bad" in prompt:
                raise ValueError("no")
            return '{"fits": [2]}'

        return answer

    rows = [{"company": n, "title": t, "text": "x " * 300} for n in ("Acme", "Bolt", "Bad") for t in ("Cook", "Cook", "Lead", "Chef", "Host")]
    p = postings(spark, rows).withColumn("profile", F.when(F.col("company") == "Bad", "b").otherwise("a"))
    lines = {r["company_id"]: r["line"] for r in client.company_lines(p).collect()}
    assert lines["acme"].startswith("Acme – hiring: Cook; Lead – x x") and len(lines["acme"]) < 240
    got = {r["company_id"]: r["fits"] for r in client.rate_companies(p, make, "s").collect()}
    assert got == {"acme": False, "bolt": True}
    judged = {r["seq"]: (r["assessment"], r["error"]) for r in client.assess(p, lambda: lambda s, q: '{"total": 7}', "s", "total int").collect()}
    assert len(judged) == 15 and all(a["total"] == 7 and e is None for a, e in judged.values())


def test_derived_searches(spark):
    answers = {"good": '{"target_roles": ["cook"], "clarity": 5}', "list": "[1]", "bad": "none"}
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(answers)], "id long, text string")
    got = {r["id"]: r for r in client.derive_searches(texts, lambda: lambda s, q: answers[q], "s").collect()}
    assert got[0]["derived"]["target_roles"] == ["cook"] and got[0]["derived"]["fields"] == [] and got[0]["error"] is None
    assert got[1]["derived"] is None and got[2]["derived"] is None and got[1]["error"] and got[2]["error"]
