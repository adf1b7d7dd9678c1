"""Text functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from gleaner import queries as library
from gleaner.functions import money as M
from gleaner.functions import text as T


def apply(spark, f, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"c{k} {'string' if a is None or isinstance(a, str) else 'double'}" for k, a in enumerate(args)))
    return row.select(f(*[F.col(f"c{k}") for k in range(len(args))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, canon",
    [
        ("Data Engineer (m/w/d)", "data engineer"),
        ("Softwareentwickler:in (all genders)", "softwareentwickler"),
        ("Engineering Manager - Remote, Europe", "engineering manager"),
        ("Engineering Manager (Payments)", "engineering manager payments"),
        ("Engineer – Spain", "engineer spain"),
        ("Head of Data | Germany | Remote", "head of data"),
        ("Contractor (US Canada, Europe, MENA, I", "contractor"),
        ("Support (APAC time zones)", "support"),
        ("Remote", "remote"),
        ("R&amp;D Lead 100%", "r d lead 100"),
        (None, ""),
    ],
)
def test_title_canon(spark, title, canon):
    assert apply(spark, T.title_canon, title) == canon


@pytest.mark.parametrize(
    "name, words, key",
    [
        ("ACME Software GmbH & Co. KG", ["acme", "software"], "acme"),
        ("Plain Concepts S.L.", ["plain", "concepts", "s", "l"], "plainconcepts"),
        ("GFT Technologies SE", ["gft", "technologies"], "gft"),
        ("The Group", ["the", "group"], "thegroup"),
        ("", [], ""),
        ("Labs Digital", ["labs", "digital"], "labs"),
    ],
)
def test_companies(spark, name, words, key):
    assert apply(spark, T.company_tokens, name) == words and apply(spark, T.company_key, name) == key


@pytest.mark.parametrize(
    "a, b, kind",
    [
        ("Oliver", "OLIVER Agency", "strong"),
        ("IBM", "International Business Machines", "strong"),
        ("Hero", "Delivery Hero", "weak"),
        ("tngtech", "TNG Technology Consulting", "weak"),
        ("Acme", "Zeta", ""),
        ("Acme GmbH", "acme", "strong"),
        ("", "acme", ""),
    ],
)
def test_company_match(spark, a, b, kind):
    f = lambda x, y: T.company_match(T.company_tokens(x), T.company_tokens(y))
    assert apply(spark, f, a, b) == kind and apply(spark, f, b, a) == kind


def test_small_functions(spark):
    assert apply(spark, T.raw_key, "ACME, Inc.", "Engineer (m/w/d) | Berlin") == "acme inc|engineer"
    assert apply(spark, T.title_norm, "  Data  Engineer (M/W/D) –") == "data engineer"
    assert apply(spark, T.words, "The Head of C++ and Go") == ["head", "c++", "go"]
    assert apply(spark, T.first_place, "Barcelona, Catalonia") == "barcelona"
    assert apply(spark, T.role_head, "Head of Engineering") == "head" and apply(spark, T.role_head, "Senior Marketing Manager") == "manager"
    assert apply(spark, T.role_head, "senior") is None
    assert apply(spark, T.strip_html, "<p>a &amp;amp; b</p><li>c\xa0 d</li>") == "a & b\n c d"
    assert apply(spark, T.clean_source, " My Feed!! ") == "my-feed" and apply(spark, T.clean_source, "") == "unknown"
    assert apply(spark, T.campaign_name, "Spring-24") == "spring-24" and apply(spark, T.campaign_name, "-x") == ""
    assert apply(spark, T.slug, "Köln & Bonn") == "k%C3%B6ln-bonn"
    assert apply(spark, T.company_slugs, "Plain Concepts S.L.") == ["plainconcepts", "plain-concepts"]
    assert apply(spark, T.parse_json_answer, '<think>{}</think>```json\n{"a": 1}\n```') == '{"a": 1}'
    assert apply(spark, T.parse_json_answer, "none") is None


@pytest.mark.parametrize("text, phrase, found", [("we use go daily", "Go", True), ("mongodb", "go", False), ("x", " ", False), ("a.b here", "a.b", True), ("axb", "a.b", False), ("café öl", "öl", True)])
def test_phrases(spark, text, phrase, found):
    assert apply(spark, T.has_phrase, text, phrase) is found


def test_languages(spark):
    assert apply(spark, T.written_in, "wir sind die und der das nicht mit für auf bei eine " * 2) == "german"
    assert apply(spark, T.written_in, "we are the team for you " * 6) == "english"
    assert apply(spark, T.written_in, "too short") == "" and apply(spark, T.written_in, None) == ""


def test_signatures(spark):
    words = [f"word{k}" for k in range(120)]
    one, two = " ".join(words), " ".join(words[:100] + ["other"] * 20)
    f = lambda a, b: T.similarity(T.signature(a), T.signature(b))
    assert apply(spark, f, one, one) == 1.0 and 0.5 < apply(spark, f, one, two) < 1
    assert apply(spark, f, one, "short") is None and apply(spark, T.signature, None) == []


def test_money_and_time(spark):
    assert apply(spark, M.to_eur, "100", "usd") == pytest.approx(86) and apply(spark, M.to_eur, "100", "XXX") == 100
    assert apply(spark, M.to_eur, "many", None) is None
    day = lambda f, v: str(apply(spark, f, v))
    assert day(M.parse_time, "1700000000") == day(M.parse_time, "1700000000000") == day(M.parse_time, "2023-11-14T22:13:20Z") == "2023-11-14 22:13:20"
    assert apply(spark, M.parse_time, "soon") is None and apply(spark, M.parse_time, "") is None
    assert day(M.parse_mail_date, "Mon, 02 Jun 2025 0:00:00 GMT") == "2025-06-02 00:00:00"
    now = F.lit("2024-01-31").cast("timestamp")
    assert day(lambda v: M.parse_days_ago(v, now), "Posted 30+ Days Ago") == "2024-01-01 00:00:00"
    assert apply(spark, lambda v: M.parse_days_ago(v, now), "Posted") is None


def test_md5_signatures_made_together(spark):
    """Hashes of many texts at once are those of the expressions on arrays, at every length of shingle; the named queries use them."""
    texts = [None, "", "é" * 299, "é" * 300, "x" * 400, " ".join(["y" * 100] * 5), "ß÷ÿ 😀 x" * 90, "À\u00a0É x-" * 200, "日本 語x " * 300, "WORD\tw\u0130 " * 900]
    texts += [" ".join(str(i * i) * (1 + (i + k) % 4) for i in range(40 + 12 * k)) for k in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    both = d.select(T.md5_numbers(F.col("text")).alias("got"), T.signature_numbers(T.signature(F.col("text"), F.md5)).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in both) and {len(r["got"]) for r in both} >= {0, 1, 64}


def test_reposts_hash_no_arrays(spark):
    plan = library.with_reposts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "md5(" not in plan and "_md5_numbers" in plan
