"""Public addresses against Python's own reading of them, and links that are asked once."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import address as A
from gleaner.operators import links
from gleaner.operators.buckets import BucketTable


def public(spark, urls):
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    return [r["p"] for r in rows.select("i", A.is_public_url(F.col("url")).alias("p")).orderBy("i").collect()]


def test_literal_addresses(spark):
    rng = random.Random(28)
    nets = [ipaddress.ip_network(n) for n in A.RESERVED + A.EXCEPTED]
    found = [ipaddress.ip_address(int(n.network_address) + d) for n in nets for d in (-1, 0, 1, n.num_addresses - 1, n.num_addresses) if 0 <= int(n.network_address) + d < 1 << (32 if n.version == 4 else 128)]
    found += [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(60)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(30)]
    within = lambda a, names: any(a in ipaddress.ip_network(n) for n in names if ipaddress.ip_network(n).version == a.version)
    want = [not within(a, A.RESERVED) or within(a, A.EXCEPTED) for a in found]
    spelled = [f"http://[{a}]/" if a.version == 6 else f"https://{a}:8080/x?y" for a in found]
    assert public(spark, spelled) == want and {True, False} == set(want)
    whole = [f"http://[{a.exploded.upper()}]" if a.version == 6 else f"http://u@{int(a)}/" for a in found]
    assert public(spark, whole) == want


@pytest.mark.parametrize("ok, urls", [
    (False, ["http://127.1/", "http://0x7f.0.0.1/", "http://0177.0.0.1", "http://017700000001", "http://10.0.258", "http://[::1%eth0]/", "http://[::ffff:8.8.8.8]/", "http://[fe80::1]", "http://127.0.0.1./", "http://a:b@127.0.0.1#x"]),
    (False, ["ftp://8.8.8.8/", "javascript:alert(1)", "", None, "http://", "http:///x", "http://localhost", "http://x.internal/", "http://server/", "http://[1:2]/", "http://[1::2::3]/"]),
    (True, ["http://8.8.8.8", "http://8.8.2056", "HTTPS://Example.ORG:1/", "http://[2606:4700::1111]/", "http://192.0.0.9/", "http://08.example/"]),
])
def test_odd_notations(spark, ok, urls):
    assert public(spark, urls) == [ok] * len(urls)


def test_resolved_names(spark):
    rows = spark.createDataFrame([(0, "http://a.x/", ["8.8.8.8", "2606:4700::1"]), (1, "http://a.x/", ["8.8.8.8", "10.0.0.1"]), (2, "http://a.x/", []), (3, "http://10.0.0.1/", ["8.8.8.8"])], "i int, url string, at array<string>")
    assert [r[0] for r in rows.orderBy("i").select(A.is_public_url(F.col("url"), F.col("at"))).collect()] == [True, False, False, False]


def test_links_are_asked_once(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", links.SCHEMA, ["url"], 4)
    urls = spark.createDataFrame([(f"https://h{k % 2}.example/{k}",) for k in range(10)] * 2 + [("http://10.0.0.1/",), (None,)], "url string")
    web = lambda due: due.select("url", F.when(~F.col("url").endswith("4"), 200).alias("status"), F.when(F.col("url").endswith("6"), "This job has EXPIRED. Job not found").otherwise("").alias("body"))
    assert [links.check_links(urls, table, web, now, keep=100, per_host=4) for now in (1000, 1001, 1002)] == [8, 2, 0]
    assert {r["url"][-1]: r["alive"] for r in table.read().collect()} == {str(k): k not in (4, 6) for k in range(10)}
    assert links.check_links(urls, table, web, 1101, keep=100, per_host=9) == 8 and table.version() == 3
    posts = spark.createDataFrame([("https://h0.example/4", False, ""), ("https://h0.example/4", True, ""), ("https://h1.example/1", False, ""), ("http://10.0.0.1/", False, ""), ("https://new.example/", False, "")], "url string, direct boolean, partner string")
    assert sorted((str(r["alive"]) for r in links.with_alive(posts, table.read()).collect())) == ["False", "False", "None", "True", "True"]


def test_join_url_is_that_of_the_standard_library(spark):
    from urllib.parse import urljoin

    from gleaner.operators.discovery import join_url

    sources = ["https://a.example/x/y.html?q=/z", "http://a.example", "https://a.example:8080/x/"]
    hrefs = ["https://b.example/p", "//b.example/p", "/p?x", "p/q", "p", "HTTP://b.example"]
    rows = [(s, h, urljoin(s, h)) for s in sources for h in hrefs]
    got = spark.createDataFrame(rows, "s string, h string, u string").select("u", join_url(F.col("s"), F.col("h")).alias("j")).collect()
    assert [(r["u"].replace("http://b.example", "HTTP://b.example") if r["j"] and r["j"].startswith("HTTP") else r["u"]) for r in got] == [r["j"] for r in got]
    assert spark.createDataFrame([("https://a.example", "mailto:x@y")], "s string, h string").select(join_url(F.col("s"), F.col("h"))).first()[0] is None


def test_crawl_reads_boards_first_and_stops_at_the_budget(spark):
    from gleaner.operators.discovery import crawl, first_boards

    pages = {
        "https://www.a.example/": '<a href="/deep/er/page"><a href="/jobs"><a href="https://jobs.a.example/x"><a href="https://other.example/"><a href="/jobs">',
        "https://jobs.a.example/x": '<a href="https://jobs.lever.co/acme"><a href="/more">',
        "https://www.a.example/jobs": '<a href="https://boards.greenhouse.io/late">',
    }
    web = spark.createDataFrame(list(pages.items()), "url string, html string")
    starts = spark.createDataFrame([("a", "a.example", "https://www.a.example/"), ("b", "b.example", "https://b.example/")], "site string, base string, url string")
    fetch = lambda due: due.join(web, "url", "left")
    read = crawl(starts, fetch, 5)
    got = [(r["place"], r["url"], r["html"] is not None) for r in read.where("site = 'a'").orderBy("place").collect()]
    assert got == [
        (0, "https://www.a.example/", True), (1, "https://jobs.a.example/x", True), (2, "https://www.a.example/jobs", True),
        (3, "https://www.a.example/deep/er/page", False), (4, "https://jobs.lever.co/acme", False),
    ]
    assert read.where("site = 'b'").count() == 1
    assert [tuple(r) for r in first_boards(read).collect()] == [("a", "lever", "acme")]
    assert crawl(starts.where("false"), fetch, 5).count() == 0
