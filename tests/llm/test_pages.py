"""WARC by round trips and brute force, HTML extraction on hand-made pages."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import html_extract as H
from gleaner.llm import warc as W
from gleaner.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, record_type int, host string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute_warc(rows):
    out, first = [], {}
    for i, _, h in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        first[d] = min(first.get(d, i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        d = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and first[d] != i
        out.append((i, len(data), d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=str)


def test_archive_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(W, "FILES", ((99, 7), (300, 3), (1 << 62, 1)))
    rng = random.Random(11)
    bodies = ["", None, "x" * 99, "x" * 100, "é" * 50, "a\r\n\r\nWARC/1.1\r\n" * 12, "\x00 null" * 30, "z" * 2_000_000]
    rows = [(i, f"http://h{i % 3}.example/{i}", rng.choice(bodies)) for i in range(60)]
    rows += [(100, "http://evil\r\nWARC-Type: revisit", "q" * 200), (101, None, "q" * 200)]
    got = W.archive_pages(frame(spark, rows)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_warc(rows)
    assert {r["page_id"]: r["url"] for r in got}[101] is None


def test_archive_edges(spark):
    big = "same " * 50
    rows = [(None, "u", big), (None, "u", big), (5, "u", big), (5, "u", big), (7, "u", big), (8, "u", None)]
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in W.archive_pages(frame(spark, rows)).collect())
    assert got == [(0, "revisit", 5), (0, "revisit", 5), (5, "response", 0), (5, "response", 0), (7, "revisit", 5), (8, "response", 0)]
    assert W.archive_pages(frame(spark, [])).count() == 0


def test_archive_files_are_bounded(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 2_000_000) for i in range(5)] + [(i, "u", f"{i} " * 300) for i in range(10, 40)]
    got = W.archive_pages(frame(spark, rows), target=f"file://{tmp_path}/kept").collect()
    assert len(got) == 35 and all(r["record_type"] == "response" for r in got)
    sizes = [len(zlib.decompress(p.read_bytes(), 31)) for p in tmp_path.rglob("*.gz")]
    assert 16 << 20 < sum(sizes) and max(sizes) < 17 << 20
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["size=0", "size=2"] and len(list((tmp_path / "kept/size=2").glob("*.gz"))) > 1
    again = W.read_archive(spark, f"file://{tmp_path}/kept", payloads=True)
    assert {r["page_id"]: r["payload"] for r in again.collect()} == {i: h for i, _, h in rows}


def test_payloads_come_back(spark):
    scratch = Scratch(spark, "t")
    html = ["<p>a</p>", "tail\r\n\r\n", "\r\n\r\nhead", ""]
    records = frame(spark, [(i, "http://x.example", h) for i, h in enumerate(html)])
    records = records.selectExpr("page_id", "url", "html as payload", "sha2(html, 256) as payload_digest", "cast(null as long) as refers_to")
    W.write_archive(records, path := scratch.folder("a"))
    got = {r["page_id"]: r["payload"] for r in W.read_archive(spark, path, payloads=True).collect()}
    assert got == dict(enumerate(html))


def test_broken_archives_fail():
    with pytest.raises(ValueError):
        list(W.parse_records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))
    with pytest.raises(ValueError):
        list(W.parse_records(b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))


def page(body, title="t"):
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p>a{{}}</style></head><body class="home">
    <header><h1>Site name</h1></header><nav><a href="/">Home</a></nav><!-- <p>no</p> -->
    <div id="content-12"><div class="post">{body}<p>All rights of this site are with us.</p></div><div class="comments"><p>First!</p></div></div>
    <aside>More <b>news</b></aside><script>if (1 < 2) document.write("<p>x</p>")</script><footer>&copy; us</footer></body></html>"""


def test_template_of_a_host(spark):
    rows = [(i, f"https://News.example:80/{i}", page(f"<h2>Title {i}</h2><p>One &amp; <i>two</i>\n {i}<p>Three<br>four &lt;b&gt; {i * 7}")) for i in range(20)]
    rows += [(50, "https://other.example/", "<div><p>alone</p><form><p>mail</p></form></div>"), (51, None, None), (52, "::", ""), (53, "https://news.example/", "text <b>only")]
    got = {r["page_id"]: r for r in H.extract_pages(frame(spark, rows)).collect()}
    for i in range(20):
        assert got[i]["text"] == f"Title {i}\nOne & two {i}\nThree four <b> {i * 7}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (50, 51, 52, 53)] == ["alone", "", "", "text only"]
    assert H.extract_pages(frame(spark, [])).count() == 0


def test_equal_pages_keep_their_text(spark):
    body = "<article><p>Always the same</p></article>"
    got = H.extract_pages(frame(spark, [(i, "http://a.example/", f"<html><body>{body}</body></html>") for i in range(12)] * 2)).collect()
    assert len(got) == 24 and all(r["text"] == "Always the same" for r in got)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><header><h1>T</h1></header><p>a</p></article><header>H</header>", "T\na"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("a < b &nbsp; c", "a < b c"),
        ("<p title='>'>x</p><script>y", "x"),
        ("<div class='ad-box'>buy<p>now</div><p>text</p>", "text"),
        ("<p>shadow <span class=road>road</span></p>", "shadow road"),
        ("<p>one</span> two</b></p></div>three", "one two\nthree"),
        ("x" * 300_000, "x" * 300_000),
    ],
)
def test_blocks(html, text):
    assert H.extract(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body class="home has-sidebar"><p>a</p></body>', "a"),
        ('<body class="sidebar"><p>a</p></body>', "a"),
        ('<html class="no-cookie"><body><main id="banner"><p>a</p></main></body></html>', "a"),
        ('<div id="page" class="no-sidebar"><p>a</p><div class="sidebar">side</div></div>', "a"),
        ('<article class="post category-social"><p>a</p></article>', "a"),
        ('<div class="social"><h1>Title</h1><p>one two three</p></div><p>end</p>', "Title\none two three\nend"),
        ('<div class="sidebar"><p>one two three</p></div>', "one two three"),
        ('<p>one</p><div class="comments"><article class="comment"><p>one two three four five</p></article></div>', "one"),
        ('<div class="promo"><p>one two three</p></div><p>four five six</p>', "four five six"),
    ],
)
def test_wrappers_are_not_beside(html, text):
    assert H.extract(html) == text


def test_wrappers_of_a_host(spark):
    body = '<html><body class="home has-sidebar"><div id="page" class="right-sidebar"><article class="category-social"><h1>Title {0}</h1><p>Text {0}</p></article></div><div class="sidebar">x</div></body></html>'
    got = H.extract_pages(frame(spark, [(i, "http://a.example/", body.format(i)) for i in range(12)])).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Title {i}\nText {i}" for i in range(12)}


SPLIT = {
    "lead": ("<article><h1>Title {0}</h1><p class=lead>Lead {0}</p><div class=body>{1}</div></article>", "Title {0}\nLead {0}\n{1}"),
    "main": ("<main><h1>Title {0}</h1><article><p>{1}</p></article></main><p>Visit {0}</p>", "Title {0}\n{1}"),
    "sections": ("<div class=post><div class=one>{1}</div><div class=two>Second {0}</div><p>Same</p></div><div class=foot>Same foot</div>", "{1}\nSecond {0}"),
    "same": ("<div class=post><div class=one>{1}</div><p>Same</p></div><div class=foot>Same foot</div>", "{1}"),
}


@pytest.mark.parametrize("kind", SPLIT)
def test_text_that_varies_around_the_deepest_slot(spark, kind):
    html, text = SPLIT[kind]
    long = [f"word{i} " * 30 + "end" for i in range(12)]
    rows = [(i, "http://a.example/", f"<html><body>{html.format(i, long[i])}</body></html>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(frame(spark, rows)).collect()}
    assert got == {i: text.format(i, long[i]) for i in range(12)}


def test_articles_without_a_template():
    html = "<article class=a><p>one</p></article><article class=b><p>two</p></article><p>three</p>"
    assert H.extract(html) == "one\ntwo"


def untold(i, n_ads=3):
    """A page whose classes say nothing: a rotating menu, notice and teaser around and inside a varying article."""
    rng = random.Random(i)
    words = lambda k: " ".join(rng.choices(["amber", "birch", "cedar", "dune", "elm"], k=k)) + f" {i}"
    menu = "".join(f"<li>go {k} {i % 4}</li>" for k in range(5))
    body = [words(30) for _ in range(rng.randint(2, 5))]
    page = f"""<html><head><title>{i}</title></head><body><div class=xa><ul>{menu}</ul></div><div class=xb>Buy {i % n_ads} now</div>
        <div class=xc><div class=xd>Title {i}</div><div class=xe>Same words on every page</div><div class=xf>{"".join(f"<p>{b}</p>" for b in body)}</div>
        <div class=xg>See also {i % 2}</div></div><div class=xh>Some site {i % n_ads}</div></body></html>"""
    return page, "\n".join([f"Title {i}", *body])


def test_classes_decide_without_telling_names(spark):
    made = [untold(i) for i in range(80)]
    rows = [(i, "http://plain.example/", h) for i, (h, _) in enumerate(made)]
    # a host of which most pages are copies of one, and one whose class names mislead
    rows += [(1000 + i, "http://copies.example/", untold(7 if i % 3 else i)[0]) for i in range(120)]
    rows += [(2000 + i, "http://odd.example/", h.replace("xc", "sidebar").replace("xf", "ad-banner")) for i, (h, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(frame(spark, rows)).collect()}
    assert {i: got[i] for i in range(80)} == {i: t for i, (_, t) in enumerate(made)}
    assert all(got[1000 + i] == untold(7 if i % 3 else i)[1] for i in range(120))
    assert all(got[2000 + i] == t for i, (_, t) in enumerate(made))


@pytest.mark.parametrize("n", [5, 12, 40, 400])
@pytest.mark.parametrize("wrap", ["main", "main article", "article"])
def test_headings_and_bylines_of_articles_stay(spark, n, wrap):
    """Whatever the number of pages, what all articles of a host have in common is still theirs."""
    begin, end = "".join(f"<{t}>" for t in wrap.split()), "".join(f"</{t}>" for t in reversed(wrap.split()))
    page = (
        "<html><body><nav><a href=/>Home</a></nav><div class=top>Welcome to the site</div>{b}<h1>Dish {k}</h1><p class=byline>By the kitchen team</p>"
        "<h2>Ingredients</h2><p>Take {k} eggs and {m} onions for it.</p><h2>Method</h2><p>Cook for {k} minutes, then stir {m} times.</p>{e}<div class=bottom>All rights reserved</div></body></html>"
    )
    rows = [(k, f"https://h.example/{k}", page.format(k=k, m=k * 7 % 101, b=begin, e=end)) for k in range(n)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(n):
        assert got[k].split("\n") == [f"Dish {k}", "By the kitchen team", "Ingredients", f"Take {k} eggs and {k * 7 % 101} onions for it.", "Method", f"Cook for {k} minutes, then stir {k * 7 % 101} times."]


def test_few_pages_leave_it_to_names(spark):
    page = "<html><body><div class=ad>Buy {0}</div><div class=text><p>One two three {0}</p><div class=newsletter>Join {0}</div></div></body></html>"
    got = {r["page_id"]: r["text"] for r in H.extract_pages(frame(spark, [(i, "http://a.example/", page.format(i)) for i in range(3)])).collect()}
    assert got == {i: f"One two three {i}" for i in range(3)}


def test_classes_equal_brute_force(spark):
    """Occurrence vectors as lists of counts, and classes by equality of vectors, against the digests of the plan."""
    rows = [(i, "http://a.example/", untold(i)[0]) for i in range(30)] + [(50, "http://a.example/", "<p>other</p>"), (51, "http://a.example/", None)]
    vectors = {}
    for k, (_, _, h) in enumerate(rows):
        for path, (_, name, n, _, _) in H.parse(h or "").elements.items():
            vectors.setdefault((path, name), [0] * len(rows))[k] = n
    classes = {}
    for token, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(token)
    want = {frozenset(c) for v, c in classes.items() if len(c) >= H.MIN_CLASS and sum(n > 0 for n in v) >= H.MIN_SUPPORT * len(rows)}
    tokens = H.page_tokens(frame(spark, rows).selectExpr("'a' as host", "page_id as page", "html")).where("name is not null")
    grouped = tokens.groupBy("token", "name").agg(F.bit_xor(F.xxhash64("page", "n")).alias("v"), F.count(F.lit(1)).alias("s"))
    found = grouped.groupBy("v", "s").agg(F.collect_set(F.struct("token", "name")).alias("c")).where(f"size(c) >= {H.MIN_CLASS} and s >= {H.MIN_SUPPORT * len(rows)}")
    assert {frozenset((t["token"], t["name"]) for t in r["c"]) for r in found.collect()} == want and len(want) == 1


@pytest.mark.parametrize(
    "html",
    ['<a "' * 250_000, "<div>" * 20_000 + "x", "<div class=ad>" * 20_000 + "x", "<b>" * 20_000 + "<p>x" * 20_000, "<!" * 500_000, "<script" * 150_000, "<div>x" * 20_000 + "</div></p>" * 20_000, "<a b='" * 100_000, "<li>x<b>" * 30_000],
    ids=range(9),
)
def test_parsing_is_linear(html):
    began = time.thread_time()
    H.parse(html)
    assert time.thread_time() - began < 6  # on a slow machine; a quadratic scan takes minutes
