"""Entity resolution, rules, matching, ranking and state on small tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner import queries as library
from gleaner import service_queries
from gleaner import values as V
from gleaner.functions import text as T
from gleaner.operators import matching, ranking, resolve, rules, state
from gleaner.sources.postings import COLUMNS, SCHEMA, conform
from gleaner.tables import Scratch, components

TEXT = " ".join(f"word{k}" for k in range(120))
LONG = "Principal engineer of very large distributed storage systems and their many clients"
OTHER = " ".join(f"other{k}" for k in range(120))


def postings(spark, rows):
    base = {n: None for n in COLUMNS} | {"remote": False, "direct": False}
    full = [base | {"seq": i, "source": "a", "company": "Acme", "title": "Engineer", "url": f"https://x.example/{i}", "text": ""} | r for i, r in enumerate(rows)]
    return conform(spark.createDataFrame([tuple(r[n] for n in COLUMNS) for r in full], SCHEMA))


CASES = [
    ([{"company": "Acme GmbH"}, {"source": "b", "title": "Engineer (m/w/d)"}], [0, 0]),
    ([{"company": "Grafana"}, {"company": "Grafana Labs"}], [0, 0]),
    ([{"company": "Hero", "text": TEXT}, {"company": "Delivery Hero", "source": "b", "text": TEXT}], [0, 0]),
    ([{"company": "Hero", "text": TEXT}, {"company": "Delivery Hero", "source": "b", "text": OTHER}], [0, 1]),
    ([{"company": "Hero", "text": TEXT}, {"company": "Delivery Hero", "text": TEXT}], [0, 1]),
    ([{"title": "Senior Data Platform Engineer", "text": TEXT}, {"source": "b", "title": "Data Platform Engineer", "text": TEXT}], [0, 0]),
    ([{"title": "Senior Data Platform Engineer", "text": TEXT}, {"title": "Data Platform Engineer", "text": TEXT}], [0, 1]),
    ([{"title": "Engineer – Spain"}, {"source": "b", "title": "Engineer – Germany"}], [0, 1]),
    ([{"title": "Principal engineer of very large distributed storage systems and their many clients"}, {"source": "b", "title": "Principal engineer of very large distributed storage systems and their"}], [0, 0]),
]


@pytest.mark.parametrize("rows, want", CASES)
def test_both_modes_agree_on_pairs(spark, rows, want):
    df = postings(spark, rows)
    for clustered in (resolve.clusters_by_closure(df), resolve.clusters_by_replay(df)):
        assert [r["cluster_id"] for r in clustered.orderBy("seq").select("cluster_id").collect()] == want


def test_replay_by_parts_is_global_first_fit(spark):
    rng = random.Random(12)
    rows = [
        {"source": rng.choice("abcd"), "company": rng.choice(["Hero", "Delivery Hero", "Hero Labs", "Zeta", "Zeta GmbH", "Omega"]), "title": rng.choice(["Data Lead", "Data Team Lead", "Cook", LONG, LONG[:72]]), "text": rng.choice([TEXT, OTHER, ""])}
        for _ in range(90)
    ]
    df = postings(spark, rows)
    assert {r["seq"]: r["cluster_id"] for r in resolve.clusters_by_replay(df).collect()} == first_fit(spark, rows)


def first_fit(spark, rows):
    """The rule as it reads, over a list of clusters; names and texts are compared by the columns that the library has for them."""
    keyed = [r.asDict() for r in resolve.with_keys(postings(spark, rows)).orderBy("seq").collect()]
    names = spark.createDataFrame([(a["seq"], b["seq"], a["company_words"], b["company_words"], a["signature"], b["signature"]) for a in keyed for b in keyed], "a long, b long, x array<string>, y array<string>, s array<long>, t array<long>")
    pair = {(r["a"], r["b"]): r for r in names.select("a", "b", T.company_match(F.col("x"), F.col("y")).alias("match"), T.similarity(F.col("s"), F.col("t")).alias("alike")).collect()}
    pool, out = [], {}
    for r in keyed:
        def fits(members, rule):
            seed, fullest = members[0], max(members, key=lambda m: len(m["text"]))
            other = all(m["source"] != r["source"] for m in members)
            match, alike = pair[r["seq"], seed["seq"]]["match"], pair[r["seq"], fullest["seq"]]["alike"]
            if rule == "key":
                return any(m["match_key"] == r["match_key"] for m in members)
            if rule == "title":
                return seed["canon"] == r["canon"] and (match == "strong" or (match == "weak" and other and (alike or 0) >= 0.6))
            if seed["collapsed"] != r["collapsed"] or not other:
                return False
            short = min([r, *members], key=lambda m: len(m["canon"]))
            if len(short["title"].strip()) >= 70 and (seed["canon"].startswith(r["canon"]) or r["canon"].startswith(seed["canon"])):
                return alike is None or alike >= 0.6
            a, b = set(seed["canon"].split()), set(r["canon"].split())
            return len(a & b) / len(a | b) >= 0.6 and (alike or 0) >= 0.9

        found = next((m for rule in ("key", "title", "company") for m in pool if fits(m, rule)), None)
        if found is None:
            pool.append(found := [])
        found.append(r)
        out[r["seq"]] = found[0]["seq"]
    return out


POSTS = "opening long, seq long, source string, n_text int, n_canon int, n_title int, signature array<long>"


def plain_first_fit(posts, links):
    """One pass in order of seq over posts of openings with given links."""
    to = {}
    for opening, home, *link in links:
        to.setdefault(opening, []).append((link[0] == "", home, link))
    homes, members = {}, {}
    alike = lambda a, b: (lambda low: len(low & set(a) & set(b)) / len(low))(set(sorted(set(a) | set(b))[:64])) if a and b else None
    for opening, seq, source, n_text, n_canon, n_title, signature in sorted(posts, key=lambda p: p[1]):
        if opening not in homes:
            homes[opening] = opening
            for _, home, (kind, begins, shares) in sorted(to.get(opening, [])):
                of = members.get(home, []) if homes.get(home) == home else []
                if not of:
                    continue
                sim = alike(signature, max(of, key=lambda m: m[2])[5])
                shown = min([(n_canon, n_title), *[(m[3], m[4]) for m in of]], key=lambda x: x[0])[1]
                if kind == "strong":
                    fits = True
                elif any(m[1] == source for m in of):
                    fits = False
                elif kind == "weak":
                    fits = (sim or 0) >= 0.6
                elif begins and shown >= 70:
                    fits = sim is None or sim >= 0.6
                else:
                    fits = shares and (sim or 0) >= 0.9
                if fits:
                    homes[opening] = home
                    break
        members.setdefault(homes[opening], []).append((seq, source, n_text, n_canon, n_title, signature))
    return homes


def random_links(rng, n, posts_each=2, links_each=3):
    seqs = rng.sample(range(n * posts_each * 2), n * posts_each)
    posts = []
    for k in range(n):
        own = sorted(seqs[k * posts_each : (k + 1) * posts_each])
        posts += [(own[0], q, rng.choice("abcdefgh"), rng.randint(0, 40), rng.randint(5, 9), rng.choice([30, 80]), rng.choice([[], [1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]])) for q in own]
    firsts = sorted({p[0] for p in posts})
    links = set()
    for at, opening in enumerate(firsts[1:], 1):
        for home in {firsts[rng.randrange(at)] for _ in range(links_each)}:
            links.add((opening, home, *rng.choice([("strong", False, False), ("weak", False, False), ("", True, True), ("", True, False), ("", False, True)])))
    return posts, sorted(links)


def test_first_fit_in_rounds_equals_one_pass(spark):
    for seed in (1, 2):
        posts, links = random_links(random.Random(seed), 120)
        frames = spark.createDataFrame(posts, POSTS), spark.createDataFrame(links, "opening long, home long, kind string, begins boolean, shares boolean")
        homes, rounds = resolve.first_fit(*frames, Scratch(spark, "fit"))
        assert {r["opening"]: r["home"] for r in homes.collect()} == plain_first_fit(posts, links)
        assert 1 < rounds < 25
    empty = [f.where("false") for f in frames]
    assert resolve.first_fit(*empty, Scratch(spark, "fit"))[0].count() == 0


def test_signatures_are_crc32_of_shingles(spark):
    words = [f"word{k}" for k in range(120)]
    want = sorted({zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(116)})[:64]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(T.signature(F.col("t")).alias("s")).first()["s"]
    assert got == want


def test_links_equal_all_pairs(spark):
    """Blocking loses nothing: links by keys are those of all pairs of openings."""
    rng = random.Random(5)
    companies = ["Hero", "Delivery Hero", "Hero Labs", "Hero Labs Group", "DH", "D H", "Heroic", "Global Solutions", "Global", "Solutions", "A B", "Ab", "Herodot Solutions", "Labs"]
    titles = ["Data Lead", "Data Team Lead", "Senior Data Team Lead", "Cook", "Lead", "Lead Cook of all " + "very " * 12 + "large kitchens", "Lead Cook of all " + "very " * 12 + "lar"]
    rows = [{"company": rng.choice(companies), "title": rng.choice(titles)} for _ in range(150)]
    o = resolve._openings(resolve.with_keys(postings(spark, rows)))
    pairs = o.alias("x").crossJoin(o.alias("y")).where("x.opening < y.opening")
    match = T.company_match(F.col("x.company_words"), F.col("y.company_words"))
    want = pairs.where("x.canon = y.canon").select("x.opening", "y.opening", match.alias("kind")).where("kind <> ''").collect()
    assert sorted(map(tuple, resolve.title_links(o).collect())) == sorted(map(tuple, want)) != []
    both = [r for r in pairs.where("x.collapsed = y.collapsed").select(F.col("x.opening").alias("a"), F.col("y.opening").alias("b"), F.col("x.canon").alias("s"), F.col("y.canon").alias("t")).collect()]
    close = {(r["a"], r["b"]) for r in both if len(set(r["s"].split()) & set(r["t"].split())) >= 0.6 * len(set(r["s"].split()) | set(r["t"].split()))}
    begins = {(r["a"], r["b"]) for r in both if r["s"].startswith(r["t"]) or r["t"].startswith(r["s"])}
    got = resolve.company_links(o).collect()
    assert {(r["a"], r["b"]) for r in got if r["shares"]} == close != set()
    assert {(r["a"], r["b"]) for r in got if r["begins"]} <= begins and any(r["begins"] for r in got)


def test_best_fills_gaps_and_ids_stay(spark):
    rows = [
        {"source": "b", "partner": "Jooble", "text": TEXT, "salary_max": 50.0, "currency": "USD", "employment_type": "full", "remote": True},
        {"source": "c", "direct": True, "text": "short"},
        {"source": "d", "company": "Zeta"},
    ]
    clustered = resolve.clusters_by_closure(postings(spark, rows))
    best = {r["cluster_id"]: r for r in resolve.best_of_clusters(clustered).collect()}
    b = best[0]
    assert (b["seq"], b["copies"], b["salary_max"], b["currency"], b["employment_type"], b["remote"]) == (1, 2, 50.0, "USD", "full", True)
    none = spark.createDataFrame([], "alias string, uid string, seen long")
    ids = resolve.stable_ids(clustered, resolve.best_of_clusters(clustered), none)
    assert {r["cluster_id"]: r["uid"] for r in ids.collect()} == {0: "acme|engineer", 2: "zeta|engineer"}
    book = Scratch(spark, "t").table(resolve.remember(none, clustered, ids, 1000), "book")
    later = resolve.clusters_by_closure(postings(spark, [{"company": "ACME GmbH", "source": "z"}, {"company": "New"}]))
    got = {r["cluster_id"]: r["uid"] for r in resolve.stable_ids(later, resolve.best_of_clusters(later), book).collect()}
    assert got == {0: "acme|engineer", 1: "new|engineer"}
    assert resolve.remember(book, later.where("false"), ids.where("false"), 1000 + 91 * 86400).count() == 0


def test_one_id_for_one_cluster(spark):
    book = spark.createDataFrame([("acme|engineer", "old", 1), ("zeta|engineer", "old", 1)], "alias string, uid string, seen long")
    clustered = resolve.clusters_by_closure(postings(spark, [{}, {"company": "Zeta"}]))
    got = {r["cluster_id"]: r["uid"] for r in resolve.stable_ids(clustered, resolve.best_of_clusters(clustered), book).collect()}
    assert got == {0: "old", 1: "zeta|engineer"}


def test_the_book_stays_where_it_is(spark):
    rows = spark.range(2000).selectExpr("concat('a', id) AS alias", "concat('u', id) AS uid", "id AS seen")
    asked = spark.range(0, 2000, 3).selectExpr("id AS cluster_id", "concat('a', id) AS raw_key", "'m' AS match_key", "concat('own', id) AS own")
    spark.sql("DROP TABLE IF EXISTS test_book")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for _ in range(2):  # the second replaces the first
            book = resolve.save_book(rows, "test_book", 16)
        joined = book.select("alias", "uid").join(resolve.cluster_aliases(asked), "alias")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 667 and "Bucketed: true" in plan and "hashpartitioning(alias" in plan
        scan = plan[: plan.index("FileScan")].splitlines()[-4:]
        assert not any("Exchange" in line for line in scan), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS test_book")


def test_ids_are_given_in_order_of_clusters(spark):
    """An earlier cluster that is refused its first choice still goes before later ones at its second."""
    rng = random.Random(4)
    wishes = {k: rng.sample("ABCDEFGH", rng.randint(0, 4)) for k in range(25)}
    rows, taken, want = [], set(), {}
    for k, uids in wishes.items():
        rows += [(f"a{k}-{at}-{n}", uid, 1) for at, uid in enumerate(uids) for n in range(9 - at)]
    book = spark.createDataFrame(rows, "alias string, uid string, seen long")
    clusters = [(k, f"a{k}-{at}-{n}", "m") for k, uids in wishes.items() for at, _ in enumerate(uids) for n in range(9 - at)] + [(k, f"own{k % 3}", "m") for k in wishes]
    clustered = spark.createDataFrame(clusters, "cluster_id long, raw_key string, match_key string")
    best = spark.createDataFrame([(k, f"own{k % 3}", f"u{k % 2}") for k in wishes], "cluster_id long, raw_key string, url string")
    for k, uids in wishes.items():
        h = zlib.crc32(f"u{k % 2}".encode())
        want[k] = next(u for u in [*uids, f"own{k % 3}", f"own{k % 3}#{h}", f"own{k % 3}#{h}-{k}"] if u not in taken)
        taken.add(want[k])
    assert {r["cluster_id"]: r["uid"] for r in resolve.stable_ids(clustered, best, book).collect()} == want


def test_components_of_the_library(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (8, 9)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges, Scratch(spark, "t")).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_prefilter_names_the_first_reason(spark):
    p = rules.Profile(
        title_include=("engineer",), title_exclude=("intern",), blocked_companies=("bad",), home=("Berlin",), remote_ok=("Europe",), floor=60_000,
        hard_exclude=("on-?call",), require_any=("python",), learned={"data lead": True, "cook": False},
    )
    here = {"location": "Berlin", "text": "python"}
    rows = [
        here, {"company": "Bad GmbH"} | here, {"title": "Engineer Intern"} | here, {"title": "Data Lead"} | here, {"location": "Paris", "text": "python"},
        {"location": "Remote", "text": "python, Europe", "remote": True}, {"location": "Remote", "text": "python, Europe, US-only", "remote": True},
        {"location": "Paris", "title": "Freelance engineer", "text": "python"}, {"salary_max": 50_000.0, "currency": "EUR"} | here,
        {"salary_max": 500.0} | here, {"location": "Berlin", "text": "python with On-Call shifts"}, {"location": "Berlin", "text": "java"},
    ]
    got = postings(spark, rows).select("seq", rules.prefilter(p, F.current_timestamp()).alias("r")).orderBy("seq")
    assert [r["r"] for r in got.collect()] == [
        "", "company", "title", "", "location", "", "location", "", "stated salary below floor", "", "excluded: “On-Call”", "requirement not met",
    ]
    ask = postings(spark, [{"title": "Gardener"} | here, {"title": "Cook"} | here, {"title": "Gardener", "location": "", "text": ""}, {"title": "Intern"} | here])
    assert [r[0] for r in ask.select(rules.worth_asking(p, F.current_timestamp())).collect()] == [True, False, True, False]


def test_old_postings(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    df = postings(spark, [{}, {}, {}]).withColumn("posted", F.when(F.col("seq") == 0, None).otherwise(F.lit("2024-01-01").cast("timestamp")))
    df = df.withColumn("direct", F.col("seq") == 2)
    assert [r[0] for r in df.orderBy("seq").select(rules.too_old(rules.Profile(), F.col("posted"), F.col("direct"), now)).collect()] == [False, True, False]


def search(spark, **over):
    names = [c.split(" ")[0] for c in matching.SEARCH_SCHEMA.split(", ")]
    row = {n: None for n in names} | {"search_id": 1, "target_roles": ["Marketing Manager", "Head of Sales"], "remote_regions": ["Europe"], "work_modes": ["remote"]} | over
    return spark.createDataFrame([tuple(row[n] for n in names)], matching.SEARCH_SCHEMA)


@pytest.mark.parametrize(
    "job, over, points",
    [
        ({"title": "Marketing Manager", "location": "Remote, Europe"}, {}, 73),
        ({"title": "Senior Marketing Manager (EU)", "location": "Remote - EU", "direct": True}, {}, 78),
        ({"title": "Head of Sales", "location": "Remote, Europe"}, {}, 71),
        ({"title": "Junior Marketing Manager", "location": "Remote, Europe"}, {}, None),
        ({"title": "Marketing Analyst", "location": "Remote, Europe"}, {}, None),
        ({"title": "Marketing Manager", "location": "Berlin"}, {}, None),
        ({"title": "Marketing Manager", "location": "Remote"}, {}, None),
        ({"title": "Marketing Manager", "location": "Remote", "text": "anyone in Europe"}, {}, 73),
        ({"title": "Marketing Manager", "location": "Remote"}, {"remote_regions": ["Worldwide"]}, 73),
        ({"title": "Marketing Manager", "location": "Lisbon, Portugal"}, {"locations": [("Lisbon", "")], "work_modes": []}, 75),
        ({"title": "Marketing Manager", "location": "Remote, Europe", "text": "we need seo and crm"}, {"keywords": ["SEO", "crm", "remote"]}, 81),
        ({"title": "Marketing Manager", "location": "Remote, Europe", "text": "x " * 400}, {"keywords": ["SEO"]}, None),
        ({"title": "Marketing Manager", "location": "Remote, Europe", "salary_max": 40_000.0}, {"salary": (60_000.0, "EUR", "year")}, None),
        ({"title": "Marketing Manager", "location": "Remote, Europe", "text": "join our talent pool"}, {}, None),
        ({"title": "Marketing Manager", "location": "Remote, Europe", "text": "gambling"}, {"deal_breakers": ["gambling"]}, 53),
        ({"title": "Marketing Manager", "location": "Remote, Europe", "employment_type": "Freelance"}, {"employment_types": ["permanent"]}, 63),
    ],
)
def test_scores(spark, job, over, points):
    got = matching.match(postings(spark, [job]), search(spark, **over)).collect()
    assert [r["score"] for r in got] == ([] if points is None else [points])


def test_feedback_moves_scores(spark):
    names = [c.split(" ")[0] for c in matching.SIGNALS_SCHEMA.split(", ")]
    signal = lambda **x: spark.createDataFrame([(1, *[x.get(n) for n in names])], f"search_id long, {matching.SIGNALS_SCHEMA}")
    job = {"title": "Marketing Manager", "location": "Remote, Europe"}
    run = lambda **x: [r["score"] for r in matching.match(postings(spark, [job]), search(spark), signal(**x)).collect()]
    assert run() == [73]
    assert run(role_down={"Marketing Manager": 1}) == [67]
    assert run(role_down={"Marketing Manager": 2}) == []
    assert run(liked_words=["marketing", "growth"]) == [76]
    assert run(excluded_companies=["acme"]) == []


def test_candidates_hold_all_that_scores(spark):
    rng = random.Random(7)
    words = "head of sales data engineer lead senior manager marketing cook growth remote".split()
    df = postings(spark, [{"title": " ".join(rng.choices(words, k=3)), "location": "Remote, Europe"} for _ in range(200)])
    s = search(spark, target_roles=["Head of Data", "Senior Manager", "Growth Lead"])
    every = matching.score(df.crossJoin(s).select("*", *matching.no_signals()))
    assert {r["seq"] for r in every.collect()} == {r["seq"] for r in matching.match(df, s).collect()} != set()


def test_digest_is_the_greedy_choice(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice(["A", "a", "B", "C"]), rng.randint(60, 100), rng.random() < 0.3) for i, s in enumerate(rng.choices([1, 2], k=80))]
    df = spark.createDataFrame(rows, "search_id long, seq long, company string, score int, direct boolean").withColumn("partner", F.lit(""))
    want = []
    for s in (1, 2):
        count, taken = {}, []
        for r in sorted((r for r in rows if r[0] == s and r[3] >= V.DIGEST_MIN_SCORE), key=lambda r: (-r[3], not r[4], r[1])):
            if count.get(r[2].lower(), 0) < 2 and len(taken) < 7:
                count[r[2].lower()] = count.get(r[2].lower(), 0) + 1
                taken.append(r[1])
        want += [(s, i, k + 1) for k, i in enumerate(taken)]
    picks = ranking.digest(df)
    assert sorted((r["search_id"], r["seq"], r["rank"]) for r in picks.collect()) == sorted(want)
    paid = spark.createDataFrame([(1, 999, "Z", 80, False, "")], picks.drop("rank").schema)
    both = ranking.insert_sponsored(picks, paid).where("search_id = 1").orderBy("rank").collect()
    assert [r["rank"] for r in both] == list(range(1, len(both) + 1)) and both[2]["seq"] == 999


def test_caps_by_column_limit_before_the_shuffle(spark):
    """A cap that differs by row still lets each task keep a bounded number of rows of a group."""
    rows = [("p", ["strong", "possible", "other"][k % 3], k % 50, k) for k in range(300)]
    df = spark.createDataFrame(rows, "profile string, status string, total int, seq long")
    best = ranking.capped_sections(df, {"strong": 3, "possible": 2})
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1) > plan.index("Exchange hashpartitioning") and ", Partial" in plan
    want = []
    for status, n in (("strong", 3), ("possible", 2)):
        of = sorted((r for r in rows if r[1] == status), key=lambda r: (-r[2], r[3]))[:n]
        want += [(*r, k + 1) for k, r in enumerate(of)]
    assert sorted(map(tuple, best.select("profile", "status", "total", "seq", "rank").collect())) == sorted(want)
    assert ranking.capped_sections(df, {}).count() == 0


def test_rules_of_state(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    change = spark.createDataFrame([("a", 2, 0), ("b", 3, 1), ("b", 4, 2)], "k string, v int, arrival long")
    assert {(r["k"], r["v"]) for r in state.last_wins(old, change, ["k"]).collect()} == {("a", 2), ("b", 4)}
    assert {(r["k"], r["v"]) for r in state.insert_or_ignore(old, change, ["k"]).collect()} == {("a", 1), ("b", 3)}
    filled = state.fill_if_empty(spark.createDataFrame([("a", ""), ("b", "x")], "k string, w string"), spark.createDataFrame([("a", "y", 0), ("b", "z", 0)], "k string, w string, arrival long"), ["k"], ["w"])
    assert {(r["k"], r["w"]) for r in filled.collect()} == {("a", "y"), ("b", "x")}


def written(monkeypatch, run):
    """Schemas of the tables that a run writes."""
    schemas, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: schemas.append(df.schema) or table(self, df, name))
    run()
    return schemas


@pytest.mark.parametrize("name", ["replay_clusters", "duplicate_clusters", "company_block_pairs", "title_block_pairs"])
def test_links_carry_no_texts(spark, monkeypatch, tmp_path, name):
    """Tables between the steps hold lengths and numbers of the texts, not the texts, and not their hashes as digits."""
    rows = postings(spark, [{"company": "Acme", "title": "Blue ring", "source": "a"}, {"company": "Acme Labs", "title": "Blue ring", "source": "b"}])
    monkeypatch.setattr(library, "with_reposts", lambda spark, sf_dir: rows)
    schemas = written(monkeypatch, lambda: library.QUERIES[name](spark, str(tmp_path)))
    kinds = {f.name: f.dataType.simpleString() for s in schemas for f in s}
    assert "text" not in kinds and kinds["signature"] == "array<bigint>"


def test_clusters_make_keys_once(spark, monkeypatch, tmp_path):
    """What is returned is put together from written tables: titles and texts aren't read again."""
    rows = postings(spark, [{"company": "Acme", "title": "Blue ring", "source": "a"}, {"company": "Acme Labs", "title": "Blue ring", "source": "b"}])
    monkeypatch.setattr(library, "with_reposts", lambda spark, sf_dir: rows)
    found = library.duplicate_clusters(spark, str(tmp_path))
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()
    assert len({r["cluster_id"] for r in found.collect()}) == 1 and found.count() == 2


def test_ids_carry_no_texts(spark, monkeypatch, tmp_path):
    rows = postings(spark, [{"company": "Acme"}, {"company": "Zeta"}, {"company": "Acme"}])
    monkeypatch.setattr(library, "P", lambda spark, sf_dir: rows)
    names = {n for s in written(monkeypatch, lambda: library.stable_ids(spark, str(tmp_path))) for n in s.fieldNames()}
    assert "n_text" in names and not names & {"text", "signature"}


def test_crawled_pages_stay_where_they_lie(spark, monkeypatch, tmp_path):
    """Only pages that are due are written, never all that were captured."""
    spark.createDataFrame([(i, f"https://x/{i}", f"page {i}") for i in (0, 1, 40, 41, 80, 400)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = []
    schemas = written(monkeypatch, lambda: found.extend(service_queries.crawl_sites(spark, str(tmp_path)).collect()))
    assert sorted((r["site"], r["place"], r["captured"]) for r in found) == [(0, 0, True), (1, 0, True)]
    assert all("page_id" not in s.fieldNames() for s in schemas if "html" in s.fieldNames())


def test_beginnings_only_at_lengths_of_other_titles(spark, monkeypatch):
    """A long title isn't laid out at every length, and titles of too different numbers of words never meet."""
    long = " ".join(f"word{k}" for k in range(30))
    titles = ["word0 word1 word2", long[:100], long, "word29"]
    rows = [(k, "acme", t, len(t)) for k, t in enumerate(titles)]
    o = spark.createDataFrame(rows, "opening long, collapsed string, canon string, shown int")
    laid, met, keys, meet = [], [], resolve._keys, resolve._meet
    monkeypatch.setattr(resolve, "_keys", lambda *a: laid.append(keys(*a)) or laid[-1])
    monkeypatch.setattr(resolve, "_meet", lambda *a: met.append(meet(*a)) or met[-1])
    got = resolve.company_links(o).collect()
    assert sorted(map(tuple, got)) == [(0, 1, True, False), (0, 2, True, False), (1, 2, True, False)]
    assert sum(k.count() for k in laid) <= 2 * len(titles) ** 2 and met[0].count() == 0
    assert [r["s"] for r in spark.sql("select array(1L, 2L) a, array(1L, 2L) b, array(3L) c, array(2L, 3L) d, cast(array() as array<bigint>) e").select(
        F.array(*[T.similarity(F.col(x), F.col(y)) for x, y in ("ab", "ac", "ad", "ae", "ee")]).alias("s")).collect()] == [[1.0, 0.0, 1 / 3, None, None]]
