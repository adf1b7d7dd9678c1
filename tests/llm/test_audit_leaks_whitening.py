import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from gleaner.llm import decontaminate as D
from gleaner.llm import filter_audit as A
from gleaner.llm import whitening as W

# ---------------------------------------------------------------- filter audit


def fails(text, earlier):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search("[#$%&*|]", text)), text in earlier,
    )


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        earlier = {t or "" for j, t, _ in docs if i is not None and j is not None and j < i}
        rows.append((lang or "", fails(text or "", earlier), i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == part]
        shapley = [0] * 5
        for order in itertools.permutations(range(5)):
            left = of
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                only = sum(r[1][f] and sum(r[1]) == 1 for r in of)
                out[part, "".join("ABCDE"[k] for k in order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in of) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley["ABCDE".index(order[step - 1])])
    return out


DOCS = "doc_id long, text string, lang string, n int, part string, good int"


def audit(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, "x", 1) for d in docs], DOCS)
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split()] for r in A.audit_filters(df, of).collect()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(12)
    long = " ".join(f"w{k}" for k in range(260))
    texts = [long, long + " #", "A B " * 150, "a b " * 150, "", None, "x" * 50_000, "Ünïcode CAPS", long + " | $", " \t\n "]
    docs = [(i * 40_000, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(40_000, long, "en"), (40_000, "other", "en"), (None, long, "en"), (None, None, None), (None, long, "de"), (-5, long, "fr")]
    labels = [(i * 40_000, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(50)] + [(0, 1, 1), (None, 1, 1), (99, 1, 1)]
    merged = {}
    for i, q, t in labels:
        old = merged.get(i, (0, 0))
        merged[i] = (max(old[0], q or 0), max(old[1], t or 0))
    assert audit(spark, docs, labels) == brute_audit(docs, [(i, *v) for i, v in merged.items()])


def test_audit_of_nothing(spark):
    assert audit(spark, [], []) == {}
    (only,) = {tuple(v[:3]) for k, v in audit(spark, [(1, "", None)], []).items() if k[1].startswith("A") and k[2] == 1}
    assert only == (0, 1, 0)


def test_merges_of_lists():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        assert A.union(*lists) == sorted(set().union(*lists))
        a, b = lists[0], lists[-1]
        assert A.difference(a, b) == sorted(set(a) - set(b))
    assert A.union() == [] and A.difference([], [1]) == [] and A.difference([1, 2], []) == [1, 2]
    assert A.union(list(range(0, 1000)), list(range(500, 2000)), [1500]) == list(range(2000))


# ---------------------------------------------------------------- decontamination


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_hits(docs, items, window=10):
    phrases = []
    for item, text in items:
        w = words_of(text)
        if w and item is not None:
            m = min(window, len(w))
            phrases += [(item, w[k : k + m]) for k in range(len(w) - m + 1)]
    out = []
    for i, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def contaminated(spark, docs, items, **more):
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return D.contaminated_documents(a, b, **more)


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("sizes", [(1 << 19, 1 << 18, 1 << 12), (50, 40, 7)])
def test_decontamination_equals_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("SEGMENT_WORDS", "ROUND_WORDS", "PIECE_WORDS"), sizes, strict=True):
        monkeypatch.setattr(D, name, size)
    rng = random.Random(13)
    vocabulary = ["de", "la", "Où", "été", "x1", "漢字", "\U0001f600", "AB", "ab", "z"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "\x00", "--"]) for _ in range(n))
    items = [(k, say(rng.choice([12, 25, 40]))) for k in range(12)] + [(20, "rare"), (21, "de la"), (22, ""), (23, None), (None, "secret words"), (0, "another text of item zero"), (30, "été")]
    docs = []
    for k in range(60):
        text = say(rng.randint(0, 30))
        if k % 3 == 0:
            w = words_of(rng.choice(items[:12])[1])
            at = rng.randrange(max(1, len(w) - 10))
            text += " " + " / ".join(w[at : at + rng.randint(8, 14)]).upper().replace("É", "é").replace("Ù", "ù") + " " + say(3)
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "ab"), (7, "rare"), (7, "rare secret words"), (None, "de la"), (103, "Another text of item ZERO"), (104, "x " * 3000 + "rare")]
    got = contaminated(spark, docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_hits(docs, items), key=key)
    assert sum(r["contaminated"] for r in got) > 20


def test_spans_lists_and_dropping(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"x {item} y"), (2, item), (3, "one two three"), (4, None)]
    rows = {r["doc_id"]: r for r in contaminated(spark, docs, [(5, item), (11, item)]).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(1, 12)] and [tuple(s) for s in rows[2]["spans"]] == [(0, 11)]
    assert rows[1]["items"] == ["11", "5"] and rows[3]["spans"] == [] and rows[4]["items"] == []
    a = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, __k string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {r["doc_id"] for r in D.drop_contaminated(a, b).collect()} == {3, 4}


def test_proximity_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 25)))) for k in range(40)]
    items = [(k, " ".join(rng.choices("abcdefghijk", k=3))) for k in range(6)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in contaminated(spark, docs, items, slack=2).collect()}
    for i, text in docs:
        w = text.split()
        hit = set()
        for _, t in items:
            p = t.split()
            for a, b in itertools.combinations(range(len(w) + 1), 2):
                if b - a <= len(p) + 2 and set(p) <= set(w[a:b]) and w[a] in p and not set(p) <= set(w[a : b - 1]):
                    hit |= set(range(a, b))
        assert {k for a, b in got[i] for k in range(a, b)} == hit, i
    assert any(got.values())


def test_no_documents_or_items(spark):
    assert contaminated(spark, [], [(1, "a")]).count() == 0
    (r,) = contaminated(spark, [(1, "a b")], []).collect()
    assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (2, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_positions_come_back():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 5000)
    ends = np.cumsum(np.bincount(words, minlength=50))
    positions = np.argsort(words, kind="stable")
    assert (D._unpack(D._pack(positions, ends), ends) == positions).all()
    one = np.array([1])
    assert (D._unpack(D._pack(np.array([0]), one), one) == 0).all()


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int, n int, component int"


def whitened(spark, rows):
    return W.whitened_components(spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], VECTORS)).collect()


def test_whitening_equals_plain_numpy(spark):
    rng = np.random.default_rng(11)
    base = (rng.normal(size=(150, 40)) * rng.uniform(0.2, 3, 40)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000 + k, base[0].tolist()) for k in range(70)] + [(None, base[1].tolist()), (3, base[2].tolist())]
    bad = [(5000, None), (5001, [float("nan")] * 40), (5002, [float("inf"), *[0.0] * 39]), (5003, [None, *[0.0] * 39]), (5004, []), (5005, [1.0, 2.0])]
    got = whitened(spark, rows + bad)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(rows), x.sum(axis=0)
    centred = np.array([[float(int(a) * n - int(s)) / n for a, s in zip(r, sums, strict=True)] for r in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = centred @ vectors / np.sqrt(values)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    by: dict = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    for (i, _), d, w in zip(rows, deviation, want, strict=True):
        of = by[i, d]
        assert sorted(of) == list(range(1, 33))
        for k in range(32):
            assert abs(of[k + 1][0]["whitened"]) == pytest.approx(abs(w[k]), abs=1e-7)
            assert of[k + 1][0]["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9
    signs = [np.sign(by[i, d][1][0]["whitened"]) * np.sign(w[0]) for (i, _), d, w in zip(rows, deviation, want, strict=True) if abs(w[0]) > 1e-6]
    assert len(set(signs)) == 1


def test_whitening_of_little(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(k, [1.0, 2.0]) for k in range(5)]) == []  # no variance
    line = whitened(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])
    assert {r["component"] for r in line} == {1} and len(line) == 5 and {round(r["explained"], 6) for r in line} == {1.0}
    assert sum(r["whitened"] ** 2 for r in line) / 5 == pytest.approx(1.0)


def test_each_vector_once_weighted_by_one(spark):
    rows = [(k, [float(k % 3), float(k % 2)], 0, 0, 0) for k in range(50)]
    df = spark.createDataFrame(rows, VECTORS)
    assert W.whiten(df, counted=False).first()["fit"]["n"] == 6 and W.whiten(df).first()["fit"]["n"] == 50


def test_packing_of_entries():
    x = np.array([[0, -1], [127, -128], [128, 0], [40_000, 1], [1 << 40, -5]], np.int64)
    codes = W._pack(x)
    assert [c[0] for c in codes] == [0, 0, 1, 2, 3] and (W._unpack(codes) - W.SHIFT == x).all()
    big = W.Whitening.__new__(W.Whitening)
    big.n, big.sums = 10, np.array([10_000_000, 20])
    assert big.deviation(np.array([[1_000_003, 1], [1_000_000 + (1 << 20), 5]])) == [30**2 + 10**2, ((1 << 20) * 10) ** 2 + 30**2]
    with pytest.raises(OverflowError):
        big.deviation(np.array([[1 << 60, 0]]))
