import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.llm import fingerprints as P

SCHEMA = "doc_id long, text string, near_next int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_print(text):
    leaf = re.compile(r"(?s)[^.!?|]{0,200}[.!?|]+|[^.!?|]{1,200}")
    tree = [[[sha(x) for x in leaf.findall(p)] for p in s.split("\n")] for s in text.split("\n\n")]
    node = lambda xs: sha("".join(xs))
    root = node(node(node(p) for p in s) for s in tree)
    return root + ":" + ";".join("/".join("".join(x[:8] for x in p) for p in s) for s in tree)


def brute_like(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    x, y = (set(re.findall("[0-9a-f]{8}", p.split(":")[1])) for p in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    rng = random.Random(8)
    words = ["un", "deux", "été.", "fin!", "\n", "\n\n", "x|", "\U0001f600", "long" * 120]
    texts = {i * 3 % 101: " ".join(rng.choices(words, k=rng.randint(0, 40))) for i in range(40)}
    texts |= {500: None, 501: "", 502: "z" * 100_001, 503: texts[0], 504: texts[0]}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r for r in P.compare_with_next(df).collect()}
    ids = sorted(texts)
    for at, i in enumerate(ids):
        t, follow = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + follow[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(edited), brute_print(t), brute_print(edited))
        assert r["near_edited"] == pytest.approx(brute_like(brute_print(t), brute_print(edited)))
        assert r["near_next"] == pytest.approx(brute_like(brute_print(t), brute_print(follow)))
    assert len(got) == len(ids) and got[503]["near_next"] == 1.0


def test_edges(spark):
    one = P.compare_with_next(spark.createDataFrame([(7, "abcd", 0)], SCHEMA)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha("abca")
    rows = [(None, "abcd", 0), (None, "", 0), (3, "b", 0), (3, "a", 0), (2, "12345678", 0)]
    got = P.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in got) == sorted([(0, sha("abc")), (0, sha("")), (3, sha("b")), (3, sha("a")), (2, sha("123456a"))])
    assert P.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_changed_branches(spark):
    df = spark.createDataFrame([("a.\nb. c.\n\nd.", "a.\nb. x.\n\nd.\ne."), ("same", "same")], "s string, t string")
    tree = [P.fingerprint(P.merkle_tree(F.col(c))) for c in ("s", "t")]
    got = [[tuple(x) for x in r[0]] for r in df.select(P.changed_branches(*tree)).collect()]
    assert got == [[(0, 1), (1, 1)], []]


def test_plan_has_no_python(spark):
    df = P.compare_with_next(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], SCHEMA))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
