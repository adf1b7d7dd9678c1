"""Exact, substring and near dedup against brute force on small tables."""

import itertools
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from gleaner.llm import minhash_dedup as M
from gleaner.llm.common import components, Scratch
from gleaner.llm.exact_dedup import exact_dedup, exact_groups
from gleaner.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, keep_id long"  # keep_id clashes with a result's name


def brute_components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(rng: random.Random, n: int = 260) -> dict[int, str]:
    vocabulary = [f"w{k}" for k in range(500)]
    bases = [rng.choices(vocabulary, k=rng.randint(40, 150)) for _ in range(12)]
    passage = rng.choices(vocabulary, k=30)
    texts = {}
    for i in range(n):
        words = list(rng.choice(bases)) if i % 4 else rng.choices(vocabulary, k=rng.randint(1, 120))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        if i % 7 == 0:
            words += passage
        texts[i] = " ".join(words)
    return texts


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)  # the blocks of large groups are used too
    texts = near_copies(random.Random(5))
    texts |= {1000: None, 1001: "", 1002: " \n", 1003: "One two", 1004: "one  TWO", 1005: "x " * 30000}
    got = {r["doc_id"]: r for r in M.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in texts.items()], SCHEMA)).collect()}
    want = brute_components(texts)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert got[1000]["n_shingles"] == got[1001]["n_shingles"] == got[1002]["n_shingles"] == 0 and got[1003]["n_shingles"] == 1
    assert got[1005]["n_shingles"] == 1


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", 0), (None, "a b c d e f", 0), (7, "a b c d e f", 0), (7, "a b c d e f", 0), (9, "a b c d e f", 1)]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    kept = M.near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "keep_id"] and kept.count() == 4
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rows = [(3, "a b c d e f", 0), (7, "a b c d e f", 0), (7, "q r s t u v w", 0), (9, "q r s t u v w", 0)]
    got = M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(3, 2, 3, True), (7, 2, 3, False), (7, 3, 3, False), (9, 3, 3, False)]


def test_tables_find_pairs_at_the_threshold():
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    missed = 0
    for _ in range(300):
        a = M._mix(M.np.array(rng.sample(range(2**40), 350), M.np.uint64))
        b = M.np.concatenate([a[:300], M._mix(M.np.array(rng.sample(range(2**41, 2**42), 50), M.np.uint64))])
        x, y = M.tensor_halves(a), M.tensor_halves(b)
        hits = set(x[x == y] & 1)
        missed += hits != {0, 1}
    assert missed <= 1 and base


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_exact_groups(spark):
    texts = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (6, ""), (8, "a b "), (None, "q"), (2, "x" * 300_000), (1, "x" * 300_000), (1, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(df).collect())
    assert got == [(-1, None, 1, True), (1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 3, True), (4, 4, 2, True), (5, 3, 3, False), (6, 4, 2, False), (8, 8, 1, True), (9, 3, 3, False)]
    assert exact_groups(df.where("false")).count() == 0


def test_exact_dedup_keeps_what_groups_keep(spark):
    rows = [(5, "a  b", 1), (3, "a\tb", 2), (4, None, 3), (6, "", 4), (None, "q", 5), (None, "a b", 6), (1, "c", 7), (1, "c", 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = exact_dedup(df)
    assert kept.columns == df.columns and sorted(r["keep_id"] for r in kept.collect()) == [2, 3, 5, 7, 8]
    assert exact_dedup(df.where("false")).count() == 0


def test_exact_groups_tell_colliding_digests_apart(spark):
    df = spark.createDataFrame([(i, f"text {i % 3}", 0) for i in range(12)], SCHEMA)
    got = exact_groups(df, digest=lambda c: F.lit("same")).collect()
    assert all(r["keep_id"] == r["doc_id"] % 3 and r["group_size"] == 4 for r in got)


def brute_units(text):
    """Units with their trailing blank, cut by hand."""
    out, at, k = [], 0, 0
    while k < len(text):
        end = None
        if text[k] == "\n":
            end = k + 1
        elif text[k] in ".!?,;:":
            j = k + 1
            while j < len(text) and j <= k + 8 and text[j] in string.punctuation and text[j] != "_":
                j += 1
            if j < len(text) and text[j] in " \t":
                end = j + 1
        if end:
            out.append(text[at:end])
            at = k = end
        else:
            k += 1
    return out + [text[at:]] * (at < len(text))


def brute_passages(rows, min_words):
    """Rows of ``id, text, spans`` by comparing the words of paragraphs, in the order of ids, and then those beside them."""
    first, texts, out = {}, {}, []
    for i, text in sorted(rows):
        units = brute_units(text)
        words = [u.lower().encode().split() for u in units]
        ends = list(itertools.accumulate(map(len, units)))
        texts[i] = words
        own, found = {}, []
        for k in range(len(units)):
            for j in range(k + 1, len(units) + 1):
                run = tuple(itertools.chain.from_iterable(words[k:j]))
                if words[k] and len(run) >= min_words:
                    if run in first:
                        found.append((k, j, *first[run]))
                    elif own.setdefault(run, (i, k, j))[2] <= k:
                        found.append((k, j, *own[run]))
                    break
        first |= own
        spelled = [(m.group().lower().encode(), m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text)]
        spans = []
        for at, (k, j, f, f_k, f_j) in enumerate(found):
            a, b = ends[k] - len(units[k]), ends[j - 1]
            near = [abs(found[x][0] - k) for x in (at - 1, at + 1) if 0 <= x < len(found)]
            if f != i and (len(near) < 2 or max(near) > 1):
                before = next((w for w in reversed(texts[f][:f_k]) if w), [])
                after, enough = [], None
                for w in texts[f][f_j:]:
                    after += w
                    if enough is not None and len(after) > enough:
                        break
                    if enough is None and len(after) >= min_words:
                        enough = len(after)
                left, right = [w for w in spelled if w[1] < a], [w for w in spelled if w[1] >= b]
                while left and before and left[-1][0] == before[-1]:
                    a = left.pop()[1]
                    before = before[:-1]
                while right and after and right[0][0] == after[0]:
                    b = right.pop(0)[2]
                    after = after[1:]
            spans.append((a, b))
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        cuts = [0, *itertools.chain.from_iterable(merged), len(text)]
        out.append((i, "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)), merged))
    return out


def cleaned(spark, rows, **options):
    got = substring_dedup(spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA), **options)
    assert got.columns == ["doc_id", "text", "keep_id", "n_removed", "removed_spans"]
    assert all(r["n_removed"] == len(r["removed_spans"]) for r in got.collect())
    return sorted((r["doc_id"], r["text"], [tuple(s) for s in r["removed_spans"]]) for r in got.collect())


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    phrases = [" ".join(rng.choices(["alpha", "Béta", "gamma", "delta\t", "İx"], k=rng.randint(1, 6))) + rng.choice([".", ",", "?!", '."', ""]) for _ in range(40)]
    rows = []
    for i in range(90):
        parts = [rng.choice([str.upper, str, lambda x: f"  {x} "])(rng.choice(phrases)) for _ in range(rng.randint(0, 14))]
        rows.append((i, "".join(p + rng.choice(["\n", " ", "  ", "\n\n"]) for p in parts)))
    rows += [(100, "!" * 5000), (101, "a. " * 50), (102, "a. " * 50), (103, "x " * 30)]
    for words in (1, 4, 9):
        assert cleaned(spark, rows, min_words=words) == brute_passages(rows, words)


def test_substring_dedup_finds_passages_wherever_they_stand(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    prose = lambda n: "".join(word() + rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n"]) for _ in range(n))
    wrapped = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n // 9))
    passages = [prose(70), wrapped(63), wrapped(45).replace("\n", ".\n"), prose(70).replace("\n", " ")]
    rows = [(k, prose(80) + p + prose(40)) for k, p in enumerate(passages)]
    rows += [(10 + k, prose(50).rstrip(",. \n") + " " + p + " " + prose(50)) for k, p in enumerate(passages * 3)]
    rows += [(50 + k, prose(120)) for k in range(20)]
    got = {i: (text, spans) for i, text, spans in cleaned(spark, rows)}
    for i, text in rows:
        if 10 <= i < 50:
            passage = passages[(i - 10) % 4]
            assert sum(b - a for a, b in got[i][1]) > 0.95 * len(passage) and all(text.index(passage) - 1 <= a < b <= text.index(passage) + len(passage) + 1 for a, b in got[i][1])
        else:
            assert got[i] == (text, [])


def test_substring_dedup_edges(spark):
    line = " ".join(["word"] * 30)
    rows = [(None, line, 0), (1, None, 0), (2, "", 0), (3, f"{line}\n{line}", 0), (4, line, 0), (4, line, 0), (5, "q. " + line, 0), (5, "r. s. " + line, 0)]
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [(None, line, 0), (1, None, 0), (2, "", 0), (3, line + "\n", 1), (4, "", 1), (4, "", 1), (5, "q. ", 1), (5, "r. s. ", 1)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([("b", line, "x", 7, 1), ("a", line, "y", 8, 2)], "doc_id string, text string, removed_spans string, n_removed int, high int")
    got = {r["doc_id"]: r.asDict() for r in substring_dedup(clash).collect()}
    assert got["a"]["n_removed"] == 0 and got["b"]["text"] == "" and got["b"]["high"] == 1


def test_substring_dedup_is_linear_in_long_texts(spark):
    text = "".join(f"unit {k % 977} of a long text, " for k in range(120_000)) + "! " + "!" * 1_000_000
    rows = [(1, text, 0), (2, text, 0)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] >= 1 and got[2] >= 1


@pytest.mark.parametrize("text, n", [("a b c d e", 1), ("a b c d e f", 2), ("A\x0bb  c", 1), ("é É", 1)])
def test_shingle_sets(text, n):
    assert len(M.shingle_set(text)) == n
