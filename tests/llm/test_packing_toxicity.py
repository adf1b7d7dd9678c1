import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm.packing import CAPACITIES, pack_documents, pack_shard, sequence_cost
from gleaner.llm.toxicity import Lexicon, drop_toxic, features, fit_lexicon, fold, fold_column, score_toxicity

SCHEMA = "doc_id long, text string, score string"


def test_packing_is_whole_and_fits(spark):
    rng = random.Random(3)
    texts = {i: " ".join(["w"] * rng.choice([0, 1, 10, 300, 600, 1500, 5000, 9000])) for i in range(150)} | {900: None}
    rows = pack_documents(spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA), shard_tokens=60_000).collect()
    total = {}
    bins = {}
    for r in rows:
        assert r["start"] == r["piece"] * max(CAPACITIES)
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["capacity"]))
    assert total == {i: len((t or "").split()) for i, t in texts.items()}
    for parts in bins.values():
        at = 0
        for offset, n, cap in sorted(parts):
            assert offset == at
            at += n
        assert at <= cap and cap == min(c for c in CAPACITIES if c >= at)
    assert len({b.split("-")[0] for b in bins}) > 1
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_edges(spark):
    rows = [(None, "a b", ""), (2**60 + 1, "a b", ""), (5, "a", ""), (5, "a", "")]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (5, 1), (5, 1), (2**60 + 1, 2)]


def test_packing_of_empty_texts_and_full_bins(spark):
    assert pack_shard([(1, 0, 64), (2, 0, 0), (3, 0, 0)], (16, 32, 64)) == [(1, 0, 64, 0, 0, 64), (2, 0, 0, 1, 0, 16), (3, 0, 0, 1, 0, 16)]
    got = pack_documents(spark.createDataFrame([(1, None, ""), (2, "", ""), (3, " \t\n", "")], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"], r["capacity"]) for r in got) == [(i, 0, 0, min(CAPACITIES)) for i in (1, 2, 3)]
    full = [(1, " ".join(["w"] * max(CAPACITIES)), ""), (2, "", "")]
    got = pack_documents(spark.createDataFrame(full, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["capacity"]) for r in got) == [(1, max(CAPACITIES), max(CAPACITIES)), (2, 0, min(CAPACITIES))]


def test_packing_deals_null_ids_and_empty_texts(spark):
    rows = [(None, "a b" if i % 2 else None, "") for i in range(400)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), shard_tokens=100).collect()
    assert sorted(r["n_tokens"] for r in got) == [0] * 200 + [2] * 200
    shards = [r["bin_id"].split("-")[0] for r in got]
    assert len(set(shards)) > 100 and max(map(shards.count, shards)) < 12


def test_packing_bounds_rows_of_a_shard(spark):
    words = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"))
    sizes = pack_documents(words).groupBy(F.split("bin_id", "-")[0]).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()
    assert sum(r["t"] for r in sizes) == 1_000_000 and max(r["n"] for r in sizes) < 150_000


def brute_pack(items, capacities):
    """The same rule by linear search over all bins."""
    bins, order = [], sorted(items, key=lambda x: (-x[2], x[0], x[1]))
    rest = sum(n for _, _, n in order)
    for _, _, n in order:
        rest -= n
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += n
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: (sequence_cost(c) / min(c, n + rest), c))
            bins.append([c, n])
    return sorted(min(c for c in capacities if c >= used) for _, used in bins)


def test_packing_equals_linear_search():
    rng = random.Random(4)
    for _ in range(30):
        items = [(i, 0, rng.randint(0, 64)) for i in range(rng.randint(1, 60))]
        got = pack_shard(items, (16, 32, 64))
        assert sorted({b: c for _, _, _, b, _, c in got}.values()) == brute_pack(items, (16, 32, 64))


def test_folding(spark):
    samples = ["1d10t", "ＩＤＩＯＴ!", "іdіоt", "St@p.  it_now", "", "école N°5", "$cum!!"]
    assert fold("1D10T!!") == " idiot " and fold("іdіоt") == " idiot "
    df = spark.createDataFrame([(t,) for t in samples], "t string").select("t", fold_column(F.col("t")).alias("f"))
    assert all(r["f"] == fold(r["t"]) for r in df.collect())


def test_exceptions_and_beginnings():
    lexicon = Lexicon({" trash ": 4.0, " lowei": 5.0}, ("trash can",))
    a = lexicon.automaton()
    assert features("put it in the trash can", a)[2] == 0
    assert features("trash trash can", a)[2] == 1
    assert features("loweiung flowei", a)[2] == 1
    assert features("Tr4sh", a)[2] == 1
    long, short = (features("trash" + " fine" * n, a) for n in (1000, 30))
    assert long[1] < short[1] and long[0] == short[0]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    clean = [f"word{k}" for k in range(300)] + ["fallacy"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=rng.randint(20, 200))
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["m0ron", "zark" + rng.choice("abcdefgh"), "scum"]))
        if i % 6 == 1:
            words += ["zark", "fallacy"]
        rows.append((i, " ".join(words), ""))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    lexicon = fit_lexicon(docs, labels)
    got = score_toxicity(docs, lexicon).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 80 and sum(r["predicted"] == r["toxic"] for r in got) / len(got) >= 0.97
    kept = drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == score_toxicity(docs, lexicon).where("predicted = 0").count()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "scum", ""), (3, "x " * 100_000, ""), (3, "scum", "")], SCHEMA)
    lexicon = Lexicon({" scum ": 8.0}, (), (-3.0, 1.5, 1.0))
    got = [(r["doc_id"], r["predicted"]) for r in score_toxicity(docs, lexicon).collect()]
    assert got == [(1, 0), (2, 0), (None, 1), (3, 0), (3, 1)]
    empty = fit_lexicon(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.weights == {} and score_toxicity(docs.where("false"), empty).count() == 0
    assert drop_toxic(docs, lexicon).count() == 3


def plain_features(text, weights, exceptions):
    """Entries looked up at every position, one after the other."""
    folded = fold(text)
    covered = [(k, k + len(e) + 1) for e in exceptions for k in range(len(folded)) if folded.startswith(f" {e} ", k)]
    best = {}
    for k in range(len(folded)):
        found = [w for term, w in weights.items() if folded.startswith(term, k)]
        if found and not any(a <= k < b for a, b in covered):
            best[k] = max(found)
    total = sum(best.values())
    return math.log1p(total), math.log1p(100 * total / max(20, len(folded.split()))), len(best)


def test_features_equal_a_plain_scan():
    rng = random.Random(8)
    weights = {" scum ": 3.0, " mor": 2.0, " moron ": 4.0, " tr": 1.5, " trash ": 5.0, " été ": 2.5}
    exceptions = ("trash can", "moron test", "can trash")
    words = ["scum", "m0r0n", "moron", "more", "tr@sh", "trash", "can", "test", "fine", "word", "ÉTÉ", "x_y", "!!", "scum!!", "tr"]
    for _ in range(300):
        text = rng.choice([" ", "", "  "]) + "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randint(0, 40)))
        lexicon = Lexicon(weights, exceptions)
        assert features(text, lexicon.automaton()) == pytest.approx(plain_features(text, weights, exceptions) if text else (0.0, 0.0, 0))


def test_one_toxic_word_does_not_condemn_its_beginning(spark):
    """A beginning is an entry only where several words that clean texts don't have share it."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(400)}" for _ in range(40)]
        if i % 4 == 0:
            words.insert(rng.randrange(40), rng.choice(["pathetic", "worthless", "trash", "grumpa", "grumpb", "grumpc", "grumpd"]))
        rows.append((i, " ".join(words), ""))
        labels.append((i, int(i % 4 == 0)))
    lexicon = fit_lexicon(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {" pathetic ", " worthless ", " trash ", " grump"} <= set(lexicon.weights) and not {" path", " wort", " tras"} & set(lexicon.weights)
    fine = [
        "The path through the forest leads to the old house where we were born.", "Das Wort des Jahres ist ein altes Wort, und der Weg ist weit.",
        "Tras la reunion, el equipo volvio a casa y la tarea quedo lista.", "Worthwhile reading for all of us, and le travail est fini.",
    ]
    got = score_toxicity(spark.createDataFrame(list(enumerate(fine)), "doc_id long, text string"), lexicon)
    assert all(r["score"] < 0.3 and r["n_hits"] == 0 for r in got.collect())
