"""The pipeline against a plain-Python version of its stages; only the learned lexicon is shared."""

import random

import corpus_pipeline
from gleaner.llm.packing import CAPACITIES
from gleaner.llm.toxicity import features, fit_lexicon
from test_dedup import brute_components, brute_passages


def corpus():
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda n: "\n".join(" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(n))
    passage = " ".join(word() for _ in range(60))
    many = "\n".join(" ".join(word() for _ in range(8)) for _ in range(8))
    prose = "".join(word() + (", " if k % 6 == 5 else " ") for k in range(70))
    rows, labels = [], []
    for i in range(300):
        t = text(rng.randint(1, 6))
        if i % 10 == 3:
            t += "\n" + passage
        if i % 10 == 6:
            t = " ".join((t, many, text(1)))
        if i % 10 == 7:
            t = " ".join((t, prose, text(1)))
        if i % 10 == 4:
            t = rows[rng.randrange(len(rows))][1]
        if i % 10 == 5:
            w = rows[rng.randrange(len(rows))][1].split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        if i % 4 == 0:
            t = "zarko moronic " + t + " scummy zarko"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int("zarko" in t)))
    return [*rows, (900, "", "en", "s", 0), (901, None, None, None, None), (902, passage, "en", "s", 1)], labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    lexicon = fit_lexicon(docs, marks)
    automaton, (c0, c1, c2) = lexicon.automaton(), lexicon.curve
    clean = {}
    for i, t, *_ in rows:
        a, b, _ = features(t, automaton)
        if c0 + c1 * a + c2 * b < -0.8472979:  # the log-odds of 0.3
            clean[i] = t
    assert 0 < len(clean) < len(rows)
    first = {}
    for i, t in sorted(clean.items()):
        first.setdefault(" ".join((t or "").split()) if (t or "").strip() else (t or ""), i)
    exact = {i: clean[i] for i in first.values()}
    near = {i: t for i, t in exact.items() if brute_components(exact)[i] == i}
    left = brute_passages([(i, t) for i, t in near.items() if t is not None], 20)
    assert sum(bool(spans) for _, _, spans in left) > 40
    want = {i: len(t.split()) for i, t, spans in left if not spans or t.strip()} | {i: 0 for i, t in near.items() if t is None}
    got, bins = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
    assert got == want and max(bins.values()) <= max(CAPACITIES)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows[:80], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels[:80], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(1, "a b c", None, None, None), (1, "a b c", None, None, None), (None, "d e f", None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert (None, 3) in got and (1, 3) in got
