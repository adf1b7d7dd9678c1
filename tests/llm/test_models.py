"""BPE against the tokenizers library, language ID by gradients and held-out accuracy."""

import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import bpe
from gleaner.llm import language_id as L

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string"

TEXTS = ["", None, "aaaaaaaaaa  \n\n x", "'s don't  we'LL", "<|endoftext|> a<|endoftext|>", "日本語 テスト \U0001f600\U0001f600 é", "   x", "x" * 40_000, "the " * 30_000, "\x00\x7f\r\n\t"]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_encoding_equals_the_library(spark):
    rng = random.Random(9)
    random_texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x3040, 0x30FF), 32, 10])) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts = TEXTS + random_texts
    ids, decoded = library(texts)
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    for r in bpe.encode_documents(df, PATH, digests=True).collect():
        want = np.array(ids[r["doc_id"]], "<u4").tobytes()
        assert r["n_tokens"] == len(want) // 4 and r["ids_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded[r["doc_id"]].encode()).hexdigest()
    plain = {r["doc_id"]: r for r in bpe.encode_documents(df, PATH).collect()}
    assert all(plain[i]["ids"] == ids[i] and plain[i]["text"] == decoded[i] for i in plain)
    assert bpe.encode_documents(df.where("false"), PATH).count() == 0


def test_words_beyond_the_tables(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KNOWN", 500)
    monkeypatch.setattr(bpe, "MAX_ARCS", 10)
    monkeypatch.setattr(bpe, "LONG_WORD", 4)
    e = bpe.Encoder(PATH)
    texts = ["one two three four", "five six seven", "one two eight nine ten eleven", "x" * 3000 + " " + "ab" * 3000]
    got = [np.frombuffer(e.encode_batch([t])[0], "<u4").tolist() for t in texts]
    assert got == library(texts)[0]


def merged(word, vocabulary):
    """BPE as it reads: again and again the leftmost pair of the lowest rank."""
    ids = [vocabulary.byte[b] for b in word]
    while True:
        found = [(vocabulary.merge[p], k) for k, p in enumerate(a * bpe.PAIR + b for a, b in zip(ids, ids[1:])) if p in vocabulary.merge]
        if not found:
            return ids
        m, k = min(found)
        ids[k : k + 2] = [m % bpe.PAIR]


def test_automaton_equals_merging():
    e = bpe.Encoder(PATH)
    a, v = e.automaton, e.vocabulary
    rng = random.Random(8)
    tokens = [t for t in v.label if t in a.rank]
    words = [v.label[t] for t in rng.sample(tokens, 3000)] + [b"".join(v.label[t] for t in rng.sample(tokens, 3)) for _ in range(2000)]
    words += [bytes(rng.choices(b"aeinrst \xc3\xa9", k=rng.randint(1, 40))) for _ in range(2000)] + [b"a" * n for n in range(1, 60)] + [b"", b"\xff\x00"]
    for w in words:
        assert a.encode(w) == merged(w, v)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    assert all(a.follows(x, y) == (merged(v.label[x] + v.label[y], v) == [x, y]) for x, y in pairs)


def test_encoding_reads_the_tables():
    e = bpe.Encoder(PATH)
    before = e.encode_batch(["thwhedble eatiwh ontiea automaton"])
    used = dict(e.automaton.arcs)
    assert used and any(not ok for ok in used.values())
    e.known.clear()
    e.automaton.arcs = dict.fromkeys(used, True)
    assert e.encode_batch(["thwhedble eatiwh ontiea automaton"]) != before
    e.known.clear()
    e.automaton.table.clear()
    assert e.encode_batch(["thwhedble eatiwh ontiea automaton"]) == [b""]


def test_decode_replaces_broken_bytes():
    e = bpe.Encoder(PATH)
    ids = np.array([e.vocabulary.byte[0xE3], e.vocabulary.byte[0x41]], "<u4").tobytes()
    assert e.decode(ids) == "�A"


def test_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 110, (6, 12)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    p = {"E": rng.normal(0, 1, (256, L.EMBEDDING)), "O": rng.normal(0, 1, (L.FILTERS * len(L.WIDTHS), 3)), "o": rng.normal(0, 1, 3)}
    for w in L.WIDTHS:
        p[f"W{w}"], p[f"b{w}"] = rng.normal(0, 1, (w * L.EMBEDDING, L.FILTERS)), rng.normal(0, 1, L.FILTERS)
    weight = np.ones(3)

    def loss():
        tables = [np.einsum("be,wef->wbf", p["E"], p[f"W{w}"].reshape(w, L.EMBEDDING, L.FILTERS)) for w in L.WIDTHS]
        q = L.Network(("a", "b", "c"), tables, [p[f"b{w}"] for w in L.WIDTHS], p["O"], p["o"]).probabilities(x)
        return -np.log(q[np.arange(6), y]).mean()

    g = L._gradients(p, x, y, weight)
    for k, at in [("E", (100, 3)), ("W3", (5, 2)), ("b2", (1,)), ("O", (4, 1)), ("o", (2,)), ("W4", (30, 7))]:
        keep, h = p[k][at], 1e-5
        p[k][at] = keep + h
        up = loss()
        p[k][at] = keep - h
        down = loss()
        p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / (2 * h), abs=1e-4)


def test_tables_equal_direct_convolution():
    """Prediction by lookup tables against a plain convolution over embeddings, for every window of a text."""
    rng = np.random.default_rng(3)
    labels = ("a", "b")
    x = rng.integers(97, 123, (40, L.WINDOW)).astype(np.uint8)
    x[20:] = rng.integers(200, 220, (20, L.WINDOW))
    caught = {}
    keep, L._gradients = L._gradients, lambda p, *rest: caught.setdefault("p", p) and keep(p, *rest)
    try:
        net = L.train(x, np.repeat([0, 1], 20), labels)
    finally:
        L._gradients = keep
    p = caught["p"]
    text = "Wörter und words, 12 of all kinds " * 30
    mean, weight = np.zeros(2), 0.0
    for window in L.windows(text):
        pooled = []
        for w in L.WIDTHS:
            best = np.full(L.FILTERS, -np.inf)
            for at in range(L.WINDOW - w + 1):
                total = sum(p["E"][window[at + k]] @ p[f"W{w}"].reshape(w, L.EMBEDDING, L.FILTERS)[k] for k in range(w))
                best = np.maximum(best, total)
            pooled.append(np.maximum(best + p[f"b{w}"], 0))
        z = np.concatenate(pooled) @ p["O"] + p["o"]
        q, n = np.exp(z - z.max()), ((window != 0) & (window != 32)).sum()
        mean, weight = mean + n * q / q.sum(), weight + n
    label, score = net.predict(text)
    assert label == labels[int(mean.argmax())] and score == pytest.approx(mean.max() / weight, abs=1e-4)


def test_rare_languages_are_learned(spark):
    rows = [(i, f"keit schung {i} der und die ", "de", "") for i in range(4000)] + [(9000 + i, f"ción los que {i} y mente ", "es", "") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = L.fit_network(df, max_rows=100)
    assert net.labels == ("de", "es") and net.predict("los que ción mente y los")[0] == "es"


def test_held_out_languages(spark):
    rng = random.Random(10)
    parts = {"aa": ["ing", "the", "tion", "ou", "er"], "bb": ["sch", "keit", "ung", "ei", "ß"], "cc": ["ción", "os", "ñ", "mente", "ll"]}
    rows = []
    for i in range(360):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(4, 200))), lang if i % 9 else None, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 !?", "aa", "x"), (None, "schkeit ung keit eiß", None, "x"), (1003, "ción mente os " * 9000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in L.identify_languages(df, L.fit_network(df)).collect()}
    truth = {r[0]: r[2] for r in rows[:360] if r[2]}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 40 and sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "cc" and got[None]["lang_pred"] == "bb" and not got[None]["held_out"]
    none = L.fit_network(df.where("false"))
    assert L.identify_languages(df, none).where("lang_pred <> 'und'").count() == 0
