"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick on folded text and normalised by length.

Folding undoes disguises: lower case, full-width forms, Cyrillic and Greek look-alikes, and digits or signs for letters. A
lexicon entry is a whole word or the beginning of words, with a weight; an exception phrase covers the entries inside it,
which then don't count. The weights of the words found give two features, their sum and their density in the text, and a
logistic curve over both gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out

# Letters of other alphabets that look like Latin ones, and what stands for letters in disguised words.
CYRILLIC = "авеіјкмнорѕстухԁһӏ"
CYRILLIC_LIKE = "abeijkmhopsctyxdhl"
GREEK = "αβεηικμνορτυχ"
GREEK_LIKE = "abenikmvoptux"
SIGNS = "0134578@$!"
SIGNS_LIKE = "oieastbasi"

FULL_WIDTH = "".join(map(chr, range(0xFF41, 0xFF5B)))
FULL_WIDTH_LIKE = "".join(map(chr, range(0x61, 0x7B)))
_LETTERS, _LETTERS_LIKE = CYRILLIC + GREEK + FULL_WIDTH, CYRILLIC_LIKE + GREEK_LIKE + FULL_WIDTH_LIKE

#: Labelled rows that a fit reads at most, those with the smallest crc32 of the id.
MAX_FIT_ROWS = 20_000
MIN_FAMILIES = 3
MIN_WEIGHT = 3.0
PREFIXES = range(4, 9)
#: Different words that only toxic texts have and that share a beginning before it can be an entry.
MIN_FORMS = 3
CUT = 0.3

_FOLD = str.maketrans(_LETTERS + SIGNS, _LETTERS_LIKE + SIGNS_LIKE)
_TRAIL = re.compile(r"!+(?!\w)")
_GAP = re.compile(r"[^\w]+|_+")


def fold(text: str) -> str:
    """Words in plain lower-case letters between single spaces, with a space at either end."""
    return f" {_GAP.sub(' ', _TRAIL.sub(' ', text.lower()).translate(_FOLD)).strip()} "


def fold_column(text: Column) -> Column:
    """``fold`` as a column."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)!+(?!\w)", " ")
    plain = F.translate(plain, _LETTERS + SIGNS, _LETTERS_LIKE + SIGNS_LIKE)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"(?U)[^\w]+|_+", " ")), F.lit(" "))


@dataclass(frozen=True)
class Lexicon:
    """Entries ``" word "`` or ``" beginning"`` with weights, exception phrases, and the curve of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase).strip()) + 2, None))
        if len(a):
            a.make_automaton()
        return a


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, int]:
    """Logarithms of the summed weight and of the weight per 100 words; the number of words found."""
    if not text or not len(automaton):
        return 0.0, 0.0, 0
    folded = fold(text)
    best: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(folded):
        at = end + 1 - size
        if w is None:
            covered.append((at, end))
        else:
            best[at] = max(w, best.get(at, 0.0))
    if covered:
        covered.sort()
        upto, k, kept = -1, 0, {}
        for at in sorted(best):
            while k < len(covered) and covered[k][0] <= at:
                upto = max(upto, covered[k][1])
                k += 1
            if at >= upto:
                kept[at] = best[at]
        best = kept
    total = sum(best.values())
    return math.log1p(total), math.log1p(100 * total / max(20, folded.count(" ") - 1)), len(best)


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton steps, with a ridge so that separable data settle."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    penalty = np.diag([0.01, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_FIT_ROWS,
    exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learn entries, weights, exception phrases and the curve from labelled rows that aren't held out.

    At most ``max_rows`` labelled rows are read, which also bounds what comes to the driver: their terms, pairs and features. A
    term's weight is its smoothed log-odds between the classes, counted in
    families of documents (by one minimum hash of three-word shingles) so that copies of one text don't vouch for each other.
    A word needs so many toxic families that chance alone would hardly yield one such among all words; words of one or two
    letters are none. The beginning of words becomes an entry only where ``MIN_FORMS`` different words that no clean text has
    share it, so that one toxic word doesn't condemn all words that begin like it; all its words together must pass as a word
    does. A pair of words with an entry inside that clean families use more than toxic
    ones becomes an exception. Without labels of both classes the lexicon is empty and every score is the curve's floor.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.crc32(F.col("id").cast("string").cast("binary")), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).join(F.broadcast(ids), "id").select("id", "y", fold_column(F.col("raw")).alias("t"))
    rows = rows.withColumn("w", F.split(F.trim("t"), " "))
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 3)), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(3)]))
    rows = rows.select("id", "y", "t", F.array_min(triples).alias("family"), F.array_distinct("w").alias("words"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.table(rows, "sample")
    sizes = dict(rows.groupBy("y").agg(F.countDistinct("family")).collect())
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(exceptions=exceptions)
    table = (
        rows.select("y", "family", F.explode("words").alias("word"))
        .where("length(word) > 2")
        .groupBy("word")
        .agg(*[F.countDistinct(F.when(F.col("y") == v, F.col("family"))).alias(n) for v, n in ((1, "a"), (0, "b"))])
    )
    table = scratch.table(table, "words")
    chance = sizes[1] / (sizes[0] + sizes[1])
    least = max(MIN_FAMILIES, math.ceil(math.log(max(2, table.count())) / math.log(1 / chance)))
    odds = F.log((F.col("a") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("b") + 0.5) / (sizes[0] + 1.0))
    toxic = (F.col("a") >= least) & (odds >= MIN_WEIGHT) & (F.col("b") * 10 <= F.col("a"))
    judged = table.withColumns({"w": odds, "entry": toxic})
    exact = judged.where("entry").select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("term"), "w")
    begin = F.explode(F.array(*[F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in PREFIXES]))
    starts = judged.select(begin.alias("term"), "a", "b").where("term is not null").groupBy("term")
    starts = starts.agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("forms"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    starts = starts.where((F.col("forms") >= MIN_FORMS) & toxic).select("term", odds.alias("w"))
    weights = {r["term"]: r["w"] for r in exact.union(starts).orderBy("term").collect()}
    lexicon = Lexicon(weights, exceptions)
    if not weights:
        return lexicon
    spots = _spots(rows, lexicon).select("y", "family", F.explode("pairs").alias("pair")).groupBy("pair")
    spots = spots.agg(*[F.countDistinct(F.when(F.col("y") == v, F.col("family"))).alias(n) for v, n in ((0, "clean"), (1, "toxic"))])
    spots = spots.where((F.col("clean") >= MIN_FAMILIES) & (F.col("clean") > 4 * F.col("toxic")))
    learned = tuple(sorted(r["pair"] for r in spots.select("pair").collect()))
    lexicon = Lexicon(weights, exceptions + learned)
    data = np.array([tuple(r) for r in _spots(rows, lexicon).select("f1", "f2", "y").collect()], float)
    scratch.discard(rows, table)
    return Lexicon(weights, lexicon.exceptions, _curve(data[:, :2], data[:, 2]))


def _spots(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Label, features and the word pairs around entries, for folded texts."""

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            texts = batch.column("t").to_pylist()
            found = [features(t, automaton) for t in texts]
            pairs = [sorted(_pairs(t, automaton)) if n else [] for t, (_, _, n) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("family"), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)), pa.array(pairs, pa.list_(pa.string()))],
                ["y", "family", "f1", "f2", "pairs"],
            )

    return rows.select("y", "family", "t").mapInArrow(spot, "y int, family long, f1 double, f2 double, pairs array<string>")


def _pairs(folded: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Pairs of neighbouring words of which one holds an entry."""
    words = folded.split()
    hit = [any(True for _ in automaton.iter(f" {w} ")) for w in words]
    return {f"{a} {b}" for a, b, p, q in zip(words, words[1:], hit, hit[1:], strict=False) if p or q}


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, n_hits``.

    Whole texts are read. Null and empty texts hold no entry and get the score of such a text. Rows that repeat an id are
    scored each; a null id is allowed and isn't held out. An empty table gives an empty result. Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    c0, c1, c2 = lexicon.curve

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [features(t.as_py(), automaton) for t in batch.column("text")]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * a + c2 * b)))) for a, b, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([n for _, _, n in found], pa.int32())], ["doc_id", "score", "n_hits"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(score, f"doc_id {kind}, score double, n_hits int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_hits")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents that aren't predicted toxic, all columns as they are; null and empty texts stay."""
    c0, c1, c2 = lexicon.curve

    @F.pandas_udf("double")
    def toxic_score(texts: pd.Series) -> pd.Series:
        automaton = lexicon.automaton()
        found = (features(t, automaton) for t in texts)
        return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * a + c2 * b)))) for a, b, _ in found], dtype="float64")

    return docs.where(toxic_score(F.col(text_col)) < cut)
