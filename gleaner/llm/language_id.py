"""Language ID: a byte convolutional network with filters of several widths, max pooling and softmax, trained in numpy.

Texts are folded to lower-case bytes with runs of bytes that can't be letters as one space, and cut into windows of fixed
length. A byte's embedding, the filters and the output layer are trained on windows of a bounded sample of labelled rows.
Trained filters act on embeddings of 256 bytes only, so they become lookup tables for prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, held_out

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled rows that a fit reads at most, as many of each language, and windows of each.
MAX_FIT_ROWS = 3_000
WINDOWS_OF_A_ROW = 4
EPOCHS = 6
UNDETERMINED = "und"
BROADCAST_LANGUAGES = 10_000

_NO_LETTER = re.compile(rb"[^a-z\x80-\xff]+")
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, zero-padded at the end."""
    data = _NO_LETTER.sub(b" ", text.lower().encode("utf-8", "replace"))
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


@dataclass
class Network:
    labels: tuple[str, ...]
    tables: list[np.ndarray]  # of each width: (width, 256, filters)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of each window, in blocks of bounded size."""
        parts = []
        for at in range(0, len(x), 512):
            block = x[at : at + 512]
            pooled = []
            for table, bias in zip(self.tables, self.biases, strict=True):
                span = block.shape[1] - len(table) + 1
                total = table[0][block[:, :span]]
                for k in range(1, len(table)):
                    total += table[k][block[:, k : k + span]]
                pooled.append(np.maximum(total.max(axis=1) + bias, 0))
            logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability: the mean over all windows, weighted by their bytes that aren't space."""
        if text is None or not self.labels or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        x = windows(text)
        weight = ((x != 0) & (x != 32)).sum(axis=1).astype(float)
        p = (self.probabilities(x) * weight[:, None]).sum(axis=0) / max(1.0, weight.sum())
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, p[best]))


def train(x: np.ndarray, y: np.ndarray, labels: tuple[str, ...], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows, each class weighted alike."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p = {"E": rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32)}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(f32)
        p[f"b{w}"] = np.zeros(FILTERS, f32)
    p["O"] = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(f32)
    p["o"] = np.zeros(len(labels), f32)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    share = np.bincount(y, minlength=len(labels))
    class_weight = (len(y) / (len(labels) * np.maximum(share, 1))).astype(f32)
    step, size = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            g = _gradients(p, x[rows], y[rows], class_weight)
            step += 1
            for k, a in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                a -= 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    tables = [np.einsum("be,wef->wbf", p["E"], p[f"W{w}"].reshape(w, EMBEDDING, FILTERS)).astype(f32) for w in WIDTHS]
    return Network(labels, tables, [p[f"b{w}"] for w in WIDTHS], p["O"], p["o"])


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, class_weight: np.ndarray) -> dict[str, np.ndarray]:
    n = len(x)
    emb = p["E"][x]
    pooled, caches = [], []
    for w in WIDTHS:
        span = x.shape[1] - w + 1
        columns = np.concatenate([emb[:, k : k + span] for k in range(w)], axis=2)
        act = columns @ p[f"W{w}"]
        arg = act.argmax(axis=1)
        top = np.take_along_axis(act, arg[:, None], axis=1)[:, 0] + p[f"b{w}"]
        pooled.append(np.maximum(top, 0))
        caches.append((columns, arg, top > 0))
    h = np.concatenate(pooled, axis=1)
    z = h @ p["O"] + p["o"]
    q = np.exp(z - z.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    q[np.arange(n), y] -= 1
    q *= (class_weight[y] / n)[:, None]
    g = {"O": h.T @ q, "o": q.sum(axis=0), "E": np.zeros_like(p["E"])}
    dh = q @ p["O"].T
    rows = np.arange(n)[:, None]
    for i, (w, (columns, arg, on)) in enumerate(zip(WIDTHS, caches, strict=True)):
        d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
        g[f"b{w}"] = d.sum(axis=0)
        picked = columns[rows, arg]  # (n, filters, w * embedding)
        g[f"W{w}"] = np.einsum("nfc,nf->cf", picked, d)
        back = (d[:, :, None] * p[f"W{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
        for k in range(w):
            np.add.at(g["E"], x[rows, arg + k], back[:, :, k])
    return g


def fit_network(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = MAX_FIT_ROWS,
    windows_of_a_row: int = WINDOWS_OF_A_ROW,
) -> Network:
    """Train on rows that aren't held out and have a language and a text.

    The sample is bounded by ``max_rows`` rows, as many of each language (one at least), and ``windows_of_a_row`` windows
    drawn from each. Rows are taken in order of the crc32 of their id, so a rare language is learned from all its rows. Only
    the drawn windows leave the executors. Without any row, the network has no labels and every prediction is ``und``.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = rows.select(key.alias("k"), F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = Scratch(docs.sparkSession, "languages").table(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "counts")
    languages = counts.count()
    quota = max(1, max_rows // max(1, languages))
    counts = F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts  # so that texts don't move
    # of a frequent language only the keys below some bound can be among the first: twice the quota is expected there
    near = rows.join(counts, "lang").where(F.col("k") <= F.lit(2.0**32) * F.least(F.lit(1.0), F.lit(2.0 * quota + 100) / F.col("n")))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text"), strict=True):
                w = windows(text.as_py())
                some = ((w != 0) & (w != 32)).any()
                drawn.append(w[np.random.default_rng([11, k]).permutation(len(w))[:windows_of_a_row]].tobytes() if some else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("k", "id", "lang")), pa.array(drawn, pa.binary())], ["k", "id", "lang", "drawn"])

    drawn = near.select("k", "id", "lang", "text").mapInArrow(draw, "k long, id string, lang string, drawn binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("k", "id", "drawn"))
    sample = drawn.withColumn("r", first).where(F.col("r") <= quota).collect()
    sample = sorted((r["k"], r["id"] or "", r["lang"], bytes(r["drawn"])) for r in sample)
    labels = tuple(sorted({lang for _, _, lang, _ in sample}))
    x = [np.frombuffer(d, np.uint8).reshape(-1, WINDOW) for *_, d in sample]
    y = np.repeat([labels.index(lang) for _, _, lang, _ in sample], [len(w) for w in x]).astype(np.int64)
    if not len(y):
        return Network((), [], [], np.zeros((0, 0)), np.zeros(0))
    return train(np.concatenate(x), y, labels)


def identify_languages(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    All windows of the whole text count. Null texts and texts without a letter are ``und`` with score 0. Rows are
    independent, so repeated rows and null ids need no rule (a null id isn't held out). An empty table gives an empty result.
    Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
