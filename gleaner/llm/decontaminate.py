"""Benchmark decontamination: a positional inverted index of the corpus, searched for phrases of test items.

The index is a table of segments. Each holds some documents of one input split: for every term the ascending positions at
which it stands, positions counted on through the segment's documents. Segments are written, so that any number of
benchmarks can be searched and lost executors cost nothing, and no posting is shuffled. A search takes, in each segment,
the postings of the rarest word of every phrase, shifted to where the phrase would begin, and keeps those that the shifted
lists of its other words hold too, rarest first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words of an item that form one phrase.
WINDOW = 10
#: Words of a segment; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 19
#: Words of test items that are sent to the executors at once; more are searched in so many rounds.
ROUND_WORDS = 1 << 18
#: Longest run of an item's words that is sent in one piece, without the overlap.
PIECE_WORDS = 1 << 12
#: Candidates that are intersected at once.
CANDIDATES = 1 << 18

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same by bytes: every byte of a longer code point belongs to a word, A-Z becomes a-z, the rest of ASCII parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_TEXT_STEP = 1 << 20

SEGMENT = "segment long, doc_id {id}, starts array<int>, terms array<string>, ends array<int>, positions binary"


def _split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs of about a megabyte that end between words."""
    at = 0
    while at < len(text):
        end = min(at + _TEXT_STEP, len(text))
        cut = end if end == len(text) else text.rfind(b" ", at, end) + 1
        while cut <= at < len(text):  # one word is longer than a run
            cut = text.find(b" ", end) + 1 or len(text)
        yield text[at:cut].split()
        at = cut


class _Segment:
    """Words of documents as numbers, and from them the postings."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.runs: list[np.ndarray] = []
        self.starts = [0]
        self.ids: list = []

    def add(self, doc_id, text: bytes | None) -> None:
        n = self.starts[-1]
        for words in _split((text or b"").translate(_LETTERS)):
            run = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            self.runs.append(run)
            n += len(run)
        self.starts.append(n)
        self.ids.append(doc_id)

    def postings(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Terms, where the positions of each end, and all positions by term."""
        words = np.concatenate(self.runs) if self.runs else np.empty(0, np.int32)
        ends = np.cumsum(np.bincount(words, minlength=len(self.numbers)))
        return [w.decode("utf-8", "replace") for w in self.numbers], ends, np.argsort(words, kind="stable")


def _pack(positions: np.ndarray, ends: np.ndarray) -> bytes:
    """Positions as differences within their term, least bytes of all first: small differences leave zeros that compress."""
    steps = np.diff(positions, prepend=0).astype("<i8")
    begins = ends[:-1][ends[:-1] < len(positions)]
    steps[begins] = positions[begins]
    return np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(packed: bytes, ends: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    total = np.cumsum(steps)
    size = np.diff(ends, prepend=0)
    before = np.concatenate(([0], total))[ends - size]
    return total - np.repeat(before, size)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all words of all texts, written to the shared folder: ``segment, doc_id, starts, terms, ends,
    positions``, a row a segment, ``doc_id`` an array. A document without words has a place in it, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        segment = _Segment()

        def close() -> pa.RecordBatch:
            terms, ends, positions = segment.postings()
            columns = [[next(numbers)], [segment.ids], [segment.starts], [terms], [ends.tolist()], [_pack(positions, ends)]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["segment", "doc_id", "starts", "terms", "ends", "positions"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                segment.add(doc_id, text.as_py())
                if segment.starts[-1] >= SEGMENT_WORDS or len(segment.ids) >= SEGMENT_WORDS:
                    yield close()
                    segment = _Segment()
        if segment.ids:
            yield close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return Scratch(docs.sparkSession, "index").table(rows.mapInArrow(run, SEGMENT.format(id=f"array<{docs.schema[id_col].dataType.simpleString()}>")), "segments")


def item_words(text: Column) -> Column:
    """The words of a text as an array; A-Z lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(WORD), F.lit(0))


def item_pieces(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, words``: items with an id, cut into runs of bounded length that overlap by a phrase less one word."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), item_words(F.col(text_col)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - window, F.lit(0))
    begins = words.withColumn("at", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WORDS))))
    return begins.select("item_id", F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + window - 1)).alias("words"))


class _Phrases:
    """The phrases of a round: a row of words each, as numbers of the round's own vocabulary; -1 behind a shorter phrase."""

    def __init__(self, pieces: list[tuple], window: int):
        vocabulary: defaultdict[str, int] = defaultdict(count().__next__)
        rows: dict[tuple, int] = {}
        owners: list[tuple[int, int]] = []
        self.items: list = []
        for item, words in pieces:
            w = [vocabulary[x] for x in words]
            self.items.append(item)
            for at in range(max(1, len(w) - window + 1)):
                phrase = (*w[at : at + window], *[-1] * (window - len(w)))
                owners.append((rows.setdefault(phrase, len(rows)), len(self.items) - 1))
        self.words = np.array(list(rows), np.int64).reshape(-1, window)
        pairs = np.array(owners, np.int64).reshape(-1, 2)
        self.owner = pairs[np.lexsort((pairs[:, 1], pairs[:, 0])), 1]
        self.owner_ends = np.cumsum(np.bincount(pairs[:, 0], minlength=len(rows)))
        self.vocabulary = list(vocabulary)


class _Lists:
    """Postings of a segment by the numbers of a round's vocabulary. ``keys`` holds number * span + position, ascending by
    position within a number's run, so that one search finds whether a list holds a position."""

    def __init__(self, row: dict, vocabulary: list[str]):
        ends = np.array(row["ends"], np.int64)
        positions = _unpack(row["positions"], ends)
        self.starts = np.array(row["starts"], np.int64)
        self.span = int(self.starts[-1]) + 1
        term = {t: k for k, t in enumerate(row["terms"])}
        of = np.array([term.get(w, -1) for w in vocabulary], np.int64)
        size = np.diff(ends, prepend=0)
        self.size = np.where(of < 0, 0, size[of]) if len(size) else np.zeros(len(of), np.int64)
        self.begin = np.cumsum(self.size) - self.size
        found = np.flatnonzero(self.size)
        parts = [positions[ends[k] - size[k] : ends[k]] + n * self.span for n, k in zip(found.tolist(), of[found].tolist(), strict=True)]
        self.keys = np.concatenate(parts) if parts else np.empty(0, np.int64)

    def next(self, words: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The first key of each word from a position on; it may be another word's."""
        at = np.searchsorted(self.keys, words * self.span + positions)
        return np.where(at < len(self.keys), self.keys[np.minimum(at, len(self.keys) - 1)], -1)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def anchors(self, phrases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrases all of whose words stand in the segment, with the order of their words from the rarest on and the postings
        of the rarest; a bounded number of these at once."""
        sizes = np.where(phrases < 0, np.iinfo(np.int64).max, self.size[phrases])
        rank = np.argsort(sizes, axis=1, kind="stable")
        rarest = np.take_along_axis(sizes, rank[:, :1], axis=1)[:, 0]
        there = np.flatnonzero(rarest)
        upto = np.cumsum(rarest[there])
        at = 0
        while at < len(there):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
            some, n = there[at:end], rarest[there[at:end]]
            phrase = np.repeat(some, n)
            first = phrases[some, rank[some, 0]]
            within = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
            keys = self.keys[np.repeat(self.begin[first], n) + within]
            yield phrase, rank, keys - np.repeat(first, n) * self.span
            at = end

    def phrase_matches(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, first position and position behind the last of every exact occurrence within one document."""
        out = [np.empty((3, 0), np.int64)]
        length = (phrases >= 0).sum(axis=1)
        for phrase, rank, start in self.anchors(phrases):
            start = start - rank[phrase, 0]
            keep = start >= 0
            phrase, start = phrase[keep], start[keep]
            for k in range(1, phrases.shape[1]):
                offset = rank[phrase, k]
                word = phrases[phrase, offset]
                place = start + offset
                keep = (word < 0) | ((place < self.span) & (self.next(np.maximum(word, 0), place) == word * self.span + place))
                phrase, start = phrase[keep], start[keep]
            end = start + length[phrase]
            keep = self.document(start) == self.document(end - 1)
            out.append(np.stack((phrase[keep], start[keep], end[keep])))
        return tuple(np.concatenate(out, axis=1))

    def proximity_matches(self, phrases: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of one document that hold every word of a phrase, in any order, and are longer than it by ``slack`` words at
        most; of those that begin at one word the shortest."""
        out = [np.empty((3, 0), np.int64)]
        length = (phrases >= 0).sum(axis=1)
        longest = phrases.shape[1] + slack
        for phrase, rank, at in self.anchors(phrases):
            back = np.arange(longest)
            both = np.unique(np.stack((np.repeat(phrase, longest), np.maximum(np.repeat(at, longest) - np.tile(back, len(at)), 0))), axis=1)
            phrase, start = both
            low, high = np.full(len(start), self.span), start.copy()
            for k in range(phrases.shape[1]):
                word = phrases[phrase, rank[phrase, k]]
                found = self.next(np.maximum(word, 0), start) - word * self.span
                keep = (word < 0) | ((found >= start) & (found < np.minimum(start + length[phrase] + slack, self.span)))
                found = np.where(word < 0, start, found)
                low, high = np.where(word < 0, low, np.minimum(low, found))[keep], np.where(word < 0, high, np.maximum(high, found))[keep]
                phrase, start = phrase[keep], start[keep]
            keep = (low == start) & (self.document(low) == self.document(high))
            out.append(np.stack((phrase[keep], low[keep], high[keep] + 1)))
        return tuple(np.concatenate(out, axis=1))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans that the given ones cover together, apart and ascending."""
    order = np.argsort(starts, kind="stable")
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > upto[:-1]))
    return starts[new], upto[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


SPANS = "array<struct<start:int,end:int>>"


def search_index(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every document of an index: the spans of words, [start, end) from 0, that phrases of
    test items cover, and the ids of these items. A phrase is ``window`` neighbouring words of an item, or all of a shorter one.
    With ``slack``, a phrase also matches a stretch that holds all its words in any order and is at most so many words longer.

    Test items are sent to the executors in rounds of about ``ROUND_WORDS`` words, so what is broadcast is bounded however
    large the benchmark is; each round reads the index once. Items with a null id or without words are left out.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "search")
    pieces = scratch.table(item_pieces(items, id_col, text_col, window), "pieces")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    rounds = max(1, -(-total // ROUND_WORDS))
    item_type = items.schema[id_col].dataType.simpleString()
    item_arrow = items.select(id_col).limit(0).toArrow().schema.field(0).type
    doc_type = index.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"segment long, place int, doc_id {doc_type}, n_words long, spans {SPANS}, items array<{item_type}>"

    def search(phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = phrases.value
            for batch in batches:
                for k in range(batch.num_rows):
                    yield _found(batch.slice(k, 1), p, slack, item_arrow)

        return run

    found = []
    dealt = pieces.withColumn("round", F.pmod(F.xxhash64("item_id", "words"), F.lit(rounds)))
    for k in range(rounds):
        some = dealt.where(F.col("round") == k).select("item_id", "words").collect()  # about ROUND_WORDS words
        found.append(index.mapInArrow(search(spark.sparkContext.broadcast(_Phrases([tuple(r) for r in some], window))), schema))
    if rounds == 1:
        return found[0].drop("segment", "place")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    whole = every.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return whole.select("doc_id", "n_words", F.arrow_udf(merge_spans, SPANS)("spans").alias("spans"), "items")


def merge_spans(spans: pa.Array) -> pa.Array:
    """Arrays of spans to what they cover together."""
    out = []
    for row in spans:
        s = row.values
        a, b = _merged(s.field("start").to_numpy(), s.field("end").to_numpy()) if len(s) else ((), ())
        out.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _found(segment: pa.RecordBatch, phrases: _Phrases, slack: int | None, item_type: pa.DataType) -> pa.RecordBatch:
    row = segment.to_pylist()[0]
    lists = _Lists(row, phrases.vocabulary)
    n_docs = len(row["doc_id"])
    spans, items = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)]
    if len(phrases.words):
        hits = lists.phrase_matches(phrases.words)
        if slack is not None:
            hits = tuple(np.concatenate(x) for x in zip(hits, lists.proximity_matches(phrases.words, slack), strict=True))
        phrase, start, end = hits
        if len(phrase):
            doc = lists.document(start)
            a, b = _merged(start, end)
            cuts = np.unique(lists.starts[_inside(lists.starts, a, b)])  # spans of neighbouring documents that touch are parted
            a, b = np.sort(np.concatenate((a, cuts))), np.sort(np.concatenate((b, cuts)))
            for d, x, y in zip(lists.document(a).tolist(), a.tolist(), b.tolist(), strict=True):
                spans[d].append({"start": x - int(lists.starts[d]), "end": y - int(lists.starts[d])})
            pair = np.unique(np.stack((doc, phrase)), axis=1)
            n = np.diff(phrases.owner_ends, prepend=0)[pair[1]]
            piece = phrases.owner[np.repeat(phrases.owner_ends[pair[1]] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            for d, i in np.unique(np.stack((np.repeat(pair[0], n), piece)), axis=1).T.tolist():
                items[d].append(phrases.items[i])
            items = [list(dict.fromkeys(x)) for x in items]
    words = np.diff(lists.starts)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    columns = [pa.array([row["segment"]] * n_docs, pa.int64()), pa.array(range(n_docs), pa.int32()), segment.column("doc_id").flatten(), pa.array(words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(item_type))]
    return pa.RecordBatch.from_arrays(columns, ["segment", "place", "doc_id", "n_words", "spans", "items"])


def _inside(cuts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which cuts lie strictly inside one of the spans, which are apart and ascending."""
    k = np.searchsorted(a, cuts, side="left") - 1
    return (k >= 0) & (cuts < b[np.maximum(k, 0)])


def contaminated_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slack: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items``.

    A word is hit where an occurrence of a phrase covers it; ``items`` are the distinct ids of the phrases' items, sorted as
    text. Null or empty texts have no words and aren't hit. Rows that repeat a doc_id, or have none, each have their own
    result; rows that repeat an item_id are one item. Items with a null id or without words match nothing. Empty tables give
    an empty result, or documents without hits. Extra columns are ignored. Texts of any length are read whole.
    """
    found = search_index(build_index(docs, id_col, text_col), items, item_col, item_text_col, slack=slack)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans", names.alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any phrase of a test item, all columns as they are. Of rows that repeat an id all go if one is hit;
    rows with a null id stay."""
    hit = contaminated_documents(docs, items, id_col, text_col, item_col, item_text_col).where("contaminated").select(F.col("doc_id").alias("__hit"))
    return docs.join(hit, docs[id_col] == hit["__hit"], "left_anti")
