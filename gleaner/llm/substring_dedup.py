"""Substring dedup: paragraphs of neighbouring units are normalised and hashed, the earliest of each digest stays.

A unit is a line, cut further behind punctuation that white space follows, so that a passage which begins or ends inside a
line or sentence still holds whole units. Every unit begins a paragraph: itself and as many units behind it as it takes to
reach ``MIN_WORDS`` words. A unit of that many words is its own paragraph; shorter ones (headings, list items, hard-wrapped
lines) count together. Digests of all paragraphs of all documents are grouped, and a paragraph that repeats an earlier one
is removed with all its units. A passage may begin and end inside a unit: where a run of such paragraphs begins or ends, it
is lengthened word by word for as long as the words are those beside the first occurrence. Whatever is removed stays at an
earlier place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Scratch

#: Words of the shortest passage that is removed.
MIN_WORDS = 20

# Where a unit ends: a line feed, or punctuation with closing signs and one blank behind it.
_END = r"[.!?,;:][!-/:-@\[-^`{-~]{0,8}[ \t]|\n"
_BYTES_END, _TEXT_END = re.compile(_END.encode()), re.compile(_END)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = " \t\n\x0b\x0c\r"
SPAN = "struct<start:int,end:int>"


class _Paragraphs:
    """The paragraphs of a batch of texts: for each its text, first unit, unit behind its last, and 96 bits of digest."""

    def __init__(self, texts: list[bytes | None], min_words: int):
        units: list[bytes] = []
        words: list[int] = []
        sizes = []
        for text in texts:
            before, at = len(words), 0
            if text:
                for end in chain((m.end() for m in _BYTES_END.finditer(text)), (len(text),)):
                    if at < end:
                        unit = text[at:end].split()
                        at = end
                        words.append(len(unit))
                        units.append(b" ".join(unit))
            sizes.append(len(words) - before)
        size, last = np.array(sizes, np.int64), np.cumsum(np.array(sizes, np.int64))
        upto = np.concatenate(([0], np.cumsum(np.array(words, np.int64))))
        full = np.flatnonzero(np.diff(upto))  # units without words begin and change no paragraph
        text_of = np.repeat(np.arange(len(texts)), size)[full]
        end = np.searchsorted(upto, upto[full] + min_words)
        whole = end <= last[text_of]
        start, end, self.text = full[whole], end[whole], text_of[whole]
        spelled = b" ".join([units[k] for k in full.tolist()])
        lengths = np.array([len(units[k]) for k in full.tolist()], np.int64)
        behind = np.cumsum(lengths + 1) - 1  # in spelled, of the units with words
        rank = np.concatenate(([0], np.cumsum(np.diff(upto) > 0)))
        first, final = rank[start], rank[end] - 1
        view = memoryview(spelled)
        digests = [xxh3_128_digest(view[a:b]) for a, b in zip((behind - lengths)[first].tolist(), behind[final].tolist(), strict=True)]
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        self.high, self.low = halves[:, 0], (halves[:, 1] >> 32).astype(np.int32)
        base = (last - size)[self.text]
        self.start, self.end = start - base, end - base

    def again(self) -> np.ndarray:
        """Paragraphs that repeat an earlier one of their own text without overlapping it."""
        order = np.lexsort((self.start, self.low, self.high, self.text))
        text, high, low = self.text[order], self.high[order], self.low[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        out = np.zeros(len(order), bool)
        out[order] = self.start[order] >= self.end[first]
        return out


def _encode(texts: pa.Array) -> list[bytes | None]:
    return [t if t is None else t.lower().encode("utf-8", "replace") for t in texts.to_pylist()]


def paragraphs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``high, low, doc_id, pos, again`` of every paragraph: its digest, first unit, and whether its text has it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                p = _Paragraphs(_encode(batch.column("text")), min_words)
                columns = [pa.array(p.high), pa.array(p.low), batch.column("doc_id").take(pa.array(p.text)), pa.array(p.start.astype(np.int32)), pa.array(p.again())]
                yield pa.RecordBatch.from_arrays(columns, ["high", "low", "doc_id", "pos", "again"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, f"high long, low int, doc_id {docs.schema[id_col].dataType.simpleString()}, pos int, again boolean")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, cut``: all paragraphs that repeat an earlier one: first unit, digest, and the place of the first occurrence,
    ascending.

    Rank is (doc_id, unit). Only digests and positions are shuffled. Counting is pre-aggregated, and a paragraph that a third
    of the corpus shares meets its first occurrence in a skewed join that Spark splits.
    """
    found = paragraphs(docs, id_col, text_col, min_words)
    first = found.groupBy("high", "low").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that Spark can split the hot side of the join
    first = Scratch(docs.sparkSession, "passages").table(first.select("high", "low", F.col("f.doc_id").alias("f_doc"), F.col("f.pos").alias("f_pos")), "first")
    later = found.join(first, ["high", "low"]).where("doc_id <> f_doc or again")
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "high", "f_doc", "f_pos"))).alias("cut"))


def _unit_ends(text: str) -> list[int]:
    ends = [m.end() for m in _TEXT_END.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def _beside(text: str, ends: list[int], start: int, min_words: int) -> tuple[list[str], list[str]]:
    """The words of the unit before the paragraph that begins at a unit, and those behind it: of as many units as reach a
    paragraph's length, and of one more. A passage that goes on further would hold another whole paragraph."""
    spell = lambda k: _WORD.findall(text[ends[k - 1] if k else 0 : ends[k]].lower())
    before: list[str] = []
    k = start
    while k and not before:
        k -= 1
        before = spell(k)
    k, n = start, 0
    while k < len(ends) and n < min_words:
        n += len(spell(k))
        k += 1
    after: list[str] = []
    enough = None
    while k < len(ends) and (enough is None or len(after) == enough):
        after += spell(k)
        k += 1
        if enough is None and len(after) >= min_words:
            enough = len(after)
    return before, after


def _lengthen(text: str, a: int, b: int, before: list[str], after: list[str]) -> tuple[int, int]:
    """A span with the words to both sides that equal these."""
    for word in reversed(before):
        end = a
        while end and text[end - 1] in _BLANK:
            end -= 1
        begin = end
        while begin and text[begin - 1] not in _BLANK:
            begin -= 1
        if text[begin:end].lower() != word:
            break
        a = begin
    for word in after:
        begin = b
        while begin < len(text) and text[begin] in _BLANK:
            begin += 1
        end = begin
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        if text[begin:end].lower() != word:
            break
        b = end
    return a, b


def _edges(cut: Column) -> Column:
    """Of the paragraphs of a text those with no neighbour that goes, too, on one side; not those that repeat their own text."""
    apart = lambda x, y: ~F.coalesce(F.abs(x["pos"] - y["pos"]) <= 1, F.lit(False))
    return F.filter(cut, lambda x, i: apart(x, F.get(cut, i - 1)) | apart(x, F.get(cut, i + 1)))


def edge_words(docs: DataFrame, cuts: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``doc_id, sides``: for the paragraphs at the edges of what goes, the words beside their first occurrences.

    ``docs`` are joined by id, those that hold a first occurrence, and are shuffled for it unless these are few.
    """
    asked = cuts.select("doc_id", F.explode(_edges(F.col("cut"))).alias("x")).select("doc_id", "x.pos", "x.f_doc", "x.f_pos").where("doc_id <> f_doc").distinct()
    scratch = Scratch(docs.sparkSession, "edges")
    asked = scratch.table(asked, "asked")
    wanted = asked.select("f_doc", "f_pos").distinct().groupBy("f_doc").agg(F.collect_list("f_pos").alias("at"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, at in zip(batch.column("f_doc").to_pylist(), batch.column("text"), batch.column("at").to_pylist(), strict=True):
                whole = text.as_py()
                ends = _unit_ends(whole)
                rows += [(doc, k, *_beside(whole, ends, k, min_words)) for k in at if k < len(ends)]
            kinds = (batch.schema.field("f_doc").type, pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["f_doc", "f_pos", "before", "after"])

    texts = docs.join(wanted, docs[id_col] == wanted["f_doc"]).where(F.col(text_col).isNotNull()).select("f_doc", F.col(text_col).alias("text"), "at")
    said = texts.mapInArrow(look, f"f_doc {docs.schema[id_col].dataType.simpleString()}, f_pos int, before array<string>, after array<string>")
    # rows that repeat the first occurrence's id may differ; one of them speaks
    said = scratch.table(said.groupBy("f_doc", "f_pos").agg(F.min(F.struct("before", "after")).alias("s")), "said")  # a hot place is split
    return asked.join(said, ["f_doc", "f_pos"]).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "s.before", "s.after")).alias("sides"))


def _without(text: str, wanted: dict[int, set[int]], sides: dict[int, tuple[list[str], list[str]]], min_words: int) -> tuple[str, list[dict[str, int]]]:
    """A text without the paragraphs that begin at some units and have their digests, lengthened by the words beside their first
    occurrences, and the spans that went."""
    p = _Paragraphs(_encode(pa.array([text])), min_words)
    ends = _unit_ends(text)
    found = []
    for start, end, high in zip(p.start.tolist(), p.end.tolist(), p.high.tolist(), strict=True):
        if high in wanted.get(start, ()):
            a, b = ends[start - 1] if start else 0, ends[end - 1]
            found.append(_lengthen(text, a, b, *sides[start]) if start in sides else (a, b))
    spans: list[dict[str, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(b, spans[-1]["end"])
        else:
            spans.append({"start": a, "end": b})
    at, kept = 0, []
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*kept, text[at:]]), spans


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with cleaned text, and ``n_removed``, ``removed_spans`` (offsets in the original text).

    Units are normalised by lower case and single spaces. Removed paragraphs that touch or overlap are one span; spans are
    ``[start, end)`` in code points, ascending and apart. They hold whole units with the blank or line feed that ends each, and
    beside them the words that also stand beside the first occurrence; a word is what white space parts. A paragraph that
    repeats one of its own document goes too, unless both overlap. Text of fewer than ``min_words`` words between other text
    stays, however often it repeats.

    Null text stays null with nothing removed, empty text stays empty. Rows that repeat an id count as one document: what
    they share with each other at the same place stays in each. Rows with a null id are left alone. An empty table gives an
    empty result. The column names ``n_removed`` and ``removed_spans`` are replaced if the input has them.
    """
    docs = docs.drop("n_removed", "removed_spans")
    scratch = Scratch(docs.sparkSession, "cuts")
    cuts = scratch.table(repeated_paragraphs(docs, id_col, text_col, min_words), "cuts")
    sides = scratch.table(edge_words(docs, cuts, id_col, text_col, min_words), "sides")
    cut = cuts.join(sides, "doc_id", "left").select(F.col("doc_id").alias("__id"), F.col("cut").alias("__cut"), F.col("sides").alias("__sides"))

    def remove(texts: pa.Array, starts: pa.Array, highs: pa.Array, sides: pa.Array) -> pa.Array:
        out = []
        for text, at, of, beside in zip(texts, starts, highs, sides, strict=True):
            if not text.is_valid or not at.is_valid:
                out.append(None)
                continue
            wanted: dict[int, set[int]] = {}
            for k, h in zip(at.values.to_pylist(), of.values.to_pylist(), strict=True):
                wanted.setdefault(k, set()).add(h)
            words = {x["pos"]: (x["before"], x["after"]) for x in beside.as_py() or ()}
            kept, spans = _without(text.as_py(), wanted, words, min_words)
            out.append({"text": kept, "spans": spans})
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(span))]))

    remove_udf = F.arrow_udf(remove, f"struct<text:string,spans:array<{SPAN}>>")
    joined = docs.join(cut, docs[id_col] == cut["__id"], "left")
    hit = F.when(F.col("__cut").isNotNull(), F.col(text_col))
    done = joined.withColumn("__done", remove_udf(hit, F.col("__cut.pos"), F.col("__cut.high"), F.col("__sides")))
    text = F.when(F.col("__done").isNull(), F.col(text_col)).otherwise(F.col("__done.text"))
    spans = F.coalesce("__done.spans", F.array().cast(f"array<{SPAN}>"))
    return done.select(
        *[text.alias(c) if c == text_col else docs[c] for c in docs.columns], F.size(spans).alias("n_removed"), spans.alias("removed_spans")
    )
