"""BPE encoding and decoding by a tokenization automaton, compiled once from the merges of a tokenizer file.

A token sequence is what BPE gives for its bytes exactly if no merge ever crosses the border of two neighbours. The automaton
whose states are tokens, with an arc to each token that may follow, therefore accepts the right sequences and no others. It
is what gadgets make, applied merge by merge in order of rank: the gadget of ``left right -> merged`` takes the arc ``right``
off the state ``left``, gives every state with an arc ``left`` an arc ``merged``, and starts the state ``merged`` as a copy of
``right``. Between most of the 50,000 tokens there is an arc, so the table isn't written out: whether an arc survives follows
from the gadgets of the tokens at either side of it alone, in order of rank, and is compiled into the table when first asked.

Bytes are read by a second table, the trie of all tokens. A word is read by the longest token that an arc of the state leads
to; where none does, the last token gives way to a shorter one. As a word and each beginning of it have one right sequence
only, a place that was given up once is never tried again, so reading is linear. Decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words and tokens that a task remembers before it starts anew, and token arcs that it holds.
MAX_KNOWN = 160_000_000
MAX_ARCS = 4_000_000
#: Longer words aren't remembered.
LONG_WORD = 64
PAIR = 1 << 20  # above all token ids and ranks


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by the byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Byte tokens, merges by pair of token ids, token bytes and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.label = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.byte = [0] * 256
        for c, b in letters.items():
            self.byte[b] = ids[c]
        self.merge: dict[int, int] = {}  # left * PAIR + right -> rank * PAIR + merged
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[ids[left] * PAIR + ids[right]] = rank * PAIR + ids[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label |= {i: t.encode() for t, i in self.special.items()}


class Automaton:
    """Byte trie and token arcs of a vocabulary; arcs are compiled as pairs are met, up to ``MAX_ARCS`` at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.merge = {pair: m // PAIR for pair, m in vocabulary.merge.items()}
        self.rank = {t: -1 for t in vocabulary.byte}
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        for pair, m in vocabulary.merge.items():
            if self.rank.setdefault(m % PAIR, m // PAIR) == m // PAIR:
                left[m % PAIR], right[m % PAIR] = pair // PAIR, pair % PAIR
        # what stands at a token's left and right border, from its byte to the token itself
        self.at_left, self.at_right = ({t: self._spine(t, part) for t in self.rank} for part in (left, right))
        self.arcs: dict[int, bool] = {}
        self.width = {t: len(vocabulary.label[t]) for t in self.rank}
        self.table: dict[int, int] = {}  # state * 256 + byte -> state
        self.token = [-1]  # of each state, if one ends there
        for t in self.rank:
            if t not in left or self.follows(left[t], right[t], self.rank[t]):
                self.token[self._state(vocabulary.label[t])] = t
        self.shorter = {t: self._longest(vocabulary.label[t][:-1], 0) for t in self.token if t >= 0}

    @staticmethod
    def _spine(token: int, part: dict[int, int]) -> list[int]:
        out = [token]
        while out[-1] in part:
            out.append(part[out[-1]])
        return out[::-1]

    def follows(self, x: int, y: int, before: float = math.inf) -> bool:
        """Whether the arc from ``x`` to ``y`` is there once the gadgets of all merges of a rank under ``before`` are applied.

        At either side of the border stands what the gadgets have made so far of ``x`` and ``y``; the next gadget of both is
        applied, unless one that joins the two comes first. Of equal ranks the one further left in the word comes first.
        """
        a, b, i, j = self.at_right[x], self.at_left[y], 0, 0
        while True:
            joins = self.merge.get(a[i] * PAIR + b[j], math.inf)
            at_a = self.rank[a[i + 1]] if i + 1 < len(a) else math.inf
            at_b = self.rank[b[j + 1]] if j + 1 < len(b) else math.inf
            if joins < at_a and joins <= at_b and joins < before:
                return False
            if at_a == at_b == math.inf:
                return True
            if at_a <= at_b:
                i += 1
            else:
                j += 1

    def _state(self, word: bytes) -> int:
        """The trie's state of a word, with the states on the way to it."""
        s = 0
        for b in word:
            t = self.table.get(s * 256 + b)
            if t is None:
                t = self.table[s * 256 + b] = len(self.token)
                self.token.append(-1)
            s = t
        return s

    def _longest(self, word: bytes, at: int) -> int:
        """The longest token at a place of a word, -1 at its end."""
        table, token, s, best = self.table, self.token, 0, -1
        for k in range(at, len(word)):
            s = table.get(s * 256 + word[k])
            if s is None:
                break
            if token[s] >= 0:
                best = token[s]
        return best

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a pre-split word."""
        arcs, width, shorter, longest = self.arcs, self.width, self.shorter, self._longest
        if len(arcs) > MAX_ARCS:
            arcs.clear()
        out: list[int] = []
        given_up: set[int] = set()
        at, t = 0, longest(word, 0)
        while t >= 0:
            end = at + width[t]
            ok = end not in given_up
            if ok and out:
                key = out[-1] * PAIR + t
                ok = arcs.get(key)
                if ok is None:
                    ok = arcs[key] = self.follows(out[-1], t)
            if ok:
                out.append(t)
                at = end
                t = longest(word, at)
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                given_up.add(at)
                t = out.pop()
                at -= width[t]
        return out


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.automaton = Automaton(self.vocabulary)
        self.known: dict[str, bytes] = {}  # tokens of words that the automaton has read
        self.held = 0
        self.pieces = regex.compile(PATTERN).findall
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        label = self.vocabulary.label
        self.length = np.array([len(label.get(i, b"")) for i in range(max(label) + 1)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.labels = np.frombuffer(b"".join(label.get(i, b"") for i in range(max(label) + 1)), np.uint8)
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in self.vocabulary.special.items()}

    def split(self, text: str) -> list[list[str] | str]:
        """Lists of pre-split words, with special tokens as strings between them."""
        parts = self.special.split(text) if self.special else [text]
        return [p if k % 2 else self.pieces(p) for k, p in enumerate(parts)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(t or "") for t in texts]
        known, encode = self.known, self.automaton.encode
        words = set(chain.from_iterable(p for parts in split for p in parts if isinstance(p, list)))
        if self.held > MAX_KNOWN:
            known.clear()
            self.held = 0
        rare = {}
        for word in words.difference(known):
            data = word.encode("utf-8", "replace")
            ids = encode(data)
            (known if len(data) <= LONG_WORD else rare)[word] = pack(f"<{len(ids)}I", *ids)
            self.held += 200 + len(data) + 4 * len(ids)
        found = ChainMap(known, rare).__getitem__ if rare else known.__getitem__
        return [b"".join(self.special_ids[p] if isinstance(p, str) else b"".join(map(found, p)) for p in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        """The text of token ids: arc labels in order; bytes that aren't UTF-8 become replacement characters."""
        tokens = np.frombuffer(ids, "<u4")
        n = self.length[tokens]
        ends = np.cumsum(n)
        where = np.repeat(self.start[tokens] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return self.labels[where].tobytes().decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, which keeps its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` and the decoded ``text``; with ``digests``, the SHA-256 of both in their place.

    Every node needs the tokenizer file at ``tokenizer_path``. Whole texts are encoded; special tokens in a text are
    recognised, none are added. Null counts as empty and has no tokens. Rows are independent, so repeated rows and null ids
    need no rule. An empty table gives an empty result. Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = bpe.encode_batch(batch.column("text").to_pylist())
                texts = [bpe.decode(x) for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    columns = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
                else:
                    columns = [pa.array([np.frombuffer(x, "<u4") for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *columns], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "text"))]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [kind, "long", *kinds], strict=True))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
