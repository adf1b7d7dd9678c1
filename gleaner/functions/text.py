"""Text normalisation as column expressions. Missing text is the empty string."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .. import values as V

#: Java patterns without regard to case, with Unicode word boundaries.
I = "(?iuU)"  # noqa: E741
_WORD = "[a-z0-9à-ÿß+#]+"
_ROLE_WORD = "[a-zà-ÿ0-9+#]+"


def lit_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def among(word: Column, words) -> Column:
    return word.isin(*words)


@F.pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Character references decoded, all of them; Spark has no such function."""
    return s.map(html.unescape, na_action="ignore")


def unescape(s: Column) -> Column:
    """The references that postings use in titles and names, without leaving the JVM."""
    s = F.coalesce(s, F.lit(""))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return s


def norm(s: Column) -> Column:
    """FN-01: lower case, all but a-z and 0-9 as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))


def raw_key(company: Column, title: Column) -> Column:
    """FN-02: normalised company and title, without gender tags and per-country endings."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), f"{I}{V.GENDER_TAG_KEY}", "")
    return F.concat(norm(company), F.lit("|"), norm(F.split(plain, r" \| ")[0]))


def strip_html(s: Column, unescape=unescape_html) -> Column:
    """FN-03: text of an HTML fragment; bodies of scripts and styles stay."""
    s = F.regexp_replace(unescape(F.coalesce(s, F.lit(""))), r"(?i)<(br|/p|/li|/h\d)[^>]*>", "\n")
    s = unescape(F.regexp_replace(s, "<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(s, "[ \t\xa0]+", " "), r"(?U)^\s+|\s+$", "")


def tokens(s: Column) -> Column:
    """FN-07."""
    return F.regexp_extract_all(F.lower(unescape(s)), F.lit(_WORD), F.lit(0))


def company_tokens(name: Column) -> Column:
    """FN-08: words without legal forms, or all words if none is left."""
    words = tokens(name)
    kept = F.filter(words, lambda w: ~among(w, V.LEGAL))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def company_key(name: Column) -> Column:
    """FN-09: one id per company: no one-letter words, no extra words at the end, joined."""

    def key(words: Column) -> Column:
        last = F.array_max(F.transform(words, lambda w, i: F.when((i == 0) | ~among(w, V.CORP_EXTRA), i + 1)))
        return F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(F.slice(words, F.lit(1), last), ""))

    def shorter(words: Column) -> Column:
        long = F.filter(words, lambda w: F.length(w) > 1)
        return let(F.when(F.size(long) > 0, long).otherwise(words), key)

    return let(company_tokens(name), shorter)


def _says_something(part: Column) -> Column:
    return F.exists(tokens(part), lambda w: ~w.rlike("^[0-9]+$") & ~among(w, V.TITLE_NOISE))


def title_canon(title: Column) -> Column:
    """FN-10: the title without gender tags and endings, and without parts that only name a place, time zone or mode."""
    t = F.split(unescape(title), r" \| ")[0]
    t = F.regexp_replace(t, f"{I}{V.GENDER_TAG}", " ")
    t = F.regexp_replace(t, f"{I}{V.GENDER_ENDING}", "")
    t = F.regexp_replace(t, r"\([^)]*$", " ")

    def resolve(acc: Column, group: Column) -> Column:
        inner = F.substring(group, F.lit(2), F.length(group) - 2)
        keep = _says_something(inner) & ~inner.rlike(f"{I}{V.TIME_ZONES}")
        return F.replace(acc, group, F.when(keep, F.concat(F.lit(" ("), inner, F.lit(") "))).otherwise(F.lit(" ")))

    def whole(t: Column) -> Column:
        parts = F.filter(F.split(t, r"(?U)\s+[-–—|/]\s+|\s*\|\s*|,\s+"), _says_something)
        return let(parts, lambda p: F.array_join(tokens(F.when(F.size(p) > 0, F.array_join(p, " ")).otherwise(t)), " "))

    def resolved(t: Column) -> Column:
        return F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\(([^)]*)\)"), F.lit(0))), t, resolve)

    return let(let(t, resolved), whole)


def title_norm(title: Column) -> Column:
    """FN-11: the key under which a verdict on a title is kept."""
    t = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), f"{I}{V.GENDER_TAG_VERDICT}", " "))
    return F.btrim(F.regexp_replace(t, r"(?U)\s+", " "), F.lit(" -–|,·"))


def words(s: Column) -> Column:
    """FN-12: words of a title or role that count."""
    found = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(_ROLE_WORD), F.lit(0))
    return F.filter(found, lambda w: ~among(w, V.STOP) & (F.length(w) > 1))


def first_place(location: Column) -> Column:
    """FN-13."""
    return F.trim(F.split(F.lower(F.coalesce(location, F.lit(""))), r"[,;/(|]")[0])


def role_words(role: Column) -> Column:
    return F.filter(words(role), lambda w: ~among(w, V.MODIFIERS))


def role_head(role: Column) -> Column:
    """FN-14: the word that makes the role; null for a role without words."""
    own = role_words(role)
    of = F.regexp_extract(F.lower(role), r"(?U)^\s*([a-zà-ÿ]+)\s+of\b", 1)
    return F.when(F.size(own) > 0, F.when(F.array_contains(own, of), of).otherwise(F.try_element_at(own, F.lit(-1))))


def has_phrase(text: Column, phrase: Column) -> Column:
    """FN-15: a phrase between word boundaries in lower-case text; blank phrases are in no text."""
    p = F.trim(F.lower(F.coalesce(phrase, F.lit(""))))
    escaped = F.regexp_replace(p, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return (p != "") & F.rlike(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?U)\b"), escaped, F.lit(r"\b")))


def signature(text: Column, hashed=F.crc32) -> Column:
    """FN-16: the 64 smallest distinct hashes of five-word shingles of the first 800 words; short texts have none."""

    def low(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 5))
        shingles = F.transform(starts, lambda i: hashed(F.concat_ws(" ", *[F.get(w, i + k) for k in range(5)])))
        found = F.slice(F.sort_array(F.array_distinct(shingles)), 1, V.SIGNATURE_SIZE)
        return F.when(F.length(F.array_join(w, " ")) >= V.SIGNATURE_MIN_CHARS, found).otherwise(F.slice(found, 1, 0))

    return let(F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0)), 1, V.SIGNATURE_WORDS), low)


def signature_numbers(signature: Column) -> Column:
    """Hashes that are hexadecimal digits as numbers of their first 60 bits: an eighth of the bytes in the same order, and two
    that differ become one with a probability of 2^-60."""
    return F.transform(signature, lambda h: F.conv(F.left(h, F.lit(15)), 16, 10).cast("long"))


def md5_numbers(text: Column) -> Column:
    """``signature_numbers(signature(text, F.md5))``, with the hashes of many texts made at once: as expressions on arrays, these
    cost more than all other steps of resolution together."""
    return _md5_numbers(F.lower(F.coalesce(text, F.lit(""))))


#: Shingles that are hashed at once; texts of one call are taken in such portions.
PORTION = 4096
#: Word characters are all Latin-1, a byte each; every other character becomes a space.
_SPACED = bytes(i if re.fullmatch(_WORD, chr(i)) else 32 for i in range(256))
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
_SHORT = 55  # bytes that fit one block of MD5
_OWN, _MARK = np.zeros((2, _SHORT + 1, 64), np.uint8)  # by length: the bytes of a block that are the text's, the bit behind them
for _n in range(_SHORT + 1):
    _OWN[_n, :_n], _MARK[_n, _n] = 255, 128


def _md5_starts(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of each stretch of the data. Stretches of one block go through the rounds side by side."""
    n = ends - starts
    fit = np.minimum(n, _SHORT)
    blocks = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(64), np.uint8), 64)[starts]
    blocks = (blocks.view("<u8") & _OWN.view("<u8")[fit]) | _MARK.view("<u8")[fit]
    words = np.ascontiguousarray(blocks.view("<u4").T)
    words[14] = n * 8
    begin = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(n), x) for x in begin)
    for i in range(64):
        if i < 16:
            f, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[k]
        f += _SINES[i]
        s = _SHIFTS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    high, low = ((x + y).byteswap().astype(np.int64) for x, y in zip((a, b), begin))
    found = ((high & 0xFFFFFFFF) << 28) | ((low & 0xFFFFFFFF) >> 4)
    for i in np.flatnonzero(n > _SHORT):
        found[i] = int(hashlib.md5(data[starts[i] : ends[i]], usedforsecurity=False).hexdigest()[:15], 16)
    return found


def _smallest(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The smallest distinct hashes of the shingles of each text of words between single spaces."""
    starts, ends, sizes, offset = [], [], [], 0
    for text in texts:
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + offset
        first, last = np.append(offset, gaps + 1), np.append(gaps, offset + len(text))
        starts.append(first[: max(1, len(first) - 4)])
        ends.append(last[4:] if len(last) > 4 else last[-1:])
        sizes.append(len(starts[-1]))
        offset += len(text)
    hashes = _md5_starts(b"".join(texts), np.concatenate(starts), np.concatenate(ends))
    for h in np.split(hashes, np.cumsum(sizes)[:-1]):
        h.sort()
        yield h[np.append(True, h[1:] != h[:-1])][: V.SIGNATURE_SIZE]


@F.pandas_udf(ArrayType(LongType()))
def _md5_numbers(texts: pd.Series) -> pd.Series:
    found, waiting, size = [[]] * len(texts), {}, 0

    def take() -> None:
        for i, h in zip(waiting, _smallest(list(waiting.values()))):
            found[i] = h

    for i, text in enumerate(texts):
        words = text.encode("latin-1", "replace").translate(_SPACED).split(None, V.SIGNATURE_WORDS)[: V.SIGNATURE_WORDS]
        joined = b" ".join(words)
        if len(joined) >= V.SIGNATURE_MIN_CHARS:
            waiting[i] = joined.decode("latin-1").encode()
            size += len(words)
        if size >= PORTION:
            take()
            waiting, size = {}, 0
    if waiting:
        take()
    return pd.Series(found)


def similarity(a: Column, b: Column) -> Column:
    """FN-17: share of the smallest hashes of the union that both have; null if a signature is empty."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, V.SIGNATURE_SIZE)
    share = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    known = F.when(a == b, 1.0).when(~F.arrays_overlap(a, b), 0.0).otherwise(share)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), known)


def company_match(a: Column, b: Column) -> Column:
    """FN-18 on company words: 'strong' (the same), 'weak' (maybe) or ''."""
    ca, cb = F.array_join(a, ""), F.array_join(b, "")
    swap = F.size(b) < F.size(a)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    rest = F.slice(long, F.size(short) + 1, F.greatest(F.lit(1), F.size(long)))
    prefixed = (F.slice(long, F.lit(1), F.size(short)) == short) & F.forall(rest, lambda w: among(w, V.CORP_EXTRA))
    initials = F.array_join(F.transform(long, lambda w: F.left(w, F.lit(1))), "")
    strong = (ca == cb) | prefixed | ((F.size(short) == 1) & (F.size(long) >= 2) & (F.try_element_at(short, F.lit(1)) == initials))
    subset = F.size(F.array_except(short, long)) == 0
    weak = subset | ((F.least(F.length(ca), F.length(cb)) >= 3) & (ca.startswith(cb) | cb.startswith(ca)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "").when(strong, "strong").when(weak, "weak").otherwise("")


def written_in(text: Column) -> Column:
    """FN-21: the language by its frequent words; ties go by the order of the lists; '' if too short to tell."""
    w = F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zäöüßàâçéèêëîïôûùñáíóú]+"), F.lit(0)), 1, V.LANGUAGE_WORDS_READ)
    counts = let(w, lambda w: F.array(F.size(w), *[_hits(w, ws) for ws in V.LANGUAGE_WORDS.values()]))

    def name(n: Column) -> Column:
        hits = F.slice(n, 2, len(V.LANGUAGE_WORDS))
        best = F.array_max(hits)
        found = F.element_at(lit_array(V.LANGUAGE_WORDS), F.array_position(hits, best).cast("int"))
        return F.when((best >= V.LANGUAGE_MIN_HITS) & (best >= V.LANGUAGE_MIN_SHARE * n[0]), found).otherwise("")

    return let(counts, name)


def _hits(w: Column, listed) -> Column:
    return F.size(F.filter(w, lambda x: among(x, listed)))


def slug(s: Column) -> Column:
    """FN-26: a percent-encoded path part."""
    return F.url_encode(F.btrim(F.regexp_replace(F.lower(s), r"(?U)[^\w]+", "-"), F.lit("-")))


def clean_source(s: Column) -> Column:
    """FN-28."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9._-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.left(plain, F.lit(40)), F.lit("")), F.lit("unknown"))


def campaign_name(s: Column) -> Column:
    """FN-29: a valid name, or ''."""
    plain = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return F.when(plain.rlike("^[a-z0-9][a-z0-9_-]{0,39}$"), plain).otherwise("")


def short_hash(s: Column, digits: int = 7) -> Column:
    """FN-30: the first digits of the SHA-256."""
    return F.left(F.sha2(s, 256), F.lit(digits))


def is_json(s: Column) -> Column:
    """Whether a text is one JSON value and nothing else; parsers stop behind the first."""
    whole = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    return F.coalesce(whole.isNotNull() & F.try_variant_get(whole, "$[0]", "variant").isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull(), F.lit(False))


def parse_json_answer(s: Column) -> Column:
    """FN-32: the outermost JSON object in a model's answer as text, without thoughts and fences; null if there is none."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?s)<think>.*?</think>", "")
    found = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when((found != "") & is_json(found), found)


def company_slugs(name: Column) -> Column:
    """FN-24: candidate board names of a company, in order, without repeats."""
    plain = F.transform(company_tokens(name), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    plain = F.filter(plain, lambda w: F.length(w) > 1)
    spaced = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+"), lambda w: ~among(F.regexp_replace(w, "[^a-z0-9]", ""), V.LEGAL))
    kept = F.array_join(F.transform(spaced, lambda w: F.regexp_replace(w, "[^a-z0-9-]", "")), "")
    found = F.array(F.array_join(plain, ""), F.array_join(plain, "-"), company_key(name), kept)
    return F.array_distinct(F.filter(found, lambda g: (F.length(g) >= 3) & ~among(g, V.CORP_EXTRA + V.LEGAL)))


def any_of(patterns) -> str:
    """FN-42: one pattern for several, without regard to case."""
    return I + "|".join(f"(?:{p})" for p in patterns)


def places_pattern(places) -> str:
    return I + r"\b(?:" + "|".join(re.escape(p) for p in places) + r")\b"
