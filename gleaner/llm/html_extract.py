"""HTML extraction by equivalence classes: tokens that share an occurrence vector over a host's pages form its template.

Tokens are the elements of a page, told apart by their path of tags, classes and ids, and its text blocks. A token's
occurrence vector is how often it stands in each page of the host. Vectors are compared by an order-free digest, so classes
come from one grouping by (host, token) and one by (host, vector), however many pages a host has. Classes that are large and
frequent enough are valid; their elements, nested by path, are the host's template.

An element of the template that stands once in a page is a slot. What it holds differs from page to page in the article, and
recurs in menus, notices and adverts, so the number of different contents of a slot tells which it is: a slot with far fewer
than the article's is dropped, whatever its name. The article's slot is the deepest one that holds most of the remaining
text, widened as long as more of that text lies around it, within the article or main element if there is one. All remaining
slots in it are extracted. Names of classes and ids only decide where the pages don't: on hosts without a valid template, in
elements outside of it, and in slots of which too few contents have been seen.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A valid class has so many tokens at least, and stands in so large a share of the host's pages.
MIN_CLASS, MIN_SUPPORT = 3, 0.5
#: A slot's contents recur if there are so many times fewer of them than of the article's.
RECURS = 2
#: Slots are judged, and text is taken for the template's, once so many different contents were to be expected.
EVIDENCE = 8
#: Share of the text that the article's slot holds at least; slots with more than half of all text are never dropped.
MAIN_SHARE, MOST = 0.6, 0.5
#: An element marked by its class holds the article all the same if it has more than so much of the page's text: with an h1,
#: article or main element in it, and without.
WRAPPER_SHARE, BARE_SHARE = 0.5, 0.8
#: Templates are broadcast up to this many bytes, else joined by host.
BROADCAST_BYTES = 4_000_000

# Kinds of elements in HTML, and words that mark parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body div main section table tbody td tr center blockquote".split())
BOXES = CONTAINERS - frozenset("article body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("head script style noscript template iframe object svg canvas select button textarea form nav footer aside menu dialog".split())
BESIDE = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead "
    "comment comments disqus cookie cookies consent notice popup modal newsletter subscribe share sharing social related recommended widget pagination "
    "login signup".split()
)
# Words before one of them that only tell of a page's layout or subject (has-sidebar, category-social), and elements that no
# class puts beside the article.
MODIFIERS = frozenset("has have no not non without with hide category categories cat tag tagged topic".split())
NEVER_BESIDE = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

ROOT = 0

_RAW = re.compile(r"<(script|style|noscript|textarea|title|iframe)(?=[\s/>])", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
# An open element that a new one of the group closes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_KEEPS_P = VOID - {"hr"}
_LISTS = frozenset(("ul", "ol", "dl", "table", "select"))
_RAW_TAGS = frozenset(("script", "style", "noscript", "textarea", "title", "iframe"))


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(100_000)
def child(path: int, name: str) -> int:
    """The path of an element below another: paths are digests, so that they don't grow with depth."""
    return digest(f"{path}/{name}")


def tags(text: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``start, end, tag, closes, attributes`` of tags, and with an empty tag of comments, declarations and raw text, in one
    pass. A quote that hides the end of its tag to the end of the text doesn't count, nor does any after it."""
    at, quotes = 0, True
    while (start := text.find("<", at)) >= 0:
        at = start + 1
        if text.startswith("<!--", start):
            end = text.find("-->", start)
            at = len(text) if end < 0 else end + 3
            yield start, at, "", False, ""
        elif raw := _RAW.match(text, start):
            end = text.find(">", raw.end())
            if end < 0:
                return
            close = re.compile(rf"</{raw[1]}\s*>", re.I).search(text, end)
            at = close.end() if close else len(text)
            yield start, at, raw[1].lower(), True, ""
        elif name := _NAME.match(text, start):
            end = name.end()
            while quotes and (stop := _STOP.search(text, end)) and stop[0] != ">":
                end = text.find(stop[0], stop.end()) + 1
                quotes = end > 0
            stop = text.find(">", end if quotes else name.end())
            if stop < 0:
                if not quotes:
                    return
                quotes, at = False, start
                continue
            at = stop + 1
            yield start, at, name[2].lower(), bool(name[1]), text[name.end() : stop]
        elif text[at : at + 1] in ("!", "?", "/"):
            end = text.find(">", at)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", False, ""


@dataclass
class Template:
    """Paths of a host: the article's slot, dropped slots, slots known not to recur, and digests of its text blocks."""

    main: int
    dropped: frozenset[int] = frozenset()
    trusted: frozenset[int] = frozenset()
    constants: frozenset[int] = frozenset()


@dataclass(slots=True)
class Block:
    text: str
    mark: int  # of the path and text
    linked: int
    skipped: bool
    named: int  # number of the innermost element that a class puts beside the article, or -1
    article: bool
    main: bool
    slot: bool
    dropped: bool
    heading: bool
    beside: bool = False

    def constant(self, template: Template) -> bool:
        """Whether it goes because it stands on the host's pages whatever they hold. An article or main element says itself what
        is the page's own, and a heading may well be the same on every page."""
        return not (self.article or self.main or self.heading) and self.mark in template.constants


@dataclass(slots=True)
class Open:
    """An open element. ``owner`` is the nearest element of a block kind, itself included."""

    tag: str
    path: int = ROOT
    owner: Open | None = None
    skipped: bool = False
    named: int = -1
    article: bool = False
    main: bool = False
    slot: bool = False
    dropped: bool = False
    above: Open | None = None
    chars: int = 0
    content: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: By path: parent, name, how often, characters of text (without links and skipped kinds) and digest of the contents.
    elements: dict[int, list] = field(default_factory=lambda: {ROOT: [ROOT, "", 1, 0, 0]})


def _marks(value: str) -> set[str]:
    """Words of BESIDE in a class or id, but for those that follow a modifier in the same class."""
    found = set()
    for one in value.split():
        for word in _WORD.findall(one):
            if word in MODIFIERS:
                break
            if word in BESIDE:
                found.add(word)
    return found


def _signature(tag: str, attributes: str) -> tuple[str, bool, frozenset[str]]:
    """Tag with its classes and id without digits, whether the element can't hold an article by kind, and words of its classes
    and id that say so."""
    name, skipped, said = tag, tag in SKIPPED, set()
    if attributes and "=" in attributes:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        marks = []
        for key in ("class", "id"):
            if key in found:
                marks.append("-".join(_WORD.findall(found[key].lower())))
                said |= _marks(found[key].lower())
        if marks:
            name = f"{tag}.{'.'.join(marks)}"
        skipped = skipped or found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true"
        skipped = skipped or bool(re.search(r"\bhidden\b", re.sub(r'"[^"]*"|\'[^\']*\'', "", attributes)))
    return name, skipped, frozenset(said)


class _Names:
    """Elements that a word in a class or id puts beside the article, unless they turn out to hold it."""

    def __init__(self) -> None:
        self.above: list[int] = []
        self.comments: list[bool] = []
        self.wraps: list[bool] = []

    def add(self, above: int, said: frozenset[str]) -> int:
        self.above.append(above)
        self.comments.append(said <= COMMENTS)
        self.wraps.append(False)
        return len(self.above) - 1

    def settle(self, blocks: list[Block]) -> None:
        """Mark blocks in elements that don't hold most of the page's text; sums go from the innermost element outwards."""
        held = [0] * len(self.above)
        size = lambda b: 0 if b.skipped else len(b.text) - b.linked
        for b in blocks:
            if b.named >= 0:
                held[b.named] += size(b)
        for k in range(len(held) - 1, -1, -1):
            if (up := self.above[k]) >= 0:
                held[up] += held[k]
                self.wraps[up] |= self.wraps[k]
        total = sum(map(size, blocks))
        fine: list[bool] = []
        for k, h in enumerate(held):
            holds = h > WRAPPER_SHARE * total if self.wraps[k] else h > BARE_SHARE * total and not self.comments[k]
            fine.append(holds and (self.above[k] < 0 or fine[self.above[k]]))
        for b in blocks:
            b.beside = b.skipped or b.named >= 0 and not fine[b.named]


def parse(text: str, template: Template | None = None) -> Page:
    """Blocks of a page in order and its elements by path; with a template, blocks tell where they lie in it."""
    page, names = Page(), _Names()
    root = Open("", slot=template is not None and template.main == ROOT)
    root.owner = root
    stack, count = [root], {}  # open elements, and how many of each tag
    signatures: dict[tuple[str, str], tuple[str, bool, frozenset[str]]] = {}
    parts: list[str] = []
    linked = links = 0
    mask = 0x7FFFFFFFFFFFFFFF

    def flush() -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if whole:
            top = stack[-1]
            b = Block(whole, digest(f"{top.path}|{whole}"), min(linked, len(whole)), top.skipped, top.named, top.article, top.main, top.slot, top.dropped, top.tag in HEADINGS)
            page.blocks.append(b)
            if not b.skipped and b.linked < len(whole):
                top.owner.chars += len(whole) - b.linked
                top.owner.content = (top.owner.content * 31 + b.mark) & mask
        linked = 0

    def close() -> Open:
        e = stack.pop()
        count[e.tag] -= 1
        if e.owner is e:
            known = page.elements[e.path]
            known[3] += e.chars
            known[4] = (known[4] * 31 + e.content) & mask
            up = e.above.owner
            up.chars += e.chars
            up.content = (up.content * 31 + e.content) & mask
        return e

    def close_down_to(wanted: tuple[str, ...], fence: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in wanted:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in fence:
                return

    at = 0
    for start, end, tag, closes, attributes in tags(text):
        if start > at:
            parts.append(text[at:start])
            linked += (start - at) * bool(links)
        at = end
        if tag in _RAW_TAGS:
            parts.append(" ")
            continue
        if not tag:
            continue
        block = tag in BLOCKS
        if closes:
            if tag == "a":
                links = max(0, links - 1)
            if count.get(tag):
                if block:
                    flush()
                while close().tag != tag:
                    pass
            continue
        if tag == "br":
            parts.append(" ")
        if block:
            flush()
            links = 0
            if own := _CLOSES.get(tag):
                if any(count.get(t) for t in own):
                    close_down_to(own, _LISTS)
            elif tag not in _KEEPS_P and count.get("p"):
                close_down_to(("p",), CONTAINERS)
        if tag in VOID:
            continue
        key = (tag, attributes)
        if key not in signatures:
            signatures[key] = _signature(tag, attributes)
        name, skipped, said = signatures[key]
        up = stack[-1]
        if tag == "header":
            skipped = skipped or not (up.article or up.main)
        e = Open(tag, up.path, up.owner, up.skipped or skipped, up.named, up.article or tag == "article", up.main or tag == "main", up.slot, up.dropped, up)
        if block:
            e.path, e.owner = child(up.path, name), e
            page.elements.setdefault(e.path, [up.path, name, 0, 0, 0])[2] += 1
            if template is not None:
                e.slot = up.slot or e.path == template.main
                # within an article or main element only whole boxes go: a byline is the same on many pages, too
                e.dropped = up.dropped or e.path in template.dropped and (tag in BOXES or not (up.article or up.main))
        links += tag == "a"
        if up.named >= 0 and (tag in ("h1", "main") or tag == "article" and not said):
            names.wraps[up.named] = True
        trusted = template is not None and block and e.path in template.trusted
        if said and not skipped and not trusted and tag not in NEVER_BESIDE:
            e.named = names.add(up.named, said)
        if attributes.endswith("/"):
            e.tag = ""
        stack.append(e)
        count[e.tag] = count.get(e.tag, 0) + 1
        if not e.tag:
            close()
    parts.append(text[at:])
    flush()
    while len(stack) > 1:
        close()
    page.elements[ROOT][3:] = root.chars, root.content
    names.settle(page.blocks)
    return page


def extract(text: str, template: Template | None = None) -> str:
    """The article's blocks of a page, one a line; without a template, of its article or else main elements, else the body."""
    if template is not None:
        blocks = parse(text, template).blocks
        if any(b.slot and not b.dropped for b in blocks):
            return "\n".join(b.text for b in blocks if b.slot and not b.dropped and not b.beside and not b.constant(template))
    blocks = [b for b in parse(text).blocks if not b.beside]
    inside = [b for b in blocks if b.article] or [b for b in blocks if b.main] or blocks
    return "\n".join(b.text for b in inside)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def page_tokens(pages: DataFrame) -> DataFrame:
    """``host, page, token, parent, name, n, chars, content`` of ``host, page, html``: elements with the text in them, and text
    blocks with null name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, key, text in zip(batch.column("host"), batch.column("page"), batch.column("html"), strict=True):
                page = parse(text.as_py() or "")
                texts: dict[int, int] = {}
                for b in page.blocks:
                    if not b.skipped:
                        texts[b.mark] = texts.get(b.mark, 0) + 1
                rows = [(p, *found) for p, found in page.elements.items()] + [(t, None, None, n, None, None) for t, n in texts.items()]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                fixed = [pa.array([host.as_py()] * len(rows), pa.string()), pa.array([key.as_py()] * len(rows), pa.int64())]
                yield pa.RecordBatch.from_arrays([*fixed, *columns], ["host", "page", "token", "parent", "name", "n", "chars", "content"])

    return pages.mapInArrow(run, "host string, page long, token long, parent long, name string, n int, chars long, content long")


def nest(rows: pd.DataFrame) -> tuple[int, list[int], list[int]] | None:
    """The article's slot, the dropped slots and those known not to recur, from ``token, parent, name, support, most, chars,
    contents`` of the elements of a host's template; None if they don't tell."""
    known = {r.token: r for r in rows.itertuples()}
    if ROOT not in known or not known[ROOT].chars:
        return None
    around: dict[int, list[int]] = {}  # from the element to the root; an element outside the template hides what is above it

    def chain(t: int) -> list[int]:
        path = []
        while t in known and t not in around:
            path.append(t)
            t = known[t].parent if t != ROOT else None
        upper = around.get(t, [])
        for t in reversed(path):
            around[t] = upper = [t, *upper]
        return upper

    slots = [t for t, r in known.items() if r.most == 1 and chain(t)[-1] == ROOT]
    varied = lambda t: known[t].contents / known[t].support
    tag = lambda t: known[t].name.split(".", 1)[0]
    total, main = known[ROOT].chars, ROOT
    for _ in range(2):  # the article's variety is first taken from whole pages, then from its slot
        level = varied(main)
        judged = {t for t in slots if level * known[t].support >= EVIDENCE}
        recurs = {t for t in judged.difference(around[main]) if RECURS * varied(t) <= level and known[t].chars <= MOST * total}
        dropped = [t for t in recurs if recurs.isdisjoint(around[t][1:])]
        left = {t: known[t].chars for t in slots}
        for t in dropped:
            for a in around[t]:
                if a in left:
                    left[a] -= known[t].chars
        rest = left[ROOT]
        if rest < (1 - MOST) * total:
            return None
        able = [t for t in slots if tag(t) in CONTAINERS and known[t].contents > 1 and left[t] >= MAIN_SHARE * rest and recurs.isdisjoint(around[t])]
        if not able:
            return None
        main = max(able, key=lambda t: (len(around[t]), left[t]))
    edge = max((k for k, t in enumerate(around[main]) if tag(t) in ("article", "main")), default=len(around[main]))
    wider = [t for t in around[main][: edge + 1] if t in left and tag(t) in CONTAINERS]
    main = max(wider, key=lambda t: (left[t], len(around[t])))
    sure = [t for t in judged if recurs.isdisjoint(around[t])]
    return main, dropped, sure


def deduce_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, main, dropped, trusted, constants`` from ``host, page, html``.

    A group of ``nest`` holds the elements of one host that stand in half of its pages, so it is bounded by the size of pages.
    """
    tokens = scratch.table(page_tokens(pages), "tokens")
    occurrence = F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    elements = tokens.where("name is not null").groupBy("host", "token")
    elements = elements.agg(
        F.max("parent").alias("parent"), F.max("name").alias("name"), F.count(F.lit(1)).alias("support"), F.max("n").alias("most"),
        occurrence, F.sum("chars").alias("chars"), F.approx_count_distinct("content").alias("contents"),
    ).where("support > 1")
    elements = scratch.table(elements, "elements")
    roots = elements.where(F.col("token") == ROOT).select("host", F.col("support").alias("pages"))
    classes = elements.groupBy("host", "vector", "support").agg(F.count(F.lit(1)).alias("size")).join(roots, "host")
    valid = classes.where((F.col("size") >= MIN_CLASS) & (F.col("support") >= MIN_SUPPORT * F.col("pages"))).select("host", "vector")
    valid = scratch.table(valid, "valid")
    # the page itself belongs to every template, also where other pages of the host have nothing else in common
    template = elements.where(F.col("token") != ROOT).join(valid, ["host", "vector"]).unionByName(elements.where(F.col("token") == ROOT))

    def nested(rows: pd.DataFrame) -> pd.DataFrame:
        found = nest(rows)
        out = [(rows["host"].iloc[0], *found)] if found else []
        return pd.DataFrame(out, columns=["host", "main", "dropped", "trusted"])

    mains = template.groupBy("host").applyInPandas(nested, "host string, main long, dropped array<long>, trusted array<long>")
    mains = scratch.table(mains, "mains")
    # text in the very class of the article's slot stands once wherever the slot does, whatever the slot holds
    slots = mains.join(elements.select("host", F.col("token").alias("main"), "vector", "support", "contents"), ["host", "main"])
    slots = slots.where(F.col("contents") >= EVIDENCE).select("host", "vector", "support")
    texts = tokens.where("name is null").groupBy("host", "token").agg(occurrence, F.count(F.lit(1)).alias("support")).where("support > 1")
    constants = texts.join(slots, ["host", "vector", "support"]).groupBy("host").agg(F.collect_set("token").alias("constants"))
    none = F.array().cast("array<long>")
    found = mains.join(constants, "host", "left").select("host", "main", "dropped", "trusted", F.coalesce("constants", none).alias("constants"))
    found = scratch.table(found, "templates")
    scratch.discard(tokens, elements, valid, mains)
    return found


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Templates are deduced per host over all its pages; a host without a valid template, or a page without its slot, falls back
    on the page's own article or main element, else its body. Scripts, menus, forms, footers and the like never count, by
    kind. A line break element is white space within its block.

    Null html is empty and gives an empty text, null urls are one host. Rows that repeat an id are pages each, but count as
    one place in a token's vector. An empty table gives an empty result. Extra columns are ignored. Ids are integers.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    templates = deduce_templates(rows.select("host", F.col("page_id").alias("page"), "html"), scratch)
    size = templates.agg(F.sum(F.length("host") + 8 * (F.size("dropped") + F.size("trusted") + F.size("constants")) + 128)).first()[0] or 0
    joined = rows.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left")
    parts = ["main", "dropped", "trusted", "constants"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, main, *sets in zip(batch.column("html"), *(batch.column(c) for c in parts), strict=True):
                template = Template(main.as_py(), *(frozenset(s.as_py()) for s in sets)) if main.is_valid else None
                texts.append(extract(text.as_py() or "", template))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", *parts).mapInArrow(run, "page_id long, url string, text string, n_chars long")
