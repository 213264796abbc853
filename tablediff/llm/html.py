"""HTML extraction with wrappers: union-free regular expressions inferred for each template of a host.

All pages of a host with the same frame (its containers with text, in order) are
aligned one after another, menus, headers and footers included. What all have is
the wrapper's fixed part; text that differs becomes a slot, runs of like elements
a repeated group, and what some pages lack an optional group. The wrapper tells
in which element the pages have their own text, which texts in it are the
template's, and whether an element whose class names it a side matter is one.
Every page is then read by the wrapper of its own template.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Elements of HTML by what they are to a reader.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "audio", "video", "canvas", "select"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: White space in the text.
BREAKS = {"br", "hr", "img", "td", "th"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"}
CONTENT = {"article", "main"}
AROUND = {"html", "body", "div", "section", "center", *CONTENT}
#: Elements of the article's own text, which may recur on a page or two without being the template's.
OWN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "code"}
#: Words in class, id or role that name what stands beside an article. The wrapper may tell otherwise.
APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo",
    "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup",
    "promo", "related", "replies", "sidebar", "signup", "sponsored", "subscribe",
}
#: A paragraph ends where one of these begins, and an item of a list where the next one does.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "option": {"option"}}


#: Pages that have to share a text in an element of the article's own kind before it is taken for the template's.
SEVERAL = 3
#: Groups in which the partial wrappers of one template are merged before they meet.
SALT = 256


class Place:
    """An open element: what is asked of it holds for all that is in it, so a deep page costs no more than a flat one."""

    __slots__ = ("name", "sign", "key", "parent", "apart", "named", "content", "link", "open_p", "head")

    def __init__(self, name: str, sign: str, named: bool, parent: Place | None):
        self.name, self.sign, self.parent = name, sign, parent
        self.key = xxhash.xxh64_intdigest(sign, parent.key if parent else 0) >> 1  # of the whole path
        up = parent or _OUTSIDE
        self.content = up.content or name in CONTENT
        self.apart = up.apart or name in APART or name == "header" and not self.content
        self.named = up.named or ((self.key,) if named else ())  # the outermost element that its class sets apart
        self.link = up.link or name == "a"
        self.open_p = self if name == "p" else None if name in BLOCK else up.open_p
        self.head = up.head or (self if name == "head" else None)


class _Outside:
    content = apart = link = False
    named: tuple[int, ...] = ()
    open_p = head = None


_OUTSIDE = _Outside()
ROOT = Place("", "", False, None)


@dataclass
class Text:
    """A piece of text, and the innermost element around it."""

    value: str
    place: Place
    block: int


def pieces(html: str) -> Iterator[Text]:
    """The texts of a page that a reader could see, in order, and where they stand.

    Broken markup is read leniently: what is not closed ends with what holds it,
    and an end that nothing began is passed over.
    """
    top, opened = ROOT, defaultdict(int)
    block, at = 0, 0

    def close(upto: Place) -> Place:
        place = top
        while True:
            opened[place.name] -= 1
            if place is upto:
                return place.parent
            place = place.parent

    while m := MARKUP.search(html, at):
        name = (m["name"] or "").lower()
        if m.start() > at:
            yield Text(html[at : m.start()], top, block)
        at = m.end()
        if not name:
            continue
        if name in BLOCK:
            block += 1
        if m["end"]:
            if opened[name]:
                place = top
                while place.name != name:
                    place = place.parent
                top = close(place)
            continue
        closed = m["rest"].rstrip().endswith("/")
        if name in RAW:
            if not closed:  # what scripts and the like hold is no markup
                end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in VOID or closed:
            if name in BREAKS:
                yield Text(" ", top, block)
            continue
        if name in BLOCK and top.open_p:
            top = close(top.open_p)
        if name in BLOCK and top.head:
            top = close(top.head)
        if top.name in CLOSES.get(name, ()):
            top = close(top)
        if name in BREAKS:
            yield Text(" ", top, block)
        top = Place(name, *_signature(name, m["rest"]), top)
        opened[name] += 1
    if at < len(html):
        yield Text(html[at:], top, block)


def _signature(name: str, rest: str) -> tuple[str, bool]:
    """The element's name with its id and classes, and whether they name it a side matter."""
    if "=" not in rest:
        return name, False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
    words = re.split(r"[^a-z0-9]+", " ".join(found.get(k, "").lower() for k in ("id", "class", "role")))
    sign = name + "".join(f"#{x}" for x in found.get("id", "").split()) + "".join(f".{x}" for x in found.get("class", "").split())
    sign = re.sub(r"\d+", "0", sign)  # numbers tell pages apart, not places
    return sign, name not in ("html", "body") and not CONTENT & {name} and bool(APART_WORDS & set(words))


def _clean(value: str) -> str:
    return " ".join(unescape(value).split())


def digest(value: str) -> str:
    """What a wrapper keeps of a text: 128 bits, however long it is."""
    return xxhash.xxh3_128_hexdigest(value)


# --- wrappers


@dataclass(frozen=True)
class Node:
    """A part of a wrapper: text in an element.

    It may repeat, be missing on some pages, or differ: a slot, with value None.
    `pages` have it, with `words` in all.
    """

    key: int
    value: str | None
    repeated: bool = False
    optional: bool = False
    pages: int = 1
    words: int = 0

    def with_(self, other: Node, **changes) -> Node:
        """Both as one, `other` from another page unless `pages` is given."""
        return replace(
            self, value=self.value if self.value == other.value else None, repeated=self.repeated or other.repeated,
            optional=self.optional or other.optional, words=self.words + other.words, **({"pages": self.pages + other.pages} | changes),
        )


@dataclass
class Wrapper:
    """The nodes that pages have in order, the elements around them, and whether any two of the pages differ."""

    nodes: list[Node] = field(default_factory=list)
    #: Of each element: that around it, its signature, and bits: side matter by name, by class, a link.
    elements: dict[int, tuple[int, str, int]] = field(default_factory=dict)
    pages: int = 0
    print: int = 0
    differ: bool = False

    @classmethod
    def of(cls, html: str) -> Wrapper:
        """A page's own wrapper, with runs of like nodes folded into repeated groups."""
        out = cls(pages=1)
        values = xxhash.xxh64()
        for t in pieces(html):
            if not (value := _clean(t.value)):
                continue
            values.update(value + "\n")
            n = len(value.split())
            node = Node(t.place.key, digest(value), words=n)
            if out.nodes and out.nodes[-1].key == node.key:
                out.nodes[-1] = replace(out.nodes[-1].with_(node, pages=1), repeated=True)
            else:
                out.nodes.append(node)
            place = t.place
            while place is not None and place.key not in out.elements:
                bits = (place.apart and 1) | (place.named != () and 2) | (place.link and 4)
                out.elements[place.key] = (place.parent.key if place.parent else -1, place.sign, bits)
                place = place.parent
        out.nodes, out.print = _fold(out.nodes), values.intdigest() >> 1
        return out

    def add(self, other: Wrapper) -> None:
        """Aligns another wrapper with this one: mismatches become optional groups and slots."""
        if not self.pages:
            self.__dict__.update(other.__dict__)
            return
        self.nodes = _align(self.nodes, other.nodes)
        self.elements = other.elements | self.elements
        self.differ |= other.differ or self.print != other.print
        self.pages += other.pages

    def dumps(self) -> str:
        nodes = [[n.key, n.value, n.repeated, n.optional, n.pages, n.words] for n in self.nodes]
        return json.dumps([nodes, [[k, *v] for k, v in self.elements.items()], self.pages, self.print, self.differ])

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        nodes, elements, *rest = json.loads(text)
        return cls([Node(*n) for n in nodes], {k: (up, sign, bits) for k, up, sign, bits in elements}, *rest)


def _fold(nodes: list[Node], longest: int = 8) -> list[Node]:
    """Folds groups of up to `longest` nodes that follow each other in the same elements."""
    for size in range(2, longest + 1):
        if len(nodes) < 2 * size:
            break
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            if len(out) >= 2 * size and out[-1 - size].key == node.key:
                a, b = out[-2 * size : -size], out[-size:]
                if all(x.key == y.key for x, y in zip(a, b)):
                    out[-2 * size :] = [replace(x.with_(y, pages=max(x.pages, y.pages)), repeated=True) for x, y in zip(a, b)]
        nodes = out
    return nodes


def _align(a: list[Node], b: list[Node]) -> list[Node]:
    """Both in one sequence. Where they differ, the side goes on that comes sooner to what the other is at."""
    if [n.key for n in a] == [n.key for n in b]:
        return [x.with_(y) for x, y in zip(a, b)]
    at_a, at_b = defaultdict(list), defaultdict(list)
    for at, nodes in ((at_a, a), (at_b, b)):
        for k, n in enumerate(nodes):
            at[n.key].append(k)

    def ahead(at: list[int], k: int) -> int | None:
        place = bisect_left(at, k)
        return at[place] if place < len(at) else None

    out, i, j = [], 0, 0
    missing = lambda nodes: [replace(n, optional=True) for n in nodes]
    while i < len(a) and j < len(b):
        if a[i].key == b[j].key:
            out.append(a[i].with_(b[j]))
            i, j = i + 1, j + 1
            continue
        to_a, to_b = ahead(at_a[b[j].key], i), ahead(at_b[a[i].key], j)
        if to_a is not None and (to_b is None or to_a - i <= to_b - j):
            out += missing(a[i:to_a])
            i = to_a
        elif to_b is not None:
            out += missing(b[j:to_b])
            j = to_b
        else:
            out += missing([a[i], b[j]])
            i, j = i + 1, j + 1
    return _fold(out + missing(a[i:]) + missing(b[j:]))


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of some pages."""
    out = Wrapper()
    for html in pages:
        out.add(Wrapper.of(html))
    return out


def rule(wrapper: Wrapper) -> dict:
    """How to read the pages of a wrapper: `inside` which element, without which `fixed` texts, and which elements are `plain`.

    Words in slots count for every element around them; those of fixed parts do
    not, unless all pages are the same. An element whose class names it a side
    matter is plain if hardly any words (a tenth) stand elsewhere. From the outermost the
    rule goes to the inner element, as long as nothing beside that has words of
    its own outside of links; an article or main element with half of the words
    is taken at once. Fixed are texts of any length that are the same on all of
    several pages that have them; in paragraphs, headings, lists and the like,
    which pages may quote from each other, on all pages of the template.
    """
    if not wrapper.nodes:
        return NOTHING
    slots = [n for n in wrapper.nodes if n.value is None or not wrapper.differ]

    def count(skip: int) -> dict[int, int]:
        own: dict[int, int] = defaultdict(int)
        for n in slots:
            if not wrapper.elements[n.key][2] & skip:
                own[n.key] += n.words
        return own

    total: dict[int, int] = _upwards(wrapper, count(1 | 4))
    bits = {k: v[2] for k, v in wrapper.elements.items()}
    outer = [k for k, (up, _, b) in wrapper.elements.items() if b & 2 and not bits.get(up, 0) & 2]
    plain = [k for k in outer if total[ROOT.key] and 10 * total[k] >= 9 * total[ROOT.key]]
    under = set(plain)
    for k in _outwards(wrapper):
        if wrapper.elements[k][0] in under:
            under.add(k)
    own: dict[int, int] = defaultdict(int)
    for n in slots:
        b = bits[n.key]
        if not b & (1 | 4) and not (b & 2 and n.key not in under):
            own[n.key] += n.words
    sums = _upwards(wrapper, own)
    inner = defaultdict(list)
    for k, (up, sign, _) in wrapper.elements.items():
        if sums[k] and re.split(r"[#.]", sign)[0] in AROUND:
            inner[up].append(k)
    name = lambda k: re.split(r"[#.]", wrapper.elements[k][1])[0]
    at = ROOT.key
    while name(at) not in CONTENT and inner[at]:
        content = [k for k in inner[at] if name(k) in CONTENT]
        best = max(content or inner[at], key=lambda k: (sums[k], k))
        if sums[best] < sums[at] and not (content and 2 * sums[best] >= sums[at]):
            break
        at = best
    fixed = set()
    if wrapper.differ:
        varied = {n.key for n in wrapper.nodes if n.value is None}
        for n in wrapper.nodes:
            if n.value and n.key not in varied and (n.pages > 1 if name(n.key) not in OWN else n.pages >= SEVERAL and not n.optional):
                fixed.add((n.key, n.value))
    return {"inside": at, "fixed": sorted(fixed), "plain": sorted(plain)}


def _outwards(wrapper: Wrapper) -> list[int]:
    """All elements, each after that around it."""
    inner = defaultdict(list)
    for k, (up, *_) in wrapper.elements.items():
        inner[up].append(k)
    out = [ROOT.key] if ROOT.key in wrapper.elements else []
    for k in out:
        out += inner[k]
    return out


def _upwards(wrapper: Wrapper, own: dict[int, int]) -> dict[int, int]:
    """The sums of elements with all that is in them."""
    sums = defaultdict(int, own)
    for k in reversed(_outwards(wrapper)):
        sums[wrapper.elements[k][0]] += sums[k]
    return sums


NOTHING = {"inside": ROOT.key, "fixed": [], "plain": []}


def article(html: str, rule: dict = NOTHING) -> str:
    """The article of a page: its blocks, joined by two newlines.

    Where the page has no text in the rule's element, it is read from its
    article or main elements, else from all of it.
    """
    plain, fixed, inside = set(rule["plain"]), {tuple(f) for f in rule["fixed"]}, {}

    def within(place: Place) -> bool:
        """Whether it is in the rule's element; the answer is kept for each element, so that a deep page is read once."""
        seen = []
        while place is not None and id(place) not in inside:
            seen.append(place)
            place = place.parent
        found = inside[id(place)] if place is not None else False
        for p in reversed(seen):
            found = inside[id(p)] = found or p.key == rule["inside"]
        return found

    texts = [t for t in pieces(html) if not t.place.apart and (not t.place.named or t.place.named[0] in plain)]
    chosen = [t for t in texts if within(t.place)]
    if rule["inside"] == ROOT.key or not any(not t.value.isspace() for t in chosen):
        chosen = [t for t in texts if t.place.content] or texts
    blocks: dict[int, list[str]] = {}
    places = {k for k, _ in fixed}
    for t in chosen:
        if t.place.key not in places or (t.place.key, digest(_clean(t.value))) not in fixed:
            blocks.setdefault(t.block, []).append(t.value)
    joined = (_clean("".join(b)) for b in blocks.values())
    return "\n\n".join(b for b in joined if b)


def frame(html: str) -> int:
    """The template of a page: the containers that have text, in order of the first, but for side matters."""
    found, last = {}, None
    for t in pieces(html):
        place = t.place
        if place is last or place.apart or t.value.isspace():
            continue
        last = place
        while place.name not in AROUND and place.parent is not None:
            place = place.parent
        found.setdefault(place.key)
    return xxhash.xxh64_intdigest(",".join(map(str, found))) >> 1


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every row of `pages` (page_id, url, html; other columns are ignored).

    Each task aligns its pages with the wrapper of their host and frame; partial
    wrappers of a template are merged in SALT groups and then in one, so a host
    with a third of all pages is a row a task and template. Rules are small (an
    element and hashes of fixed texts) and joined by host and frame; Spark checks their
    size before it broadcasts them. Exact copies tell a wrapper nothing, and
    rows without html have no text. A null url belongs to the host "". Returns
    page_id, url, text (empty if none), n_chars; repeated rows and null ids give
    a row each, and an empty table an empty one.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))

    def emit(held: dict[tuple[str, int], Wrapper]) -> pa.RecordBatch:
        salt = TaskContext.get().partitionId() % SALT
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([salt] * len(keys), pa.int32()), pa.array([held[k].dumps() for k in keys], pa.string())],
            ["host", "frame", "salt", "wrapper"],
        )

    def partial(batches):
        held: dict[tuple[str, int], Wrapper] = {}
        for batch in slices(batches, 256):
            for html, host in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((host, frame(html)), Wrapper()).add(Wrapper.of(html))
            if len(held) > 1000:
                yield emit(held)
                held = {}
        yield emit(held)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = Wrapper()
        for text in sorted(group["wrapper"]):
            out.add(Wrapper.loads(text))
        return group.head(1).assign(wrapper=out.dumps())

    def rules(group: pd.DataFrame) -> pd.DataFrame:
        found = rule(Wrapper.loads(merge(group)["wrapper"].iloc[0]))
        return pd.DataFrame({"host": group["host"].iloc[:1], "frame": group["frame"].iloc[:1], "rule": [json.dumps(found)]})

    schema = "host string, frame long, salt int, wrapper string"
    wrappers = rows.where("html <> ''").select("html", "host").mapInArrow(partial, schema)
    wrappers = wrappers.groupBy("host", "frame", "salt").applyInPandas(merge, schema)
    found = stash(wrappers.groupBy("host", "frame").applyInPandas(rules, "host string, frame long, rule string"), "rules")

    def framed(batches):
        for batch in slices(batches, 256):
            frames = pa.array([frame(h) for h in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, frames], ["page_id", "url", "html", "host", "frame"])

    def read(batches):
        cache: dict[str | None, dict] = {None: NOTHING}
        for part in slices(batches, 256):
            texts = []
            for html, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if text not in cache:
                    cache = {None: NOTHING} if len(cache) > 10_000 else cache
                    cache[text] = json.loads(text)
                texts.append(article(html, cache[text]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    ruled = rows.mapInArrow(framed, "page_id long, url string, html string, host string, frame long").join(found, ["host", "frame"], "left")
    return ruled.select("page_id", "url", "html", "rule").mapInArrow(read, "page_id long, url string, text string, n_chars long")
