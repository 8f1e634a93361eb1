"""Main text of web pages by wrappers inferred from each host's pages.

A page is a stream of slots: the open elements (with their classes) around each text block. A host's wrapper is a
union-free regular expression over slots, a list of leaves. It starts as one page's stream with adjacent repeats folded
into repeated groups. Every further page is aligned with it: each mismatch makes what only one side has optional, and
texts that differ at a place make it a text slot, while a text that all pages have at that place is the template's own.
A leaf so has its place in the order of the wrapper, and adds up its text, linked text and pages. All pages take part:
tasks fold their own pages, and the wrappers of a host, at most one from each task, are aligned in two rounds.

A page is then matched with its host's wrapper, and what its leaves are decides about its blocks. Elements that HTML
itself sets apart (navigation, footers, forms and so on) go. Of the rest, leaves inside an article element are kept, but
for article elements that hold links in the main over all pages of the host; or, where the page has none, inside a main
element, or else those of the region that holds most of the varying, unlinked text of the leaves that the page has: from
the root, the element that holds two thirds of it is entered again and again. Template texts of such a region go, those
of an article or main element stay. Class names decide only what alignment can't know: lists of comments and the like
are never kept, and an element named as an advert, notice and so on isn't, unless it holds most of the page's text
itself.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript template iframe svg select button xmp noembed".split()
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SCOPE = set("article aside body div footer form header main nav section table td th ul ol dl blockquote figure".split())
#: An element that one of these starts closes, if it is open in the same scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What isn't the article: elements, and words of classes, ids and roles.
NOISE_TAGS = set("head nav footer aside form menu dialog".split())
NOISE_WORDS = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsored banner breadcrumb breadcrumbs comment comments respond replies disqus cookie cookies consent gdpr notice notices alert footer masthead menu menus modal popup nav navbar navigation newsletter pagination promo related recommended share sharing sidebar sidebars social subscribe toolbar widget widgets contentinfo complementary search".split())
#: Those of them that name lists of items.
ITEM_WORDS = set("comment comments respond replies related recommended".split())
#: Different pages that have a slot, before what they all have in it counts as template: one page can't be compared.
DISTINCT = 2
#: Lists that differ over more than LONG by LONG places are matched WINDOW by WINDOW places at a time.
LONG, WINDOW = 400, 100
SALTS = 64

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]).*?>|</{t}>|\Z", re.S | re.I) for t in RAW}
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


class Slots:
    """Slots of a host as numbers: each is a block element, with its classes, inside another slot. 0 is the page itself."""

    def __init__(self, parents=(), names=()):
        self.parents, self.names, self.of, self.natures, self.articles = [0], [""], {}, [("open", False)], [0]
        for parent, name in zip(parents, names):
            self.inside(parent, name)

    def inside(self, parent: int, name: str) -> int:
        slot = self.of.get((parent, name))
        if slot is None:
            slot = self.of[parent, name] = len(self.names)
            self.parents.append(parent)
            self.names.append(name)
            self.natures.append(_nature(*self.natures[parent], *name.split(".")))
            self.articles.append(self.articles[parent] or (slot if self.natures[slot][0] == "article" else 0))
        return slot

    def path(self, slot: int) -> str:
        parts = []
        while slot:
            parts.append(self.names[slot])
            slot = self.parents[slot]
        return "/".join(reversed(parts))

    def nature(self, slot: int) -> str:
        """`out`: elements that HTML sets apart, and named lists of other items. `named`: has a name of noise, with no article or main element below. Otherwise the container: `article`, `main` or `open`."""
        inside, named = self.natures[slot]
        return "named" if named and inside != "out" else inside


def _nature(inside: str, named: bool, tag: str, *names: str) -> tuple[str, bool]:
    """The container of an element in one of ``inside``, and whether it or one around it has a name of noise."""
    if inside == "out" or tag in NOISE_TAGS or (tag == "header" and inside == "open"):
        return "out", False
    if tag in ("article", "main"):
        named = False
    if tag not in ("body", "html") and is_named(names, NOISE_WORDS):
        if is_named(names, ITEM_WORDS):
            return "out", False
        named = True
    return (tag if tag == "article" or (tag == "main" and inside == "open") else inside), named


def blocks(source: str, slots: Slots) -> list[tuple[int, str, int]]:
    """(slot, text, linked characters) of each block with text, in page order. Open and unclosed elements end with their parents."""
    stack: list[int] = [0]
    names: list[str] = []
    opened: dict[str, int] = {}
    out: list[tuple[int, str, int]] = []
    text: list[str] = []
    linked, links = [0], [0]

    def flush():
        words = " ".join("".join(text).split())
        if words:
            out.append((stack[-1], words, min(linked[0], len(words))))
        text.clear()
        linked[0] = 0

    def put(raw: str):
        if raw:
            raw = html.unescape(raw)
            text.append(raw)
            if links[0]:
                linked[0] += len(raw.strip())

    def close(to: int):
        if any(n in BLOCK for n in names[to:]):
            flush()
        for n in names[to:]:
            opened[n] -= 1
        links[0] = opened.get("a", 0)
        del stack[to + 1 :], names[to:]

    def last(tag: str) -> int:
        return next(i for i in range(len(names) - 1, -1, -1) if names[i] == tag)

    at = 0
    while (m := TOKEN.search(source, at)) is not None:
        put(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                put(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                i = last(tag)
                if tag in BLOCK or not any(n in SCOPE for n in names[i:]):
                    close(i)
            continue
        if tag in RAW_END:
            at = RAW_END[tag].search(source, at).end() if not m[3].endswith("/") or tag != "svg" else at
            continue
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
        if tag in BLOCK:
            flush()
            if opened.get("p"):
                nearest = next((i for i in range(len(names) - 1, -1, -1) if names[i] == "p" or names[i] in SCOPE), 0)
                if names[nearest] == "p":
                    close(nearest)
        for i in range(len(names) - 1, -1, -1) if tag in CLOSES else ():
            if names[i] in CLOSES[tag]:
                close(i)
                break
            if names[i] in ("ul", "ol", "dl", "table", "article", "section", "div", "body"):
                break
        if tag in VOID or m[3].endswith("/"):
            continue
        # Without digits: numbered names must not part the slots of a host's pages.
        marks = sorted({w for a in ATTRIBUTE.findall(m[3]) for w in re.sub(r"[./0-9]+", "_", "".join(a[1:]) if a[0].lower() != "itemprop" else "".join(a[1:]).lower()).split()}) if m[3] else []
        names.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(slots.inside(stack[-1], ".".join([tag, *marks])) if tag in BLOCK else stack[-1])
        links[0] += tag == "a"
    put(source[at:])
    flush()
    return out


class Leaf:
    """A place in a wrapper: its slot, whether pages can lack it, whether it is in a repeated group, and sums over all pages.

    Sums: characters, linked characters, blocks, marks of the texts that all pages have here (None before the first page),
    marks of up to DISTINCT different pages.
    """

    __slots__ = ("slot", "optional", "repeated", "sums", "ahead")

    def __init__(self, slot, optional=False, repeated=False, sums=None):
        self.slot, self.optional, self.repeated, self.sums, self.ahead = slot, optional, repeated, sums or [0, 0, 0, None, []], None

    def here(self) -> Leaf:
        """The leaf that this one has become part of."""
        return self if self.ahead is None else self.ahead.here()

    def take(self, other: Leaf) -> None:
        self.optional |= other.optional
        self.repeated |= other.repeated
        mine, its = self.sums, other.sums
        if its[3] is not None:
            same = its[3] if mine[3] is None else sorted(set(mine[3]).intersection(its[3]))
            self.sums = [*(a + b for a, b in zip(mine[:3], its[:3])), same, sorted({*mine[4], *its[4]})[:DISTINCT] if same else []]
        other.ahead = self

    def is_fixed(self) -> bool:
        """Whether the template has a text of its own here."""
        return bool(self.sums[3]) and len(self.sums[4]) >= DISTINCT

    def plain(self, fixed: bool = False) -> int:
        """Characters of text, if most of it isn't linked: of varying text, or ``fixed``, of the template's own."""
        chars, linked = self.sums[:2]
        return 0 if 2 * linked >= chars or (self.is_fixed() and len(self.sums[3]) == 1 and not self.repeated) != fixed else chars


def fold(stream: list[int], longest: int = 8) -> list[tuple[int, bool, list[int]]]:
    """(slot, repeated, numbers of its blocks) of a page's leaves: adjacent repeats of up to ``longest`` units become one."""
    units = [[(s, False, [i])] for i, s in enumerate(stream)]
    name = lambda unit: tuple(x[0] for x in unit)
    for width in range(1, longest + 1):
        out, i, names = [], 0, [name(u) for u in units]
        while i < len(units):
            body, j = names[i : i + width], i + width
            while len(body) == width and names[j : j + width] == body:
                j += width
            if j > i + width:
                rounds = [[x for u in units[k : k + width] for x in u] for k in range(i, j, width)]
                out.append([(same[0][0], True, [n for x in same for n in x[2]]) for same in zip(*rounds)])
                i = j
            else:
                out.append(units[i])
                i += 1
        units = out
    return [x for u in units for x in u]


def matching(a: list[int], b: list[int]) -> list[tuple]:
    """Opcodes from one list of slots to the other, in time that doesn't grow with the square of long lists: what they begin and end with alike is cut off, and long rests are matched window by window."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    found, i, k, size = [], 0, 0, WINDOW if len(x) * len(y) > LONG * LONG else max(len(x), len(y))
    while i < len(x) and k < len(y):
        last = i + size >= len(x) and k + size >= len(y)
        some = [m for m in SequenceMatcher(None, x[i : i + size], y[k : k + size], autojunk=False).get_matching_blocks() if m[2]]
        some = [(i + m[0], k + m[1], m[2]) for m in some if last or 2 * max(m[0], m[1]) < size]  # the second half is seen again
        found += some
        if last:
            break
        i, k = (some[-1][0] + some[-1][2], some[-1][1] + some[-1][2]) if some else (i + size // 2, k + size // 2)
    pairs = [(0, 0, head)] * bool(head) + [(i + head, k + head, m) for i, k, m in found] + [(len(a) - tail, len(b) - tail, tail)]
    out, i, k = [], 0, 0
    for to, at, size in pairs:
        if to > i or at > k:
            out.append(("other", i, to, k, at))
        if size:
            out.append(("equal", to, to + size, at, at + size))
        i, k = to + size, at + size
    return out


def align(a: list[Leaf], b: list[Leaf]) -> list[Leaf]:
    """One wrapper for two: what both have stays, in order, and adds up; what one has becomes optional."""
    out: list[Leaf] = []
    for kind, i, j, k, m in matching([x.slot for x in a], [x.slot for x in b]):
        if kind == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                x.take(y)
            out += a[i:j]
        else:
            for x in (*a[i:j], *b[k:m]):
                x.optional = True
                out.append(x)
    seen = out[:1]
    for x in out[1:]:  # a slot next to itself is a repeat
        if x.slot == seen[-1].slot:
            seen[-1].take(x)
            seen[-1].repeated = True
        else:
            seen.append(x)
    return seen


def places(wrapper: list[Leaf], page: list[tuple]) -> list[Leaf]:
    """The wrapper's leaf for each leaf of a page. One out of order belongs to the leaf of its slot with most text."""
    found: list = [None] * len(page)
    for kind, i, j, k, _ in matching([x.slot for x in wrapper], [x[0] for x in page]):
        if kind == "equal":
            found[k : k + j - i] = wrapper[i:j]
    most: dict[int, Leaf] = {}
    for x in wrapper:
        if x.slot not in most or x.sums[0] > most[x.slot].sums[0]:
            most[x.slot] = x
    return [f or most.get(x[0]) or Leaf(x[0]) for f, x in zip(found, page)]


@lru_cache(1 << 16)
def words_of(name: str) -> tuple[str, ...]:
    """The words of one class, id or role, parted at hyphens, capitals and the like."""
    return tuple(w.lower() for w in re.findall(r"[A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name)))


def is_named(names: list[str], listed: set) -> bool:
    """Whether one of the names is of listed words alone: `sidebar` and `cookie-notice` are, `has-sidebar` isn't."""
    return any((w := words_of(n)) and listed.issuperset(w) for n in names)


def region(leaves: list[Leaf], slots: Slots, plain) -> list[Leaf]:
    """The leaves of the smallest element that holds two thirds of the plain text at each step from the root."""
    some = [x for x in leaves if plain(x)]
    below, order = {0: sum(map(plain, some))}, sorted({x.slot for x in some})
    own: dict[int, int] = {}
    for x in some:
        own[x.slot] = own.get(x.slot, 0) + plain(x)
    around, todo = set(), order
    while todo:  # all elements around the leaves, each once
        todo = [p for p in {slots.parents[s] for s in todo} if p and p not in around]
        around.update(todo)
    for slot in sorted(around | set(order), reverse=True):  # elements have greater numbers than those around them
        if (parent := slots.parents[slot]) and slot:
            below[parent] = below.get(parent, 0) + below.get(slot, 0) + own.get(slot, 0)
    inner: dict[int, list[int]] = {}
    for slot in sorted(around):
        inner.setdefault(slots.parents[slot], []).append(slot)
    at = 0
    while best := max(inner.get(at, ()), key=lambda s: below.get(s, 0), default=None):
        if 3 * below.get(best, 0) < 2 * below[at]:
            break
        at = best
    if not at:
        return some
    inside = {at}
    for slot in sorted(around | set(order)):
        if slots.parents[slot] in inside:
            inside.add(slot)
    return [x for x in some if x.slot in inside and x.slot != at]


def _is_unlinked(leaves) -> bool:
    """Whether most of the text of some leaves isn't linked."""
    chars, linked = map(sum, zip(*(x.sums[:2] for x in leaves)))
    return 2 * linked < chars


def chosen(leaves: list[Leaf], slots: Slots) -> tuple[set[int], bool]:
    """Numbers of a page's leaves that hold its main text, and whether the template's own texts among them go.

    An article or main element is kept with all that it holds. Of article elements of different slots, those that over
    all pages of the host hold links in the main are teasers of other pages, and go: if any other is there, or if the
    region outside of them holds more varying text than they hold text. Outside of articles, what all pages of the host
    have at a place is template, unless such text outweighs what differs: then the pages are much alike, and nothing of
    it goes.
    """
    of = [slots.nature(x.slot) for x in leaves]
    if "article" in of:
        inside = [slots.articles[x.slot] if n == "article" else 0 for x, n in zip(leaves, of)]
        plain = {a for a in set(inside) if a and _is_unlinked(x for x, b in zip(leaves, inside) if a == b)}
        outer = [x for x, n in zip(leaves, of) if n in ("main", "open")]
        if plain or sum(map(Leaf.plain, outer)) <= sum(x.sums[0] for x, a in zip(leaves, inside) if a):
            return {i for i, a in enumerate(inside) if a and (a in plain or not plain)}, False
        of = ["out" if n == "article" else n for n in of]
    if "main" in of:
        return {i for i, n in enumerate(of) if n == "main"}, False
    mass = lambda kind, **fixed: sum(x.plain(**fixed) for x, n in zip(leaves, of) if n in kind)
    kinds = ("open", "named") if mass(("named",)) > mass(("open",)) else ("open",)
    mean = lambda **fixed: sum(x.plain(**fixed) / x.sums[2] for x, n in zip(leaves, of) if n in kinds and x.sums[2])
    alike = mean(fixed=True) > mean()
    plain = (lambda x: x.plain() or x.plain(fixed=True)) if alike else Leaf.plain
    kept = {id(x) for x in region([x for x, n in zip(leaves, of) if n in kinds], slots, plain)}
    return {i for i, (x, n) in enumerate(zip(leaves, of)) if id(x) in kept and n in kinds}, not alike


def main_blocks(found: list[tuple], page: list[tuple], leaves: list[Leaf], kept: set[int], strict: bool) -> list[int]:
    """Numbers of one page's main blocks. If ``strict``, template texts are left out, unless the page would have no other text."""
    mine = sorted((n, i) for i in kept for n in page[i][2])
    own = [n for n, i in mine if not (strict and leaves[i].is_fixed() and mark(found[n][1]) in leaves[i].sums[3])]
    return own or [n for n, _ in mine]


def mark(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Host:
    """A wrapper as it grows. Pages of a shape that was seen add to the leaves that the first of them was aligned with."""

    def __init__(self):
        self.wrapper, self.known, self.slots = [], {}, Slots()

    def page(self, found: list[tuple]) -> None:
        page = fold([s for s, _, _ in found])
        shape = tuple(x[:2] for x in page)
        leaves = self.known.get(shape)
        if leaves is None:
            leaves = [Leaf(s, repeated=r) for s, r, _ in page]
            # An empty page says that everything is optional, as any other that lacks it does.
            self.wrapper = align(self.wrapper, leaves) if self.wrapper or self.known else leaves
            if len(self.known) >= 1000:
                self.known.clear()
            self.known[shape] = leaves
        whole = None
        for leaf, (_, _, numbers) in zip(leaves, page):
            s = leaf.here().sums
            s[0] += sum(len(found[n][1]) for n in numbers)
            s[1] += sum(found[n][2] for n in numbers)
            s[2] += len(numbers)
            if s[3] is None or s[3]:
                of = {mark(found[n][1]) for n in numbers}
                s[3] = sorted(of if s[3] is None else of.intersection(s[3]))
                if s[3] and len(s[4]) < DISTINCT:
                    whole = whole or mark(json.dumps(found))
                    if whole not in s[4]:
                        s[4].append(whole)


def dump(wrapper: list[Leaf], slots: Slots) -> str:
    """The leaves, and the slots that they are in or below, each once."""
    used, todo = set(), {x.slot for x in wrapper}
    while todo:
        used |= todo
        todo = {slots.parents[s] for s in todo} - used
    new = {s: i for i, s in enumerate(sorted(used | {0}))}
    kept = [s for s in sorted(used) if s]
    return json.dumps([[new[slots.parents[s]] for s in kept], [slots.names[s] for s in kept], [[new[x.slot], x.optional, x.repeated, x.sums] for x in wrapper]])


def load(raw: str, slots: Slots) -> list[Leaf]:
    """Leaves whose slots are put among those given."""
    parents, names, leaves = json.loads(raw)
    to = [0]
    for parent, name in zip(parents, names):
        to.append(slots.inside(to[parent], name))
    return [Leaf(to[slot], *more) for slot, *more in leaves]


def _infer(batches):
    def rows(hosts):
        return pa.RecordBatch.from_arrays([pa.array(list(hosts)), pa.array([dump(h.wrapper, h.slots) for h in hosts.values()])], ["host", "wrapper"])

    hosts: dict[str, Host] = {}
    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            of = hosts.setdefault(host, Host())
            of.page(blocks(source or "", of.slots))
            if len(hosts) >= 2000:
                yield rows(hosts)
                hosts = {}
    if hosts:
        yield rows(hosts)


def _merge(table: pa.Table, last: bool = False) -> pa.Table:
    slots = Slots()
    first, *rest = [load(w, slots) for w in sorted(table.column("wrapper").to_pylist(), key=lambda w: (-len(w), w))]
    for other in rest:
        first = align(first, other)
    if last:  # marks that no page will be matched with
        for x in first:
            if not x.is_fixed():
                x.sums[3:] = [[], []]
    return pa.table({"host": table.column("host")[:1], "wrapper": [dump(first, slots)]})


WRAPPERS = "host string, wrapper string"


def host_of(url: str):
    """The host of a url column, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#@]*)", 1))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and wrapper (JSON) from all pages; pages without a host share the empty one."""
    parts = pages.select(host_of(url_col).alias("host"), F.col(html_col)).mapInArrow(_infer, WRAPPERS)
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("host", "salt").applyInArrow(lambda t: _merge(t), WRAPPERS)
    return parts.groupBy("host").applyInArrow(lambda t: _merge(t, True), WRAPPERS)


def _extract(wrappers):
    """Text of pages. ``wrappers``: by host, broadcast, or None if each row brings its own."""

    def run(batches):
        parsed: dict[str, tuple] = {}
        for batch in batches:
            out = []
            own = batch.column(4).to_pylist() if wrappers is None else None
            for i, (source, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host not in parsed or len(parsed[host][2].names) > 1_000_000:
                    if len(parsed) >= 2000:
                        parsed.clear()
                    slots = Slots()
                    parsed[host] = load((own[i] if wrappers is None else wrappers.value.get(host)) or "[[], [], []]", slots), {}, slots
                wrapper, known, slots = parsed[host]
                found = blocks(source or "", slots)
                page = fold([s for s, _, _ in found])
                shape = tuple(x[:2] for x in page)
                if shape not in known:
                    if len(known) >= 1000:
                        known.clear()
                    leaves = places(wrapper, page)
                    known[shape] = leaves, *chosen(leaves, slots)
                out.append("\n".join(found[n][1] for n in main_blocks(found, page, *known[shape])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Blocks of the main text in page order, parted by a line feed; inside a block white space becomes one blank and
    character references are decoded; a line break element counts as white space. Null or empty html, and pages
    without main text, give the empty text. Null urls share a host. Repeated rows give repeated results. Pages are
    read whole, a page at a time, however long. Wrappers of ``most_bytes`` in all are broadcast, and pages stay where
    they are; more are joined by host and a salt, so that no host is one task. Ties of regions go to the first on the
    page. An empty table gives an empty table. Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = written(infer_wrappers(rows, "url", "html"), "wrappers")
    rows, out = rows.withColumn("host", host_of("url")), "page_id long, url string, text string, n_chars long"
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= most_bytes:
        return rows.mapInArrow(_extract(spark.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()})), out)
    salt, salts = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = rows.withColumn("salt", salt).join(found.withColumn("salt", salts), ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "host", "wrapper").mapInArrow(_extract(None), out)
