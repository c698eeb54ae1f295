"""Main text of web pages by union-free regular expressions of their hosts.

Every page is an ordered tree of block elements. All pages of a host are aligned into one wrapper:
sibling elements that only some pages have become optional, runs of equal groups of siblings become
one repeated group, and texts that differ between pages become slots. The wrapper says how much
varying text each of its elements holds on average. From the root, a page's main container is
reached by going to the element with most of the varying text; of the container, a page gives its
blocks but those that the wrapper shows to be template text or lists of links.

Pages of equal structure are merged in their tasks, then structures in the order of their hashes, so
the wrapper of a host does not depend on how its pages are dealt, and only counts are shuffled.

Defined cases: a null or empty html gives the empty text; a very long page is read whole; a null url
or one without a host shares the wrapper of pages without a host; where a host has one page, or no
text of it varies, all text counts as varying; parts of a page that no other has count by their own
wrapper; repeated rows are extracted alike and count as pages; an empty table gives an empty result.
Only url and html are read and the id is passed on, whatever other columns there are.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import pickle
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Longest repeated group, in siblings.
GROUP = 8
#: Share of a container's varying text that an element must hold to be gone into.
SHARE = 0.7
#: Pages by which text that never varies is known to be the host's, and share of link text in a list of links.
SEEN, LINKS = 3, 0.8
#: Elements that a page's tree is deep.
NESTED = 150
#: Groups of structures of a host that are merged apart, and structures that a task keeps at a time.
PARTS, KEPT = 16, 2000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
HEADING = frozenset("h1 h2 h3".split())
#: Elements that never hold article text.
DROPPED = RAW | frozenset("head nav footer header aside form button select input label svg canvas object audio video menu dialog fieldset search map math".split())
#: Words in class, id or role by which a smaller part of a container is taken to be no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner menu menubar nav navbar navigation breadcrumb breadcrumbs"
    " header masthead footer sidebar side aside rail widget notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login"
    " form search share sharing social comment comments reply replies respond disqus discussion related recommended pagination pager toolbar complementary"
    " contentinfo skip subscription paywall".split()
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: What an end tag of an element inside of a line can't reach across.
_STOPS = BLOCK - {"p"}
_CLOSES_P = BLOCK - {"body", "html", "caption", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Scanner:
    """Finds where tags end, in one pass over a page however broken it is: what is known not to come
    any more isn't looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.open_quotes: set[int] = set()  # quotes from which no tag end is reached

    def end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`: the first outside of quotes, or if
        there is none the first of all; -1 if there is none."""
        if self.last[">"] < at:
            return -1
        i, seen = at, []
        while (m := _SPECIAL.search(self.page, i)) is not None:
            q, c = m.start(), m[0]
            if c == ">":
                return q
            seen.append(q)
            if q in self.open_quotes or self.last[c] <= q:
                break
            i = self.page.find(c, q + 1) + 1
        self.open_quotes.update(seen)
        return self.page.find(">", at)


def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


_RAW_ENDS = {tag: _raw_end(tag) for tag in RAW}


def tokens(page: str):
    """('text', words), ('open', tag, attributes) and ('close', tag) in page order; comments,
    declarations and the contents of raw elements are left out."""
    at, n, scan = 0, len(page), _Scanner(page)
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield "text", page[at:end], ""
            at = end
        elif page.startswith(("<!", "<?"), at):
            close = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(close, at + {"-->": 4, "]]>": 9}.get(close, 2))
            at = n if end < 0 else end + len(close)
        elif (m := _NAME.match(page, at)) is None or (end := scan.end(m.end())) < 0:
            yield "text", "<", ""
            at += 1
        else:
            tag, closing = m[1].lower(), page[at + 1] == "/"
            rest = page[m.end() : end]
            at = end + 1
            if closing:
                yield "close", tag, ""
                continue
            yield "open", tag, rest.removesuffix("/")
            if tag in RAW:
                found = _RAW_ENDS[tag].search(page, at)
                at = found.start() if found else n


@functools.lru_cache(20_000)
def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Of an element: its key in a wrapper (tag, classes and id without numbers), whether it never
    holds article text, and whether it is named like a part that is none."""
    a = {k.lower(): next((x for x in v if x), "") for k, *v in _ATTR.findall(attributes)} if attributes else {}
    said = f"{a.get('class', '')} {a.get('id', '')}".lower()
    key = ".".join([tag, *sorted(set(re.findall(r"[a-z_-]+", said)))])
    never = tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true"
    words = re.split(r"[^a-z]+", f"{said} {a.get('role', '')}".lower())
    return key, never, tag not in ("html", "body", "main", "article") and any(w in MARKS for w in words)


class Element:
    """A block element of a page; items are its texts (text, in a link) and elements in page order."""

    __slots__ = ("depth", "items", "key", "marked", "never", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.items, self.depth = tag, [], 0
        self.key, self.never, self.marked = _named(tag, attributes)

    def elements(self) -> list[Element]:
        return [x for x in self.items if x.__class__ is Element]


def parse(page: str) -> Element:
    """The tree of a page, with the ends that HTML leaves out. Elements inside of a line only matter
    where they are links or never hold article text; what is nested deeper than NESTED elements stands
    in the innermost of those, block after block."""
    root = Element("")
    open_: list[tuple[str, Element]] = [("", root)]  # tag, the element that takes what comes next
    places: dict[str, list[int]] = {}  # of each tag, where it is open

    def push(tag: str, into: Element) -> None:
        places.setdefault(tag, []).append(len(open_))
        open_.append((tag, into))

    def pop(tags, stop) -> None:
        """Close the innermost of tags and all inside of it, if no tag of stop is open inside of it."""
        i = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if i and (i == len(open_) - 1 or all(places[t][-1] <= i for t in stop if places.get(t))):
            for t, _ in open_[i:]:
                places[t].pop()
            del open_[i:]

    links = 0
    for kind, x, rest in tokens(page):
        if kind == "text":
            open_[-1][1].items.append((x, links > 0))
        elif kind == "open":
            if x in _CLOSES_P and places.get("p"):
                pop(("p",), _STOPS)
            if x in _SIBLINGS:
                pop(*_SIBLINGS[x])
            into = open_[-1][1]
            if x in BLOCK or x in DROPPED or "hidden" in rest:
                e = Element(x, rest)
                if x in BLOCK or e.never:
                    e.depth = into.depth + 1
                    into.items.append(e)
                    if e.never or e.depth < NESTED:
                        into = e
            elif x == "br":
                into.items.append((" ", False))
            if x not in VOID:
                push(x, into)
            if x == "a":
                links = 1
        else:
            if x == "a":
                links = 0
            if x not in VOID and places.get(x):
                pop((x,), () if x in BLOCK or x in DROPPED else _STOPS)
                if links and not places.get("a"):
                    links = 0
    return root


# --- wrappers


class Part:
    """An element of a wrapper: on how many pages it is, characters of its own texts outside and
    inside of links, the hash of its own texts while it is the same on all pages (None: a slot),
    whether it is optional or repeated, and the parts inside of it."""

    __slots__ = ("inner", "key", "link", "optional", "pages", "repeated", "same", "size")

    def __init__(self, key, pages=1, size=0, link=0, same=0, optional=False, repeated=False, inner=()):
        self.key, self.pages, self.size, self.link, self.same = key, pages, size, link, same
        self.optional, self.repeated, self.inner = optional, repeated, list(inner)

    def state(self):
        return self.key, self.pages, self.size, self.link, self.same, self.optional, self.repeated, [x.state() for x in self.inner]

    @staticmethod
    def of(state) -> Part:
        return Part(*state[:-1], [Part.of(x) for x in state[-1]])


def part(e: Element) -> Part:
    """The wrapper of one element of one page."""
    size = link = same = 0
    for x in e.items:
        if x.__class__ is tuple and (said := " ".join(x[0].split())):
            same = xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass"), same)
            if x[1]:
                link += len(said)
            else:
                size += len(said)
    return Part(e.key, 1, size, link, same, inner=fold([part(x) for x in e.elements() if not x.never], together))


def together(a: Part, b: Part) -> Part:
    """Two occurrences of a repeated part on one page."""
    same = None if a.same is None or b.same is None else xxhash.xxh64_intdigest(b.same.to_bytes(8, "little"), a.same)
    return Part(a.key, max(a.pages, b.pages), a.size + b.size, a.link + b.link, same, a.optional or b.optional, True, _aligned(a.inner, b.inner, together))


def align(a: Part, b: Part) -> Part:
    """The part that matches both, of different pages."""
    same = a.same if a.same == b.same else None
    return Part(a.key, a.pages + b.pages, a.size + b.size, a.link + b.link, same, a.optional or b.optional, a.repeated or b.repeated, _aligned(a.inner, b.inner, align))


def fold(parts: list[Part], join) -> list[Part]:
    """Runs of an equal group of siblings become one group, joined place by place."""
    for g in range(1, GROUP + 1):
        if len(parts) < 2 * g:
            break
        keys, out, i = [x.key for x in parts], [], 0
        while i < len(parts):
            n = 1
            while keys[i + n * g : i + (n + 1) * g] == keys[i : i + g] and i + (n + 1) * g <= len(keys):
                n += 1
            group = parts[i : i + g] if n > 1 else parts[i : i + 1]
            for k in range(1, n):
                group = [join(x, y) for x, y in zip(group, parts[i + k * g : i + (k + 1) * g], strict=True)]
            if n > 1:
                for x in group:
                    x.repeated = True
            out += group
            i += n * g if n > 1 else 1
        parts = out
    return parts


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the first in order. A row of the table is one number whose
    bits say where the length grows, so that long lists of siblings take little time and memory."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    out = [(k, k) for k in range(low)]
    a, b = a[low:], b[low:]
    if not a or not b:
        return out
    # bit j of a key's number: the j-th of b, from the end, is that key
    m, of = len(b), {}
    for j, x in enumerate(reversed(b)):
        of[x] = of.get(x, 0) | (1 << j)
    full, row = (1 << m) - 1, (1 << m) - 1
    rows = [0]  # of the suffix a[i:]: where the length grows, from the end of a on
    for x in reversed(a):
        hit = row & of.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row ^ full)
    rows.reverse()
    grown = lambda i, j: (rows[i] & ((1 << (m - j)) - 1)).bit_count()  # noqa: E731  (length for a[i:], b[j:])
    i = j = 0
    while i < len(a) and j < m:
        if a[i] == b[j]:
            out.append((low + i, low + j))
            i, j = i + 1, j + 1
        elif (best := grown(i, j)) == 0:
            break
        elif grown(i + 1, j) == best:
            i += 1
        else:
            j += 1
    return out


def _aligned(a: list[Part], b: list[Part], join) -> list[Part]:
    """Siblings of both: matched ones joined, the others optional, in order."""
    if [x.key for x in a] == [x.key for x in b]:
        return [join(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for m, n in [*matches([x.key for x in a], [x.key for x in b]), (len(a), len(b))]:
        for x in [*a[i:m], *b[j:n]]:
            x.optional = True
            out.append(x)
        if m < len(a):
            out.append(join(a[m], b[n]))
        i, j = m + 1, n + 1
    return fold(out, join)


def infer(pages: list[str]) -> Part:
    """The wrapper of some pages of one host, in this order."""
    return functools.reduce(align, (part(parse(x)) for x in pages))


def expression(p: Part) -> str:
    """A wrapper as a regular expression over tokens: # is a slot, ? optional, + repeated."""
    own = "#" if p.same is None else "text" if p.same else ""
    body = f"<{p.key}>{own}{''.join(map(expression, p.inner))}</>"
    return f"({body}){'+' if p.repeated else ''}{'?' if p.optional else ''}" if p.repeated or p.optional else body


# --- extraction


def _weights(w: Part, every: bool, out: dict[int, tuple[float, float]]) -> tuple[float, float]:
    """Of each part: varying characters outside of links and all characters in links, a page."""
    slot = w.size / w.pages if every or w.same is None else 0.0
    link = w.link / w.pages
    for x in w.inner:
        a, b = _weights(x, every, out)
        often = x.pages / w.pages
        slot, link = slot + a * often, link + b * often
    out[id(w)] = slot, link
    return slot, link


class Reader:
    """Main texts of the pages of one host."""

    def __init__(self, wrapper: Part):
        self.wrapper, self.weight, self.places = wrapper, {}, {}
        if not _weights(wrapper, wrapper.pages == 1, self.weight)[0]:
            _weights(wrapper, True, self.weight)
        self.known = wrapper.pages >= SEEN

    def _of(self, e: Element, w: Part | None) -> list[tuple[Element, Part | None]]:
        """The elements of an element, each with its part of the wrapper: the next of its key, else the
        first."""
        if w is None:
            return [(x, None) for x in e.elements()]
        places = self.places.get(id(w))
        if places is None:
            places = self.places[id(w)] = {}
            for k, x in enumerate(w.inner):
                places.setdefault(x.key, []).append(k)
        at, out = 0, []
        for x in e.elements():
            known = places.get(x.key)
            if known is None:
                out.append((x, None))
                continue
            k = bisect.bisect_left(known, at)
            at = known[k] if k < len(known) else known[0]
            out.append((x, w.inner[at]))
        return out

    def _varying(self, e: Element, w: Part | None) -> float:
        return 0.0 if e.never or w is None else self.weight[id(w)][0]

    def container(self, root: Element) -> tuple[Element, Part | None]:
        """Down from the root, while one element holds most of the varying text. Elements named like
        boilerplate weigh nothing while others have text; a title stays with its text."""
        e, w = root, self.wrapper
        while True:
            inner = [(x, p, self._varying(x, p)) for x, p in self._of(e, w)]
            if any(v and not x.marked for x, _, v in inner):
                inner = [(x, p, 0.0 if x.marked else v) for x, p, v in inner]
            best = max(inner, key=lambda y: y[2], default=None)
            own = w.size / w.pages if w is not None and w.same is None else 0.0
            if best is None or not best[2] or best[2] < SHARE * (own + sum(v for *_, v in inner)):
                return e, w
            if best[1].repeated or not best[0].elements() or any(v and x.tag in HEADING for x, _, v in inner):
                return e, w
            e, w = best[0], best[1]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        e, w = self.container(parse(page))
        blocks: list[str] = []
        line: list[str] = []

        def end() -> None:
            said = " ".join(entities.unescape("".join(line)).split())
            if said:
                blocks.append(said)
            line.clear()

        whole = self.weight[id(w)][0] if w is not None else 0.0

        def walk(e: Element, w: Part | None) -> None:
            inside = iter(self._of(e, w))
            for x in e.items:
                if x.__class__ is tuple:
                    line.append(x[0])
                    continue
                x, p = next(inside)
                end_of_line = x.tag in BLOCK
                if end_of_line:
                    end()
                if not self._left_out(x, p, whole):
                    walk(x, p)
                    if end_of_line:
                        end()

        walk(e, w)
        end()
        return "\n".join(blocks)

    def _left_out(self, e: Element, w: Part | None, whole: float) -> bool:
        if e.never:
            return True
        slot, link = self.weight[id(w)] if w is not None else (0.0, 0.0)
        if e.marked and 2 * slot < whole or e.marked and w is None:
            return True
        if w is None or not self.known:
            return False
        if not slot and w.pages >= SEEN and not link:
            return _has_text(w)  # the same on all pages that have it
        return link > 0 and link >= LINKS * (slot + link) and any(x.repeated for x in w.inner)


def _has_text(w: Part) -> bool:
    return bool(w.size) or any(map(_has_text, w.inner))


def main_text(page: str | None, wrapper: Part | None = None) -> str:
    """The main text of a page under its host's wrapper, its own if there is none."""
    return Reader(wrapper or part(parse(page))).text(page) if page else ""


# --- on Spark


def hosts(url_col: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_SCHEMA = "host string, structure long, wrapper binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["host", "structure", "wrapper"])


def _structure(p: Part) -> int:
    def said(x: Part) -> str:
        return f"{x.key}{'+' if x.repeated else ''}{'?' if x.optional else ''}({' '.join(map(said, x.inner))})"

    return xxhash.xxh64_intdigest(said(p).encode("utf-8", "surrogatepass")) >> 1


def _of_pages(batches):
    """host, structure, wrapper: pages of one host and structure joined in the task."""
    kept: dict[tuple[str, int], Part] = {}

    def out():
        return _rows([(h, s, pickle.dumps(w.state(), 5)) for (h, s), w in kept.items()])

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = part(parse(page))
            key = host, _structure(w)
            kept[key] = align(kept[key], w) if key in kept else w
            if len(kept) >= KEPT:
                yield out()
                kept.clear()
    yield out()


def _merged(batches):
    """The wrappers of consecutive rows of one host (and part) aligned in their order."""
    now, wrapper, part_ = None, None, 0
    for b in batches:
        done = []
        for host, s, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            own = Part.of(pickle.loads(blob))
            if (host, s % PARTS) == now:
                wrapper = align(wrapper, own)
            else:
                if now is not None:
                    done.append((now[0], part_, pickle.dumps(wrapper.state(), 5)))
                now, wrapper, part_ = (host, s % PARTS), own, s % PARTS
        yield _rows(done)
    if now is not None:
        yield _rows([(now[0], part_, pickle.dumps(wrapper.state(), 5))])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper: a row for each host, from all of its pages."""
    ship(pages.sparkSession)
    p = pages.select(hosts(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).where("html is not null and html <> ''")
    own = p.mapInArrow(_of_pages, _SCHEMA)
    part_ = F.col("structure") % PARTS
    own = own.repartition("host", part_).sortWithinPartitions("host", part_, "structure").mapInArrow(_merged, _SCHEMA)
    own = own.repartition("host").sortWithinPartitions("host", "structure")
    own = own.select("host", (F.col("structure") * 0).alias("structure"), "wrapper").mapInArrow(_merged, _SCHEMA)
    return own.select("host", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    own = cut(wrappers(pages, url_col, html_col), "wrappers").withColumnRenamed("host", "h")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), hosts(url_col).alias("host"))

    def run(batches):
        readers: dict[bytes, Reader] = {}
        for b in batches:
            texts = []
            for page, blob in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if blob not in readers:
                    if len(readers) > 1000:
                        readers.clear()
                    readers[blob] = Reader(Part.of(pickle.loads(blob))) if blob else None
                texts.append(readers[blob].text(page) if page else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = p.join(own, p.host == own.h, "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
