"""Main text of web pages by union-free regular expressions inferred per host.

A page is a balanced token stream: tags with what stands between them, and text. A
wrapper starts as one page and is aligned with one page of the same host after the
other. Where both differ it is made more general: runs of equal groups become a
repeated group, a group that only one side has becomes optional, texts that differ
become a text slot. No alternatives arise, so the wrapper stays union-free. The
region with most of the slots' text is the article; what menus, adverts and the
like hold never counts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Pages that meet in one wrapper: a busy host has as many groups as it needs.
GROUP_PAGES = 256
SHARE = 0.6
CLASSES = 1 << 16
# Elements nested deeper are taken as siblings, as browsers do; content lists above WIDE are aligned first come, first served.
DEPTH = 160
WIDE = 250_000

# Element names of the HTML standard by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDERS = set("ul ol dl table body article section div nav main aside td th select".split())
DROPPED = set("head script style noscript template nav header footer aside form button select textarea iframe svg object canvas audio video dialog menu title input".split())
DROPPED_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|footer|sidebar|aside|widget|ad|ads|advert|advertisement|advertising|banner|promo|promotion|sponsor|sponsored|notice|cookie|cookies|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|breadcrumb|breadcrumbs|pagination|pager|related|recommended|comment|comments|disqus|reply|replies|respond)(?:$|[\s_-]|s\b)",
    re.I,
)
ARTICLE_NAME = re.compile(r"(?:^|\s)(?:article|articlebody|main|content|post|entry|story|article-body|post-content|entry-content|main-content)(?:$|\s)", re.I)

RAW_END = "|".join(RAW)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW_END})(?=[\s/>])(?P<rawattr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</(?P<close>[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-z][^\s/>]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?P<end>>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
NAMES = re.compile(r"\b(class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass(slots=True)
class Group:
    """An element with its content: groups and texts in order."""

    tag: str
    name: str = ""
    content: list = field(default_factory=list)

    @property
    def dropped(self) -> bool:
        return self.tag in DROPPED or bool(self.name) and bool(DROPPED_NAME.search(self.name))


def parsed(source: str) -> Group:
    """Balanced token stream of a page. Unclosed tags end with what holds them, stray ends and cut tags are left out."""
    root = Group("html")
    stack = [root]
    for m in TOKEN.finditer(source):
        kind = m.lastgroup
        if kind == "text":
            if (top := stack[-1].content) and isinstance(top[-1], str):
                top[-1] += m["text"]
            else:
                top.append(m["text"])
        elif m["open"] is not None:
            if not m["end"]:
                continue
            tag, attr = m["open"].lower(), m["attr"]
            if tag == "html":
                continue
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[k].tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in HOLDERS:
                    break
            name = ""
            if len(attr) > 3:
                found = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(attr)}
                hidden = "hidden" in found or found.get("aria-hidden") == "true"
                name = "popup" if hidden else " ".join(v for k, v in found.items() if k != "aria-hidden")
            group = Group(tag, name)
            stack[-1].content.append(group)
            if tag not in VOID and not attr.endswith("/") and len(stack) < DEPTH:
                stack.append(group)
        elif m["close"] is not None:
            tag = m["close"].lower()
            if tag == "p" and all(g.tag != "p" for g in stack):
                stack[-1].content.append(Group("p"))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
    return root


@dataclass(slots=True)
class Part:
    """One place of a wrapper: a group (with the wrapper of its content) or a text; ``text`` None is a slot."""

    key: tuple
    text: str | None = None
    inner: list = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    chars: int = 0


def _key(x: Group | str) -> tuple:
    return ("#",) if isinstance(x, str) else (x.tag, x.name)


def _folded(content: list) -> list[tuple[tuple, list, bool]]:
    """Places of a content list, with runs of an equal group as one: (key, members, repeated)."""
    out: list[tuple[tuple, list, bool]] = []
    for x in content:
        if isinstance(x, str) and not x.strip():
            continue
        key = _key(x)
        if out and out[-1][0] == key:
            out[-1][1].append(x)
        else:
            out.append((key, [x], False))
    return [(k, members, len(members) > 1) for k, members, _ in out]


def _common(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of places in a longest common subsequence; equal starts and ends are taken at once."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < min(len(a), len(b)) - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lo : len(a) - tail], b[lo : len(b) - tail]
    middle = []
    if len(x) * len(y) > WIDE:
        places: dict[tuple, list[int]] = {}
        for j, k in enumerate(y):
            places.setdefault(k, []).append(j)
        j = 0
        for i, k in enumerate(x):
            at = places.get(k, [])
            n = bisect_left(at, j)
            if n < len(at):
                middle.append((lo + i, lo + at[n]))
                j = at[n] + 1
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                middle.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return [(k, k) for k in range(lo)] + middle + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _part(key: tuple, members: list, repeated: bool) -> Part:
    part = Part(key, repeated=repeated)
    if key == ("#",):
        part.text = " ".join("".join(members).split())
        part.chars = len(part.text)
    else:
        for m in members:
            part.inner = aligned(part.inner, m.content) if part.inner or m is not members[0] else wrapper_of(m.content)
    return part


def wrapper_of(content: list) -> list[Part]:
    return [_part(*place) for place in _folded(content)]


def aligned(wrapper: list[Part], content: list) -> list[Part]:
    """The wrapper made general enough for one more content list."""
    places = _folded(content)
    pairs = _common([p.key for p in wrapper], [p[0] for p in places])
    out, i, j = [], 0, 0
    for a, b in [*pairs, (len(wrapper), len(places))]:
        for part in wrapper[i:a]:
            part.optional = True
            out.append(part)
        for place in places[j:b]:
            part = _part(*place)
            part.optional = True
            out.append(part)
        i, j = a + 1, b + 1
        if a == len(wrapper):
            break
        part, (key, members, repeated) = wrapper[a], places[b]
        part.repeated |= repeated
        if key == ("#",):
            text = " ".join("".join(members).split())
            if part.text != text:
                part.text = None
            part.chars += len(text)
        else:
            for m in members:
                part.inner = aligned(part.inner, m.content)
        out.append(part)
    return out


def expression(wrapper: list[Part]) -> str:
    """The wrapper written as a regular expression; a text slot is ``#``."""
    out = []
    for p in wrapper:
        text = ("#" if p.text is None else p.text) if p.key == ("#",) else f"<{p.key[0]}>{expression(p.inner)}</{p.key[0]}>"
        mark = {(True, True): "*", (False, True): "+", (True, False): "?", (False, False): ""}[p.optional, p.repeated]
        out.append(f"({text}){mark}" if mark else text)
    return "".join(out)


def _is_dropped(key: tuple) -> bool:
    return key != ("#",) and (key[0] in DROPPED or bool(key[1]) and bool(DROPPED_NAME.search(key[1])))


def _weight(part: Part, slots: bool) -> int:
    """Characters of slots (or of all text) under a place, without what never counts."""
    if part.key == ("#",):
        return part.chars if part.text is None or not slots else 0
    return 0 if _is_dropped(part.key) else sum(_weight(p, slots) for p in part.inner)


def main_path(wrapper: list[Part]) -> list[tuple]:
    """Keys from the top to the region of the article.

    A place that names itself as the article wins, the one with most text of several.
    Else the way leads down as long as one place holds most of the slots' text.
    """
    slots = any(_weight(p, True) for p in wrapper)
    named: list[tuple[int, list[tuple]]] = []

    def look(parts: list[Part], path: list[tuple]) -> None:
        for p in parts:
            if p.key == ("#",) or _is_dropped(p.key):
                continue
            if p.key[0] in ("article", "main") or ARTICLE_NAME.search(p.key[1]):
                named.append((_weight(p, False), [*path, p.key]))
            look(p.inner, [*path, p.key])

    look(wrapper, [])
    articles = [x for x in named if x[1][-1][0] == "article"] or named
    if articles and max(articles)[0]:
        return max(articles, key=lambda x: (x[0], len(x[1])))[1]
    path, parts = [], wrapper
    while True:
        total = sum(_weight(p, slots) for p in parts)
        best = max(parts, key=lambda p: _weight(p, slots), default=None)
        if best is None or best.key == ("#",) or best.repeated or best.key[0] in ("p", "pre", "h1") or not total or _weight(best, slots) < SHARE * total:
            return path
        path.append(best.key)
        parts = best.inner


def _regions(group: Group, path: list[tuple]) -> list[Group]:
    found = [group]
    for key in path:
        found = [x for g in found for x in g.content if isinstance(x, Group) and _key(x) == key]
    return found


def _blocks(group: Group, out: list[list[str]]) -> None:
    """Gather texts; a block element starts a new block before and after itself."""
    for x in group.content:
        if isinstance(x, str):
            out[-1].append(x)
        elif not x.dropped:
            if x.tag in BLOCKS:
                out.append([])
                _blocks(x, out)
                out.append([])
            else:
                _blocks(x, out)


def text_of(page: Group, path: list[tuple]) -> str:
    """Blocks of the page's article, joined by a line break; where the page lacks the path, its own best region is taken."""
    regions = _regions(page, path) if path else [page]
    if not regions:
        own = main_path(wrapper_of(page.content))
        regions = _regions(page, own) if own else [page]
    out: list[list[str]] = [[]]
    for region in regions:
        _blocks(region, out)
        out.append([])
    texts = [" ".join(html.unescape("".join(b)).split()) for b in out if b]
    return "\n".join([t for t in texts if t])


def extracted(sources: list[str]) -> list[str]:
    """Main texts of pages of one host; the wrapper is inferred from all of them."""
    pages = [parsed(s) for s in sources]
    wrapper: list[Part] = []
    for n, page in enumerate(pages):
        wrapper = aligned(wrapper, page.content) if n else wrapper_of(page.content)
    path = main_path(wrapper)
    return [text_of(p, path) for p in pages]


def host_of(url):
    """Host of a URL in lower case; null and texts without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every row.

    Pages of a host meet in groups of about ``GROUP_PAGES``, dealt by key and
    address, so a host with a third of all pages is many groups. How many is told by
    the size of the host's class, a table of at most ``CLASSES`` rows. Null html gives an
    empty text. Repeated rows are extracted each; other columns are not read.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.col(url)).alias("host"))
    kind = rows.schema["k"].dataType.simpleString()
    rows = rows.withColumn("class", F.pmod(F.xxhash64("host"), F.lit(CLASSES)))
    sizes = rows.groupBy("class").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_PAGES)
    deal = rows.join(F.broadcast(sizes), "class", "left").withColumn("part", F.pmod(F.xxhash64("k", "url"), F.ceil(F.coalesce("n", F.lit(1)) / GROUP_PAGES)).cast("int"))

    def extract(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("url", "ascending"), ("html", "ascending")])
        texts = extracted([h or "" for h in table["html"].to_pylist()])
        return pa.table({"k": table["k"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    out = deal.select("host", "part", "k", "url", "html").groupBy("host", "part").applyInArrow(extract, f"k {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("k", key)
