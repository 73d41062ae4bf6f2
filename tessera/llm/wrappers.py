"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of block tags and text runs (a run is the text of a block
between two block tags, inline mark-up included). The streams of a host are aligned one
by one with its wrapper, which begins as the first page:

* runs that differ become a slot, runs that agree everywhere stay template text;
* tags that only one side has become optional groups, found by the longest common order;
* tags that follow each other in equal blocks, of up to ``PERIOD`` elements, become one
  repeated group, whose occurrences are aligned with each other.

Wrappers are inferred within tasks and merged in two rounds, the first of which deals a host's
wrappers out, so that a host with very many pages isn't one task's work. From its
wrapper a host gets a decision (``decide``): where its main text lies, which groups are
menus (mostly links), and which runs inside are template text. Each page is then read along
it; a page on which the decision finds nothing is read by a wrapper of its own.

Elements that say by tag, role, class or id that they are menus, headers, footers, sidebars,
notices, adverts, forms or comments are tokens without content.

Defined results for odd input: null or empty html, or a page without main text, gives '' and 0;
a url that is null or without host gives a page that is read by its own wrapper; repeated
rows give repeated rows; unclosed, crossed and unknown tags are read as browsers do, nearly;
a very long page is read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .skew import join_groups

# Tags by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table div section article main aside nav header footer form blockquote body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li td th dt dd pre blockquote figure figcaption caption tr ul ol dl table header".split())
# Tags and words in class, id, role and label that mark what isn't main text.
NOISE_TAGS = frozenset("head script style nav header footer aside form button select textarea template noscript iframe svg dialog menu object canvas audio video title".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner menu menus nav navi navigation navbar breadcrumb breadcrumbs sidebar sidebars footer footers header headers masthead topbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup paywall share sharing social comment comments commentlist discussion replies reply respond disqus "
    "related recommended recommendations widget widgets toolbar pagination pager login search complementary contentinfo toc hidden skip".split()
)
TITLE_WORDS = frozenset(("header", "headers"))
STATE = re.compile(r"(has|with|without|no|is|not)[-_]|.*[-_](open|closed|enabled|disabled)$", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^"'>]|"[^"]*"|'[^']*')*>|[^<]+|<""", re.S)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PERIOD, SUPPORT, MOST_ITEMS = 4, 8, 256
MENU_LINKS, TEMPLATE_CHARS, MAIN_SHARE = 0.5, 200, 0.7
SALTS, HELD_HOSTS = 256, 512


@dataclass(slots=True)
class Run:
    """Text between two block tags."""

    text: str
    links: int


@dataclass(slots=True)
class Element:
    key: str
    tag: str
    noise: bool
    children: list = field(default_factory=list)


def _noise(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in NOISE_TAGS:
        return not (tag == "header" and inside_article)  # an article's own header has its title
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if tag in ("body", "html", "main", "article") and not any(w in ("comment", "comments", "ad", "advert") for w in WORD.findall(attributes.get("class", "").lower())):
        return False
    names = [n for n in attributes.get("class", "").split() if not STATE.match(n)]
    words = {w.lower() for w in WORD.findall(" ".join([*names, *(attributes.get(a, "") for a in ("id", "role", "aria-label"))]))}
    return bool(words & NOISE_WORDS - (TITLE_WORDS if inside_article else set()))


def parse(html: str) -> Element:
    """The block elements of a page, with their text runs."""
    root = Element("html", "html", False)
    stack: list[Element] = [root]
    parts: list[str] = []
    links = depth_a = 0
    articles = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                stack[-1].children.append(Run(text, min(links, len(text))))
            parts.clear()
        links = 0

    def pop() -> None:
        nonlocal articles
        articles -= stack.pop().tag in ("article", "main")

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.match(html, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            parts.append(token)
            links += len(token) if depth_a else 0
            continue
        found = TAG.match(token)
        if not found:
            continue  # comments, doctype
        tag = found[1].lower()
        closing = token[1] == "/"
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if closing else 1
            elif tag in ("br", "wbr", "img") and not closing:
                parts.append(" ")
            elif not closing and tag in ("span", "label", "small") and _noise(tag, _attributes(token), articles > 0):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)  # an inline advert or label
                at = end.end() if end else at
            continue
        if tag in RAW and not closing:  # not part of a text, and no end of one
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth].tag in SCOPES and tag not in SCOPES:
                    break
            depth_a = 0
            continue
        depth_a = 0
        closes = CLOSES.get(tag, CLOSED_BY_BLOCKS)
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in closes:
                while len(stack) > depth:
                    pop()
                if closes is not CLOSED_BY_BLOCKS:
                    continue
                break
            if stack[depth].tag in SCOPES and stack[depth].tag not in closes:
                break
        attributes = _attributes(token) if len(token) > len(tag) + 2 else {}
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        names = re.sub(r"\d+", "0", ".".join(sorted(attributes.get("class", "").lower().split())))
        one = Element(f"{tag}.{names}" if names else tag, tag, _noise(tag, attributes, articles > 0))
        stack[-1].children.append(one)
        if tag not in VOID and not token.endswith("/>"):
            stack.append(one)
            articles += tag in ("article", "main")
    flush()
    return root


def _attributes(token: str) -> dict[str, str]:
    out = {name.lower(): value.strip("\"'") for name, value in ATTRIBUTE.findall(token)}
    if re.search(r"\shidden(?=[\s/>])", token):
        out["hidden"] = ""
    return out


# Wrappers


@dataclass(slots=True)
class Item:
    """A part of a wrapper: an element, a group of elements, or a run of text.

    ``items`` is None for text. ``text`` is what a run says on all pages, None for a slot.
    ``pages`` counts the pages that have it, ``seen`` holds hashes of the longest runs
    of some of these pages, which tells different pages from copies.
    """

    key: str
    items: list | None
    pages: int = 1
    repeated: bool = False
    text: str | None = None
    chars: int = 0
    links: int = 0
    seen: list = field(default_factory=list)

    def plain(self) -> list:
        return [self.key, [i.plain() for i in self.items] if self.items is not None else None, self.pages, self.repeated, self.text, self.chars, self.links, self.seen]

    @staticmethod
    def of(x: list) -> Item:
        return Item(x[0], [Item.of(i) for i in x[1]] if x[1] is not None else None, *x[2:])


def _runs(e: Element) -> Iterator[Run]:
    for c in e.children:
        if isinstance(c, Run):
            yield c
        elif not c.noise:
            yield from _runs(c)


def wrapper_of(root: Element) -> Item:
    """The wrapper of one page."""
    longest = max((r.text for r in _runs(root)), key=len, default="")
    mark = xxhash.xxh32_intdigest(longest.encode())

    def item(node: Run | Element) -> Item:
        if isinstance(node, Run):
            return Item("#", None, text=node.text, chars=len(node.text), links=node.links, seen=[mark])
        return Item(node.key + ("!" if node.noise else ""), [] if node.noise else folded([item(c) for c in node.children]), seen=[mark])

    return item(root)


def _joined(a: Item, b: Item, same_page: bool) -> Item:
    """Two parts with one key as one."""
    items = a.items if a.items is None else aligned(a.items, b.items, same_page)
    seen = sorted({*a.seen, *b.seen})[:SUPPORT]
    return Item(a.key, items, max(a.pages, b.pages) if same_page else a.pages + b.pages, a.repeated or b.repeated, a.text if a.text == b.text else None, a.chars + b.chars, a.links + b.links, seen)


def folded(items: list[Item]) -> list[Item]:
    """Equal neighbours, and equal blocks of neighbours, as repeated groups."""
    out: list[Item] = []
    for i in items:
        if out and out[-1].key == i.key:
            out[-1] = _joined(out[-1], i, True)
            out[-1].repeated = True
        else:
            out.append(i)
    for n in range(2, PERIOD + 1):
        at = 0
        while at + 2 * n <= len(out):
            keys = [i.key for i in out[at : at + n]]
            end = at + n
            group = None
            while end + n <= len(out) and [i.key for i in out[end : end + n]] == keys:
                block = out[end : end + n]
                group = [_joined(x, y, True) for x, y in zip(group or out[at : at + n], block, strict=True)]
                end += n
            if group:
                out[at:end] = [Item(f"({' '.join(keys)})", group, max(i.pages for i in group), True, seen=group[0].seen)]
            at += 1
    return out


def aligned(a: list[Item], b: list[Item], same_page: bool = False) -> list[Item]:
    """Two sequences as one: what both have in the same order is joined, the rest is optional."""
    x, y = [i.key for i in a], [i.key for i in b]
    if x == y:
        return [_joined(i, j, same_page) for i, j in zip(a, b, strict=True)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out: list[Item] = []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(_joined(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    out = folded([*out, *a[i:], *b[j:]])
    if len(out) > MOST_ITEMS:  # no order to be found: one repeated group for each key, at the first place of the key
        once: dict[str, Item] = {}
        for i in out:
            if i.key in once:
                i = _joined(once[i.key], i, True)
                i.repeated = True
            once[i.key] = i
        out = list(once.values())
    return out


def merged(a: Item, b: Item) -> Item:
    """The wrapper of the pages of two wrappers."""
    return _joined(a, b, False)


def expression(item: Item, pages: int | None = None) -> str:
    """A wrapper as a union-free regular expression: ``#`` is a slot, quoted text a template's."""
    if item.items is None:
        out = "#" if item.text is None else f'"{item.text}"'
    elif item.key.startswith("("):
        out = "".join(expression(i, item.pages) for i in item.items)
    else:
        out = f"<{item.key}>{''.join(expression(i, item.pages) for i in item.items)}</{item.key}>"
    optional = pages is not None and item.pages < pages
    return f"({out}){'*' if item.repeated and optional else '+' if item.repeated else '?'}" if item.repeated or optional else out


# Decisions


def _elements(items: list[Item]) -> Iterator[Item]:
    """The elements of a sequence, groups opened."""
    for i in items:
        if i.items is not None:
            if i.key.startswith("("):
                yield from _elements(i.items)
            else:
                yield i


def _texts(items: list[Item]) -> Iterator[Item]:
    for i in items:
        if i.items is None:
            yield i
        elif i.key.startswith("("):
            yield from _texts(i.items)


def _template(text: Item, key: str) -> bool:
    return text.text is not None and len(text.text) <= TEMPLATE_CHARS and len(text.seen) >= SUPPORT and key.split(".")[0] not in HEADINGS


def _sums(item: Item) -> tuple[int, int]:
    """(characters, of these in links) below an element."""
    chars, links = sum(t.chars for t in _texts(item.items)), sum(t.links for t in _texts(item.items))
    for e in _elements(item.items):
        c, l = _sums(e)  # noqa: E741
        chars, links = chars + c, links + l
    return chars, links


def _content(item: Item) -> int:
    own = sum(t.chars - t.links for t in _texts(item.items) if not _template(t, item.key))
    chars, links = _sums(item)
    return 0 if chars and links > MENU_LINKS * chars else own + sum(_content(e) for e in _elements(item.items))


def decide(wrapper: Item) -> dict:
    """What a wrapper says of its pages: the path to the main text, the menus and the template texts inside."""
    path, node = [], wrapper
    while True:
        below = [(e, _content(e)) for e in _elements(node.items) if e.key.split(".")[0] not in LEAVES]
        all_of_it = _content(node)
        named = [(e, c) for e, c in below if c and e.key.split(".")[0] in ("article", "main")]
        best, content = max(named or below, key=lambda x: x[1], default=(None, 0))
        if not content or not named and content < MAIN_SHARE * all_of_it:
            break
        path.append(best.key)
        node = best
        if best.key.split(".")[0] == "article":
            break
    menus, template = [], []

    def look(item: Item, at: tuple[str, ...]) -> None:
        for t in _texts(item.items):
            if _template(t, item.key):
                template.append(_mark(at, t.text))
        for e in _elements(item.items):
            chars, links = _sums(e)
            here = (*at, e.key)
            if chars and links > MENU_LINKS * chars:
                menus.append(_mark(here, ""))
            else:
                look(e, here)

    look(node, ())
    return {"path": path, "menus": menus, "template": template}


def _mark(path: tuple[str, ...], text: str) -> int:
    return xxhash.xxh64_intdigest("\0".join((*path, "", text)).encode()) >> 1


def blocks_by(root: Element, decision: dict) -> list[str]:
    """The main text's blocks of a page, in page order."""
    found = [root]
    for key in decision["path"]:
        found = [c for e in found for c in e.children if isinstance(c, Element) and c.key == key and not c.noise]
    menus, template = set(decision["menus"]), set(decision["template"])
    out: list[str] = []

    def look(e: Element, at: tuple[str, ...]) -> None:
        for c in e.children:
            if isinstance(c, Run):
                if not template or _mark(at, c.text) not in template:
                    out.append(c.text)
            elif not c.noise:
                here = (*at, c.key)
                if not menus or _mark(here, "") not in menus:
                    look(c, here)

    for e in found:
        look(e, ())
    return out


def main_text(html: str, decision: dict | None) -> str:
    root = parse(html)
    found = blocks_by(root, decision) if decision else []
    return "\n".join(found or blocks_by(root, decide(wrapper_of(root))))


# Tables


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper as JSON) of ``pages`` (url, html)."""
    schema = pa.schema([("host", pa.string()), ("salt", pa.int64()), ("pages", pa.int64()), ("wrapper", pa.string())])

    def out(held: dict[str, Item], salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int64()), pa.array([w.pages for w in held.values()], pa.int64()), pa.array([json.dumps(w.plain()) for w in held.values()], pa.string())], schema=schema)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, Item] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = wrapper_of(parse(html.as_py()))
                held[host] = merged(held[host], one) if host in held else one
                if len(held) >= HELD_HOSTS:
                    yield out(held, salt)
                    held = {}
        if held:
            yield out(held, salt)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial wrappers of a group, one at a time."""
        whole, key = None, None
        for batch in batches:
            for host, salt, text in zip(batch.column("host").to_pylist(), batch.column("salt").to_pylist(), batch.column("wrapper"), strict=True):
                key = host, salt
                one = Item.of(json.loads(text.as_py()))
                whole = one if whole is None else merged(whole, one)
        yield out({key[0]: whole}, key[1])

    kind = "host string, salt long, pages long, wrapper string"
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null")
    partial = rows.mapInArrow(in_task, kind)
    dealt = partial.groupBy("host", "salt").applyInArrow(together, kind)
    return dealt.groupBy("host").applyInArrow(together, kind).select("host", "pages", "wrapper")


def host_decisions(wrappers: DataFrame) -> DataFrame:
    """(host, copies, decision as JSON)."""
    schema = pa.schema([("host", pa.string()), ("copies", pa.int64()), ("decision", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(decide(Item.of(json.loads(w.as_py())))) for w in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], schema=schema)

    return wrappers.mapInArrow(run, "host string, copies long, decision string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    decisions = materialise(host_decisions(infer_wrappers(pages)), "host-decisions")
    total = decisions.agg(F.sum("copies")).first()[0] or 0
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for html, decision in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if decision is not None and decision not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[decision] = json.loads(decision)
                page = html.as_py()
                texts.append(main_text(page, known[decision] if decision is not None else None) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    read = join_groups(rows.where("host is not null"), decisions, "host", total).unionByName(rows.where("host is null").withColumn("decision", F.lit(None).cast("string")))
    return read.select("page_id", "url", "html", "decision").mapInArrow(run, "page_id long, url string, text string, n_chars long")
