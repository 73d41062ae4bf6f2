"""The query language: text to a small plan of predicates, evaluated as Columns.

Words and "phrases" are alternatives unless AND, OR, NOT (in any case) or NEAR(..)
stand beside them; ``word*`` is a prefix, ``column:word`` restricts a term, and
``publish_date>=2020`` or ``created_at<..`` filter entries. Terms of fewer than
three characters can't use the trigram index and go to the low-precision route.
Binding, tightest first: side by side, NOT, AND, OR.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_COLUMNS = ("chunk_text", "title", "author", "publisher", "publish_date")
META_COLUMNS = ("title", "author", "publisher", "publish_date")
OPERATORS = ("AND", "OR", "NOT")
TRIGRAM = 3
TOKEN = re.compile(r'"(?P<phrase>[^"]*)"|(?P<near>NEAR\([^)]*\))|(?P<word>"[^"]*$|\S+)', re.I)
RANGE = re.compile(r"(publish_date|created_at)(>=|<=|>|<)(.+)")
COLUMN = re.compile(r"(title|author|publisher|publish_date|chunk_text):(.+)")
NEAR = re.compile(r'NEAR\(\s*(.*?)\s*(?:,\s*(\d+)\s*)?\)', re.I | re.S)
NEAR_DISTANCE = 10


class QueryError(ValueError):
    """A query that can't be evaluated; ``code`` names the reason."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Term:
    body: str
    column: str | None = None
    prefix: bool = False

    def __str__(self) -> str:
        quoted = '"' + self.body.replace('"', '""') + '"' + "*" * self.prefix
        return f"{self.column}:{quoted}" if self.column else quoted

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,) if self.column else TEXT_COLUMNS


@dataclass(frozen=True)
class Near:
    bodies: tuple[str, ...]
    distance: int
    source: str

    def __str__(self) -> str:
        return self.source


@dataclass
class Query:
    """``items``: terms, NEAR groups and operator names in order, with the implied ORs."""

    items: list = field(default_factory=list)
    like_terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    filters: list[tuple[str, str]] = field(default_factory=list)
    ranges: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def match(self) -> str | None:
        """The full-text expression, or None."""
        return " ".join(map(str, self.items)) or None

    @property
    def terms(self) -> list[Term]:
        """Every term that scores, NEAR members included."""
        out = []
        for item in self.items:
            out += [item] if isinstance(item, Term) else [Term(b) for b in item.bodies] if isinstance(item, Near) else []
        return [t for t in out if len(t.body) >= TRIGRAM]


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token: phrase, near or word."""
    return [(m.lastgroup, m[m.lastgroup]) for m in TOKEN.finditer(text)]


def parse(text: str, as_filters: bool = False) -> Query:
    """Parse a query. ``as_filters``: metadata column terms become entry filters and leave the expression."""
    out = Query()

    def add(item) -> None:
        beside = out.items and isinstance(item, Term) and isinstance(out.items[-1], Term)
        out.items.extend(["OR", item] if beside else [item])

    def scored(body: str) -> None:
        if body and body.lower() not in {p.lower() for p in out.phrases}:
            out.phrases.append(body)

    def plain(body: str, column: str | None = None) -> None:
        if len(body) >= TRIGRAM:
            add(Term(body, column))
            if column in (None, "chunk_text"):
                scored(body)
        elif body:
            out.like_terms.append(body)

    for kind, token in tokens(text):
        if kind == "phrase":
            add(Term(token))
            scored(token)
        elif kind == "near":
            inside = NEAR.fullmatch(token)
            bodies = tuple(phrase or word.strip('"') for phrase, word in re.findall(r'"([^"]*)"|(\S+)', inside[1]))
            add(Near(bodies, int(inside[2] or NEAR_DISTANCE), token))
        elif token.upper() in OPERATORS:
            out.items.append(token.upper())
        elif found := RANGE.fullmatch(token):
            out.ranges.append((found[1], found[2], found[3].strip('"')))
        elif found := COLUMN.fullmatch(token):
            column, body = found[1], found[2].strip('"')
            if as_filters and column in META_COLUMNS:
                out.filters += [(column, body)] if body else []
            else:
                plain(body, column)
        elif token.endswith("*") and len(token) > 1:
            add(Term(token[:-1], prefix=True))
            scored(token[:-1])
        else:
            plain(token.strip('"'))
    return out


def contains(column: Column, body: str) -> Column:
    return F.lower(F.coalesce(column, F.lit(""))).contains(body.lower())


def occurrences(column: Column, body: str) -> Column:
    """How often ``body`` starts in ``column``, overlaps counted, whatever the case."""
    quoted = "\\Q" + body.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(F.lower(F.coalesce(column, F.lit(""))), F.lit(f"(?={quoted})"))


def _near(item: Near, columns: Callable[[str], Column]) -> Column:
    """All bodies in one column within ``distance`` trigrams between neighbours, in any order."""
    if any(len(b) < TRIGRAM for b in item.bodies):
        return F.lit(False)
    gap = max(item.distance - (TRIGRAM - 1), 0)
    quoted = [re.escape(b.lower()) for b in item.bodies]

    def ordered(done: list[str], rest: list[str]) -> list[str]:
        return [p for i, x in enumerate(rest) for p in ordered([*done, x], rest[:i] + rest[i + 1 :])] if rest else [f"(?s){f'.{{0,{gap}}}'.join(done)}"]

    any_order = ordered([], quoted)
    hit = lambda c: reduce(Column.__or__, [F.lower(F.coalesce(columns(c), F.lit(""))).rlike(p) for p in any_order])
    return reduce(Column.__or__, [hit(c) for c in TEXT_COLUMNS])


def condition(query: Query, columns: Callable[[str], Column], names: tuple[str, ...] = TEXT_COLUMNS, known: Callable[[Term | Near], Column] | None = None) -> Column | None:
    """The boolean Column of a query's expression; ``columns`` gives the Column of a text column name.

    ``known`` gives whether a term or NEAR group holds where that is known already, as from an index.
    """
    items = list(query.items)
    if not items:
        return None
    at = 0

    def one(item) -> Column | None:
        if isinstance(item, Near):
            return known(item) if known else _near(item, columns)
        if len(item.body) < TRIGRAM:
            return None  # no trigram: nothing matches, and beside other terms it doesn't count
        if known:
            return known(item)
        return reduce(Column.__or__, [contains(columns(c), item.body) for c in item.columns if c in names] or [F.lit(False)])

    def beside() -> Column:
        nonlocal at
        found = []
        while at < len(items) and not isinstance(items[at], str):
            found.append(one(items[at]))
            at += 1
        if not found:
            raise QueryError("bad_query", f"an operator has no term beside it in {query.match}")
        some = [c for c in found if c is not None]
        return reduce(Column.__and__, some) if some else F.lit(False)

    def joined(name: str, lower: Callable[[], Column], join: Callable[[Column, Column], Column]) -> Column:
        nonlocal at
        left = lower()
        while at < len(items) and items[at] == name:
            at += 1
            left = join(left, lower())
        return left

    without = lambda: joined("NOT", beside, lambda a, b: a & ~b)
    both = lambda: joined("AND", without, lambda a, b: a & b)
    whole = joined("OR", both, lambda a, b: a | b)
    if at < len(items):
        raise QueryError("bad_query", f"unexpected {items[at]} in {query.match}")
    return whole
