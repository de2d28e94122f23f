"""The query language: scanner, grammar and syntax tree, on the driver."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from quarry.functions.text import python_tokens

# Fixed values of the language.
_KINDS = {"dir": ("dir", "directory", "folder"), "file": ("file", "document"), "link": ("link", "symlink", "alias"), "other": ("other",)}
_UNITS = {"b": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3, "t": 4, "tb": 4, "tib": 4}
_FIELDS = {"name": "name", "path": "path", "in": "path", "ext": "ext", "extension": "ext", "tag": "tag", "label": "tag", "scope": "scope", "where": "scope", "kind": "kind", "type": "kind", "size": "size", "date": "modified", "modified": "modified", "mtime": "modified", "created": "created", "birth": "created", "btime": "created", "changed": "changed", "ctime": "changed"}
MAX_DISTANCE = 256


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Proximity:
    distance: int
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    """field: name, path, ext, tag, scope, kind, size, modified, created or changed; op and number for the comparisons."""

    field: str
    value: str
    op: str = "="
    low: int = 0
    high: int = 0


@dataclass(frozen=True)
class Not:
    arm: object


@dataclass(frozen=True)
class And:
    arms: tuple


@dataclass(frozen=True)
class Or:
    arms: tuple


@dataclass(frozen=True)
class Query:
    """The lists (sorted, without repeats) and the expression, None where the string has none."""

    terms: tuple = ()
    excluded: tuple = ()
    phrases: tuple = ()
    proximities: tuple = ()
    filters: tuple = ()  # pairs of a filter and whether it is negated
    expression: object = None

    @property
    def text(self) -> str:
        return " ".join(self.terms)

    @property
    def content_terms(self) -> list[str]:
        """Terms whose postings a deep pass reads."""
        more = [t for p in self.phrases for t in python_tokens(p)] + [t for p in self.proximities for t in p.terms]
        return sorted({*self.terms, *self.excluded, *more, *_expression_terms(self.expression)})

    def key(self) -> str:
        """A canonical string: equal for queries that mean the same to the engine."""
        parts = [("terms", self.terms), ("excluded", self.excluded), ("phrases", self.phrases), ("proximities", self.proximities), ("filters", self.filters), ("expr", (self.expression,))]
        show = lambda v: f"{len(str(v))}:{v}"
        return "q1" + "".join(show(k) + show(len(v)) + "".join(map(show, v)) for k, v in parts)


def _expression_terms(e) -> list[str]:
    if isinstance(e, Term):
        return [e.text]
    if isinstance(e, Phrase):
        return python_tokens(e.text)
    if isinstance(e, Proximity):
        return list(e.terms)
    if isinstance(e, Not):
        return _expression_terms(e.arm)
    return [t for arm in getattr(e, "arms", ()) for t in _expression_terms(arm)]


@dataclass
class _Token:
    text: str
    quoted: bool = False
    paren: bool = False

    def says(self, word: str) -> bool:
        return not self.paren and self.text.lower() == word


_LEX = re.compile(r'(?P<paren>[()])|(?P<minus>-)?"(?P<quoted>(?:[^"\\]|\\.)*)(?:"|\\?\Z)|(?P<word>[^\s()"]+)', re.S)


def scan(text: str) -> list[_Token]:
    """Words, quoted strings (a minus before the quote belongs to them) and parentheses; an open quote runs to the end."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _LEX.match(text, at)
        if m["paren"]:
            out.append(_Token(m["paren"], paren=True))
        elif m["word"] is not None and m["word"] == "-" and text[m.end() : m.end() + 1] == '"':
            m = _LEX.match(text, at)
            quoted = _LEX.match(text, m.end())
            out.append(_Token("-" + re.sub(r"\\(.)", r"\1", quoted["quoted"], flags=re.S), quoted=True))
            m = quoted
        elif m["word"] is not None:
            out.append(_Token(m["word"]))
        else:
            value = (m["minus"] or "") + re.sub(r"\\(.)", r"\1", m["quoted"], flags=re.S)
            if value:
                out.append(_Token(value, quoted=True))
        at = m.end()
    return out


def parse_size(text: str) -> tuple[str, int] | None:
    m = re.fullmatch(r"(>=|<=|>|<|=)?\s*(\d+)\s*([a-z]*)", text.strip().lower())
    if not m or (m[3] and m[3] not in _UNITS):
        return None
    n = int(m[2]) << 10 * _UNITS.get(m[3], 0)
    return (m[1] or "=", n) if n < 1 << 64 else None


def parse_date(text: str) -> tuple[str, int, int] | None:
    """Operator, and the first seconds of the day and of the next."""
    m = re.fullmatch(r"(>=|<=|>|<|=)?\s*(\d{4})-(\d{2})-(\d{2})", text.strip())
    try:
        day = dt.datetime(int(m[2]), int(m[3]), int(m[4]), tzinfo=dt.timezone.utc) if m else None
    except ValueError:
        return None
    if not day:
        return None
    low = int(day.timestamp())
    return m[1] or "=", low, low + 86_400


def parse_filter(text: str) -> Filter | None:
    if text.startswith("@") and text[1:].strip():
        return Filter("scope", text[1:].strip().lower())
    name, colon, value = text.partition(":")
    kind, value = _FIELDS.get(name.strip().lower()), value.strip()
    if not colon or not kind or not value:
        return None
    low = value.lower()
    if kind == "kind":
        found = next((k for k, names in _KINDS.items() if low in names), None)
        return Filter("kind", found) if found else None
    if kind == "size":
        found = parse_size(value)
        return Filter("size", low, found[0], found[1]) if found else None
    if kind in ("modified", "created", "changed"):
        found = parse_date(value)
        return Filter(kind, low, *found) if found else None
    return Filter(kind, low.lstrip(".") if kind == "ext" else low)


def parse_proximity(text: str) -> Proximity | None:
    m = re.fullmatch(r"(?:near|proximity):(\d+):(.*)", text, re.S)
    if not m or not 1 <= int(m[1]) <= MAX_DISTANCE:
        return None
    terms = sorted({t for part in m[2].split(",") for t in python_tokens(part)})
    return Proximity(int(m[1]), tuple(terms)) if len(terms) >= 2 else None


def _all(arms: list):
    flat = [x for a in arms for x in (a.arms if isinstance(a, And) else (a,))]
    return flat[0] if len(flat) == 1 else And(tuple(flat))


def _any(arms: list):
    flat = [x for a in arms for x in (a.arms if isinstance(a, Or) else (a,))]
    return flat[0] if len(flat) == 1 else Or(tuple(flat))


class _Failed(Exception):
    """The string has no expression."""


class _Grammar:
    """or := and ('or' and)*; and := (['and'] not)+; not := 'not' not | '-'atom | atom; atom := '(' or ')' | value."""

    def __init__(self, tokens: list[_Token]):
        self.tokens, self.at = tokens, 0

    def now(self) -> _Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, word: str) -> bool:
        t = self.now()
        found = t is not None and t.says(word)
        self.at += found
        return found

    def whole(self):
        try:
            found = self.disjunction()
        except _Failed:
            return None
        return found if self.at == len(self.tokens) else None

    def disjunction(self):
        arms = [self.conjunction()]
        while self.take("or"):
            arms.append(self.conjunction())
        return _any(arms)

    def conjunction(self):
        arms = []
        while (t := self.now()) is not None and not t.says("or") and not (t.paren and t.text == ")"):
            self.take("and")
            arms.append(self.negation())
        if not arms:
            raise _Failed
        return _all(arms)

    def negation(self):
        if self.take("not"):
            return Not(self.negation())
        t = self.now()
        if t is None:
            raise _Failed
        if not t.paren and t.text.startswith("-") and len(t.text) > 1:
            self.at += 1
            return Not(_atom(t.text[1:], t.quoted))
        if t.paren and t.text == "(":
            self.at += 1
            inner = self.disjunction()
            close = self.now()
            if close is None or not close.paren or close.text != ")":
                raise _Failed
            self.at += 1
            return inner
        if t.paren:
            raise _Failed
        self.at += 1
        return _atom(t.text, t.quoted)


def _atom(text: str, quoted: bool):
    found = parse_proximity(text) or parse_filter(text)
    if found:
        return found
    text = text.strip().lower()
    if not text:
        raise _Failed
    return Phrase(text) if quoted else _all([Term(t) for t in python_tokens(text)])


def parse(text: str) -> Query:
    """The lists come from all tokens but operators and parentheses, whether or not the string has an expression."""
    tokens = scan(text)
    lists: dict[str, set] = {k: set() for k in ("terms", "excluded", "phrases", "proximities", "filters")}
    for t in tokens:
        if t.paren or not t.quoted and t.text.lower() in ("and", "or", "not"):
            continue
        negative = t.text.startswith("-") and len(t.text) > 1
        value = t.text[1:] if negative else t.text
        if (near := parse_proximity(value)) and not negative:
            lists["proximities"].add(near)
        elif found := parse_filter(value):
            lists["filters"].add((found, negative))
        elif negative:
            lists["excluded"].update(python_tokens(value))
        elif t.quoted:
            if value.strip():
                lists["phrases"].add(value.strip().lower())
        else:
            lists["terms"].update(python_tokens(value))
    ordered = {k: tuple(sorted(v, key=repr if k in ("filters", "proximities") else None)) for k, v in lists.items()}
    return Query(**ordered, expression=_Grammar(tokens).whole() if tokens else None)
