"""A small parsing-expression-grammar engine with memoised rules.

A parser is a function ``(source, position) -> (position, nodes) | None``. A node is a tuple ``(name, start, end, children)``;
sequences and repetitions pass their children up, ``rule`` names them. Choice is ordered and committed, as
in any PEG; nested constructs are written with ``defer``.

Nesting would make a plain recursive parser try an inner construct again for every outer one that fails, in time that doubles with each
level. ``memo`` keeps the result of a rule per position of the line, and ``run_of`` the end of a repetition for every position at which
one of its items begins, so each is worked out once: time is in proportion to the line. ``prepare`` fills a rule's table from the
right, so that its calls of itself find their answers and nothing recurses as deep as the text nests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex

Node = tuple[str, int, int, tuple]


class Source:
    """One line and the tables of its rules; they go with the line."""

    __slots__ = ("text", "tables")

    def __init__(self, text: str):
        self.text = text
        self.tables: dict[int, dict] = {}

    def table(self, owner: int) -> dict:
        return self.tables.setdefault(owner, {})


Parser = Callable[[Source, int], "tuple[int, tuple[Node, ...]] | None"]
_MISSING = object()


def term(pattern: str, flags: int = 0) -> Parser:
    """A regular-expression terminal without a node of its own."""
    match = regex.compile(pattern, flags).match

    def parse(source: Source, at: int):
        m = match(source.text, at)
        return None if m is None else (m.end(), ())

    return parse


def seq(*parts: Parser) -> Parser:
    def parse(source: Source, at: int):
        found: tuple = ()
        for p in parts:
            r = p(source, at)
            if r is None:
                return None
            at, more = r
            if more:
                found += more
        return at, found

    return parse


def choice(*options: Parser) -> Parser:
    def parse(source: Source, at: int):
        for p in options:
            r = p(source, at)
            if r is not None:
                return r
        return None

    return parse


def many(p: Parser, least: int = 0, most: int | None = None) -> Parser:
    def parse(source: Source, at: int):
        found, n = [], 0
        while most is None or n < most:
            r = p(source, at)
            if r is None or r[0] == at:
                break
            at, more = r
            found.extend(more)
            n += 1
        return None if n < least else (at, tuple(found))

    return parse


def at_one_of(characters: str, p: Parser) -> Parser:
    """``p`` where it can begin at all, told by its first character."""
    first = frozenset(characters)
    return lambda source, at: p(source, at) if source.text[at : at + 1] in first else None


def run_of(p: Parser) -> Parser:
    """As many ``p`` as there are, without nodes. Where one run meets the items of another it ends where that one did."""
    key = id(p)

    def parse(source: Source, at: int):
        ends = source.table(key)
        passed = []
        while (end := ends.get(at)) is None:
            passed.append(at)
            r = p(source, at)
            if r is None or r[0] == at:
                end = at
                break
            at = r[0]
        for k in passed:
            ends[k] = end
        return end, ()

    return parse


def memo(p: Parser) -> Parser:
    key = id(p)

    def parse(source: Source, at: int):
        known = source.table(key)
        r = known.get(at, _MISSING)
        if r is _MISSING:
            r = known[at] = p(source, at)
        return r

    return parse


def prepare(source: Source, p: Parser, places: Iterable[int]) -> None:
    """Works out a memoised rule at all places where it can begin, from the last to the first."""
    for at in sorted(places, reverse=True):
        p(source, at)


def maybe(p: Parser) -> Parser:
    return many(p, 0, 1)


def unless(p: Parser) -> Parser:
    """Succeeds without consuming where ``p`` fails."""
    return lambda source, at: (at, ()) if p(source, at) is None else None


def rule(name: str, p: Parser) -> Parser:
    def parse(source: Source, at: int):
        r = p(source, at)
        return None if r is None else (r[0], ((name, at, r[0], r[1]),))

    return parse


def defer(get: Callable[[], Parser]) -> Parser:
    return lambda source, at: get()(source, at)
