"""A small reader of regular expressions, for deriving from one what all its matches contain.

It knows what Python and Java write alike: literals, escapes, character sets, groups, alternatives and
repeats. Anything else is an error, so that no rule is read wrongly in silence.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Chars:
    """One of these characters; None: too many to name."""

    some: frozenset[str] | None


@dataclass(frozen=True)
class Either:
    """One of several sequences of nodes."""

    ways: tuple[tuple, ...]


@dataclass(frozen=True)
class Repeat:
    """A node low to high times (None: no bound)."""

    node: object
    low: int
    high: int | None


#: Escapes of one character, and of sets that are not named.
_ONE = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}
_SETS, _PLACES = "dDwWsS", "bBAZ"
_NAMED = 64


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        got = self.text[self.at : self.at + n]
        if len(got) < n:
            raise ValueError(f"regular expression ends early: {self.text}")
        self.at += n
        return got

    def escape(self) -> str | None:
        """The character of an escape whose backslash is read; None for a set, '' for a place."""
        c = self.take()
        if c in _ONE:
            return _ONE[c]
        if c in _SETS:
            return None
        if c in _PLACES:
            return ""
        if c in "xu":
            return chr(int(self.take(2 if c == "x" else 4), 16))
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c} in {self.text}")
        return c

    def alternatives(self) -> tuple[tuple, ...]:
        ways = [self.sequence()]
        while self.peek() == "|":
            self.take()
            ways.append(self.sequence())
        return tuple(ways)

    def sequence(self) -> tuple:
        nodes: list = []
        while self.peek() and self.peek() not in "|)":
            node = self.repeated(self.atom())
            if node is not None:
                nodes.append(node)
        return tuple(nodes)

    def atom(self):
        """The next node; None for a place or a flag, which match nothing."""
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.charset()
        if c == ".":
            return Chars(None)
        if c in "^$":
            return None
        if c == "\\":
            one = self.escape()
            return None if one == "" else Chars(None if one is None else frozenset(one))
        return Chars(frozenset(c))

    def group(self):
        if self.peek() == "?":
            self.take()
            kind = self.take()
            if kind in "=!<":
                raise ValueError(f"looks around are not read: {self.text}")
            while kind not in ":)":
                kind = self.take()
            if kind == ")":
                return None
        inner = Either(self.alternatives())
        if self.take() != ")":
            raise ValueError(f"unbalanced group in {self.text}")
        return inner

    def charset(self) -> Chars:
        negated = self.peek() == "^"
        self.at += negated
        some: set[str] | None = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else c
            if low and self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else c
                span = range(ord(low), ord(high) + 1)
                some = None if some is None or len(span) > _NAMED else some | set(map(chr, span))
            else:
                some = None if some is None or low is None else some | {low}
        self.take()
        return Chars(None if negated or some is None else frozenset(some))

    def repeated(self, node):
        bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}
        while self.peek() and (self.peek() in bounds or (self.peek() == "{" and self.text[self.at + 1 : self.at + 2].isdigit())):
            c = self.take()
            if c == "{":
                inside = self.text[self.at : self.text.index("}", self.at)]
                self.take(len(inside) + 1)
                low, comma, high = inside.partition(",")
                found = int(low), (int(high) if high else None) if comma else int(low)
            else:
                found = bounds[c]
            if self.peek() in ("?", "+"):  # lazy or possessive: the same strings
                self.take()
            node = None if node is None else Repeat(node, *found)
        return node


def parse(regex: str) -> Either:
    """The alternatives of a regular expression, each a sequence of nodes."""
    reader = _Reader(regex)
    out = Either(reader.alternatives())
    if reader.peek():
        raise ValueError(f"unbalanced group in {regex}")
    return out
