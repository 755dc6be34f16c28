"""Literals that every match of an expression must contain, and one automaton that looks for those of many expressions.

An expression's factors are a set of literals of which any match holds at least one, read from its syntax tree. Where no
such set is worth having (too short, too many), the expression has none and is always tried. Literals and texts are folded
alike, so that whatever Python's re holds for equal without regard to case is equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import product
from re import _constants as kinds  # the tree that re itself compiles
from re import _parser as trees

#: A set of literals has no more than this many, none shorter than SHORTEST; a class of more characters than CLASS is not spelled out.
MOST, SHORTEST, CLASS = 64, 3, 8
#: Characters that re takes for i or s without regard to case and lower() does not turn into these alone.
_ODD = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))
#: What literals are made of: ASCII and the letters of Latin-1, whose equals all fold to the same character.
FOLDABLE = frozenset(chr(c) for c in (*range(1, 0x80), *range(0xC0, 0x100)) if c not in (0xD7, 0xDF, 0xF7))


def folded(text: str) -> str:
    """text in lower case, with the odd forms of i and s as these."""
    if not text.isascii():
        for odd, plain in _ODD:
            text = text.replace(odd, plain)
    return text.lower()


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """The set that fewer texts can be expected to meet: longer literals first, then fewer."""
    worth = lambda s: (0, 0) if s is None else (min(map(len, s), default=0), -len(s))
    return max(a, b, key=worth)


def _union(sets: Iterable[frozenset | None]) -> frozenset | None:
    out: set[str] = set()
    for s in sets:
        if s is None or len(out := out | s) > MOST:
            return None
    return frozenset(out)


def _characters(inside: Sequence) -> frozenset | None:
    """All strings of a class of few characters."""
    found: set[str] = set()
    for kind, value in inside:
        if kind is kinds.LITERAL:
            found.add(chr(value))
        elif kind is kinds.RANGE and value[1] - value[0] < CLASS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(map(folded, found)) if len(found) <= CLASS and found <= FOLDABLE else None


def _node(kind, value) -> tuple[frozenset | None, frozenset | None]:
    """All strings that the node can match, if they are few, and literals of which each match holds one, if known."""
    if kind is kinds.LITERAL:
        return (frozenset([folded(chr(value))]) if chr(value) in FOLDABLE else None), None
    if kind is kinds.IN:
        return _characters(value), None
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):  # nothing is consumed: what stands before and after is adjacent
        return frozenset([""]), None
    if kind is kinds.SUBPATTERN:
        return _sequence(value[3])
    if kind is kinds.ATOMIC_GROUP:
        return _sequence(value)
    if kind is kinds.BRANCH:
        ways = [_sequence(v) for v in value[1]]
        return _union(e for e, _ in ways), _union(_better(e, r) for e, r in ways)
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        least, most, item = value
        exact, held = _sequence(item)
        if least == 0:
            return (_union([exact, frozenset([""])]) if most == 1 else None), None
        return (exact if least == most == 1 else None), _better(exact, held)
    return None, None


def _sequence(nodes: Iterable) -> tuple[frozenset | None, frozenset | None]:
    run, whole, best = frozenset([""]), True, None
    for kind, value in nodes:
        exact, held = _node(kind, value)
        best = _better(best, held)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        # the run of adjacent literals ends here; another begins with this node, if its strings are known
        best, whole = _better(best, run), False
        run = exact if exact is not None else frozenset([""])
    return (run if whole else None), _better(best, run)


def factors(regex: str, flags: int = re.I | re.S) -> frozenset[str]:
    """Folded literals of which every match of the expression holds one; empty if none are known that are worth looking for."""
    exact, held = _sequence(trees.parse(regex, flags))
    found = _better(exact, held)
    return found if found and min(map(len, found)) >= SHORTEST else frozenset()


class Literals:
    """One automaton over the factors of several expressions."""

    def __init__(self, regexes: Sequence[str]):
        import ahocorasick

        each = [factors(r) for r in regexes]
        self.always = sum(1 << i for i, f in enumerate(each) if not f)
        self.all = (1 << len(each)) - 1
        held: dict[str, int] = {}
        for i, f in enumerate(each):
            for literal in f:
                held[literal] = held.get(literal, 0) | 1 << i
        self.automaton = ahocorasick.Automaton()
        for literal, mask in held.items():
            self.automaton.add_word(literal, mask)
        if held:
            self.automaton.make_automaton()
        self.any = bool(held)

    def possible(self, text: str) -> int:
        """Bits of the expressions that may match the text."""
        found = self.always
        if self.any and found != self.all:
            for _, mask in self.automaton.iter(folded(text)):
                found |= mask
                if found == self.all:
                    break
        return found
