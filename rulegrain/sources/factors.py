"""Required literals of regular expressions: what a line must hold before a pattern is worth trying.

`required` reads a pattern's syntax tree and returns alternatives, short strings
of which every match holds at least one. Patterns that Python's parser reads
differently from Java's, or not at all, give none, and neither do those made of
classes only: such rules are tried wherever they apply.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as op
from re import _parser

#: More alternatives or longer ones than these cut a literal short; both only make the filter wider.
MOST, LONGEST = 32, 24
#: What Java reads in another way: class intersections and nested classes, quoting.
FOREIGN = re.compile(r"&&|\[[^\]]*\[|\\[QEpPhHvVRXGzZ]")


def _class(items: list) -> set[str] | None:
    """The characters of a small class."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(out) > 8:
            return None
    return out


class _Reader:
    def __init__(self, folded: bool):
        self.folded = folded  # case is ignored beyond ASCII: k and s have partners there

    def texts(self, chars: set[str]) -> set[str] | None:
        low = {c.lower() for c in chars}
        usable = all(c.isascii() and not (self.folded and c in "ks") for c in low)
        return low if usable and low else None

    def sequence(self, items) -> tuple[set[str] | None, set[str] | None]:
        """(all strings that the items can match, if few; the best alternatives of which a match holds one)."""
        run: set[str] = {""}
        whole, found = True, []

        def end() -> None:
            nonlocal run, whole
            found.append(run)
            run, whole = {""}, False

        def add(texts: set[str] | None) -> None:
            nonlocal run
            if texts is None:
                end()
                return
            longer = {a + b for a in run for b in texts}
            if len(longer) > MOST or max(map(len, longer)) > LONGEST:
                end()
                longer = texts
            run = longer

        for kind, value in items:
            if kind is op.LITERAL:
                add(self.texts({chr(value)}))
            elif kind is op.IN:
                chars = _class(value)
                add(self.texts(chars) if chars else None)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                low, high, inside = value
                exact, best = self.sequence(inside)
                if low == 0:
                    end()
                    continue
                for _ in range(min(low, LONGEST) if exact else 0):
                    add(exact)
                if not exact:
                    found.append(best or {""})
                if not exact or high != low or low > LONGEST:
                    end()
            elif kind is op.SUBPATTERN or kind is op.ATOMIC_GROUP:
                inside = value[3] if kind is op.SUBPATTERN else value
                exact, best = self.sequence(inside)
                found.append(best or {""})
                add(exact)
            elif kind is op.BRANCH:
                sides = [self.sequence(s) for s in value[1]]
                if all(e for e, _ in sides) and sum(len(e) for e, _ in sides) <= MOST:
                    add(set().union(*(e for e, _ in sides)))
                else:
                    bests = [b for _, b in sides]
                    if all(bests) and sum(map(len, bests)) <= 4 * MOST:
                        found.append(set().union(*bests))
                    end()
            elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):  # those take no room
                end()
        exact = run if whole else None
        found.append(run)
        best = max(found, key=lambda s: (min(map(len, s)), -len(s)))
        return exact, best if min(map(len, best)) else None


def required(pattern: str) -> list[str] | None:
    """Lower-case ASCII strings; a text without any of them, in any case, has no match. None: no such strings are known."""
    if FOREIGN.search(pattern):
        return None
    named = re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", re.sub(r"\\k<(\w+)>", r"(?P=\1)", pattern))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = _parser.parse(named)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    folded = bool(re.search(r"\(\?[a-zA-Z]*[uU]", pattern))
    _, best = _Reader(folded).sequence(tree)
    return sorted(best) if best else None
