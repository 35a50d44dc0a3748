"""Cheap tests that a sentence must pass before a rule's pattern is tried on it.

A gate never decides a find: it holds wherever the pattern finds anything. Read off a pattern are the literal beginnings of
its finds, and literal parts that every find has; a plain search for those costs a fraction of a pattern's. A pattern with
neither has no gate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product
from re import _constants as C
from re import _parser

from .rule_table import Rule

#: Longest beginnings looked at, shortest ones worth a search, and the most of them in a rule.
SIZES, SHORTEST, MOST = (6, 4, 3), 3, 60
#: Ends of literal texts: those that a pattern may go no further than, and those that may go on.
Heads = tuple[set[str], set[str]]


def _parsed(pattern: str):
    """Python's reading of a pattern, or None if it is Java's alone; case is the searches' affair."""
    try:
        return _parser.parse(pattern.replace("(?i)", ""))
    except re.error:
        return None


def _signs(members) -> set[str] | None:
    """The characters of a small class, digits among them."""
    found: set[str] = set()
    for op, av in members:
        if op is C.LITERAL:
            found.add(chr(av))
        elif op is C.RANGE and av[1] - av[0] < 10:
            found |= set(map(chr, range(av[0], av[1] + 1)))
        else:
            return None
    return found if len(found) <= 12 else None


def _then(before: set[str], after: set[str], size: int) -> set[str]:
    return {(a + b)[:size] for a, b in product(before, after)}


def _heads(seq, size: int) -> Heads:
    done: set[str] = set()
    going = {""}
    for op, av in seq:
        closed: set[str] = set()
        if op is C.AT:
            continue
        if op is C.LITERAL:
            more = {chr(av)}
        elif op is C.IN:
            more = _signs(av) or set()
            closed = set() if more else {""}
        elif op is C.BRANCH:
            each = [_heads(b, size) for b in av[1]]
            closed, more = set().union(*(c for c, _ in each)), set().union(*(m for _, m in each))
        elif op is C.SUBPATTERN:
            closed, more = _heads(av[3], size)
        elif op is C.MAX_REPEAT:
            least, most, sub = av
            closed, more = _heads(sub, size)
            if most != 1:  # what follows the first turn is not told
                closed, more = closed | more, set()
            if least == 0:
                more = more | {""}
        else:
            closed, more = {""}, set()
        done |= _then(going, closed, size)
        going = _then(going, more, size)
        done |= {h for h in going if len(h) >= size}
        going = {h for h in going if len(h) < size}
        if not going or len(done) + len(going) > 10 * MOST:
            break
    return done, going


def heads(rule: Rule, size: int) -> set[str]:
    """Literal beginnings of up to size characters, one of which each find has; none if they are too short or too many."""
    seq = _parsed(rule.pattern)
    if seq is None:
        return set()
    done, going = _heads(seq, size)
    found = done | going
    return found if len(found) <= MOST and min(map(len, found)) >= SHORTEST else set()


def _needs(seq) -> set[str]:
    """Literal parts, one of which each find has: the longest that are told, or none."""
    options: list[set[str]] = []
    run = {""}
    for op, av in [*seq, (None, None)]:
        signs = {chr(av)} if op is C.LITERAL else _signs(av) if op is C.IN else None
        if signs and len(run) * len(signs) <= MOST:
            run = {a + b for a, b in product(run, signs)}
            continue
        options.append(run)
        run = signs or {""}
        if op is C.BRANCH:
            each = [_needs(b) for b in av[1]]
            options.append(set().union(*each) if all(each) else set())
        elif op is C.SUBPATTERN:
            options.append(_needs(av[3]))
        elif op is C.MAX_REPEAT and av[0] > 0:
            options.append(_needs(av[2]))
    told = [o for o in options if o and "" not in o and len(o) <= MOST]
    return max(told, key=lambda o: (min(map(len, o)), -len(o)), default=set())


def needs(rule: Rule) -> set[str]:
    seq = _parsed(rule.pattern)
    return set() if seq is None else _needs(seq)


def gate(rule: Rule, text: str, lower: str, quote: Callable[[str], str]) -> str:
    """SQL that holds wherever the rule finds anything in text; '' where nothing is told. lower: the text in lower case.

    Plain searches for literals: of what is told, the fewest texts that are long enough.
    """
    told = [t for t in (*(heads(rule, size) for size in SIZES), needs(rule)) if t]
    if not told:
        return ""
    texts = min(told, key=lambda t: (min(map(len, t)) < SHORTEST, len(t)))
    anyhow = "(?i)" in rule.pattern
    texts = {t.lower() for t in texts} if anyhow else texts
    # A text that another one is part of says nothing more.
    least = sorted(t for t in texts if not any(o != t and o in t for o in texts))
    return "(" + " OR ".join(f"contains({lower if anyhow else text}, {quote(t)})" for t in least) + ")"
