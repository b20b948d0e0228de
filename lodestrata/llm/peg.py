"""A small packrat engine for parsing-expression grammars.

A parser is a function (state, position) -> (position, value) or None. Named
rules remember their result by position, so every rule is tried once per place
and a parse takes time in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Parser = Callable[["State", int], "tuple[int, object] | None"]


class State:
    __slots__ = ("text", "memo")

    def __init__(self, text: str):
        self.text = text
        self.memo: dict = {}


def terminal(pattern: str, flags: int = 0) -> Parser:
    """Matches ``pattern`` here; the value is the span."""
    match = re.compile(pattern, flags).match

    def run(s: State, i: int):
        m = match(s.text, i)
        return None if m is None else (m.end(), (i, m.end()))

    return run


def rule(body: Parser, action: Callable | None = None) -> Parser:
    """A named rule: memoised, with an optional action on (state, start, end, value)."""
    key = object()

    def run(s: State, i: int):
        got = s.memo.get((key, i), s)
        if got is s:
            got = body(s, i)
            if got is not None and action is not None:
                got = (got[0], action(s, i, got[0], got[1]))
            s.memo[(key, i)] = got
        return got

    return run


def brackets(*inside: Parser, pairs: str = "()[]{}") -> Parser:
    """A bracket, what is inside, and the bracket that closes it; brackets inside likewise.

    ``inside`` are the alternatives between brackets, tried in order; none of
    them may match at a bracket. The rule refers to itself, so open brackets
    are kept on a stack of its own: depth costs memory, never frames. Like
    every rule it remembers its result by position, for each bracket it met.
    """
    key = object()
    closing = dict(zip(pairs[::2], pairs[1::2]))
    closers = set(closing.values())

    def run(s: State, i: int):
        if (key, i) in s.memo:
            return s.memo[(key, i)]
        text, n = s.text, len(s.text)
        if i >= n or text[i] not in closing:
            return None
        stack = [i]
        at = i + 1
        while stack and at < n:
            c = text[at]
            if c in closing:
                known = s.memo.get((key, at), s)
                if known is None:
                    break
                if known is not s:
                    at = known[0]
                    continue
                stack.append(at)
                at += 1
            elif c in closers:
                if c != closing[text[stack[-1]]]:
                    break
                start = stack.pop()
                at += 1
                s.memo[(key, start)] = (at, (start, at))
            else:
                for part in inside:
                    got = part(s, at)
                    if got is not None and got[0] > at:
                        at = got[0]
                        break
                else:
                    break
        for start in stack:
            s.memo[(key, start)] = None
        return s.memo[(key, i)]

    return run


def seq(*parts: Parser) -> Parser:
    def run(s: State, i: int):
        out = []
        for p in parts:
            got = p(s, i)
            if got is None:
                return None
            i, v = got
            out.append(v)
        return i, out

    return run


def choice(*parts: Parser) -> Parser:
    """The first alternative that matches."""

    def run(s: State, i: int):
        for p in parts:
            got = p(s, i)
            if got is not None:
                return got
        return None

    return run


def many(part: Parser, least: int = 0) -> Parser:
    def run(s: State, i: int):
        out = []
        while True:
            got = part(s, i)
            if got is None or got[0] == i:
                break
            i, v = got
            out.append(v)
        return (i, out) if len(out) >= least else None

    return run


def maybe(part: Parser) -> Parser:
    def run(s: State, i: int):
        return part(s, i) or (i, None)

    return run


def ahead(part: Parser) -> Parser:
    def run(s: State, i: int):
        return None if part(s, i) is None else (i, None)

    return run


def absent(part: Parser) -> Parser:
    def run(s: State, i: int):
        return (i, None) if part(s, i) is None else None

    return run
