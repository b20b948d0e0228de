"""Token series of Python and Rust sources: identifiers, literals, all other signs."""

from __future__ import annotations

import keyword
import re
from typing import NamedTuple

IDENTIFIER, LITERAL, OTHER, BOUNDARY = "identifier", "literal", "other", "boundary"

_PYTHON = re.compile(
    r'''(?P<skip>[ \t\f\r\n\ufeff]+|\\\r?\n|\#[^\r\n]*)|(?P<string>[rRuUbBfFtT]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*+(?:\'\'\'|\Z)|"(?:[^"\\\r\n]|\\(?:\r\n|.))*+"?|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+'?))|(?P<number>\.?\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<name>[^\W\d]\w*)|(?P<op>\*\*=?|//=?|>>=?|<<=?|->|:=|[-+*/%@&|^=<>!]=|\.\.\.|[^\s\w])''',
    re.S,
)
_RUST = re.compile(
    r"""(?P<skip>[\s\ufeff]+|//[^\n]*)|(?P<block>/\*)|(?P<string>[bc]?r(?P<h>\#*)"[\s\S]*?(?:"(?P=h)|\Z)|[bc]?"(?:[^"\\]|\\[\s\S])*+"?|b?'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')|(?P<number>\d[\w]*(?:\.\d[\w]*)?(?:(?<=[eE])[+-]\d+)?)|(?P<name>'?(?:r\#)?[^\W\d]\w*)|(?P<op><<=|>>=|\.\.=|\.\.\.|::|->|=>|&&|\|\||\.\.|[-+*/%^&|=<>!]=|[^\s\w])"""
)
_MARK = re.compile(r"/\*|\*/")
#: Rust's strict keywords (fixed values).
_RUST_WORDS = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int


def python_tokens(text: str) -> list[Token]:
    """Tokens without blanks and comments; a string that is a whole statement is documentation and left out."""
    out: list[Token] = []
    line_start, depth = True, 0
    for m in _PYTHON.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            line_start = line_start or ("\n" in m[0] and depth == 0)
            continue
        if kind == "string" and line_start and depth == 0:
            rest = re.compile(r"[ \t\f]*(?:\#[^\r\n]*)?(?:[\r\n;]|\Z)").match(text, m.end())
            if rest and (not out or out[-1].text in (":", ";") or line_start):
                continue
        line_start = False
        t = m[0]
        if kind == "op":
            depth += (t in "([{") - (t in ")]}")
            out.append(Token(OTHER, t, m.start()))
            line_start = t == ":" and depth == 0
        elif kind == "name":
            literal = t in ("True", "False", "None")
            out.append(Token(LITERAL if literal else OTHER if keyword.iskeyword(t) else IDENTIFIER, t, m.start()))
        else:
            out.append(Token(LITERAL, t, m.start()))
    return out


def rust_tokens(text: str) -> list[Token]:
    """Tokens without blanks and comments of any form."""
    out: list[Token] = []
    at = 0
    while True:
        m = _RUST.match(text, at)
        if m is None:
            return out
        at = m.end()
        if m["skip"]:
            continue
        if m["block"]:
            depth = 1
            while depth:
                n = _MARK.search(text, at)
                if n is None:
                    return out
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
            continue
        t = m[0]
        if m["name"]:
            kind = LITERAL if t in ("true", "false") else OTHER if t in _RUST_WORDS else IDENTIFIER
        else:
            kind = OTHER if m["op"] else LITERAL
        out.append(Token(kind, t, m.start()))


def tokens_of(text: str, path: str | None) -> list[Token]:
    return rust_tokens(text) if path and path.endswith(".rs") else python_tokens(text)
