"""Comments and literals of Python and Rust, and words."""

from __future__ import annotations

import re

WORD = re.compile(r"\w+")

_PY = re.compile(
    r'''("""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*+(?:\'\'\'|\Z)|"(?:[^"\\\r\n]|\\(?:\r\n|.))*+"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+')|\#[^\r\n]*+''',
    re.S,
)

_RS = re.compile(
    r"""((?<![A-Za-z0-9_])[bc]?r(?P<h>\#*)"[\s\S]*?(?:"(?P=h)|\Z)|"(?:[^"\\]|\\[\s\S])*+(?:"|\Z)|'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')|//[^\n]*+|(?P<block>/\*)"""
)
_MARK = re.compile(r"/\*|\*/")


def block_end(text: str, start: int) -> int:
    """Where the Rust block comment that opens at ``start`` ends; they nest."""
    depth, at = 1, start + 2
    while depth:
        m = _MARK.search(text, at)
        if m is None:
            return len(text)
        depth += 1 if m[0] == "/*" else -1
        at = m.end()
    return at


def without_python_comments(text: str) -> str:
    if "#" not in text:
        return text
    return _PY.sub(lambda m: m[1] or " ", text)


def without_rust_comments(text: str) -> str:
    if "//" not in text and "/*" not in text:
        return text
    out, at = [], 0
    while True:
        m = _RS.search(text, at)
        if m is None:
            out.append(text[at:])
            return "".join(out)
        if m[1] is not None:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        out.append(text[at : m.start()])
        out.append(" ")
        at = block_end(text, m.start()) if m["block"] else m.end()


def without_comments(text: str, path: str | None) -> str:
    """``text`` with each comment replaced by a blank; the path tells the language."""
    if path is None:
        return text
    if path.endswith(".py"):
        return without_python_comments(text)
    if path.endswith(".rs"):
        return without_rust_comments(text)
    return text
