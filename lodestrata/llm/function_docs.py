"""Functions paired with their own documentation."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import peg
from lodestrata.llm.lexing import WORD, block_end
from lodestrata.llm.peg import ahead, brackets, choice, many, maybe, rule, seq, terminal
from lodestrata.runtime import latest_per_key, spread

#: Fewer different words than this, names and tag lines aside, are trivial.
LEAST_WORDS = 6

_LINES = re.compile(r"\r\n|\r|\n")


# --- Python -----------------------------------------------------------------

def _string_parts(s: peg.State, start: int, end: int, value) -> tuple[str, str] | None:
    """(prefix, evaluated text) of one string literal."""
    literal = s.text[start:end]
    prefix = re.match(r"[A-Za-z]*", literal)[0].lower()
    if not set(prefix) <= {"r", "u"}:
        return prefix, ""
    try:
        return prefix, ast.literal_eval(literal)
    except (ValueError, SyntaxError):
        body = literal[len(prefix) :]
        marks = 3 if body[:3] in ('"""', "'''") else 1
        return prefix, body[marks:-marks]


def _python() -> peg.Parser:
    string = rule(
        terminal(
            r'''(?:[rRuUbBfFtT]{0,2})(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*+\'\'\'|"(?:[^"\\\r\n]|\\(?:\r\n|.))*+"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+')''',
            re.S,
        ),
        _string_parts,
    )
    comment = terminal(r"#[^\r\n]*")
    blanks = terminal(r"(?:[ \t\f]|\\\r?\n)*")
    space = rule(many(choice(terminal(r"(?:[ \t\f\r\n\ufeff]|\\\r?\n)+"), comment)))
    nested = brackets(terminal(r"[^()\[\]{}\"'#rRuUbBfFtT]+"), string, comment, terminal(r"[rRuUbBfFtT][^\s()\[\]{}\"'#]*"))
    rest_of_line = many(choice(terminal(r"[^()\[\]{}\"'#\r\nrRuUbBfFtT\\]+"), string, nested, terminal(r"\\\r?\n"), terminal(r"[rRuUbBfFtT\\][^\s()\[\]{}\"'#\\]*")))
    decorator = seq(terminal("@"), rest_of_line, maybe(comment), terminal(r"[\r\n]+"), space)
    annotation = many(choice(terminal(r"[^()\[\]{}\"'#:\r\nrRuUbBfFtT\\]+"), string, nested, terminal(r"\\\r?\n"), terminal(r"[rRuUbBfFtT\\][^\s()\[\]{}\"'#:\\]*")))
    name = rule(terminal(r"[^\W\d]\w*"))
    # the first statement: strings side by side, perhaps in parentheses, and nothing else
    strings = many(seq(string, blanks), 1)
    bracketed = choice(_wrapped(many(seq(string, space), 1), space, blanks), strings)
    docstring = rule(seq(terminal(r"[ \t\f]*"), bracketed, ahead(choice(terminal(r"[;#\r\n]"), terminal(r"\Z")))), lambda s, a, b, v: (a, b, _doc_text(v)))
    newline = terminal(r"[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\r|\n)")
    empty = terminal(r"[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\r|\n)")
    suite = choice(seq(newline, many(empty), maybe(docstring)), seq(maybe(docstring)))
    rest = terminal(r"[\s\S]*")
    head = seq(terminal(r"def\b"), blanks, name, space, maybe(seq(nested, space)), maybe(seq(nested, space)), maybe(seq(terminal("->"), annotation)), terminal(r"[ \t\f]*:"))
    return seq(space, many(decorator), maybe(seq(terminal(r"async\b"), space)), head, suite, rest)


def _wrapped(body: peg.Parser, space: peg.Parser, blanks: peg.Parser) -> peg.Parser:
    """``body`` within one or more parentheses, which are counted, not nested."""

    def run(s: peg.State, i: int):
        depth = 0
        while s.text.startswith("(", i):
            depth += 1
            i = space(s, i + 1)[0]
        got = body(s, i) if depth else None
        if got is None:
            return None
        i, value = got
        for k in range(depth):
            if not s.text.startswith(")", i):
                return None
            i = (space if k < depth - 1 else blanks)(s, i + 1)[0]
        return i, value

    return run


def _doc_text(value) -> str | None:
    """The text of the strings in a parse of ``docstring``; null if one is no plain string."""
    found: list[tuple[str, str]] = []

    def walk(v) -> None:
        if isinstance(v, tuple) and len(v) == 2 and isinstance(v[0], str):
            found.append(v)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(value)
    if not found or any(not set(p) <= {"r", "u"} for p, _ in found):
        return None
    return "".join(t for _, t in found)


# --- Rust -------------------------------------------------------------------

def _unescape(body: str) -> str:
    """A Rust string literal's text."""

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "\r\n":
            return ""
        if e[0] == "x":
            return chr(int(e[1:], 16))
        if e[0] == "u":
            return chr(int(e[2:-1].replace("_", ""), 16))
        return {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}.get(e, e)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|\r?\n\s*|[\s\S])", one, body)


def _rust_string(s: peg.State, a: int, b: int, value) -> str:
    literal = s.text[a:b]
    raw = re.match(r'r(#*)"', literal)
    if raw:
        return literal[raw.end() : len(literal) - 1 - len(raw[1])]
    return _unescape(literal[1:-1])


def _block(s: peg.State, i: int):
    if not s.text.startswith("/*", i):
        return None
    end = block_end(s.text, i)
    return end, (i, end)


def _block_lines(s: peg.State, a: int, b: int, value) -> tuple[str, list[str]]:
    """A block comment's lines without its marks."""
    text = s.text[a:b]
    if not re.match(r"/\*\*(?![*/])", text):
        return "skip", []
    body = text[3:-2] if text.endswith("*/") else text[3:]
    return "doc", [re.sub(r"^[ \t]*\*(?!\*)", "", x, count=1) for x in _LINES.split(body)]


def _rust() -> peg.Parser:
    def skipped(s, a, b, v):
        return "skip", []

    blank = rule(terminal(r"[\s\ufeff]+"), skipped)
    line_doc = rule(terminal(r"///(?!/)[^\n]*"), lambda s, a, b, v: ("doc", [s.text[a + 3 : b]]))
    line = rule(terminal(r"//[^\n]*"), skipped)
    block = rule(_block, _block_lines)
    string = rule(terminal(r'''r(?P<h>\#*)"[\s\S]*?"(?P=h)|"(?:[^"\\]|\\[\s\S])*+"'''), _rust_string)
    gap = many(choice(terminal(r"\s+"), line, block))
    parts = [terminal(r"[^()\[\]{}\"'/r]+"), string, line, block, terminal(r"'(?:[^'\\\r\n]|\\.)'"), terminal(r"['/r]")]
    nested = brackets(*parts)
    inside = many(choice(*parts, nested))
    opened = seq(terminal(r"#"), gap, terminal(r"\["), gap)
    doc_attr = rule(seq(opened, terminal(r"doc\b"), gap, terminal(r"="), gap, string, gap, terminal(r"\]")), lambda s, a, b, v: ("doc", _LINES.split(v[5])))
    attr = rule(seq(opened, inside, terminal(r"\]")), skipped)
    outer = rule(many(choice(blank, line_doc, line, block, doc_attr, attr)), lambda s, a, b, v: [x for kind, lines in v if kind == "doc" for x in lines])
    words = many(seq(choice(seq(terminal(r"pub\b"), gap, maybe(nested)), terminal(r"(?:default|const|async|unsafe|safe)\b"), seq(terminal(r"extern\b"), gap, maybe(string))), gap))
    name = rule(terminal(r"(?:r#)?[^\W\d]\w*"))
    head = seq(terminal(r"fn\b"), gap, name)
    return seq(outer, words, head, terminal(r"[\s\S]*"))


_GRAMMARS: dict[str, peg.Parser] = {}


def _grammar(language: str) -> peg.Parser:
    if language not in _GRAMMARS:
        _GRAMMARS[language] = {".py": _python, ".rs": _rust}[language]()
    return _GRAMMARS[language]


def parse_function(text: str, language: str) -> tuple[list[str] | None, int, int, int, int] | None:
    """(documentation lines or None, name span, documentation-free code span) of one function.

    Null where ``text`` is no function of the language. For Python the code span
    is the whole text and the docstring's own span tells what to leave out; it
    is given as (code start, code end). For Rust the code starts at the first
    word of the declaration.
    """
    got = _grammar(language)(peg.State(text), 0)
    if got is None:
        return None
    v = got[1]
    if language == ".py":
        name, suite = v[3][2], v[4]
        doc = suite[-1]
        if doc is None or doc[2] is None:
            return None, name[0], name[1], -1, -1
        return _LINES.split(doc[2]), name[0], name[1], doc[0], doc[1]
    outer, name = v[0], v[2][2]
    start = next((x for x in _starts(v[1])), v[2][0][0])
    return (outer or None), name[0], name[1], start, len(text)


def _starts(value):
    if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], int):
        yield value[0]
    elif isinstance(value, list):
        for x in value:
            yield from _starts(x)


def telling_words(lines: list[str], display_name: str | None) -> int:
    """Different words of the documentation without tag lines and words of the name."""
    kept = [x for x in lines if not x.strip().startswith(("@", ":"))]
    words = set(WORD.findall("\n".join(kept).lower()))
    return len(words - set((display_name or "").lower().split("_")))


def pair_of(text: str, path: str, display_name: str | None, least: int = LEAST_WORDS) -> tuple[str, str] | None:
    """(code, description), or null where the function has no telling documentation."""
    language = path[-3:]
    got = parse_function(text, language)
    if got is None or got[0] is None:
        return None
    lines, _, _, a, b = got
    if telling_words(lines, display_name) < least:
        return None
    code = text[:a].rstrip(" \t") + text[b:].lstrip("\r\n") if language == ".py" else text[a:b]
    return code, "\n".join(x.strip() for x in lines).strip()


def _pairs(least: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, words = [], []
            for text, path, name in zip(b.column("text").to_pylist(), b.column("path").to_pylist(), b.column("name").to_pylist()):
                got = pair_of(text, path, name, least)
                code.append(got and got[0])
                words.append(got and got[1])
            found = pa.array([x is not None for x in code])
            if with_text:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), found, b.column("signature"), pa.array(code, pa.string()), pa.array(words, pa.string())], ["id", "at", "found", "signature", "code", "description"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), found], ["id", "at", "found"])

    return run


def documented_functions(symbols: DataFrame, least: int = LEAST_WORDS, with_text: bool = True) -> DataFrame:
    """In-workspace functions and methods with telling documentation of their own.

    Result: canonical_id and, ``with_text``, signature_text, code (the source
    without its documentation) and description. Rows without id, text or a
    ``.py``/``.rs`` path give none; brackets may nest to any depth; a null
    display_name removes no words; text that does not parse as a function has no documentation. Of a symbol
    delivered again the latest row holds. Extra columns are ignored.
    """
    wanted = F.lower(F.regexp_replace("kind", r"^\s+|\s+$", "")).isin("function", "method") & (F.col("class") == "in_workspace") & F.col("canonical_id").isNotNull() & F.col("span_text").isNotNull() & (F.col("document_path").endswith(".py") | F.col("document_path").endswith(".rs"))
    rows = symbols.where(wanted).select(F.col("canonical_id").alias("id"), F.col("indexed_at").alias("at"), F.col("span_text").alias("text"), F.col("document_path").alias("path"), F.col("display_name").alias("name"), *[F.col("signature_text").alias("signature")] * with_text)
    at = dict(rows.dtypes)["at"]
    schema = f"id string, at {at}, found boolean" + ", signature string, code string, description string" * with_text
    got = spread(rows).mapInArrow(_pairs(least, with_text), schema)
    columns = ["found", *["signature", "code", "description"] * with_text]
    held = latest_per_key(got, "id", "at", *columns).where("found")
    kept = [F.col("id").alias("canonical_id")]
    if with_text:
        kept += [F.col("signature").alias("signature_text"), "code", "description"]
    return held.select(*kept)
