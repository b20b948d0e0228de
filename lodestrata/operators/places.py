"""What the syntax around a place says: the blocks it lies in, the path, range or operator it belongs to.

Every document is read once into tokens; brackets are matched in one pass, and
each asked place is then looked up in the tokens around it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.tokens import IDENTIFIER, LITERAL, Token, rust_tokens
from lodestrata.runtime import spread

_CLOSING = {"(": ")", "[": "]", "{": "}"}
#: Range types by whether there is a start, an end, and whether the end is included (fixed values).
RANGE_TYPES = {(True, True, False): "Range", (True, False, False): "RangeFrom", (False, True, False): "RangeTo", (False, False, False): "RangeFull", (True, True, True): "RangeInclusive", (False, True, True): "RangeToInclusive"}
_COMPOUND = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
_BINARY = {"==", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>"}


def partners(tokens: list[Token]) -> list[int]:
    """For each bracket the place of its other one, in one pass; -1 for all other tokens and for brackets without one."""
    out = [-1] * len(tokens)
    stack: list[int] = []
    waiting = dict.fromkeys(_CLOSING.values(), 0)
    for i, t in enumerate(tokens):
        if t.text in _CLOSING:
            stack.append(i)
            waiting[_CLOSING[t.text]] += 1
        elif waiting.get(t.text):
            while True:  # brackets left open inside this one have no other
                k = stack.pop()
                waiting[_CLOSING[tokens[k].text]] -= 1
                if _CLOSING[tokens[k].text] == t.text:
                    out[i], out[k] = k, i
                    break
    return out


def base_type_name(text: str) -> str:
    """A type's last segment without generic arguments."""
    return re.sub(r"<.*$", "", text, flags=re.S).split("::")[-1].strip("& ")


@dataclass
class Block:
    """A block of ``mod`` or ``impl`` with what its head names."""

    kind: str
    start: int
    end: int
    name: str
    trait: str | None = None


@dataclass
class RustSource:
    """A Rust text's tokens with matched brackets and blocks."""

    text: str
    tokens: list[Token] = field(init=False)
    other: list[int] = field(init=False)
    starts: list[int] = field(init=False)
    blocks: list[Block] = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = rust_tokens(self.text)
        self.other = partners(self.tokens)
        self.starts = [t.start for t in self.tokens]
        self.blocks = list(self._blocks())

    def _word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def _blocks(self) -> Iterator[Block]:
        for i, t in enumerate(self.tokens):
            if t.text == "mod" and self._word(i + 2) == "{" and self.other[i + 2] >= 0:
                yield Block("mod", t.start, self.starts[self.other[i + 2]] + 1, self._word(i + 1))
            elif t.text == "impl" and self._word(i - 1) not in (":", "->", "(", ",", "&", "<", "=", "+"):
                k, depth, head, bound = i + 1, 0, [], False
                while k < len(self.tokens) and self._word(k) not in ("{", ";"):
                    w = self._word(k)
                    depth += {"<": 1, ">": -1, ">>": -2}.get(w, 0)
                    bound = bound or (w == "where" and depth == 0)
                    if not bound:
                        head.append(w)
                    k += 1
                if self._word(k) != "{" or self.other[k] < 0:
                    continue
                head = _without_parameters(head)
                cut = _top_level(head, "for")
                own = head if cut is None else head[cut + 1 :]
                yield Block("impl", t.start, self.starts[self.other[k]] + 1, "".join(own), None if cut is None else "".join(head[:cut]))

    def at(self, place: int) -> int:
        """The token that starts last at or before ``place``; -1 before the first."""
        return bisect_right(self.starts, place) - 1

    def around(self, place: int, kind: str) -> list[Block]:
        """Blocks of a kind around a place, the outermost first."""
        return sorted((b for b in self.blocks if b.kind == kind and b.start <= place < b.end), key=lambda b: b.start)

    def path_head(self, i: int) -> int:
        """The first component of the path that token ``i`` belongs to."""
        while self._word(i - 1) == "::" and i >= 2 and (self.tokens[i - 2].kind == IDENTIFIER or self._word(i - 2) in ("self", "super", "crate", "Self")):
            i -= 2
        return i

    def use_terminal(self, i: int) -> str | None:
        """Of ``self`` in a use list the segment ahead of the list's brace."""
        if self._word(i) != "self":
            return None
        depth = 0
        for k in range(i - 1, -1, -1):
            w = self._word(k)
            if w == "}":
                depth += 1
            elif w == "{":
                if depth == 0:
                    return self._word(k - 2) if self._word(k - 1) == "::" and self.tokens[k - 2].kind == IDENTIFIER and self._in_use(k) else None
                depth -= 1
            elif w in (";", "(", ")"):
                return None
        return None

    def _in_use(self, i: int) -> bool:
        for k in range(i, -1, -1):
            w = self._word(k)
            if w == "use":
                return True
            if w == ";" or (w not in ("{", "}", ",", "::", "self", "super", "crate", "as", "*") and self.tokens[k].kind != IDENTIFIER):
                return False
        return False

    def super_depth(self, i: int) -> int | None:
        """How many ``super`` its path has up to this one."""
        if self._word(i) != "super":
            return None
        return sum(self._word(k) == "super" for k in range(self.path_head(i), i + 1))

    def range_type(self, i: int) -> str | None:
        """The type a range sign stands for, by which of its ends are there."""
        if self._word(i) not in ("..", "..="):
            return None
        before, after = self.tokens[i - 1] if i else None, self.tokens[i + 1] if i + 1 < len(self.tokens) else None
        has_start = before is not None and (before.kind in (IDENTIFIER, LITERAL) or before.text in (")", "]", "self", "?"))
        has_end = after is not None and (after.kind in (IDENTIFIER, LITERAL) or after.text in ("(", "[", "self", "&", "*", "-", "!", "crate", "super", "Self"))
        return RANGE_TYPES.get((has_start, has_end, self._word(i) == "..="))

    def construct(self, start: int, end: int) -> str | None:
        """What is done at a place: ``binary +``, ``unary -``, ``compound +=``, ``index``, ``call``, ``try`` or ``for``; a place beside a sign counts as its."""
        i = self.at(start)
        for k in (i, i + 1):
            w = self._word(k)
            if not w or (k == i + 1 and self.starts[k] > end):
                continue
            operand = k > 0 and (self.tokens[k - 1].kind in (IDENTIFIER, LITERAL) or self._word(k - 1) in (")", "]", "self", "?"))
            if w in _COMPOUND:
                return f"compound {w}"
            if w in _BINARY and operand:
                return f"binary {w}"
            if w in ("-", "!", "*"):
                return f"unary {w}"
            if w == "?":
                return "try"
            if w == "[" and operand:
                return "index"
            if w == "(" and operand:
                return "call"
            if w == "for" and self._word(k - 1) != "impl":
                return "for"
        return None


def _without_parameters(words: list[str]) -> list[str]:
    """An impl's head without the generic parameters right behind ``impl``."""
    if not words or words[0] != "<":
        return words
    depth = 0
    for i, w in enumerate(words):
        depth += {"<": 1, ">": -1, ">>": -2}.get(w, 0)
        if depth <= 0:
            return words[i + 1 :]
    return []


def _top_level(words: list[str], wanted: str) -> int | None:
    depth = 0
    for i, w in enumerate(words):
        depth += {"<": 1, ">": -1, ">>": -2, "(": 1, ")": -1}.get(w, 0)
        if w == wanted and depth == 0 and words[i + 1 : i + 2] != ["<"]:
            return i
    return None


def dotted_around(text: str, start: int, end: int) -> list[str]:
    """Dotted names of a Python text that begin with the place's own name and go on behind it, the shortest first."""
    a = start
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_."):
        a -= 1
    out, at = [], end
    while True:
        m = re.compile(r"\.[^\W\d]\w*").match(text, at)
        if m is None:
            return out
        at = m.end()
        out.append(text[a:at])


def children(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the outermost parts wholly inside a span of Rust text: single tokens, and brackets with all they hold."""
    s = RustSource(text)
    out, i = [], bisect_right(s.starts, start - 1)
    while i < len(s.tokens) and s.starts[i] < end:
        k = s.other[i] if s.other[i] > i else i
        stop = s.starts[k] + len(s.tokens[k].text)
        if stop <= end:
            out.append((s.starts[i], stop))
            i = k + 1
        else:  # a bracket that closes outside: what it holds lies further in
            i += 1
    return out


_FACTS = pa.schema(
    [("occurrence_id", pa.string()), ("document_path", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("found", pa.string()), ("length", pa.int32()), ("name_at", pa.string()), ("impl_type", pa.string()), ("impl_trait", pa.string()), ("modules", pa.list_(pa.string())), ("use_terminal", pa.string())]
    + [("super_depth", pa.int32()), ("path_start_self", pa.bool_()), ("path_head", pa.string()), ("range_type", pa.string()), ("construct", pa.string()), ("dotted", pa.list_(pa.string()))]
)
_DDL = "occurrence_id string, document_path string, span_start int, span_end int, found string, length int, name_at string, impl_type string, impl_trait string, modules array<string>, use_terminal string, super_depth int, path_start_self boolean, path_head string, range_type string, construct string, dotted array<string>"


def facts_at(path: str, text: str, spans: list[tuple[str, int, int]]) -> Iterator[dict]:
    """The facts of each (id, start, end) of one document; places count characters."""
    rust = RustSource(text) if path.endswith(".rs") else None
    for i, a, z in spans:
        row: dict = {"occurrence_id": i, "document_path": path, "span_start": a, "span_end": z, "found": text[a:z], "length": len(text)}
        if rust is None:
            row["dotted"] = dotted_around(text, a, z) if path.endswith(".py") else []
            m = re.compile(r"[^\W\d]\w*").fullmatch(text, a, z)
            row["name_at"] = m and m[0]
        else:
            k = rust.at(a)
            whole = k >= 0 and z <= rust.starts[k] + len(rust.tokens[k].text)
            row["name_at"] = rust.tokens[k].text if whole and (rust.tokens[k].kind == IDENTIFIER or rust.tokens[k].text in ("Self", "self")) else None
            impls = rust.around(a, "impl")
            if impls:
                row["impl_type"], row["impl_trait"] = impls[-1].name, impls[-1].trait
            row["modules"] = [b.name for b in rust.around(a, "mod")]
            if whole:
                row["use_terminal"], row["super_depth"], row["range_type"] = rust.use_terminal(k), rust.super_depth(k), rust.range_type(k)
                row["path_start_self"] = rust._word(k) == "self" and rust._word(k + 1) == "::" and rust._word(k - 1) != "::"
                row["path_head"] = rust.tokens[rust.path_head(k)].text if rust.tokens[k].kind == IDENTIFIER else None
            row["construct"] = rust.construct(a, z)
        yield row


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, text, spans in zip(*(b.column(c).to_pylist() for c in ("document_path", "text", "spans"))):
            rows = [{**dict.fromkeys(_FACTS.names), **r} for r in facts_at(path, text, [(s["i"], s["a"], s["z"]) for s in spans])]
            yield pa.RecordBatch.from_pylist(rows, schema=_FACTS)


def place_facts(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """Facts of every place (occurrence_id, document_path, span_start, span_end) whose document is in ``files`` (document_path, text).

    found, length (of the document), name_at (the name around the place);
    impl_type and impl_trait of the nearest impl; modules (names of inline
    modules, outermost first); use_terminal, super_depth, path_start_self,
    path_head; range_type; construct; dotted (Python's dotted names that go on
    behind the place). A document's text is read once for all its places.
    """
    spans = occurrences.where("document_path IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL").groupBy("document_path").agg(F.collect_list(F.struct(F.col("occurrence_id").cast("string").alias("i"), F.col("span_start").cast("int").alias("a"), F.col("span_end").cast("int").alias("z"))).alias("spans"))
    texts = files.where("document_path IS NOT NULL AND text IS NOT NULL").select("document_path", "text").dropDuplicates(["document_path"])
    return spread(texts.join(spans, "document_path").select("document_path", "text", "spans")).mapInArrow(_read, _DDL)


# --- tiers ----------------------------------------------------------------------

def rust_tiers(text: str) -> tuple[str, str, int]:
    """(signature, interface, end of the head): up to the body; the documentation ahead belongs to the interface."""
    s = RustSource(text)
    first = 0
    while first < len(s.tokens) and s._word(first) == "#" and s._word(first + 1) == "[" and s.other[first + 1] >= 0:
        first = s.other[first + 1] + 1
    if first >= len(s.tokens):
        return text, text, len(text)
    at = s.starts[first]
    depth = 0
    for k in range(first, len(s.tokens)):
        w = s._word(k)
        depth += (w in "([") - (w in ")]") if len(w) == 1 else 0
        if depth == 0 and w in ("{", ";", "="):
            signature = text[at : s.starts[k]].rstrip()
            return signature, text[: s.starts[k]].strip(), s.starts[k]
    return text[at:], text, len(text)


_PY_HEAD = re.compile(r"(?m)^[ \t\ufeff]*(?:async[ \t]+)?(?:def|class)\b")


def python_tiers(text: str) -> tuple[str, str, int]:
    """(signature, interface, end of the head): up to the head's colon; the docstring belongs to the interface."""
    import ast

    m = _PY_HEAD.search(text)
    if m is None:
        return text, text, len(text)
    depth, k, quote = 0, m.end(), None
    while k < len(text):
        c = text[k]
        if quote:
            quote = None if c == quote and text[k - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            break
        k += 1
    signature = text[m.start() : k + 1].strip(" \t\r\n\ufeff")
    d = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*([rRuU]?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*\"|'[^'\n]*'))[ \t]*(?=[\r\n;#]|\Z)").match(text, k + 1)
    if d is None:
        return signature, signature, k + 1
    try:
        ast.literal_eval(d[1])
    except (ValueError, SyntaxError):
        return signature, signature, k + 1
    return signature, f"{signature}\n{d[1]}", k + 1


def _tiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(rust_tiers if p.endswith(".rs") else python_tiers)(t) for p, t in zip(b.column("document_path").to_pylist(), b.column("text").to_pylist())]
        s, i, h = zip(*got) if got else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.string()), pa.array(i, pa.string()), pa.array(h, pa.int32())], ["id", "signature_text", "interface_text", "header_end"])


def declaration_tiers(declarations: DataFrame, key: str = "canonical_id", text: str = "span_text") -> DataFrame:
    """(key, signature_text, interface_text, header_end) of declarations (key, document_path, text).

    The signature is the head up to the body, the interface the signature with
    its documentation; what has no such head is its own signature and interface.
    Rows without text or path are left out.
    """
    rows = declarations.where(F.col(text).isNotNull() & F.col("document_path").isNotNull()).select(F.col(key).alias("id"), "document_path", F.col(text).alias("text"))
    return spread(rows).mapInArrow(_tiers, "id string, signature_text string, interface_text string, header_end int").withColumnRenamed("id", key)
