"""What sources declare, call and import, as rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.functions.tokens import IDENTIFIER, Token, rust_tokens
from lodestrata.operators.places import partners
from lodestrata.runtime import spread

_SCHEMA = "document_path string, fact string, name string, detail string, start int, end int, outer_start int, outer_end int"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_RUST_KINDS = {"fn": "function", "struct": "type", "enum": "type", "union": "type", "trait": "trait", "mod": "module", "const": "constant", "static": "constant", "type": "type"}


def _python_facts(text: str) -> list[tuple]:
    """(fact, name, detail, start, end, outer start, outer end), places in characters; nothing where it does not parse."""
    mark = text[:1] == "\ufeff"
    text = text[1:] if mark else text
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = text.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    raw = [x.encode() for x in lines]

    def at(line: int, column: int) -> int:
        return starts[line - 1] + len(raw[line - 1][:column].decode(errors="ignore")) if line - 1 < len(raw) else starts[-1]

    def span(n) -> tuple[int, int]:
        return at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)

    out: list[tuple] = []
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, z = span(n)
            where = text.find(n.name, a, z)
            kind = "type" if isinstance(n, ast.ClassDef) else "function"
            out.append(("declaration", n.name, kind, where, where + len(n.name), a, z))
            if isinstance(n, ast.ClassDef):
                for base in n.bases:
                    p, q = span(base)
                    out.append(("base", n.name, text[p:q], p, q, a, z))
                for x in n.body:
                    bound = [x.name] if hasattr(x, "name") else [t.id for t in getattr(x, "targets", [getattr(x, "target", None)]) if isinstance(t, ast.Name)]
                    for name in bound:
                        out.append(("binding", n.name, name, *span(x), a, z))
        elif isinstance(n, ast.Call):
            f = n.func
            a, z = span(f)
            if isinstance(f, ast.Attribute):
                p, q = span(f.value)
                out.append(("call", f.attr, text[p:q], z - len(f.attr), z, *span(n)))
            elif isinstance(f, ast.Name):
                out.append(("call", f.id, None, a, z, *span(n)))
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            a, z = span(n)
            module = "." * getattr(n, "level", 0) + (getattr(n, "module", None) or "") if isinstance(n, ast.ImportFrom) else None
            for x in n.names:
                out.append(("relative_import" if module and module.startswith(".") else "import", x.name, module, *span(x), a, z))
                if x.asname:
                    out.append(("alias", x.asname, x.name, *span(x), a, z))
    doc = ast.get_docstring(tree, clean=False)
    if doc is not None:
        out.append(("module_documentation", "", doc, *span(tree.body[0]), 0, len(text)))
    # places count the byte-order mark the parser doesn't see
    return [(*f[:3], *(x + mark for x in f[3:])) for f in out]


def _end(tokens: list[Token], other: list[int], i: int, text: str) -> int:
    """Where an item ends: at its body's closing brace or its semicolon."""
    k = i
    while k < len(tokens):
        t = tokens[k].text
        if t in ("(", "["):
            if other[k] < 0:
                break
            k = other[k]
        elif t == "{":
            return tokens[other[k]].start + 1 if other[k] >= 0 else len(text)
        elif t == ";":
            return tokens[k].start + 1
        k += 1
    return len(text)


_INNER_LINES = re.compile(r"[\s\ufeff]*((?://![^\n]*(?:\n[ \t]*|\Z))+)")
_INNER_BLOCK = re.compile(r"[\s\ufeff]*/\*!([\s\S]*?)\*/")


def _rust_module_documentation(text: str) -> list[tuple]:
    """What a document says about itself ahead of everything else."""
    m = _INNER_LINES.match(text)
    if m is not None:
        said = "\n".join(x.strip()[3:].strip() for x in m[1].rstrip().split("\n"))
        end = m.start(1) + len(m[1].rstrip())
        return [("module_documentation", "", said, m.start(1), end, 0, len(text))]
    m = _INNER_BLOCK.match(text)
    return [] if m is None else [("module_documentation", "", m[1].strip(), m.start(1) - 3, m.end(), 0, len(text))]


def _rust_facts(text: str) -> list[tuple]:
    tokens = rust_tokens(text)
    other = partners(tokens)
    out: list[tuple] = _rust_module_documentation(text)
    attributes: list[str] = []
    first = 0
    for i, t in enumerate(tokens):
        following = tokens[i + 1] if i + 1 < len(tokens) else None
        if t.text == "#" and following and following.text == "[":
            close = other[i + 1] if other[i + 1] >= 0 else len(tokens) - 1
            attributes.append("".join(x.text for x in tokens[i + 2 : close]))
            continue
        if t.text in _RUST_KINDS and following and following.kind == IDENTIFIER and not (t.text == "const" and i and tokens[i - 1].text == "*"):
            a, z = t.start, _end(tokens, other, i, text)
            span = (following.start, following.start + len(following.text))
            out.append(("declaration", following.text, _RUST_KINDS[t.text], *span, a, z))
            if t.text == "mod" and i + 2 < len(tokens) and tokens[i + 2].text == ";":
                out.append(("module_file", following.text, next((x for x in attributes if x.startswith("path=")), None), *span, a, z))
            if any(x == "test" or x.endswith("::test") or x.startswith(("test(", "tokio::test(")) for x in attributes):
                out.append(("test_attribute", following.text, None, *span, a, z))
            if "cfg(test)" in attributes and t.text == "mod":
                out.append(("test_module", following.text, None, *span, a, z))
            attributes = []
        elif t.text == "impl":
            k = i + 1
            if k < len(tokens) and tokens[k].text == "<":
                depth = 0
                while k < len(tokens):
                    depth += (tokens[k].text == "<") - (tokens[k].text == ">") - 2 * (tokens[k].text == ">>")
                    k += 1
                    if depth <= 0:
                        break
            head = []
            while k < len(tokens) and tokens[k].text not in ("{", ";", "where"):
                head.append(tokens[k])
                k += 1
            cut = next((x for x, y in enumerate(head) if y.text == "for"), None)
            if head:
                trait = "".join(x.text for x in head[:cut]) if cut is not None else None
                own = "".join(x.text for x in head[(cut + 1 if cut is not None else 0) :])
                out.append(("impl", own, trait, head[0].start, head[-1].start + len(head[-1].text), t.start, _end(tokens, other, i, text)))
            attributes = []
        elif t.kind == IDENTIFIER and following and following.text == "(" and not (i and tokens[i - 1].text in ("fn", "#", "[")):
            receiver = tokens[i - 2].text if i > 1 and tokens[i - 1].text in (".", "::") else None
            close = tokens[other[i + 1]]
            out.append(("call", t.text, receiver, t.start, t.start + len(t.text), t.start, close.start + 1))
        elif t.text == "use":
            first = i
        elif t.text == "as" and following and following.kind == IDENTIFIER and i and any(x.text == "use" for x in tokens[first:i]) and not any(x.text == ";" for x in tokens[first:i]):
            out.append(("alias", following.text, tokens[i - 1].text, tokens[i - 1].start, following.start + len(following.text), tokens[first].start, _end(tokens, other, first, text)))
        elif t.text in ("{", "}", ";"):
            attributes = []
    return out


def facts_of(text: str, path: str) -> list[tuple]:
    return _rust_facts(text) if path.endswith(".rs") else _python_facts(text)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] * 4 + [pa.int32()] * 4
    for b in batches:
        rows = [(p, *f) for p, t in zip(b.column("document_path").to_pylist(), b.column("text").to_pylist()) for f in facts_of(t, p)]
        cols = list(zip(*rows)) or [[] for _ in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _NAMES)


def extract(files: DataFrame) -> DataFrame:
    """Facts of ``.py`` and ``.rs`` files (document_path, text).

    ``fact`` is declaration, call, base, binding, impl, import, relative_import,
    alias, module_file, test_attribute, test_module or module_documentation;
    ``start`` and ``end`` place its name, the outer ones the whole construct, in
    characters. Python that does not parse gives nothing.
    """
    known = files.where("document_path IS NOT NULL AND text IS NOT NULL AND (document_path LIKE '%.py' OR document_path LIKE '%.rs')")
    return spread(known.select("document_path", "text")).mapInArrow(_facts, _SCHEMA)


def unresolved_calls(facts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Calls whose name no occurrence (document_path, span_start, span_end) covers exactly."""
    calls = facts.where("fact = 'call'").select("document_path", "name", "detail", "start", "end")
    covered = occurrences.select("document_path", occurrences.span_start.alias("start"), occurrences.span_end.alias("end")).distinct()
    return calls.join(covered, ["document_path", "start", "end"], "left_anti").withColumnRenamed("detail", "receiver")
