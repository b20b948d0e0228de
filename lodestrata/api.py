"""The questions one asks of an index, over its tables."""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import clones, graph, impact, intervals, paging, resolution, retrieval, similarity

#: What a call gives out unless told otherwise (fixed values).
LIMIT, GET_LINES, LIST_LINES, IMPACT_DEPTH = 25, 100, 10, 1
#: As many ranks as there can be.
EVERY = 2**31 - 1
DETAILS = ("location", "signature", "interface", "body")
RELATIONS = ("containers", "contains", "references", "dependents", "importers", "implementers", "implements", "tests")


@dataclass(frozen=True)
class Answer:
    """An outcome (found, ambiguous, absent, not_comparable or empty) and its rows."""

    outcome: str
    rows: DataFrame | None = None


class Index:
    """The tables of one index; every question is a plan over them.

    ``symbols``: canonical_id, display_name, kind, class, workspace_id,
    document_path, span_start, span_end, start_line, end_line, span_text,
    signature_text, test_rule; ``edges``: kind, src, dst; ``occurrences``:
    symbol_id, document_path, span_start, role, enclosing_id; ``passages``: id,
    symbol_id, render. The last two may be left out where no question needs them.
    """

    def __init__(self, symbols: DataFrame, edges: DataFrame, occurrences: DataFrame | None = None, passages: DataFrame | None = None):
        self.symbols, self.edges, self.occurrences, self.passages = symbols, edges, occurrences, passages

    def _resolved(self, reference: str) -> Answer:
        spark = self.symbols.sparkSession
        row = resolution.resolve(spark.createDataFrame([(reference,)], "reference string"), self.symbols).first()
        if row.outcome != "unique":
            return Answer(row.outcome, None if row.outcome == "absent" else self.symbols.where((F.col("display_name") == reference) | F.col("canonical_id").endswith(f"::{reference}")).orderBy("canonical_id").limit(LIMIT))
        return Answer("found", self.symbols.where(F.col("canonical_id") == row.canonical_id))

    def _detail(self, rows: DataFrame, detail: str, start: int = 1, lines: int = GET_LINES) -> DataFrame:
        if detail not in DETAILS:
            raise ValueError(f"detail is one of {', '.join(DETAILS)}")
        # the interface is the head with its documentation where the index has it, else the head
        interface = F.coalesce(*[F.col(c) for c in ("interface_text", "signature_text", "display_name") if c in rows.columns])
        content = {"location": F.lit(None).cast("string"), "signature": F.col("signature_text"), "interface": interface, "body": F.col("span_text")}[detail]
        return rows.select("canonical_id", "kind", "document_path", "start_line", "end_line", tx.window_lines(content, start, lines).alias("content"))

    def get(self, reference: str, detail: str = "body", start: int = 1, lines: int = GET_LINES) -> Answer:
        got = self._resolved(reference)
        return got if got.outcome != "found" else Answer("found", self._detail(got.rows, detail, start, lines))

    def _placed(self, document: str, offset: int | None, line: int | None, column: int | None) -> Answer:
        """The innermost symbol at an offset or a line and column; of a line alone the outermost symbols that start or lie there."""
        spark = self.symbols.sparkSession
        here = self.symbols.where(F.col("document_path") == document)
        if here.isEmpty():
            return Answer("absent")
        if offset is not None:
            spans = here.select("canonical_id", "document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
            hit = intervals.innermost(spark.createDataFrame([(0, document, offset)], "p int, document_path string, point long"), spans, "p", "canonical_id")
        elif line is not None and column is not None:
            hit = intervals.innermost_by_line(spark.createDataFrame([(0, document, line, column)], "p int, document_path string, line int, column int"), here, "p", "canonical_id")
        elif line is not None:
            # headers on the line, the outermost of them; without one whatever lies around the line, innermost
            heads = here.where(F.col("start_line") == line).select("canonical_id", "document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
            hit = intervals.outermost(heads, "canonical_id", ["document_path"])
            if hit.isEmpty():
                spans = here.select("canonical_id", "document_path", F.col("start_line").cast("long").alias("start"), (F.col("end_line") + 1).cast("long").alias("end"))
                hit = intervals.innermost(spark.createDataFrame([(0, document, line)], "p int, document_path string, point long"), spans, "p", "canonical_id")
        else:
            raise ValueError("a place is an offset, a line, or a line and a column")
        rows = self.symbols.join(hit.select("canonical_id"), "canonical_id", "left_semi")
        n = rows.limit(2).count()
        return Answer("absent") if n == 0 else Answer("found" if n == 1 else "ambiguous", rows)

    def _subject(self, reference: str | None, place: dict | None) -> Answer:
        """The subject by its name, or by its place: document with offset, line, or line and column."""
        if (reference is None) == (place is None):
            raise ValueError("a subject is given by its reference or by its place")
        if reference is not None:
            return self._resolved(reference)
        return self._placed(place["document"], place.get("offset"), place.get("line"), place.get("column"))

    def at(self, document: str, offset: int | None = None, detail: str = "location", line: int | None = None, column: int | None = None) -> Answer:
        """The innermost symbol at an offset or a line and column, or the outermost that starts on a line."""
        got = self._placed(document, offset, line, column)
        return got if got.rows is None else Answer(got.outcome, self._detail(got.rows, detail))

    def find(self, fragment: str, limit: int = LIMIT) -> DataFrame:
        return resolution.find(self.symbols, fragment).select("canonical_id", "display_name", "kind").limit(limit)

    def trace(self, reference: str, relation: str, depth: int = 20, ranked: bool = True) -> Answer:
        if relation not in RELATIONS:
            raise ValueError(f"relation is one of {', '.join(RELATIONS)}")
        got = self._resolved(reference)
        if got.outcome != "found":
            return got
        me = got.rows.select(F.col("canonical_id").alias("node"))
        name = got.rows.first().canonical_id
        edge = lambda kind, a, b: self.edges.where((F.col(a) == name) & F.col("kind").isin(kind)).select(F.col(b).alias("node")).distinct()
        if relation == "dependents":
            rows = graph.dependents(self.edges, me, depth)
            rows = graph.ranked_dependents(rows, graph.page_rank(*graph.rank_projection(self.edges, self.symbols)) if ranked else rows.select("node", F.lit(0.0).alias("rank")))
        elif relation in ("references", "tests"):
            rows = self.occurrences.where((F.col("symbol_id") == name) & (F.col("role") == "reference"))
            if relation == "tests":
                # the rule of the declaration around the place, else of its document's module
                own = self.symbols.select(F.col("canonical_id").alias("enclosing_id"), F.col("test_rule").alias("_own"))
                module = self.symbols.where("kind = 'module' AND document_path IS NOT NULL").groupBy("document_path").agg(F.min("test_rule").alias("_module"))
                rows = rows.join(own, "enclosing_id", "left").join(module, "document_path", "left").where("coalesce(_own, _module) IS NOT NULL").drop("_own", "_module")
            rows = rows.orderBy("document_path", "span_start")
        else:
            kinds, a, b = {"contains": (["contains"], "src", "dst"), "containers": (["contains"], "dst", "src"), "importers": (["imports"], "dst", "src"), "implementers": (["type_hierarchy", "overrides"], "dst", "src"), "implements": (["type_hierarchy", "overrides"], "src", "dst")}[relation]
            rows = edge(kinds, a, b).orderBy("node")
        return Answer("empty" if rows.isEmpty() else "found", rows)

    def _ranking(self, text: str, vectors: DataFrame | None = None) -> DataFrame:
        """(symbol_id, place) of every passage that matches."""
        spark = self.symbols.sparkSession
        index = retrieval.postings(self.passages.dropDuplicates(["id"]), "id", "render")
        asked = spark.createDataFrame([(text,)], "t string").select(F.lit(0).alias("query"), F.explode(tx.split_words(F.col("t"))).alias("word"))
        scored = retrieval.bm25(index, "id", asked, retrieval.corpus_totals(index, "id"))
        signals = [retrieval.ranked(scored, "query", "id", F.col("score").desc(), EVERY), *([vectors] if vectors is not None else [])]
        return retrieval.fuse(*signals).join(self.passages.select("id", "symbol_id").dropDuplicates(["id"]), "id").select("symbol_id", "place")

    def search(self, text: str, limit: int = LIMIT, vectors: DataFrame | None = None) -> DataFrame:
        """Passages by BM25, fused with ``vectors`` (query 0, id, rank) where given."""
        return self._ranking(text, vectors).where(F.col("place") <= limit).orderBy("place")

    def similar(self, reference: str | None = None, limit: int = LIMIT, without: list[str] | None = None, vectors: DataFrame | None = None, place: dict | None = None) -> Answer:
        """Symbols whose passages are like the subject's, clones of it first (exact, then variants), with how they are related to it.

        Those with labels in ``without`` are left out of the whole ranking, before the limit; ``vectors`` (query 0, id, rank) is the second signal.
        """
        got = self._subject(reference, place)
        if got.outcome != "found":
            return got
        subject = got.rows.first()
        name = subject.canonical_id
        own = self.passages.where(F.col("symbol_id") == name).first()
        if own is None:
            return Answer("not_comparable")
        rows = self._ranking(own.render, vectors).where(F.col("symbol_id") != name)
        certainty, order = F.lit(None).cast("string"), [F.col("place")]
        if "clone_substitution_key" in self.symbols.columns and subject.clone_substitution_key is not None:
            same = F.col("clone_substitution_key") == subject.clone_substitution_key
            certainty = F.when(same & F.col("clone_formatting_key").eqNullSafe(F.lit(subject.clone_formatting_key)), "exact").when(same, "variant")
            keys = self.symbols.select(F.col("canonical_id").alias("symbol_id"), "clone_substitution_key", "clone_formatting_key")
            rows = rows.join(keys, "symbol_id", "left")
            order = [F.when(F.col("certainty") == "exact", 0).when(F.col("certainty") == "variant", 1).otherwise(2), F.col("place")]
        rows = rows.select("symbol_id", "place", certainty.alias("certainty"))
        pairs = rows.select(F.lit(name).alias("subject"), F.col("symbol_id").alias("candidate"))
        labels = similarity.exclude(similarity.labelled(pairs, self.edges, self.symbols), without or [])
        return Answer("found", labels.join(rows.withColumnRenamed("symbol_id", "candidate"), "candidate").orderBy(*order).limit(limit))

    def similar_batch(self, references_: list[str], limit: int = LIMIT, without: list[str] | None = None) -> list[tuple[str, Answer]]:
        """(reference, answer) for each of a list of subjects, in its order."""
        return [(r, self.similar(r, limit, without)) for r in references_]

    def clones(self, reference: str | None = None, place: dict | None = None) -> Answer:
        """All groups of clones, or the group of one symbol by its reference or place."""
        keys = self.symbols.select("canonical_id", F.col("clone_substitution_key").alias("substitution_key"), F.col("clone_formatting_key").alias("formatting_key"), F.col("clone_token_count").alias("token_count"))
        groups = clones.clone_groups(keys)
        if reference is None and place is None:
            return Answer("found", groups.orderBy(F.col("token_count").desc(), F.col("members").desc(), "group_id", "exact_set", "canonical_id"))
        got = self._subject(reference, place)
        if got.outcome != "found":
            return got
        subject = got.rows.first()
        if subject.clone_token_count is None:
            return Answer("not_comparable")
        mine = groups.where(F.col("canonical_id") == subject.canonical_id).select("group_id")
        rows = groups.join(mine, "group_id", "left_semi").where(F.col("canonical_id") != subject.canonical_id)
        return Answer("empty" if rows.isEmpty() else "found", rows.orderBy("exact_set", "canonical_id"))

    def fragments(self, reference: str | None = None, place: dict | None = None) -> Answer:
        """Runs of tokens one symbol shares with others, longest first; pairs with too many seeds come last, without runs."""
        got = self._subject(reference, place)
        if got.outcome != "found":
            return got
        rows = clones.fragment_clones(self.symbols, subject=got.rows.first().canonical_id)
        rows = rows.orderBy(F.col("length").desc_nulls_last(), "symbol_b", "a_start", "b_start")
        return Answer("empty" if rows.isEmpty() else "found", rows)

    def page(self, answer: Answer, order: list, limit: int, asked: dict, cursor: str | None = None) -> paging.Page:
        """One page of an answer's rows in a total order; ``asked`` is what was asked, which a cursor is bound to."""
        if answer.rows is None:
            raise ValueError(f"an answer that is {answer.outcome} has no pages")
        return paging.offset_page(answer.rows, order, limit, paging.query_identity("answer", asked, "-"), cursor)

    def impact(self, regions: DataFrame, depth: int = IMPACT_DEPTH) -> tuple[DataFrame, DataFrame]:
        """(seeds, dependents within ``depth``) of changed line regions."""
        seeds, rows = impact.impact(regions, self.symbols, self.edges)
        return seeds, rows.where(F.col("distance") <= depth)


def manifest() -> str:
    """The questions, their arguments and defaults, as JSON."""
    questions = {}
    for name, f in sorted(vars(Index).items()):
        if name.startswith("_") or not callable(f):
            continue
        arguments = [{"name": p.name, "required": p.default is p.empty, **({} if p.default is p.empty else {"default": p.default})} for p in list(inspect.signature(f).parameters.values())[1:]]
        questions[name] = {"about": (inspect.getdoc(f) or "").split("\n")[0], "arguments": arguments}
    return json.dumps({"version": 1, "questions": questions, "details": DETAILS, "relations": RELATIONS}, sort_keys=True)
