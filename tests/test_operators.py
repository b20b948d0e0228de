"""Operators against small cases and plain versions of themselves."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.functions.tokens import tokens_of
from lodestrata.operators import alignment, clones, components, experiment, graph, identity, impact, intervals, paging, retrieval, similarity, status, syntax
from lodestrata.operators.snapshots import normal_path, snapshot_changes
from lodestrata.sources import files, patches, semantic_index, store


def test_snapshots_small(spark):
    rows = [
        ("w", 1, "a.py", "A" * 64, "2026-01-01"), ("w", 1, "./b.py", None, "2026-01-01"), ("w", 2, "x\\..\\a.py", "sha256:" + "a" * 64, "2026-01-02"), ("w", 2, "c.py", "b" * 64, "2026-01-02"),
        ("w", 2, "c.py", "c" * 64, "2026-01-09"), ("w", 3, " c.py ", "b" * 64, "2026-01-03"), ("w", 3, None, "b" * 64, "2026-01-03"), ("w", 3, "  ", "b" * 64, "2026-01-03"), ("w", 4, "c.py", "b" * 64, "2026-01-04"), ("v", 1, "z", None, None),
    ]
    f = spark.createDataFrame(rows, "workspace_id string, snapshot_no int, document_path string, content_hash string, delivered_at string").withColumn("change", F.lit("clash"))
    s = spark.createDataFrame([("w", 1, "complete"), ("w", 2, "complete"), ("w", 3, "partial"), ("w", 4, "complete"), ("w", 5, "complete"), ("v", 1, "complete")], "workspace_id string, snapshot_no int, status string")
    got = sorted(map(tuple, snapshot_changes(f, s).collect()))
    # b.py goes in 2, c.py comes in 2 (the later delivery holds) and changes in 4; all is gone in 5
    assert got == sorted([("w", 2, "b.py", "removed"), ("w", 2, "c.py", "added"), ("w", 4, "a.py", "removed"), ("w", 4, "c.py", "changed"), ("w", 5, "c.py", "removed")])
    assert snapshot_changes(f.limit(0), s).count() == 0
    assert snapshot_changes(f, s.limit(0)).count() == 0


def test_normal_path(spark):
    cases = {"./a//b/./c.py": "a/b/c.py", "a\\b": "a/b", " a/../../b ": "../b", "": None, None: None, "/srv/w/a.py": "a.py"}
    df = spark.createDataFrame([(k, v, "/srv/w") for k, v in cases.items()], "p string, want string, root string")
    for r in df.select("p", "want", normal_path(F.col("p"), F.col("root")).alias("got")).collect():
        assert r.got == r.want, r


def _walk(edges, seeds, horizon):
    """Distances by breadth-first search, a seed only through other seeds."""
    back = {}
    for k, s, t in edges:
        back.setdefault(t, []).append((graph.DEPENDENCE.index(k), s))

    def distances(roots):
        dist, todo = {r: 0 for r in roots}, list(roots)
        for x in todo:
            for _, y in back.get(x, []):
                if y not in dist and dist[x] < horizon:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        return dist

    out = {}
    nodes = {x for _, s, t in edges for x in (s, t)} | set(seeds)
    for x in nodes:
        dist = distances([s for s in seeds if s != x])
        if x in dist and dist[x] > 0:
            kinds = [k for t in nodes for k, s in back.get(t, []) if s == x and dist.get(t) == dist[x] - 1]
            out[x] = (dist[x], graph.DEPENDENCE[min(kinds)])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dependents(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = {(rng.choice(graph.DEPENDENCE), rng.choice(nodes), rng.choice(nodes)) for _ in range(24)}
    seeds = rng.sample(nodes, 3)
    e = spark.createDataFrame(sorted(edges), "kind string, src string, dst string")
    got = {r.node: (r.distance, r.kind) for r in graph.dependents(e, spark.createDataFrame([(s,) for s in seeds], "node string"), 4).collect()}
    assert got == _walk(edges, seeds, 4)
    one = {r.node: (r.distance, r.kind) for r in graph.dependents(e, spark.createDataFrame([(s,) for s in seeds], "node string"), 4, one_task=0).collect()}
    assert one == got


def test_dependents_depth_zero_and_empty(spark):
    e = spark.createDataFrame([("uses", "a", "b")], "kind string, src string, dst string")
    s = spark.createDataFrame([("b",)], "node string")
    assert graph.dependents(e, s, 0).count() == 0
    assert graph.dependents(e.limit(0), s).count() == 0


def test_page_rank_both_ways(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcde"], "node string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "a")], "src string, dst string")
    one = {r.node: r.rank for r in graph.page_rank(nodes, links, iterations=5).collect()}
    many = {r.node: r.rank for r in graph.page_rank(nodes, links, iterations=5, one_task=0).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)
    assert abs(sum(one.values()) - 1) < 1e-9


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(None, "n01")]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_intervals_bins(spark):
    rng = random.Random(1)
    spans = [(f"s{i}", "d", a, a + rng.randrange(0, 60)) for i in range(40) for a in [rng.randrange(100)]]
    points = [(i, "d", p) for i, p in enumerate(range(0, 170, 3))]
    s = spark.createDataFrame(spans, "sid string, document_path string, start long, end long")
    p = spark.createDataFrame(points, "pid int, document_path string, point long")
    got = {r.pid: r.sid for r in intervals.innermost(p, s, "pid", "sid", 16).collect()}
    want = {}
    for i, _, x in points:
        inside = [(z - a, n) for n, _, a, z in spans if a <= x < z]
        if inside:
            want[i] = min(inside)[1]
    assert got == want
    got = {r.sid for r in intervals.minimal(s, "sid", [], 16).collect()}
    assert got == {n for n, _, a, z in spans if not any(a <= c and y <= z and (a < c or y < z) for _, _, c, y in spans)}
    got = {r.sid for r in intervals.outermost(s, "sid", ["document_path"]).collect()}
    assert got == {n for n, _, a, z in spans if not any(c <= a and z <= y and (c < a or z < y) for _, _, c, y in spans)}


def test_text(spark):
    df = spark.createDataFrame([("HTTPClient2 föoBar-x", "a\nb\n", "ab\r\nc")], "w string, l string, c string")
    r = df.select(tx.split_words(F.col("w")).alias("w"), tx.cap_lines(F.col("l"), 1).alias("l"), tx.window_lines(F.col("l"), 9, 2).alias("n"), *[tx.line_column(F.col("c"), F.lit(k)).alias(f"c{k}") for k in (0, 3, 4, 9)]).first()
    assert r.w == ["http", "client2", "föo", "bar", "x"]
    assert tuple(r.l) == ("a", True) and tuple(r.n) == ("", None, None, 3)
    assert tuple(r.c0) == (1, 1) and tuple(r.c3) == (1, 4) and tuple(r.c4) == (2, 1) and r.c9 is None


def test_tokens_and_keys():
    a = tokens_of("def f(x):\n    '''doc'''\n    return x + 1  # note\n", "a.py")
    b = tokens_of("def f(yy): return yy + 2", "b.py")
    assert [t.text for t in a] == ["def", "f", "(", "x", ")", ":", "return", "x", "+", "1"]
    assert clones.clone_keys(a)[1] == clones.clone_keys(b)[1] and clones.clone_keys(a)[0] != clones.clone_keys(b)[0]
    c = tokens_of("def f(x, y): return x + x", "c.py")
    d = tokens_of("def f(x, y): return x + y", "d.py")
    assert clones.clone_keys(c)[1] != clones.clone_keys(d)[1]
    r = tokens_of("/* a /* b */ c */ fn r#x<'a>() { r#\"q\"#; 'c'; 1.5 } // e", "a.rs")
    assert [t.text for t in r] == ["fn", "r#x", "<", "'a", ">", "(", ")", "{", 'r#"q"#', ";", "'c'", ";", "1.5", "}"]


def test_winnow_is_rightmost_minimum():
    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        h = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        want = set()
        for a in range(max(1, len(h) - 4)):
            w = h[a : a + 5]
            want.add(a + max(i for i, x in enumerate(w) if x == min(w)))
        assert clones.winnow(np.array(h), 5) == sorted(want)


def test_shared_runs_brute():
    rng = random.Random(9)
    from lodestrata.functions.tokens import IDENTIFIER, OTHER, Token

    def make(n):
        return [Token(*rng.choice([(IDENTIFIER, "a"), (IDENTIFIER, "b"), (OTHER, "+"), (OTHER, "(")]), 0) for _ in range(n)]

    def good(a, b):
        there, back = {}, {}
        for x, y in zip(a, b):
            if x.kind != y.kind or (x.kind == OTHER and x.text != y.text):
                return False
            if x.kind == IDENTIFIER and (there.setdefault(x.text, y.text) != y.text or back.setdefault(y.text, x.text) != x.text):
                return False
        return True

    for _ in range(25):
        a, b = make(12), make(12)
        runs = [(i, j, n) for i in range(12) for j in range(12) for n in range(3, 13 - max(i, j)) if good(a[i : i + n], b[j : j + n])]
        want = {r for r in runs if not any(o != r and o[0] <= r[0] and r[0] + r[2] <= o[0] + o[2] and o[1] <= r[1] and r[1] + r[2] <= o[1] + o[2] for o in runs)}
        assert set(clones.shared_runs(a, b, 3)) == want


def test_seeds_of_common_hashes(spark):
    # hash 1 is in 150 passages (twice in every third), hash 2 in five of them, hash 3 in one
    rows = [(1, p, o) for p in range(150) for o in ((0, 9) if p % 3 == 0 else (0,))] + [(2, p, 5) for p in range(5)] + [(3, 7, 1), (1, 0, 0), (None, 1, 1), (1, None, 1)]
    n = lambda p: 2 if p % 3 == 0 else 1
    want = {(a, b): n(a) * n(b) + (b < 5) for a in range(150) for b in range(a + 1, 150)}
    got = clones.fragment_seeds(spark.createDataFrame(rows, "hash long, passage_id long, token_ordinal int"), most=4).collect()
    assert len(got) == len(want) and {(r.passage_a, r.passage_b): r.seeds for r in got} == want
    assert all(r.compared == (r.seeds <= 4) for r in got) and not all(r.compared for r in got)


def test_fragment_clones(spark):
    from lodestrata.api import Index

    shared = "".join(f"    {{0}}{k} = call{k}({{0}}{k}, {k})\n" for k in range(8))
    one = "def one(x):\n" + shared.format("v") + "    return x\n"
    two = "def two():\n    start()\n" + shared.format("w") + "    stop(9)\n"
    inner = "def inner(y):\n" + shared.format("u").replace("    ", "        ") + "        return y + 1\n"
    outer = "def outer():\n    é = 1\n    " + inner + "    return inner\n"
    at = len(outer[: outer.index("def inner")].encode())
    rows = [("w::one", "one", one, 0, len(one)), ("w::two", "two", two, 1000, 1000 + len(two)), ("w::outer", "outer", outer, 3000, 3000 + len(outer.encode())), ("w::inner", "inner", inner, 3000 + at, 3000 + at + len(inner)), ("w::same", "same", one.replace("one", "same"), 5000, 5003 + len(one))]
    s = spark.createDataFrame([(i, n, t, "a.py", "w", "function", a, z) for i, n, t, a, z in rows], "canonical_id string, display_name string, span_text string, document_path string, workspace_id string, kind string, span_start long, span_end long")
    keys = {r.canonical_id: r for r in clones.keyed(s).collect()}
    assert keys["w::outer"].substitution_key is None and keys["w::outer"].token_count == 11 and keys["w::inner"].substitution_key
    found = clones.fragment_clones(s).collect()
    assert {(r.symbol_a, r.symbol_b) for r in found} == {("w::inner", "w::one"), ("w::inner", "w::two"), ("w::inner", "w::same"), ("w::one", "w::two"), ("w::same", "w::two")}
    run = next(r for r in found if (r.symbol_a, r.symbol_b) == ("w::one", "w::two"))
    assert (run.compared, run.a_start, run.b_start, run.exact) == (True, 6, 8, False) and run.length >= 64
    guarded = clones.fragment_clones(s, most=0).collect()
    assert len(guarded) >= 5 and all(not r.compared and r.length is None for r in guarded)
    mine = Index(s.withColumns({c: F.lit(None).cast("string") for c in ("signature_text", "test_rule")}).withColumn("class", F.lit("in_workspace")), None).fragments("w::two")
    assert {(r.symbol_a, r.symbol_b) for r in mine.rows.collect()} == {("w::two", x) for x in ("w::one", "w::inner", "w::same")}


def test_skyline(spark):
    rows = [("p", "q", 0, 0, 10), ("p", "q", 2, 2, 4), ("p", "q", 2, 9, 4), ("p", "q", 8, 8, 4), ("p", "q", 0, 0, 10)]
    got = clones.drop_contained(spark.createDataFrame(rows, "passage_a string, passage_b string, a_start int, b_start int, length int")).collect()
    assert sorted(map(tuple, got)) == [("p", "q", 0, 0, 10), ("p", "q", 2, 9, 4), ("p", "q", 8, 8, 4)]


def test_fuse_and_mutual(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query int, id int, rank int")
    assert [(r.id, r.place) for r in retrieval.fuse(a, b).orderBy("place").collect()] == [(11, 1), (10, 2), (12, 3)]
    first = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "query int, id int")
    assert [tuple(r) for r in retrieval.mutual_pairs(first).collect()] == [(1, 2)]


def test_status(spark):
    rows = spark.createDataFrame([("exact",), ("exact",), ("odd",)], "rule string")
    got = {r.rule: r["count"] for r in status.counted_by(rows, "rule", ["exact", "crate_root"]).collect()}
    assert got == {"exact": 2, "crate_root": 0}
    f = spark.createDataFrame([("g", "b", "2"), ("g", "a", "1")], "g string, p string, t string")
    one = status.content_digest(f, "g", "p", "t").first().digest
    assert one == status.content_digest(f.orderBy("p"), "g", "p", "t").first().digest


def test_identity(spark):
    assert identity.parse_symbol("local 3") is None
    assert identity.parse_symbol("s m pkg 1 `a b`/C#run().") == ("pkg", [("a b", "namespace"), ("C", "type"), ("run", "method")])
    assert identity.kind_of([("C", "type"), ("run", "method")]) == "Method" and identity.kind_of([("m", "namespace"), ("run", "method")]) == "Function"
    df = spark.createDataFrame([("s m p 1 x/f().",), ("local 1",), ("bad",)], "symbol string")
    got = {r.symbol: (r.package, r.kind) for r in identity.parse_symbols(df).collect()}
    assert got == {"s m p 1 x/f().": ("p", "Function"), "local 1": (None, None), "bad": (None, None)}


def test_paging(spark):
    rows = spark.range(7)
    asked = paging.query_identity("x", {}, "h")
    page = paging.offset_page(rows, [F.col("id")], 3, asked)
    assert [r.id for r in page.rows.collect()] == [0, 1, 2] and page.total == 7
    last = paging.offset_page(rows, [F.col("id")], 3, asked, paging.encode_cursor(asked, 2))
    assert [r.id for r in last.rows.collect()] == [6] and last.cursor is None
    with pytest.raises(ValueError, match="pages 0 to 2"):
        paging.offset_page(rows, [F.col("id")], 3, asked, paging.encode_cursor(asked, 3))
    with pytest.raises(ValueError):
        paging.offset_page(rows, [F.col("id")], 3, "other", page.cursor)
    assert paging.decode_cursor("zz") is None
    k = paging.keyset_page(rows, "id", 5, asked)
    assert [r.id for r in k.rows.collect()] == [0, 1, 2, 3, 4] and paging.decode_cursor(k.cursor)[2] == "4"


def test_estimators():
    low, high = experiment.tango_interval(11, 17, 298)
    assert (round(low, 3), round(high, 4)) == (-0.057, 0.0155)
    assert experiment.percentile([1, 2, 3], 0.99) == 3
    m, a, z = experiment.bootstrap_mean([0.1, 0.2, 0.4], draws=200)
    assert a <= m <= z
    assert experiment.slope([1, 2, 3], [2, 4, 6]) == 2 and experiment.bootstrap_slope([1, 1], [1, 2]) is None
    assert experiment.accuracy_claims(-0.01, 0.02, 0.05) == {"superior": False, "non_inferior": True, "equivalent": True, "harm": False, "material_harm": False}


def test_costs(spark):
    u = spark.createDataFrame([("a", "in", 1_000_000), ("a", "out", 500_000), ("b", "in", 5)], "trial string, category string, tokens long")
    p = spark.createDataFrame([("in", 2.0), ("out", 4.0)], "category string, price double")
    assert {r.trial: r.cost for r in experiment.priced(u, p, "trial").collect()} == {"a": 4.0, "b": None}


PATCH = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -2,2 +2 @@
---- a/not-a-header
- b
+c
@@ -9,0 +9 @@
+d
diff --git a/old.rs b/new.rs
similarity index 100%
rename from old.rs
rename to new.rs
diff --git "a/caf\\303\\251.py" "b/caf\\303\\251.py"
new file mode 100644
--- /dev/null
+++ "b/caf\\303\\251.py"
@@ -0,0 +1 @@
+x
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_patches(spark):
    got = [(c.kind, c.before, c.after, c.ranges) for c in patches.parse_patch(PATCH)]
    assert got == [("modified", "x.py", "x.py", [(2, 2), (9, 0)]), ("renamed", "old.rs", "new.rs", []), ("added", None, "café.py", [(0, 0)]), ("deleted", "gone.py", None, [(1, 1)])]
    rows = patches.patch_regions(spark.createDataFrame([(1, PATCH), (2, None)], "patch_id int, text string")).collect()
    assert len(rows) == 5 and rows[0].start == 2


def test_impact(spark):
    s = spark.createDataFrame([("m", "d", 1, 20), ("f", "d", 2, 5), ("g", "d", 7, 9)], "canonical_id string, document_path string, start_line int, end_line int")
    r = spark.createDataFrame([("a", "d", 2, 4), ("b", "d", 5, 0), ("c", "d", 8, 0), ("e", "x", 1, 1)], "region_id string, document_path string, start int, count int")
    got = sorted(map(tuple, impact.seeds_of_regions(r, s).collect()))
    assert got == [("a", "f", "exact"), ("b", "m", "approximate"), ("c", "g", "approximate")]
    assert {x.region_id: x.outcome for x in impact.seed_outcome(r, impact.seeds_of_regions(r, s)).collect()}["e"] == "no_indexed_symbol_touched"
    changes = spark.createDataFrame([("a/b.py", None), ("ab/c.py", "z/y.py"), ("q", "q")], "before string, after string")
    assert impact.narrow_to_paths(changes, spark.createDataFrame([("a/",), ("z/y.py",)], "prefix string")).count() == 2


def test_syntax_and_alignment(spark):
    text = "import os as o\nclass A(B):\n    def f(self):\n        return o.path.join(g(1))\n"
    facts = {(f[0], f[1], f[2]) for f in syntax.facts_of(text, "a.py")}
    assert {("alias", "o", "os"), ("base", "A", "B"), ("declaration", "f", "function"), ("call", "join", "o.path"), ("call", "g", None), ("binding", "A", "f")} <= facts
    rust = "mod m;\n#[test]\nfn t() { a.b(x); }\nimpl<T> Tr for S<T> { fn q(&self) {} }\nuse p::q as r;"
    facts = {(f[0], f[1], f[2]) for f in syntax.facts_of(rust, "a.rs")}
    assert {("module_file", "m", None), ("test_attribute", "t", None), ("call", "b", "a"), ("impl", "S<T>", "Tr"), ("declaration", "q", "function"), ("alias", "r", "q")} <= facts
    src = spark.createDataFrame([("a.rs", "use a::b as c; fn f() { c(); self.x + 1; crate::k }")], "document_path string, text string")
    t = "use a::b as c; fn f() { c(); self.x + 1; crate::k }"

    def occ(i, what, name, kind, sym, at=None):
        p = t.index(what) if at is None else at
        return (i, "a.rs", p, p + len(what), name, kind, sym)

    rows = [occ(1, "b", "b", "function", "B"), occ(2, "c()", "b", "function", "B")[:3] + (t.index("c()") + 1, "b", "function", "B"), occ(3, "self", "S", "type", "S"), occ(4, "+", "add", "method", "add"), occ(5, "crate", "root", "module", "R"), occ(6, "fn", "zz", "function", "Z"), (7, "none.rs", 0, 1, "q", "function", "Q")]
    o = spark.createDataFrame(rows, "occurrence_id int, document_path string, span_start int, span_end int, name string, kind string, symbol_id string")
    al = spark.createDataFrame([("a.rs", "c", "b")], "document_path string, alias string, name string")
    out = alignment.align(o, src, al)
    assert {r.occurrence_id: r.rule for r in out.collect()} == {1: "exact", 2: "import_alias", 3: "self_keyword", 4: "operator_desugar", 5: "crate_root", 6: None, 7: None}
    rules, outcomes = alignment.accounts(out)
    assert sum(r["count"] for r in outcomes.collect()) == 7 and rules.count() == len(status.ALIGNMENT_RULES)
    calls = syntax.unresolved_calls(syntax.extract(src), o.where("false"))
    assert calls.count() == 1


def test_twins(spark):
    refs = spark.createDataFrame([(1, "d", "leaf"), (2, "d", "lost")], "occurrence_id int, descriptor string, document_path string")
    twins = spark.createDataFrame([("d", "top", "X"), ("d", "else", "Y")], "descriptor string, document_path string, symbol_id string")
    up = spark.createDataFrame([("leaf", "mid"), ("mid", "top"), ("lost", "loop"), ("loop", "lost")], "document string, parent string")
    assert {r.occurrence_id: r.symbol_id for r in alignment.select_twins(refs, twins, up).collect()} == {1: "X", 2: None}


def test_similarity(spark):
    p = spark.createDataFrame([("a", "b"), ("a", "c")], "subject string, candidate string")
    e = spark.createDataFrame([("uses", "b", "a"), ("type_hierarchy", "a", "c")], "kind string, src string, dst string")
    s = spark.createDataFrame([("a", None), ("b", "test_file"), ("c", None)], "canonical_id string, test_rule string")
    got = {r.candidate: r.labels for r in similarity.labelled(p, e, s).collect()}
    assert got == {"b": ["uses_subject", "tests_subject"], "c": ["used_by_subject", "type_family"]}
    assert similarity.exclude(similarity.labelled(p, e, s), ["tests_subject"]).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "src" / ".hid").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / ".hid" / "b.py").write_text("no")
    (tmp_path / "src" / "c.py").write_bytes(b"\xff\xfe")
    got = files.scan_sources(spark, str(tmp_path / "src"), "py")
    assert [tuple(r) for r in got.collect()] == [("a.py", "x = 1\n")]
    assert len(files.hashed(got).first().content_hash) == 64

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def part(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    def occurrence(place, symbol, roles):
        return part(2, part(1, b"".join(map(varint, place))) + part(2, symbol.encode()) + varint(3 << 3) + varint(roles))

    body = part(2, part(1, b"a.py") + occurrence([300, 1, 5], "s m p 1 f().", 1) + occurrence([4, 1, 6, 2], "s m p 1 g().", 0))
    (tmp_path / "index.scip").write_bytes(body)
    rows = semantic_index.read_index(spark, str(tmp_path / "index.scip"))
    assert [tuple(r)[1:] for r in rows.collect()] == [("a.py", "s m p 1 f().", 300, 1, 300, 5, True), ("a.py", "s m p 1 g().", 4, 1, 6, 2, False)]
    assert {r.symbol: r["class"] for r in semantic_index.classified(rows).collect()} == {"s m p 1 f().": "in_workspace", "s m p 1 g().": "external"}


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([("uses", "a", "b"), ("uses", "a", "b")], "kind string, src string, dst string")
    store.publish(spark, root, {"edges": one}, {"k": 16})
    snap = store.Snapshot(spark, root)
    assert snap.table("edges").count() == 1 and snap.facts == {"k": 16}
    bad = spark.createDataFrame([("external", "a.py")], "class string, document_path string")
    with pytest.raises(Exception, match="external symbol"):
        store.publish(spark, root, {"symbols": bad})
    assert store.Snapshot(spark, root).build == snap.build
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "manifest.json").write_text("{}")
    with pytest.raises(store.StoreError):
        store.publish(spark, str(tmp_path / "foreign"), {"edges": one})


def test_streaming(spark, tmp_path):
    from lodestrata.streaming import refresh

    rows = [("w", 1, "a.py", "a" * 64), ("w", 1, "b.py", None)]
    df = spark.createDataFrame(rows, "workspace_id string, snapshot_no int, document_path string, content_hash string").withColumn("delivered_at", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = refresh.on_each_batch(refresh.deliveries(spark, str(tmp_path / "in")), lambda b, n: seen.append(b.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen) == 2
