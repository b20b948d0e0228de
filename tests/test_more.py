"""Units, positions, chunks, trial evidence, backends and the questions of an index."""

import pytest
from pyspark.sql import functions as F

from lodestrata.api import Index
from lodestrata.functions import chunks, positions
from lodestrata.operators import evidence, identity, units
from lodestrata.sources import backend


def test_units(spark):
    asked = spark.createDataFrame([("src/lib.rs", "a", None), ("src/a.rs", "b", None), ("src/lib.rs", "t", "x/t.rs"), ("bin/main.rs", "a", None)], "document string, name string, path string")
    docs = spark.createDataFrame([("src/a.rs",), ("src/a/b.rs",), ("src/x/t.rs",), ("bin/a/mod.rs",)], "document_path string")
    declared = units.declared_by(asked, docs)
    assert {tuple(r) for r in declared.collect()} == {("src/a.rs", "src/lib.rs"), ("src/a/b.rs", "src/a.rs"), ("src/x/t.rs", "src/lib.rs"), ("bin/a/mod.rs", "bin/main.rs")}
    targets = spark.createDataFrame([("lib", "src/lib.rs", "default"), ("bin", "bin/main.rs", "bin.main"), ("two", "src/a.rs", "bin.two")], "target string, root string, unit string")
    reach = units.target_reach(targets, declared)
    got = {r.document: r.unit for r in identity.assign_units(targets, reach).collect()}
    assert got == {"src/lib.rs": "default", "src/x/t.rs": "default", "src/a.rs": "shared", "src/a/b.rs": "shared", "bin/main.rs": "bin.main", "bin/a/mod.rs": "bin.main"}
    assert identity.single_parent(declared).count() == 4


def test_classified_tests(spark):
    s = spark.createDataFrame([("a", "src/a.rs", 5), ("b", "src/a.rs", 50), ("c", "src/t.rs", 0), ("d", "tests/x.rs", 0), ("e", "p/test_q.py", 0), ("f", "p/q.py", 0), ("g", "src/a.rs", 99)], "canonical_id string, document_path string, span_start int")
    gated = spark.createDataFrame([("src/a.rs", 40, 60), ("src/gate.rs", None, None)], "document_path string, start int, end int")
    declared = spark.createDataFrame([("src/t.rs", "src/gate.rs")], "document string, parent string")
    got = {r.canonical_id: r.test_rule for r in units.classify_tests(s, spark.createDataFrame([("a",)], "canonical_id string"), gated, declared).collect()}
    assert got == {"a": "test_attribute", "b": "test_configuration", "c": "test_configuration", "d": "test_directory", "e": "test_file"}


def test_overrides_look_through(spark):
    b = spark.createDataFrame([("D", "f", "D.f"), ("A", "f", "A.f"), ("B", "g", None), ("D", "g", "D.g"), ("A", "g", "A.g"), ("D", "__p", "D.__p"), ("A", "__p", "A.__p")], "type string, name string, method string")
    up = spark.createDataFrame([("D", "B"), ("D", "C"), ("B", "A"), ("C", "A"), ("A", "D")], "type string, base string")
    got = {tuple(r) for r in units.look_through_overrides(b, up).collect()}
    # f is found behind B and C; g is hidden by B, but C leads to A as well
    assert ("D.f", "A.f") in got and ("D.g", "A.g") in got and not any("__p" in x for r in got for x in r)


def test_modules_and_discrepancies(spark):
    s = spark.createDataFrame([("m1", "module", "d", 0, 10), ("m2", "module", "d", 0, 20), ("x", "type", "d", 0, 9)], "canonical_id string, kind string, document_path string, span_start int, span_end int")
    o = spark.createDataFrame([("m1", 0, 3)], "symbol_id string, span_start int, span_end int")
    assert [tuple(r) for r in units.module_of_documents(s, o).collect()] == [("d", "m1")]
    refused = spark.createDataFrame([(1, "a", None), (2, None, "g")], "discrepancy_id int, symbol_id string, duplicate_group string")
    links = units.discrepancy_links(refused, spark.createDataFrame([("g", "x"), ("g", "y")], "duplicate_group string, symbol_id string"))
    assert {tuple(r) for r in links.collect()} == {(1, "a"), (2, "x"), (2, "y")}
    uses = units.unconfirmed_uses(links, spark.createDataFrame([(1, "d", 5), (2, "d", None)], "discrepancy_id int, document_path string, span_start int"), 1).collect()
    assert {(r.symbol_id, tuple(r.candidates), r.total) for r in uses} == {("a", ("a",), 1), ("x", ("x",), 2), ("y", ("x",), 2)}


def test_positions(spark):
    line = "a😀é"
    assert [positions.to_byte(line, k, "utf16") for k in range(6)] == [0, 1, None, 5, 7, None]
    assert [positions.to_byte(line, k, "utf32") for k in (0, 2, 3, 4)] == [0, 5, 7, None]
    assert positions.to_byte(line, 2, "utf8") is None and positions.to_byte(line, 7, "utf8") == 7
    df = spark.createDataFrame([(line, 3, "utf16"), (None, 1, "utf8")], "l string, c int, e string")
    assert [r[0] for r in df.select(positions.byte_of("l", "c", "e")).collect()] == [5, None]


def test_chunks():
    text = "\n\n".join(f"Sentence {i} has some words. And another one here." for i in range(30))
    got = chunks.split_passage("head line", text, 40, 10)
    assert len(got) > 5 and all(chunks.count_units(c) <= 40 and c.startswith("head line") for c in got)
    assert chunks.split_passage("h", "short") == ["h\nshort"] and chunks.split_passage("h", "") == ["h"]
    assert all(chunks.count_units(c) <= 8 for c in chunks.split_passage("a b c d e f g", "x " * 50, 8, 3))


def test_evidence(spark):
    t = spark.createDataFrame([(1, None, 5, False), (2, "E", 0, False), (3, "E", 9, True), (4, "E", 9, None)], "trial_id int, exception string, tokens int, endpoint_error boolean")
    assert [r.terminal_state for r in evidence.terminal_states(t).orderBy("trial_id").collect()] == ["completed", "infra-failure", "infra-failure", "agent-failure"]
    s = spark.createDataFrame([(1, [("sh", "grep a; grep b")]), (2, [])], "trial_id int, calls array<struct<name:string,arguments:string>>")
    assert {r.trial_id: (r.calls, r.matches) for r in evidence.invocation_counts(s, "grep").collect()} == {1: (1, 2), 2: (0, 0)}
    a = spark.createDataFrame([(1, 'x {"files": ["/a//b.py", "a/b.py", " ./c "]} y'), (2, "none"), (3, "[1]")], "id int, text string")
    assert {r.id: (r.files, r.ok) for r in evidence.parsed_answers(a).collect()} == {1: (["a/b.py", "c"], True), 2: ([], False), 3: ([], False)}


class Fixed(backend.IndexBackend):
    def documents(self):
        return ["a.py", "b.py"]

    def occurrences(self, path):
        yield ("s m p 1 f().", 0, 4, 0, 5, True)
        yield ("s m p 1 g().", 3, 9, 2, 1, False)


def test_backend(spark):
    rows = spark.read.format(backend.register(spark, Fixed)).load()
    assert rows.count() == 4
    assert {r.clause: r.violations for r in backend.conformance(rows).collect()} == {"symbol": 0, "path": 0, "range": 2, "role": 0}
    symbols, references = backend.split_duplicates(rows)
    assert {r.symbol for r in symbols.collect()} == {"s m p 1 f().@a.py@0@4", "s m p 1 f().@b.py@0@4"} and references.where("duplicate_group IS NULL").count() == 2


def test_index(spark):
    s = spark.createDataFrame(
        [("w::m::f", "f", "function", "in_workspace", "w", "a.py", 0, 20, 1, 2, "def f():\n    pass", "def f():", None, "k", "x", 50), ("w::m::g", "g", "function", "in_workspace", "w", "a.py", 25, 60, 4, 6, "def g(): f()", "def g():", "test_file", "k", "y", 50), ("w::n::g", "g", "function", "in_workspace", "w", "b.py", 0, 9, 1, 1, "def g(): 1", None, None, None, None, None)],
        "canonical_id string, display_name string, kind string, class string, workspace_id string, document_path string, span_start long, span_end long, start_line int, end_line int, span_text string, signature_text string, test_rule string, clone_substitution_key string, clone_formatting_key string, clone_token_count int",
    )
    e = spark.createDataFrame([("uses", "w::m::g", "w::m::f")], "kind string, src string, dst string")
    o = spark.createDataFrame([("w::m::f", "a.py", 30, "reference", "w::m::g")], "symbol_id string, document_path string, span_start int, role string, enclosing_id string")
    p = spark.createDataFrame([(1, "w::m::f", "f function add numbers"), (2, "w::m::g", "g function add more numbers"), (3, "w::n::g", "unrelated")], "id long, symbol_id string, render string")
    i = Index(s, e, o, p)
    assert i.get("f").rows.first().content.text.startswith("def f") and i.get("zz").outcome == "absent" and i.get("g").outcome == "ambiguous"
    assert i.at("a.py", 30).rows.first().canonical_id == "w::m::g" and i.at("a.py", 999).outcome == "absent"
    assert [r.canonical_id for r in i.find("F").collect()] == ["w::m::f"]
    assert [r.node for r in i.trace("m::f", "dependents").rows.collect()] == ["w::m::g"]
    assert i.trace("f", "tests").rows.count() == 1 and i.trace("f", "contains").outcome == "empty"
    assert [r.symbol_id for r in i.search("more numbers").collect()][0] == "w::m::g"
    near = i.similar("f").rows.collect()
    assert near[0].candidate == "w::m::g" and near[0].labels == ["uses_subject", "tests_subject"]
    assert i.clones("f").rows.first().canonical_id == "w::m::g" and i.clones("w::n::g").outcome == "not_comparable"
    assert near[0].certainty == "variant" and [a.outcome for _, a in i.similar_batch(["f", "zz"])] == ["found", "absent"]
    assert i.at("a.py", line=5).rows.first().canonical_id == "w::m::g" and i.at("a.py", line=1).rows.first().canonical_id == "w::m::f" and i.at("c.py", line=1).outcome == "absent"
    assert i.clones(place={"document": "a.py", "offset": 3}).rows.first().canonical_id == "w::m::g" and i.similar(place={"document": "a.py", "line": 1}).outcome == "found"
    seeds, rows = i.impact(spark.createDataFrame([(1, "a.py", 1, 2)], "region_id int, document_path string, start int, count int"))
    assert seeds.first().grade == "exact" and [r.node for r in rows.collect()] == ["w::m::g"]
    assert F is not None


def test_similar_excludes_before_the_limit(spark):
    names = ["f", *(f"u{k:03}" for k in range(40)), "x", "y", "z"]
    s = spark.createDataFrame([(f"w::{n}", n, "function", "in_workspace", "w", "a.py", None) for n in names], "canonical_id string, display_name string, kind string, class string, workspace_id string, document_path string, test_rule string")
    e = spark.createDataFrame([("uses", f"w::{n}", "w::f") for n in names if n[0] == "u"], "kind string, src string, dst string")
    p = spark.createDataFrame([(k, f"w::{n}", "adds two numbers" if n[0] in "fu" else "adds " + "other words " * k) for k, n in enumerate(names)], "id long, symbol_id string, render string")
    rows = Index(s, e, None, p).similar("f", 2, ["uses_subject"]).rows.collect()
    assert [r.candidate for r in rows] == ["w::x", "w::y"]


def test_long_receivers(spark):
    from lodestrata.operators import syntax

    receiver = "a" + ".where(b)" * 50
    rows = syntax.extract(spark.createDataFrame([("a.py", f"{receiver}.count()\n")], "document_path string, text string")).where("fact = 'call' AND name = 'count'").collect()
    assert [r.detail for r in rows] == [receiver]


def test_twins_by_unit_and_scope(spark):
    from lodestrata.operators import alignment

    refs = spark.createDataFrame([(1, "d", "a.rs", 15), (2, "d", "b.rs", 5)], "occurrence_id int, descriptor string, document_path string, point long")
    twins = spark.createDataFrame([("d", "a.rs", "X#0", 12), ("d", "a.rs", "X#1", 40), ("d", "c.rs", "Y", 0)], "descriptor string, document_path string, symbol_id string, start long")
    docs = spark.createDataFrame([("b.rs", "u"), ("a.rs", "v")], "document string, unit string")
    own = spark.createDataFrame([("Y", "u"), ("X#0", "v"), ("X#1", "v")], "symbol_id string, unit string")
    assert [tuple(r) for r in alignment.select_twins_by_unit(refs, twins, docs, own).collect()] == [(2, "Y")]
    spans = spark.createDataFrame([("a.rs", 0, 60), ("a.rs", 10, 20)], "document_path string, start long, end long")
    assert [tuple(r) for r in alignment.select_twins_by_scope(refs, twins, spans).collect()] == [(1, "X#0")]
    assert [tuple(r) for r in alignment.group_bases(twins).collect()] == [("d", "X")]


def test_splits(spark):
    from lodestrata.operators import splits

    ids = [f"i{k}" for k in range(20)]
    small = splits.make_split(ids, 3, 4, 5)
    large = splits.make_split(ids, 3, 6, 9, small)
    assert set(small["development"]) <= set(large["development"]) and not set(large["development"]) & set(large["frozen"])
    rows = lambda s: spark.createDataFrame([(k, x) for k, v in s.items() for x in v], "subset string, id string")
    assert splits.split_conflicts(rows(small), rows(large)).count() == 0
    t = spark.createDataFrame([(1, "fix a/b.py and c.py, not dd.py", ["a/b.py", "x/c.py", "y/d.py"]), (2, "none", [])], "task_id int, text string, paths array<string>")
    assert {r.task_id: (r.paths, r.mentioned) for r in splits.path_mentions(t).collect()} == {1: (3, 2), 2: (0, 0)}


def test_build(spark, tmp_path):
    from lodestrata.build import Parameters, build
    from lodestrata.sources.store import Snapshot

    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "pkg" / "a.py").write_text("class A:\n    def f(self):\n        return g()\n\ndef g():\n    return 1\n")
    (src / "pkg" / "b.py").write_text("def g():\n    return 1\n\ndef g():\n    return 2\n")
    text = (src / "pkg" / "a.py").read_text()
    o = spark.createDataFrame([("pkg/a.py", "w::pkg::a::g", text.index("g()"), text.index("g()") + 1, "reference")], "document_path string, symbol_id string, span_start int, span_end int, role string")
    target = str(tmp_path / "store")
    assert build(spark, str(src), target, "w", occurrences=o)
    assert build(spark, str(src), target, "w", occurrences=o) is None
    snap = Snapshot(spark, target)
    ids = {r.canonical_id for r in snap.table("symbols").collect()}
    assert ids == {"w::pkg::a::A", "w::pkg::a::f", "w::pkg::a::g", "w::pkg::b::g#0", "w::pkg::b::g#1"}
    assert {tuple(r) for r in snap.table("edges").collect()} == {("contains", "w::pkg::a::A", "w::pkg::a::f"), ("uses", "w::pkg::a::f", "w::pkg::a::g")}
    assert Parameters().guaranteed_length() == 32 and snap.facts["kgram"] == 16
    (src / "pkg" / "b.py").write_text("x = 1\n")
    assert build(spark, str(src), target, "w", occurrences=o) and Snapshot(spark, target).table("source_files").count() == 2


def test_small_things(spark, tmp_path):
    import json

    from lodestrata.api import manifest
    from lodestrata.functions.text import epoch_seconds
    from lodestrata.operators import paging
    from lodestrata.operators.clones import comparable_tokens
    from lodestrata.sources.files import environment_facts

    df = spark.createDataFrame([("12.5",), ("2026-01-01T00:00:01Z",), ("2026-01-01 00:00:01",), ("2026-01-01T01:00:01+01:00",), ("soon",), (None,)], "v string")
    assert [r[0] for r in df.select(epoch_seconds(F.col("v"))).collect()] == [12.5, 1767225601.0, 1767225601.0, 1767225601.0, None, None]
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "g string, k int")
    got = paging.capped_groups(rows, ["g"], [F.col("k")], 2).collect()
    assert {(r.g, r.k, r.total) for r in got} == {("a", 0, 5), ("a", 1, 5), ("b", 9, 1)}
    text = "class A:\n    x = 1\n    def f(self): return 2\n    y = 3\n"
    a = text.index("def")
    z = text.index("2") + 1
    assert [t.text for t in comparable_tokens(text, "a.py", [(a, z), (a + 4, z)])] == ["class", "A", ":", "x", "=", "1", "", "y", "=", "3"]
    (tmp_path / "p-1.dist-info").mkdir()
    (tmp_path / "p-1.dist-info" / "METADATA").write_text("x")
    assert len(environment_facts(spark, str(tmp_path), "3").first().fingerprint) == 64
    assert json.loads(manifest())["questions"]["trace"]["arguments"][0] == {"name": "reference", "required": True}


def test_places():
    from lodestrata.operators import places

    text = "mod m { use a::{b, self}; fn f() { let x = a[0] .. ; if (y) {} } }"
    assert places.children(text, 0, len(text))[:2] == [(0, 3), (4, 5)] and places.children(text, 8, 25)[0] == (8, 11)
    got = {r["occurrence_id"]: r for r in places.facts_at("a.rs", text, [("s", text.index("self"), text.index("self") + 4), ("r", text.index(".."), text.index("..") + 2), ("i", text.index("[0"), text.index("[0") + 1), ("p", text.index("(y"), text.index("(y") + 1)])}
    assert got["s"]["use_terminal"] == "a" and got["s"]["modules"] == ["m"] and got["r"]["range_type"] == "RangeFrom" and got["i"]["construct"] == "index" and got["p"]["construct"] is None
    assert places.dotted_around("x = h2.conn.H2(1)", 4, 6) == ["h2.conn", "h2.conn.H2"] and places.base_type_name("&a::B<C<D>>") == "B"
    # unmatched and very deep brackets
    deep = places.RustSource("fn f() { " + "(" * 50_000 + ")" * 50_000 + " ] }")
    assert deep.other[deep.starts.index(7)] == len(deep.tokens) - 1
    assert places.rust_tiers("") == ("", "", 0) and places.python_tiers("x = 1") == ("x = 1", "x = 1", 5)
    assert places.python_tiers("async def f(x='(:'):\n  'doc'; y") == ("async def f(x='(:'):", "async def f(x='(:'):\n'doc'", 20)


def test_data_breaks():
    from lodestrata.functions.tokens import rust_tokens
    from lodestrata.operators import clones

    a = rust_tokens("let t = [1, -2, 3, 4, 5, 6]; f(x);")
    b = rust_tokens("let u = [1, -2, 9, 4, 5, 7]; f(y);")
    flags = [clones.data_flags(t, True) for t in (a, b)]
    assert [t.text for t, f in zip(a, flags[0]) if not f] == ["let", "t", "=", "f", "x"]
    breaks = clones.data_breaks(a, b, *flags, 0, 4)
    assert sorted(a[k].text for k in breaks) == ["3", "6"] and clones.data_breaks(a, b, *flags, 0, 50) == set()
    whole = clones.shared_runs(a, b, 4)
    cut = clones.shared_runs(a, b, 4, None, (*flags, 4))
    assert max(n for _, _, n in whole) == len(a) and max(n for _, _, n in cut) < len(a) and all(not set(range(s, s + n)) & breaks for s, t, n in cut if s == t)


def test_vector_bytes_and_token_counts(spark):
    import os
    import struct

    from lodestrata.operators import embedding

    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None)], "id int, v array<float>")
    got = {r.id: r.b for r in df.select("id", embedding.vector_bytes(F.col("v")).alias("b")).collect()}
    assert bytes(got[1]) == struct.pack("<2f", 1.0, -2.5) and got[2] is None
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if os.path.exists(path):
        texts = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "<|endoftext|>")], "id int, text string")
        assert {r.id: r.tokens for r in embedding.token_counts(texts, path).collect()} == {1: 2, 2: 0, 3: 7}
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "a")], "id int, token string")
    table = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 8.0])], "token string, vector array<float>")
    assert {r.id: [round(x, 6) for x in r.embedding] for r in embedding.static_embeddings(tokens, table).collect()} == {1: [0.6, 0.8]}


def test_store_replaces_older_versions(spark, tmp_path):
    import json

    from lodestrata.sources import store

    root = str(tmp_path / "store")
    df = spark.range(3)
    store.publish(spark, root, {"t": df}, {"model": "m", "chunk_size": 512})
    snap = store.Snapshot(spark, root)
    assert snap.semantic_identity() == {"model": "m", "corpus_version": None, "chunk_size": 512, "chunk_overlap": None}
    place = tmp_path / "store" / "manifest.json"
    for version, fails in ((store.VERSION - 1, False), (store.VERSION + 1, True)):
        found = json.loads(place.read_text()) | {"version": version}
        for p in tmp_path.glob("store/.manifest.json.crc"):
            p.unlink()
        place.write_text(json.dumps(found))
        with pytest.raises(store.StoreError):
            store.Snapshot(spark, root)
        if fails:
            with pytest.raises(store.StoreError):
                store.publish(spark, root, {"t": df})
        else:
            store.publish(spark, root, {"t": df}, {})
            assert store.Snapshot(spark, root).table("t").count() == 3


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from lodestrata.runtime import shared_dir

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda k, default: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))

    for master in ("yarn", "spark://h:7077", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://h/x/")) == "hdfs://h/x"
    assert shared_dir(session("local[4]"))


def test_layered_digest(spark):
    from lodestrata.operators import status

    rows = [(f"p{k}", f"h{k}") for k in range(50)] + [(None, "x")]
    df = spark.createDataFrame(rows, "document_path string, content_hash string")
    one = status.layered_digest(df, "document_path", "content_hash", 7)
    assert one == status.layered_digest(df.orderBy(F.rand(1)).repartition(3), "document_path", "content_hash", 7)
    changed = df.withColumn("content_hash", F.when(F.col("document_path") == "p3", "other").otherwise(F.col("content_hash")))
    assert one != status.layered_digest(changed, "document_path", "content_hash", 7)
    assert status.layered_digest(df.limit(0), "document_path", "content_hash") == status.layered_digest(df.where("document_path IS NULL"), "document_path", "content_hash")


def test_bm25_both_ways(spark):
    """Tiles give the scores of the join, for the first rows and for all; more passages than a tile holds."""
    import random

    from lodestrata.operators import retrieval

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(("every", f"w{rng.randrange(60)}")) for _ in range(rng.randrange(1, 12)))) for i in range(1500)] + [(5000, None), (None, "w1")]
    from lodestrata.runtime import materialize

    index = materialize(retrieval.postings(spark.createDataFrame(rows, "id long, t string"), "id", "t"), "postings")
    asked = index.where("id % 7 = 0").select(F.col("id").alias("query"), "word")
    total = retrieval.corpus_totals(index, "id")
    want = {(r.query, r.id): r.score for r in retrieval.bm25(index, "id", asked, total).where("query <> id").collect()}
    every = {(r.query, r.id): r.score for r in retrieval.top_lexical(index, asked, total, 10**6).collect()}
    assert set(want) == set(every) and all(abs(want[k] - every[k]) < 1e-9 for k in want)
    few = retrieval.ranked(retrieval.top_lexical(index, asked, total, 5).withColumn("score", F.round("score", 9)), "query", "id", F.col("score").desc(), 5)
    whole = retrieval.ranked(spark.createDataFrame([(q, i, s) for (q, i), s in want.items()], "query long, id long, score double").withColumn("score", F.round("score", 9)), "query", "id", F.col("score").desc(), 5)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))
    assert retrieval.top_lexical(index, asked.limit(0), total, 5).count() == 0 and retrieval.top_lexical(index.limit(0), asked, total, 5).count() == 0
