"""The training-data operators against plain versions of themselves, and their odd cases."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import encode, format_duplicates, function_docs, mixing, near_duplicates, sentences, shared_spans, split_items
from lodestrata.llm.lexing import without_comments

SYMBOLS = "canonical_id string, display_name string, kind string, class string, workspace_id string, document_path string, span_text string, signature_text string, clone_substitution_key string, clone_token_count int, indexed_at timestamp, word string, run long, key string"


def symbols(spark, rows):
    """Rows of (id, text) with further columns by name; some extra columns clash with inner names."""
    out = []
    for r in rows:
        d = {"canonical_id": r[0], "span_text": r[1], "display_name": "f", "kind": "function", "class": "in_workspace", "workspace_id": "w", "document_path": "a.py", "clone_token_count": 50, "word": "x", "run": 1, "key": "k"}
        d |= r[2] if len(r) > 2 else {}
        out.append(tuple(d.get(c.split()[0]) for c in SYMBOLS.split(", ")))
    return spark.createDataFrame(out, SYMBOLS)


# --- 1 -----------------------------------------------------------------------

def runs(text):
    w = re.findall(r"\w+", text.lower())
    return set(zip(w, w[1:], w[2:]))


def test_near_duplicates_brute(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((5, 40, 80)))]
        for k in range(4):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"s{g}_{k}", " ".join(t), {"clone_substitution_key": rng.choice(("x", "y", None)), "clone_token_count": rng.choice((39, 40, 99))}))
    rows += [("null", None), ("empty", ""), ("two", "one two"), (None, "a b c d e f"), rows[0], rows[0]]
    s = symbols(spark, rows)
    got = [tuple(r) for r in near_duplicates.near_duplicates(s).collect()]
    known = {r[0]: (r[1], r[2]) for r in rows if r[0] and r[1] and len(r) > 2 and r[2]["clone_token_count"] >= 40}
    want = set()
    for a in known:
        for b in known:
            ka, kb = known[a][1]["clone_substitution_key"], known[b][1]["clone_substitution_key"]
            x, y = runs(known[a][0]), runs(known[b][0])
            if a < b and x and y and (ka is None or ka != kb) and len(x & y) >= 0.6 * len(x | y):
                want.add((a, b))
    assert sorted(got) == sorted(want) and len(want) > 20
    groups = near_duplicates.near_groups(s).collect()
    assert len(groups) == len([k for k in known if runs(known[k][0])])
    assert near_duplicates.near_duplicates(s.limit(0)).count() == 0


def test_close_pairs_hot_block_in_tiles(spark):
    """A run that more classes share than fit a tile still meets every class."""
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(f"s{i:02}", f"{common} x{i}", {"clone_substitution_key": f"k{i}"}) for i in range(14)]
    found = near_duplicates.near_duplicates(symbols(spark, rows), tile=4)
    assert found.count() == 14 * 13 // 2


def test_close_pairs_equal_popcount():
    import numpy as np

    rng = np.random.default_rng(0)
    sk = rng.integers(0, 256, (150, 64), dtype=np.uint8)
    sk[75:] = sk[:75]
    flips = rng.integers(0, 512, (75, 30))
    for k in range(75):
        for f in flips[k][: rng.integers(0, 30)]:
            sk[75 + k, f // 8] ^= 1 << (f % 8)
    order = np.argsort(np.arange(150) % 75, kind="stable")
    sk = sk[order]
    n, group = np.full(150, 40), np.repeat(np.arange(50), 3)
    i, j = near_duplicates.close_pairs(sk, n, group, np.zeros(150, int), np.zeros(150, bool), 0.6)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if group[a] == group[b] and int(np.unpackbits(sk[a] ^ sk[b]).sum()) <= 20}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_near_duplicates_keep_no_run_sets(spark, monkeypatch, tmp_path):
    """Once the pairs are known, the run sets and other steps are off the disk; what is left still gives the result."""
    from lodestrata import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    rows = [(f"s{g}_{k}", " ".join(f"w{g}_{i}" for i in range(60)) + f" x{k}", {"clone_substitution_key": f"k{k}"}) for g in range(20) for k in range(2)]
    found = near_duplicates.near_duplicates(symbols(spark, rows))
    assert sorted({p.name.rpartition("-")[0] for p in tmp_path.iterdir()}) == ["near-members", "near-pairs"]
    assert sorted(map(tuple, found.collect())) == sorted((f"s{g}_0", f"s{g}_1") for g in range(20))


def test_marked_sets():
    """Every set of a candidate is kept, nearly all others are held back before the shuffle."""
    import zlib
    from hashlib import blake2b

    import numpy as np
    import pyarrow as pa

    class Table:
        value = None

    fps = [blake2b(str(i).encode(), digest_size=16).digest() for i in range(20_000)]
    whole = np.zeros((near_duplicates.CHUNKS, near_duplicates.MARKS // 8 // near_duplicates.CHUNKS), np.uint8)
    for b in near_duplicates._mark(iter([pa.RecordBatch.from_arrays([pa.array(fps[:500]), pa.array(fps[500:1000])], ["fp_a", "fp_b"])])):
        for chunk, part in zip(b.column("chunk").to_pylist(), b.column("marks").to_pylist()):
            whole[chunk] = np.frombuffer(zlib.decompress(part), np.uint8)
    Table.value = zlib.compress(whole.tobytes(), 1)
    sets = pa.RecordBatch.from_arrays([pa.array(fps), pa.array([b"r"] * len(fps))], ["fp", "runs"])
    kept = [x for b in near_duplicates._marked(Table)(iter([sets, sets.slice(0, 0)])) for x in b.column("fp").to_pylist()]
    assert set(fps[:1000]) <= set(kept) and len(kept) < 1100


# --- 2 -----------------------------------------------------------------------

def stretches(rows):
    series = collections.defaultdict(set)
    for h, p, o in rows:
        if h is not None and p is not None and o is not None:
            series[p].add((o, h))
    out = set()
    for a in series:
        for b in series:
            if a < b:
                by = collections.defaultdict(list)
                for o, h in series[a]:
                    for q, g in series[b]:
                        if h == g:
                            by[o - q].append(o)
                for d, at in by.items():
                    at = sorted(set(at))
                    start = at[0]
                    for x, y in zip(at, at[1:] + [10**9]):
                        if y - x > 17:
                            if x - start + 16 >= 64:
                                out.add((a, start, b, start - d))
                            start = y
    return out


@pytest.mark.parametrize("common", [1, 3, 64])
def test_shared_stretches(spark, common):
    rng = random.Random(common)
    rows = []
    base = [(rng.randrange(40) + 1000, o) for o in range(0, 400, 9)]
    for p in range(7):
        cut, shift = rng.randrange(0, 20), rng.randrange(0, 50)
        part = base[cut : cut + 22] if p % 2 else base
        rows += [(None if rng.random() < 0.05 else h, p, o + shift) for h, o in part]
        rows += [(rng.randrange(12), p, 1000 + 5 * k) for k in range(25)]
    rows += [(5, None, 1), (5, 1, None), rows[3], rows[3]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "hash long, passage_id long, token_ordinal int").withColumn("digest", F.lit("clash"))
    got = {tuple(r)[:4] for r in shared_spans.shared_stretches(df, common=common).collect()}
    assert got == stretches(rows) and got
    assert shared_spans.shared_stretches(df.limit(0)).count() == 0


def test_stretch_over_block_edge(spark):
    rows = [(h % 3, p, 16 * h + 40 * p) for p in range(3) for h in range(12)]
    df = spark.createDataFrame(rows, "hash long, passage_id long, token_ordinal int")
    assert {tuple(r)[:4] for r in shared_spans.shared_stretches(df, common=1, block=32).collect()} == stretches(rows)


def test_shared_tokens(spark):
    rows = [(h, p, 16 * h) for p in (1, 2) for h in range(6)] + [(99, 3, 0)]
    df = spark.createDataFrame(rows, "hash long, passage_id long, token_ordinal int")
    got = {r.passage_id: (r.shared_tokens, r.stretches) for r in shared_spans.shared_tokens(df, spark.createDataFrame([(1,), (2,), (3,)], "id long")).collect()}
    assert got == {1: (96, 1), 2: (96, 1), 3: (0, 0)}


# --- 3 -----------------------------------------------------------------------

def test_comments():
    assert without_comments("a # b\n'# c' # d", "x.py").split() == ["a", "'#", "c'"]
    assert without_comments('"""# doc""" #x', "x.py").split() == ['"""#', 'doc"""']
    assert without_comments("a /* b /* c */ d */ e // f\n\"// g\" r#\"/* h \"\"#i '\"' // j", "x.rs").split() == ["a", "e", '"//', 'g"', 'r#"/*', "h", '""#i', "'\"'"]
    assert without_comments("# a", None) == "# a"


def test_format_copies(spark):
    rows = [("b", "x = Foo(1)  # hi"), ("a", "foo\n( X,1 )"), ("c", "x x foo 1"), ("d", "// note\nfoo x 1", {"document_path": "a.rs"}), ("d", "// note\nfoo x 1", {"document_path": "a.rs"}), ("n", None), ("e", "alone"), (None, "foo x 1")]
    s = symbols(spark, rows)
    for hot in (1, 50_000):
        got = {(r.keeper_id, r.id, r.copies) for r in format_duplicates.format_copies(s, hot).collect()}
        assert got == {("a", "a", 3), ("a", "b", 3), ("a", "d", 3)}
    assert {tuple(r) for r in format_duplicates.collapsed(s).collect()} == {("a", 3)}
    assert format_duplicates.format_copies(s.limit(0)).count() == 0


# --- 4 -----------------------------------------------------------------------

LONG = "Reads one two three four five six seven."


@pytest.mark.parametrize(
    ("path", "text", "has"),
    [
        ("a.py", f'def f(a, b="):"):\n    """{LONG}"""\n    return 1', True),
        ("a.py", f'@d(x=")")\nasync def f(a: dict[str, int] = {{}}) -> "x:y":\n    # note\n\n    r\'{LONG}\'\n', True),
        ("a.py", f'def f(): "{LONG}"', True),
        ("a.py", f'def f():\n    ("Reads one two "\n     "three four five six seven")\n', True),
        ("a.py", f'def f():\n    f"""{LONG}"""\n', False),
        ("a.py", f'def f():\n    b"""{LONG}"""\n', False),
        ("a.py", f'def f():\n    x = """{LONG}"""\n', False),
        ("a.py", f'def f():\n    """{LONG}""".strip()\n', False),
        ("a.py", f'def f():\n    # {LONG}\n    pass', False),
        ("a.py", f'def f():\n    def g():\n        """{LONG}"""\n', False),
        ("a.py", 'def f():\n    """\n    @param one two three four five six\n    :return: one two three four five six\n    f does f\n    """\n', False),
        ("a.py", "", False),
        ("a.rs", f"/// {LONG}\n#[inline]\npub(crate) async fn f<T>(x: T) {{}}", True),
        ("a.rs", f"#[cfg(test)]\n/** {LONG} /* in */ */\nfn f() {{}}", True),
        ("a.rs", f'#[doc = r#"{LONG}"#]\nunsafe extern "C" fn f() {{}}', True),
        ("a.rs", "#[doc = \"Reads one two \\\n   three four\"]\n#[doc = \"five six\"]\nfn f() {}", True),
        ("a.rs", f"//// {LONG}\nfn f() {{}}", False),
        ("a.rs", f"/*** {LONG} */\nfn f() {{}}", False),
        ("a.rs", f"/* {LONG} */\n// {LONG}\nfn f() {{ /// {LONG}\n fn g() {{}} }}", False),
        ("a.rs", f"//! {LONG}\nfn f() {{}}", False),
        ("a.rs", f'#[deprecated(note = "{LONG}")]\nfn f() {{}}', False),
    ],
)
def test_documentation(path, text, has):
    got = function_docs.pair_of(text, path, "f")
    assert (got is not None) == has
    if got:
        assert "three four" in got[1] and "Reads one" not in got[0]


def test_documentation_agrees_with_the_language():
    import ast

    rng = random.Random(4)
    for _ in range(300):
        q = rng.choice(('"', "'", '"""', "'''"))
        doc = rng.choice(("", "r", "u", "f", "b", "x = ")) + q + rng.choice(("plain words", "with \\\\ back", "a # b", "tab \\t")) + q + rng.choice(("", "; pass", "  # c", " + 'x'", ".x", ' "more"'))
        text = "def f(a=':', *b) -> int:" + rng.choice(("\n  ", " ", "\n\n  # c\n  ", "  # d\n  ")) + doc + "\n"
        try:
            want = ast.get_docstring(ast.parse(text).body[0], clean=False)
        except SyntaxError:
            continue
        got = function_docs.parse_function(text, ".py")
        assert got is not None and (None if got[0] is None else "\n".join(got[0])) == want, text


def test_documented_functions(spark):
    rows = [("a", f'def f():\n    """{LONG}"""\n', {"kind": " METHOD"}), ("a", f'def f():\n    """{LONG}"""\n', {"kind": " METHOD"}), ("b", f'def f():\n    """{LONG}"""\n', {"kind": "type"}), ("c", None), ("d", f'def f():\n    """{LONG}"""\n', {"document_path": None}), ("deep", "def f(a=" + "(" * 30_000 + ")" * 30_000 + f'):\n    """{LONG}"""\n'), ("long", f'def f():\n    """{LONG}"""\n' + "    x = 1\n" * 50_000), ("e", f'def f():\n    """{LONG}"""\n', {"class": "external"})]
    rows += [("rust", f"/** * {LONG} */ #[x" + "([" * 30_000 + "])" * 30_000 + "] fn f() {}", {"document_path": "a.rs"}), ("tag", f"/** * @param {LONG} */ fn f() {{}}", {"document_path": "a.rs"}), ("paren", "def f():\n    " + "(" * 30_000 + repr(LONG) + ")" * 30_000 + "\n")]
    got = function_docs.documented_functions(symbols(spark, rows)).collect()
    assert sorted((r.canonical_id, r.description) for r in got) == [("a", LONG), ("deep", LONG), ("long", LONG), ("paren", LONG), ("rust", LONG)]
    assert function_docs.documented_functions(symbols(spark, rows).limit(0)).count() == 0


# --- 6 -----------------------------------------------------------------------

def test_split_text():
    rng = random.Random(6)
    unit = re.compile(r"[A-Za-z0-9_]+|[^ \t\n\r\f]")
    for _ in range(200):
        text = "".join(rng.choice(("word", " ", "\n", ".", "(", "\n\n", "x_1", "é", "\r\n", "; ")) for _ in range(rng.randrange(0, 90)))
        size, overlap = rng.randrange(1, 20), rng.randrange(0, 25)
        pieces = split_items.split_text(text, size, overlap)
        n = len(unit.findall(text))
        if not n:
            assert pieces == []
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == n
        for (a, z, p, q, _), after in zip(pieces, [*pieces[1:], None]):
            assert 0 < z - a <= size and unit.findall(text[p:q]) == unit.findall(text)[a:z]
            if after:
                assert a < after[0] <= z < after[1] and z - after[0] <= overlap


def test_split_items(spark):
    s = symbols(spark, [("a", "x " * 600, {"workspace_id": None}), ("b", "one two three"), ("b", "one two three"), ("c", None), ("d", ""), ("e", "y\n" * 40, {"workspace_id": "w"})])
    m = spark.createDataFrame([("w", 10, None), ("v", None, 0)], "workspace_id string, chunk_size int, chunk_overlap int")
    rows = split_items.split_items(s, m).collect()
    by = collections.Counter(r.canonical_id for r in rows)
    assert by["a"] == 2 and by["b"] == 1 and by["e"] > 4 and "c" not in by and "d" not in by
    assert {r.canonical_id for r in split_items.split_items(s, m, only_split=True).collect()} == {"a", "e"}
    assert split_items.split_items(s.limit(0), m).count() == 0


# --- 7 -----------------------------------------------------------------------

def test_encode(spark):
    texts = ["Hello world's   12 x", "", None, "  \n\t ", "<|endoftext|> a", "नमस्ते ไทย 日本　語 \x1c\x85\xa0 \U0001e4d0ࡰa", "a" * 3000, "Hello world's   12 x", "can't \r\n\r\nwon't 'sd", "a\U0010ffff b \U0010ffff\U0010fffe"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("known", F.lit(1))
    t = encode._encoder(encode._vocabulary(spark, f"{encode.TOKENIZERS}/{encode.VOCABULARY}"))
    for hot in (0, 3, 65_536):
        got = {r.doc_id: r.ids for r in encode.encode(df, most_hot=hot).collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(df), encode.pieces(spark)).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encode.encode(df.limit(0)).count() == 0


# --- 8 -----------------------------------------------------------------------

def test_share_out():
    leaf = lambda w, c: mixing.Node("x", weight=w, capacity=c)
    root = mixing.Node("r", children={"a": mixing.Node("a", weight=0.5, children={"x": leaf(0.4, 10), "y": leaf(0.1, 100)}), "b": leaf(0.5, 100)})
    mixing.share_out(root, 100)
    a = root.children["a"]
    # x is short of 30, its sibling y takes them before b does
    assert round(a.children["x"].budget) == 10 and round(a.children["y"].budget) == 40 and round(root.children["b"].budget) == 50
    mixing.share_out(root, 1000)
    assert round(sum(c.budget for c in (*a.children.values(), root.children["b"]))) == 210


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randrange(1, 40), rng.choice(("en", "DE", None)), rng.choice(("Issue ", "issue", "readme", "other", None))) for i in range(300)]
    rows += [(1000, None, "en", "readme"), (1001, "", "en", "readme"), (1002, "tiny", "en", "forum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit(-1))
    targets = spark.createDataFrame([("issue", 0.3, 2), ("readme", 0.5, 3), ("forum", 0.1, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(docs, targets, total=6000)
    got = chosen.collect()
    limit = {"issue": 2, "readme": 3, "forum": 4}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= limit[r.source] for r in got)
    rep = {r.source: r for r in report.collect()}
    assert rep["gone"].tokens == 0 and rep["forum"].tokens <= 4 * rep["forum"].available_tokens
    assert rep["forum"].copies == 4 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    total = sum(r.tokens for r in rep.values())
    assert total <= 6000 and total > 5500 and rep["readme"].actual_share > rep["issue"].actual_share
    again = mixing.mixture(docs.repartition(3), targets, total=6000)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0


# --- 9 -----------------------------------------------------------------------

CASES = [
    "Dr. Ovelle met Mr. Lind at 9.30 a.m. on the host. |They left, e.g. for v1.2.3 etc. and so on. |It ended at 11 p.m. |Then sleep!",
    "See Fig. 3 and Sec. 4.1 for no. 7. |J. K. Merrow et al., rev. 5, agree. |Wait... the end. |So much for that... |We left.",
    'He said "No." and left. |"Is it so?" asked Kerro. |The title says "It broke. Fix it!" in red. |(See a.b for more.) |The owner (was it St. Lind?) signed.',
    "Call a::b first. |c.d_e depends on it. |Entries are dropped.|Then it ends.",
    "Am 3. März kam z. B. die 4. Prüfung, d. h. usw. |Danach Ende. |Er schrieb: „Das genügt.“ |Damit war es gut. |Es heißt: „Alt. Neu bauen!“ und sonst nichts.",
    "« C'est réglé. » |Ainsi finit p. ex. M. Lind. |Que faire ? |Rien !",
    "¿Qué? |¡Nada! |La Sra. Lind, núm. 3, dijo «Bien.» al pie.",
    "См. рис. 3, т. е. так. |Он сказал г. Танник и т. д. |Затем всё. |«Готов ли?» — спросил он.",
    "上限是1.5兆字节。|“有效吗？”他问道。|他说：“好。请重建！”|然后结束！！|谁？",
    "「古い。再構築せよ。」と書いた。|（詳細は参照。）|ええと……確認します。",
    "यह डॉ. ओवेल है। |क्या? |हाँ।",
    "هل هو؟ |سأل: \"هل جاهز؟\" ثم أغلق. |نعم.",
    "It took 3 hrs. \U0001f469\u200d\U0001f4bb or so. |\U0001f9ea Then \u200bzero\u200b no. \ufeff 7. |It ends.",
    "ตารางใหม่มี 5 แถว| ผู้ตรวจปิดงาน| รุ่น 3 ลบ",
    "# Title v1. Yes\n|- one. |Two\n|- three|\n\nPara one\nline two. |End\n|\n```\na. B\n\nc! D\n```\n|1. First\n|2. Second.",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(spark, case):
    text = case.replace("|", "")
    ends, at = [], 0
    for part in case.split("|"):
        at += len(part)
        if part.strip():
            ends.append(at - len(part) + len(part.rstrip()))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted(sentences.sentences(df).collect(), key=lambda r: r.end_char)
    assert [r.end_char for r in got] == ends, [r.sentence for r in got]
    assert all(text[r.start_char : r.end_char] == r.sentence for r in got)


def test_sentences_odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t　"), (4, " a.  B."), (5, "x" * 50_000 + ". " + "Y. " * 3000), (6, "a\n" * 20_000), (None, "A. B.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = collections.Counter(r.doc_id for r in sentences.sentences(df).collect())
    assert set(got) == {4, 5, 6} and got[6] == 1
    assert sentences.sentences(df.limit(0)).count() == 0


def test_sentences_without_limits(spark):
    """Long quotations and brackets stay whole; private-use characters come back."""
    inner = "One two. Three four! " * 120
    texts = {
        1: f"He said “{inner.strip()}” and left. Then he went.",
        2: f"A thing ({inner.strip()} at last) happened. Then it ended.",
        3: "A \ue000 mark \ue0ff here. And \uf000 there (a\ue021. B) too. “One. Two,” he said.",
        4: "Go to a.very." + "long" * 200 + ".host/x.html now. It works.",
        5: "『" + "はい。" * 600 + "』と言った。次だ。",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = collections.defaultdict(list)
    for r in sorted(sentences.sentences(df).collect(), key=lambda r: (r.doc_id, r.end_char)):
        rows[r.doc_id].append(r)
    for i, t in texts.items():
        assert all(t[r.start_char : r.end_char] == r.sentence for r in rows[i]), i
    assert {i: len(r) for i, r in rows.items()} == {1: 2, 2: 2, 3: 3, 4: 2, 5: 2}


def test_hot_key_is_salted(spark):
    """A key above the limit goes through two levels, with the same rows as one level gives."""
    keyed = spark.range(6000).select(F.format_string("s%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).cast("binary").alias("key"))
    from lodestrata.runtime import materialize

    keyed = materialize(keyed, "keyed")
    one, two = (sorted(map(tuple, format_duplicates.collapse(keyed, hot).collect())) for hot in (10**9, 100))
    assert one == two and max(r[2] for r in one) == 2000


def test_shared_runs_over_batches():
    """Rows of runs cut into batches at any place give the same rows once; a run spread over tiles never waits."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.randrange(40), 0, 0, rng.randrange(6)) for _ in range(200)) + [(100, t, 2, t) for t in (0, 0, 2)] + [(101, 0, 0, 7)] * 3
    names = ["run", "tile", "last", "cid"]
    held = collections.defaultdict(set)
    for r, t, k, c in rows:
        held[r, t, k].add(c)
    want = sorted((r, t, k, c) for (r, t, k), cs in held.items() if len(cs) > 1 or k for c in cs)
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*rows[i : i + size])], names) for i in range(0, len(rows), size)]
        got = [tuple(x.as_py() for x in y) for b in near_duplicates._shared(iter(batches)) for y in zip(*b.columns)]
        assert sorted(got) == want, size
