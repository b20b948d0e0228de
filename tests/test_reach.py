"""Closures: numbered by one task, by blocks of targets, and by rounds of joins."""

import pickle
import random

import pyarrow as pa

from lodestrata.operators import graph, reach


def pairs(links):
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)
    out = set()
    for a in ahead:
        seen, todo = set(), [a]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out |= {(a, y) for y in seen if y != a}
    return out


def test_closure_by_blocks(monkeypatch):
    monkeypatch.setattr(reach, "LEAST_WIDTH", 8)
    monkeypatch.setattr(reach, "MOST_WIDTH", 8)
    for seed in range(60):
        rng = random.Random(seed)
        nodes = [f"n{i}" for i in range(rng.choice([3, 12, 40]))]
        links = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.choice([1, 15, 50, 90]))})
        rng.shuffle(links)
        batch = pa.RecordBatch.from_pylist([{"src": a, "dst": b} for a, b in links])
        rows = [r for b in reach._number(iter([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)])) for r in b.to_pylist()]
        held, names = pickle.loads(rows[0]["graph"]), [x for r in rows[1:] for x in r["names"]]
        blocks, shares, got = -(-held["targets"] // 8), rng.choice([1, 3]), []
        for b in range(blocks):
            for k in range(shares):
                got += [(names[x], names[b * 8 + p]) for x, places in reach.block_reach(held, b, k, shares) for p in places]
        assert len(got) == len(set(got))
        assert set(got) == pairs(links)
    assert not list(reach._number(iter([])))


def test_closure_ways_agree(spark):
    circle = [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)]
    links = circle + [("s", "c3"), ("s", "x"), ("x", "x"), ("c5", "t"), ("t", "u"), (None, "u"), ("u", None), ("y", "y")]
    df = spark.createDataFrame([("a", *x) for x in links + links[:4]], "kind string, src string, dst string")
    one, many = ([tuple(r) for r in graph.closure(df, **limit).collect()] for limit in ({}, {"one_task": 0}))
    want = pairs([x for x in links if None not in x])
    assert len(one) == len(many) == len(want)
    assert set(one) == set(many) == want
    assert graph.closure(df.limit(0)).count() == 0


def test_closure_over_many_blocks(spark):
    links = [(i, i + 1) for i in range(25_000) if i % 5 < 4]
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(links, "src bigint, dst bigint")).collect()]
    assert len(got) == len(set(got)) == 50_000
    assert set(got) == {(a, b) for a in range(25_000) for b in range(a + 1, a - a % 5 + 5)}


def test_closure_writes_no_round(spark, monkeypatch):
    """The tables written do not grow with the longest way: before, a chain of 25 links wrote 50."""
    written = []
    for module in (graph, reach):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, keep=keep: (written.append(label), keep(df, label))[1])
    links = [(f"n{i:02}", f"n{i + 1:02}") for i in range(25)]
    got = graph.closure(spark.createDataFrame(links, "src string, dst string"))
    assert got.count() == 325
    assert len(written) <= 3
