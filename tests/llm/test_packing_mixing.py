import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from termloom.llm import mixing, packing, tokens


def first_fit_slowly(sizes, capacity):
    rooms, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, r in enumerate(rooms):
            if r >= sizes[i]:
                break
        else:
            rooms.append(capacity)
            b = len(rooms) - 1
        rooms[b] -= sizes[i]
        where[i] = b
    return where


@settings(max_examples=200)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_tree_equals_plain_first_fit(sizes):
    where, at = packing.first_fit_decreasing(sizes, 20)
    assert where == first_fit_slowly(sizes, 20)
    spans = sorted((w, a, a + s) for w, a, s in zip(where, at, sizes) if s)
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(spans, spans[1:])) and all(b <= 20 for _, _, b in spans)


def test_pack(spark):
    docs = spark.createDataFrame([(d, "w " * n, "g") for d, n in [(0, 10), (1, 0), (2, 700), (3, 3), (3, 3)]] + [(4, None, "g"), (None, "x", "g")], "doc_id bigint, text string, group string")
    specs = spark.createDataFrame([("s", 64), ("s", 64), ("bad", 0), ("none", None)], "spec string, capacity int")
    rows = packing.pack(docs, specs).collect()
    assert {r["spec"] for r in rows} == {"s"}
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"]))
    assert len(per[3]) == 2 and len(per[4]) == 1 and len(per[None]) == 1 and per[1][0][2] == 0
    two = sorted(per[2])
    assert [a for _, a, _ in two] == [64 * k for k in range(len(two))] and all(n == 64 for _, _, n in two[:-1])
    room = {}
    for r in rows:
        room[r["group"], r["container"]] = room.get((r["group"], r["container"]), 0) + r["tokens"]
    assert max(room.values()) <= 64
    assert packing.pack(docs.limit(0), specs).count() == 0 and packing.pack(docs, specs.limit(0)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    placed = packing.pack(many, specs, group_rows=500)
    assert placed.count() == 3000 and placed.select("group").distinct().count() == 6
    assert packing.fill_report(placed, specs).first()["filled"] > 0.9


def test_token_counts(spark):
    df = spark.createDataFrame([("",), (None,), ("hello world",), ("a" * 200_000,), ("<|endoftext|>",)], "text string")
    got = [r[0] for r in df.select(tokens.token_count(F.col("text"))).collect()]
    assert got[:2] == [0, 0] and 2 <= got[2] <= 3 and got[3] > 1000 and got[4] > 1


@settings(max_examples=200)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50)), max_size=30), st.integers(0, 9))
def test_pivotal_keeps_the_tokens(items, seed):
    p, sizes = [x for x, _ in items], [s for _, s in items]
    out, held, left = mixing.pivotal(p, sizes, random.Random(seed))
    assert [i for i, x in enumerate(out) if x is None] == ([held] if held is not None else [])
    assert abs(sum(s * (left if x is None else x) for x, s in zip(out, sizes)) - sum(a * b for a, b in items)) < 1e-6


def test_pooled_keeps_tokens_and_expectations():
    sizes, q, hits = [50, 20, 9, 9, 5, 3, 1], 0.3, [0] * 7
    for seed in range(4000):
        out, held, left = mixing.pooled(q, sizes, random.Random(seed))
        assert abs(sum(s * (left if x is None else x) for x, s in zip(out, sizes)) - q * sum(sizes)) < 1e-6
        for i, x in enumerate(out):
            hits[i] += left if x is None else x
    assert all(abs(h / 4000 - q) < 0.03 for h in hits)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [(i, "x" * 0, s, rng.randint(1, 40)) for i, s in enumerate(["big"] * 4000 + ["small"] * 300 + ["none"] * 50)] + [(9000, "", "big", 0), (9001, None, None, 7), (None, "", "big", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4), ("absent", 0.2, 2), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    return docs, targets


def test_mix(spark, mixed):
    docs, targets = mixed
    out = mixing.mix(docs, targets, size=F.col("size"), block_rows=100)
    rows = out.collect()
    assert len(rows) == 4353
    assert all(r["copies"] == 0 for r in rows if r["source"] in ("none", None) or not r["tokens"])
    assert max(r["copies"] for r in rows if r["source"] == "small") <= 4 and max(r["copies"] for r in rows if r["source"] == "big") <= 1
    s = {r["source"]: r for r in mixing.shares(out, targets).collect()}
    assert abs(s["big"]["tokens"] - s["small"]["tokens"]) <= 80 and s["absent"]["tokens"] == 0
    assert mixing.mix(docs.limit(0), targets, size=F.col("size")).count() == 0
    assert mixing.mix(docs, targets.limit(0), size=F.col("size")).agg(F.sum("copies")).first()[0] == 0
