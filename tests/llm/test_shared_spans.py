import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from termloom.llm import shared_spans as ss
from termloom.llm.anchors import Winnower
from termloom.llm.fm_index import FMIndex, suffix_order


@settings(max_examples=100)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.lists(st.integers(1, 5), min_size=1, max_size=4), st.sampled_from([4, 8, 60]))
def test_backward_search_counts_occurrences(text, pattern, depth):
    fm = FMIndex(np.array(text), 6, depth)
    lo, hi = fm.symbol(np.array([pattern[-1]]))
    for s in reversed(pattern[:-1]):
        lo, hi = fm.extend(np.array([s]), lo, hi)
    n = len(pattern)
    want = {i for i in range(len(text)) if text[i:i + n] == pattern}
    assert set(fm.sa[int(lo[0]):int(hi[0])].tolist()) == want if want else hi[0] <= lo[0]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=50), st.integers(1, 60))
def test_suffix_order(xs, depth):
    xs = [*xs, 0]
    got = [xs[i:i + depth] for i in suffix_order(np.array(xs), 5, depth).tolist()]
    assert got == sorted(xs[i:i + depth] for i in range(len(xs)))


@settings(max_examples=60)
@given(st.lists(st.text("ab\0", max_size=40), min_size=1, max_size=6), st.lists(st.text("abc", max_size=40), min_size=1, max_size=4), st.integers(2, 9))
def test_runs_of_a_shard_are_maximal_and_complete(held, asked, n):
    def brute_runs(x, y):
        out = set()
        for i in range(len(x)):
            for j in range(len(y)):
                if i and j and x[i - 1] == y[j - 1]:
                    continue
                k = 0
                while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                    k += 1
                if k >= n:
                    out.add((i, j, k))
        return out

    held, asked = [x for x in held if x], [x for x in asked if x]
    if not held:
        return
    shard = ss.Shard([(d, 7, x) for d, x in enumerate(held)], n)
    got = {tuple(r) for r in shard.runs().T.tolist()}
    assert got == {(a, b, i + 7, j + 7, k) for a, x in enumerate(held) for b, y in enumerate(held) if a < b for i, j, k in brute_runs(x, y)}
    if asked:
        got = {tuple(r) for r in shard.runs(ss.Stretches([(100 + d, 0, x) for d, x in enumerate(asked)], -2)).T.tolist()}
        assert got == {(a, 100 + b, i + 7, j, k) for a, x in enumerate(held) for b, y in enumerate(asked) for i, j, k in brute_runs(x, y)}


def test_no_runs_without_backward_search(spark, docs, monkeypatch):
    monkeypatch.setattr(ss.FMIndex, "extend", lambda self, s, lo, hi: (lo, lo))
    rows = [(d, 0, t) for d, t in docs if t]
    assert ss.Shard(rows, 60).runs().shape[1] == 0


def test_every_long_passage_has_a_common_anchor():
    rng, w = random.Random(1), Winnower(101, 100, chunk=1500)
    for _ in range(30):
        shared = "".join(rng.choice("ab 是") for _ in range(200))
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 3000))) + shared + "x" * rng.randint(0, 50)
        b = "y" * rng.randint(0, 400) + shared + "".join(rng.choice("abc") for _ in range(rng.randint(0, 2000)))
        who, at, h = w.of_texts([a, "short", b])
        where = {(int(i), int(p)) for i, p in zip(who, at)}
        assert any((0, a.index(shared) + k) in where and (2, b.index(shared) + k) in where for k in range(100))
        assert 1 not in who


def brute(docs, n):
    grams = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            grams.setdefault(t[i:i + n], set()).add(d)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh é是") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(5, 200)) for _ in range(40)]
    out = list(base)
    for _ in range(60):
        a, b = rng.choice(base), rng.choice(base)
        i = rng.randrange(len(a))
        out.append(b[:rng.randrange(len(b) + 1)] + a[i:i + rng.randint(20, 260)] + text(rng.randint(0, 30)))
    out += [base[0], base[0], "-" * 700, "x" + "-" * 650, "ab" * 400, "", None, "\n".join(base[3:5]), "short"]
    return list(enumerate(out))


@pytest.mark.parametrize("shard_chars", [10**6, 9000])
def test_pairs_equal_brute_force(spark, docs, shard_chars):
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, hash string")
    runs, members = ss.shared_runs(df, 60, shard_chars)
    got = {(r["doc_a"], r["doc_b"]) for r in ss.document_pairs(runs, members).collect()}
    assert got == brute(docs, 60)
    texts = dict(docs)
    rows = runs.collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    for r in rows:
        a, b, n = texts[r["doc_a"]], texts[r["doc_b"]], r["length"]
        assert n >= 60 and a[r["start_a"]:r["start_a"] + n] == b[r["start_b"]:r["start_b"] + n]
    share = {r["doc_id"]: r for r in ss.shared_per_document(df, runs, members).collect()}
    assert len(share) == len(docs)
    for d, t in docs[:40]:
        inside = set()
        for r in rows:
            for x in "ab":
                if r[f"doc_{x}"] == d:
                    inside |= set(range(r[f"start_{x}"], r[f"start_{x}"] + r["length"]))
        if share[d]["shared_chars"] != len(t):
            assert share[d]["shared_chars"] == len(inside)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    runs, members = ss.shared_runs(df)
    assert runs.count() == 0 and ss.document_pairs(runs, members).count() == 0


def test_null_ids_are_left_out_and_repeats_kept(spark):
    t = "".join(random.Random(9).choice("abcdef ") for _ in range(400))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t[:250] + "zz")], "doc_id bigint, text string")
    runs, members = ss.shared_runs(df)
    assert [(r["doc_a"], r["doc_b"]) for r in ss.document_pairs(runs, members).collect()] == [(1, 2)]
