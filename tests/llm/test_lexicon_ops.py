import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from termloom.llm import distinctive, term_counts as tc, top_per_group as tg

LINES = "term string, doc_id bigint, chunk_no int, freq int, sign string"


def lines(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LINES)


ROWS = [("a", 1, 0, 2), ("a", 1, 0, 2), ("a", 1, 1, 3), ("a", 2, 0, 1), ("b", 2, 0, None), ("c", None, 0, 4), (None, 1, 0, 9), ("", 1, 0, 9), ("d", 3, None, 1)]


def counts(df):
    return {r["term"]: (r["occurrences"], r["records"]) for r in df.collect()}


def test_counts_with_nulls_and_repeats(spark):
    assert counts(tc.count_terms(lines(spark, ROWS)).counts()) == {"a": (6, 2), "b": (0, 1), "c": (4, 0), "d": (1, 1)}
    assert counts(tc.count_terms(lines(spark, ROWS).limit(0)).counts()) == {}


def test_marks(spark):
    df = lines(spark, [("x", d, 0, 1) for d in range(10)] + [("y", d, 0, 1) for d in range(3)] + [("z", 1, 0, 1)])
    store = tc.count_terms(df)
    got = {r["term"]: r["mark"] for r in tc.mark_terms(store.counts(), store.records).collect()}
    assert got == {"x": "common", "y": None, "z": "rare"}


def test_deltas_equal_a_recount(spark, tmp_path):
    rng = random.Random(1)
    def doc(d):
        return [(rng.choice("abcdefgh"), d, c, rng.randint(1, 3)) for c in range(4)]
    old = {d: doc(d) for d in range(30)}
    store = tc.CountStore(spark, f"file://{tmp_path}/counts", buckets=4).apply(lines(spark, sum(old.values(), [])))
    new = {d: r for d, r in old.items() if d >= 5}  # deleted
    new |= {d: doc(d) for d in range(10, 15)} | {d: doc(d) for d in range(30, 35)}  # changed and added
    gone = sum((old[d] for d in [*range(5), *range(10, 15)]), [])
    come = sum((new[d] for d in [*range(10, 15), *range(30, 35)]), [])
    store.apply(lines(spark, come), lines(spark, gone))
    want = counts(tc.count_terms(lines(spark, sum(new.values(), []))).counts())
    assert store.records == len(new)
    assert counts(store.counts()) == want
    assert counts(tc.CountStore.open(spark, store.path).counts()) == want
    assert counts(tc.CountStore.open(spark, store.path, 1).counts()) != want
    again = tc.CountStore.open(spark, store.path)
    assert (again.version, again.buckets, again.records) == (2, 4, len(new))


def test_top_per_group(spark):
    rows = [(0, "t", d, f, s) for d, f, s in [(1, 1, 5), (1, 1, 5), (2, 2, 5), (3, 2, 5), (4, 9, None), (5, 1, 9), (6, None, 5)]] + [(0, None, 1, 1, 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "seg_id int, term string, doc_id bigint, freq int, score int, rank int")
    got = tg.top_per_group(df, ["seg_id", "term"], ["doc_id"], "score", 4, ["freq"])
    assert [r["doc_id"] for r in got.where("term = 't'").orderBy("rank").collect()] == [5, 3, 2, 1]
    assert got.where("term IS NULL").count() == 1 and tg.top_per_group(df.limit(0), ["term"], ["doc_id"], "score").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    big = spark.range(30000).select(F.lit(0).alias("seg_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("term"), F.col("id").alias("doc_id"), F.lit(1).alias("freq"), (F.col("id") % 7).alias("score"))
    assert [r["doc_id"] for r in tg.top_per_group(big, ["term"], ["doc_id"], "score", 2).where("term = 'hot'").orderBy("rank").collect()] == [d for d in range(29999, 0, -1) if d % 3 == 0 and d % 7 == 6][:2]


def docs(spark, rows):
    return spark.createDataFrame([(d, f"u{d}", "en", n, 0, "x") for d, n in rows], "doc_id bigint, url string, lang string, len int, off bigint, tf string")


def test_weights_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcdefghijkl"), d, c, rng.randint(1, 4)) for d in range(12) for c in range(6)]
    lens = [(d, 20 + d) for d in range(11)] + [(11, None), (3, 23)]
    df, dd = lines(spark, rows + rows[:5] + [(None, 1, 0, 5), ("", 2, 0, 5)]), docs(spark, lens)
    tf = Counter()
    for t, d, _, f in set(rows):
        tf[d, t] += f
    n = Counter(t for _, t in tf)
    avg = sum(x for _, x in set(lens) if x) / sum(1 for _, x in set(lens) if x)
    length = dict(x for x in lens if x[1])
    want = {}
    for (d, t), f in tf.items():
        if d in length and n[t] >= 3:
            k = 1.2 * (0.25 + 0.75 * length[d] / avg)
            want[d, t] = round(math.log((12 - n[t] + 0.5) / (n[t] + 0.5)) * 2.2 * f / (k + f), 6)
    stats = distinctive.term_statistics(df, dd)
    for bound in (10, 0.1, 0):  # all terms shuffled, some, none
        got = {(r["doc_id"], r["term"]): r["weight"] for r in distinctive.weigh(stats, dd, hot_share=bound).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    best = defaultdict(list)
    for (d, t), w in sorted(want.items(), key=lambda x: (-x[1], x[0][1])):
        best[d].append(t)
    top = {(r["doc_id"], r["term"]) for r in distinctive.best_terms(distinctive.weigh(stats, dd)).collect()}
    assert top == {(d, t) for d, ts in best.items() for t in ts[:3]}
    signs = {r["term"]: r["weight"] for r in distinctive.weigh(stats, dd, "llr").where("doc_id = 1").collect()}
    assert all(math.isfinite(w) for w in signs.values())
    empty = distinctive.weigh(distinctive.term_statistics(df.limit(0), dd), dd)
    assert empty.count() == 0


def test_repeated_lines_are_found_in_sets_of_chunks(spark):
    many = [("hot", 1, c, 2) for c in range(200)]
    odd = [("a", 2, c, f) for c in (None, -65, -64, -1, 0, 63, 64, 2**31 - 1, -2**31) for f in (1, 3, None)] + [("b", 2, 5, None)]
    left_out = [("", 2, 1, 1), (None, 2, 1, 1), ("a", None, 1, 1)]
    df = lines(spark, (many + odd) * 2 + left_out)
    assert distinctive.chunk_sets(df).where("term = 'hot'").count() == 4  # of 400 lines
    got = {(r["doc_id"], r["term"]): r["tf"] for r in distinctive.term_statistics(df, docs(spark, [(1, 9)])).collect()}
    assert got == {(1, "hot"): 400, (2, "a"): 36, (2, "b"): None}


def test_llr_of_a_known_table(spark):
    row = spark.createDataFrame([(10, 100, 12), (1, 100, 500)], "tf bigint, len bigint, cf bigint")
    got = [r[0] for r in row.select(distinctive.llr(F.lit(10000.0))).collect()]
    def g(a, r, c, t):
        cells = [(a, r, c), (r - a, r, t - c), (c - a, t - r, c), (t - r - c + a, t - r, t - c)]
        return 2 * sum(o * math.log(o * t / (x * y)) for o, x, y in cells if o)
    assert abs(got[0] - g(10, 100, 12, 10000)) < 1e-6 and abs(got[1] + g(1, 100, 500, 10000)) < 1e-6
