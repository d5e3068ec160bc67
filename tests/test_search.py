import pytest
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.operators import gcs, heavy_keys, index, language, search
from termloom.operators.snippet import sliding_window, snippets

DOCS = [(0, "the cat sat\nthe dog", "en", "u0"), (1, "the dog", "en", "u1"), (2, "cat", "en", None), (3, "黑龙江 cat", "zh", "u3"), (4, "", "en", "u4"), (5, None, "en", "u5"),
        (6, "dog dog dog\nlong line", "en", "u6")]


@pytest.fixture(scope="module")
def ix(spark):
    return index.Index.build(spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, url string"))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_index_tables(ix):
    assert {(r["term"], r["df"]) for r in ix.terms.where("term in ('cat', 'dog', '黑龙')").collect()} == {("cat", 3), ("dog", 3), ("黑龙", 1)}
    assert ix.stats["n_docs"] == 6  # a null text is no document; an empty one is
    assert ix.docs.where("doc_id = 4").first()["len"] == 1


def test_chinese_is_found_whatever_the_label(spark):
    docs = [(0, "黑龙江 cat", None, "u"), (1, "see 龙江", "en", "u"), (2, "水 x", "zh-CN", "u"), (3, "none", "zh", "u")]
    ix = index.Index.build(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, url string"))
    e = search.SearchEngine(ix)
    assert [sorted(r["doc_id"] for r in e.search(q)["results"]) for q in ("龙江", "黑龙江 | zzz", "水", "none")] == [[0, 1], [0, 1], [2], [3]]
    assert search.query_words("a-b 黑龙江x水") == ["a", "b", "x", "水", "黑龙", "龙江"]
    got = spark.createDataFrame([("a-b 黑龙江x水",)], "q string").select(text.query_words(F.col("q"))).first()[0]
    assert got == search.query_words("a-b 黑龙江x水")


def test_detected_languages_replace_labels(spark):
    samples = spark.createDataFrame([("en", "the house is small and the garden is old"), ("fr", "la maison est petite et le jardin est vieux")], "lang string, text string")
    docs = spark.createDataFrame([(1, "the old garden", None, "u"), (2, "le vieux jardin", "en", "u"), (3, "??", "de", "u")], "doc_id bigint, text string, lang string, url string")
    ix = index.Index.build(docs, model=language.train(samples))
    assert {r["doc_id"]: r["lang"] for r in ix.docs.collect()} == {1: "en", 2: "fr", 3: "de"}


def test_boolean_modes(ix):
    assert ids(search.matches(ix, ["cat", "dog"], "and")) == [0]
    assert ids(search.matches(ix, ["cat", "dog"], "or")) == [0, 1, 2, 3, 6]
    assert ids(search.matches(ix, ["cat", "zzz"], "and", strict=True)) == []
    assert ids(search.matches(ix, ["cat", "zzz"], "and")) == [0, 2, 3]
    assert ids(search.boolean(ix, ("not", ("or", "cat", "dog"), "the"))) == [2, 3, 6]
    assert ids(search.intersection_of(ix.postings, ["cat", "dog"])) == [0] and ids(search.union_of(ix.postings, ["cat", "dog"])) == [0, 1, 2, 3, 6]


def test_pages_partition_the_ranking(ix):
    m = search.matches(ix, ["cat", "dog"], "or")
    pages = [[r["doc_id"] for r in search.page_of(m, p, 2).collect()] for p in range(4)]
    assert pages[3] == [] and sorted(sum(pages, [])) == [0, 1, 2, 3, 6]


def test_engine(ix):
    e = search.SearchEngine(ix)
    assert e.plan("cat | dog") == ("or", ["cat", "dog"]) and e.plan("dog cat cat") == ("auto", ["cat", "dog"]) and e.plan("cat ") == ("single", ["cat"])
    r = e.search("cat | dog")
    assert r["meta"]["results"] == 5 and len(r["results"]) == 5 and r["meta"]["pages"] == 1
    assert e.search("dog | cat") is r and e.search(":cache")["hits"] == 1
    assert e.search("zzz yyy")["meta"]["results"] == 0 and e.search("")["results"] == []
    assert e.search("dog")["results"][0]["title"] is not None
    assert "error" in e.search(":nonsense") and e.search(":cache-clear") == {"cached": 0}
    assert e.search(":reload")["reloaded"] == ix.path and e.search("cat")["meta"]["results"] == 3


def test_blocks_with_gaps(spark):
    p = spark.createDataFrame([("t", d, 1 + d % 3, d % 16384) for d in range(0, 9000, 2)] + [("one", 5, 1, 7)], "term string, doc_id bigint, tf bigint, score int")
    b = index.blocks(p, 2048)
    assert sorted(r["n"] for r in b.where("term = 't'").collect()) == [404, 2048, 2048]
    assert index.decode_blocks(b).exceptAll(p).count() == 0 and index.decode_blocks(b).count() == p.count()
    t = {r["term"]: r for r in index.term_rows(b).collect()}
    assert t["t"]["count"] == 4500 and len(t["t"]["begins"]) == 3 and t["one"]["begins"] == [5]
    assert index.next_geq(p, "t", 4097).first()["doc_id"] == 4098 and index.next_geq(p, "t", 9000).count() == 0


def test_long_range_join_equals_broadcast(spark):
    docs = spark.range(-1, 300000, 997).withColumnRenamed("id", "doc_id")
    ranges = spark.createDataFrame([(-1, 99999, "a"), (99999, 250000, "b")], "start_id bigint, end_id bigint, file string")
    a, b = (sorted(map(tuple, index.locate(docs, ranges, n).select("doc_id", "file").collect())) for n in (10, 1))
    assert a == b and len(a) == sum(-1 < d <= 250000 for d in range(-1, 300000, 997))


def test_snippets():
    assert snippets("x", ["x"]) == [] and snippets(None, ["x"]) == []
    body = "cat dog one\nnothing here\ncat and dog\ndog cat x"
    assert snippets(body, ["cat", "dog"], budget=9) == ["dog cat x", "cat dog one", "cat and dog"]
    assert len(snippets("cat " * 100, ["cat"])) == 1
    assert sliding_window([1, 2, 3], 2, 1, 0) == [(1, 2), (2, 3), (3, 0)]


def test_gcs_has_no_false_negatives(spark):
    items = spark.createDataFrame([(x,) for x in ["the", "and", "of", None, "of"]], "w string")
    asked = spark.createDataFrame([(x,) for x in ["the", "of", "rnd", "dof", None]], "w string")
    got = {r["w"]: r["contained"] for r in gcs.contains(gcs.build(items, "w"), asked, "w").collect()}
    assert got == {"the": True, "of": True, "rnd": False, "dof": False, None: False}


def test_heavy_keys_edges(spark):
    rows = [("a", 1, 2)] * 5 + [("a", 2, None), (None, 1, 1), ("", 1, 1), ("b", None, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "term string, doc_id bigint, freq int, lines string")
    got = {r["term"]: (r["lines"], r["records"], r["weight_sum"]) for r in heavy_keys.per_key_totals(df).collect()}
    assert got == {"a": (6, 2, 10), None: (1, 1, 1), "": (1, 1, 1), "b": (1, 0, 3)}
    assert [r["term"] for r in heavy_keys.heavy_keys(df, share="0.5").collect()] == ["a"]
    assert heavy_keys.heavy_keys(df.limit(0)).count() == 0 and heavy_keys.per_key_totals(df.limit(0)).count() == 0
    skew = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("term"), F.col("id").alias("doc_id"), F.lit(1).alias("freq"))
    assert [(r["term"], r["records"]) for r in heavy_keys.heavy_keys(skew, share="0.3").collect()] == [("hot", 6667)]
