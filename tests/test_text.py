import re

from pyspark.sql import functions as F

from termloom.functions import ids, ranking, text


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first()["x"]


def test_words_split_like_a_regular_expression(spark):
    for t in ["a b", " lead", "trail!", "", "été à_l1", "中文。x"]:
        assert one(spark, text.words(F.col("t")), t=t) == re.split(r"\W+", t)


def test_chinese_tokens_are_character_pairs(spark):
    assert one(spark, text.tokens(F.col("t")), t="黑龙江 aaa。水") == ["黑龙", "龙江", "aaa", "水"]
    assert one(spark, text.tokens(F.col("t")), t="a-b") == ["a", "b"]


def test_searchable_first_character(spark):
    for word, ok in [("a", True), ("_x", True), ("。", True), ("-a", False), ("~", False), ("", False)]:
        assert one(spark, text.searchable(F.col("t")), t=word) is ok


def test_words_and_separators_join_back(spark):
    for t in ["a, b", ", a", "a ,", "", "--"]:
        assert "".join(one(spark, text.words_and_separators(F.col("t")), t=t)) == t


def test_title_and_body(spark):
    assert one(spark, text.title(F.col("t")), t="a\nb\nc") == "a"
    assert one(spark, text.body(F.col("t")), t="a\nb\nc") == "b\nc"
    assert one(spark, text.body(F.col("t")), t="a") == ""


def test_sliding_windows_pad_the_end(spark):
    xs = F.split("t", " ")
    assert one(spark, text.sliding(xs, 2), t="a b c") == [["a", "b"], ["b", "c"], ["c", ""]]
    assert one(spark, text.sliding(xs, 2, 2), t="a b c") == [["a", "b"], ["c", ""]]


def test_highlight_or_operands_and_files(spark):
    assert one(spark, text.highlight(F.col("t"), ["the"]), t="The other the") == "<mark>The</mark> other <mark>the</mark>"
    assert one(spark, text.or_operands(F.col("t")), t="cat | dog|x") == ["cat", "dog", "x"]
    assert one(spark, text.strip_gz(F.col("t")), t="g.z.gz") == "g.z"
    assert one(spark, text.base_name(F.col("t")), t="a/b.warc.wet.gz") == "b"
    assert one(spark, text.readable_url(F.col("t")), t="a%20b") == "a b"
    assert one(spark, text.readable_url(F.col("t")), t="a%2") == "a%2"


def test_skip_byte_ids_match_brute_force(spark):
    want, n = [], 0
    while len(want) < 3000:
        n += 1
        if not {9, 10, 32} & set(n.to_bytes(4, "big")):
            want.append(n)
    got = [r[0] for r in spark.range(1, 3001).select(ids.skip_byte_id(F.col("id"))).collect()]
    assert got == want
    assert want[:9] == [1, 2, 3, 4, 5, 6, 7, 8, 11]


def test_id_bytes_and_slugs_round_trip(spark):
    assert one(spark, ids.id_from_bytes(ids.id_bytes(F.col("t"))), t=534538) == 534538
    u = "afe190ad-cd8b-c4b1-376c-60993fb469dc"
    assert one(spark, ids.uuid_from_slug(ids.slug(F.col("t"))), t=u) == u


def test_number_rows_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = sorted((r["k"], r["n"]) for r in ids.number_rows(df, ["k"]).collect())
    assert got == [(k, k + 1) for k in range(1000)]


def test_idf_is_negative_for_frequent_terms(spark):
    assert one(spark, ranking.idf(F.lit(10.0), F.col("t")), t=8.0) < 0 < one(spark, ranking.idf(F.lit(10.0), F.col("t")), t=2.0)
    assert one(spark, ranking.impact(F.col("t"), F.lit(1.0)), t=1.0) == 8192
