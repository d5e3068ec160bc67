import gzip

from pyspark.sql import functions as F

from termloom.operators import index, language
from termloom.sources import lexicon_files, wet
from termloom.sources.settings import Settings
from termloom.streaming import segments


def record(url, body, kind="conversion"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n" + (f"WARC-Target-URI: {url}\r\n" if url else "") + "WARC-Record-ID: <urn:uuid:afe190ad-cd8b-c4b1-376c-60993fb469dc>\r\n"
    return head.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_wet_reader(spark, tmp_path):
    parts = [record(None, b"info", "warcinfo"), record("http://a/", "titré\nWARC/1.0 is text".encode()), record("http://b/", b"")]
    with open(tmp_path / "x.warc.wet.gz", "wb") as f:
        for p in parts:
            f.write(gzip.compress(p))  # one member per record
    (tmp_path / "y.warc.wet").write_bytes(parts[1] + parts[2][:40])
    rows = wet.read_wet(spark, str(tmp_path)).orderBy("source_file", "off").collect()
    assert [(r["url"], bytes(r["content"]).decode()) for r in rows[:2]] == [("http://a/", "titré\nWARC/1.0 is text"), ("http://b/", "")]
    assert rows[0]["off"] == len(parts[0]) and rows[0]["record_id"] == "afe190ad-cd8b-c4b1-376c-60993fb469dc"
    assert wet.record_at(rows[0]["source_file"], rows[0]["off"], "http://a/").startswith("titré".encode())
    assert wet.record_at(rows[0]["source_file"], rows[0]["off"], "http://b/") is None


def test_lexicon_and_range_files(spark, tmp_path):
    lex = spark.createDataFrame([("b", 2, 1), ("a", 11, 3), ("a", 2, 1)], "term string, doc_id bigint, tf int")
    lexicon_files.write_lexicon(lex, str(tmp_path / "lex"))
    back = lexicon_files.read_lexicon(spark, str(tmp_path / "lex"))
    assert sorted(map(tuple, back.collect())) == [("a", 2, 1), ("a", 11, 3), ("b", 2, 1)] and lexicon_files.invalid_lines(back).count() == 0
    (tmp_path / "bad").write_text("no tab\n\t1 2\na\t1 2\n")
    assert lexicon_files.invalid_lines(lexicon_files.read_lexicon(spark, str(tmp_path / "bad"))).count() == 2
    docs = spark.createDataFrame([(0, "f.gz"), (4, "f.gz"), (9, "g.gz")], "doc_id bigint, source string")
    lexicon_files.write_ranges(index.file_ranges(docs), str(tmp_path / "r"))
    assert sorted(map(tuple, lexicon_files.read_ranges(spark, str(tmp_path / "r")).collect())) == [(-1, 4, "f"), (8, 9, "g")]
    lexicon_files.write_url_table(docs.withColumn("url", F.col("source")), str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).count() == 3


def test_settings(tmp_path):
    (tmp_path / "c.ini").write_text("[Query]\npage_length = 7\n")
    assert Settings.load(str(tmp_path / "c.ini")).page_length == 7


def test_streamed_segments(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, url string, captured_at timestamp"
    spark.createDataFrame([(1, "a b", "en", "u"), (2, "b", "en", "u")], "doc_id bigint, text string, lang string, url string").withColumn("captured_at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    segments.start_indexing(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(60)
    docs, lex = segments.merged(spark, str(tmp_path / "ix"))
    assert docs.count() == 2 and sorted(r["term"] for r in lex.collect()) == ["a", "b", "b"]
    assert segments.windowed_captures(spark.read.parquet(str(tmp_path / "in"))).agg(F.sum("n")).first()[0] == 2


def test_language_detection(spark):
    samples = spark.createDataFrame([("en", "the house is small and the garden is old"), ("fr", "la maison est petite et le jardin est vieux"), ("xx", "zzz"), (None, "x")], "lang string, text string")
    model = language.train(samples)
    docs = spark.createDataFrame([(1, "the old garden"), (2, "le vieux jardin"), (3, None), (4, "")], "doc_id bigint, text string")
    assert dict(map(tuple, language.detect(docs, model, "doc_id").where("doc_id < 3").collect())) == {1: "en", 2: "fr"}
    assert {r["detected"] for r in language.detect(docs, model, "doc_id", languages=["fr"]).collect()} == {"fr"}
