"""Building an inverted index: documents -> lexicon -> scored postings, terms and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codecs, ranking, text
from ..runtime import new_scratch
from . import language

BLOCK = 2048
INDEX_LANGUAGES = ("en", "fr", "de", "it", "la", "es", "zh")


def with_url(df: DataFrame) -> DataFrame:
    return df.where("url IS NOT NULL AND url <> ''")


def with_content(df: DataFrame, content: str = "text") -> DataFrame:
    return df.where(F.length(content) > 0)


def in_languages(df: DataFrame, languages: tuple[str, ...] = INDEX_LANGUAGES, skip_chinese: bool = False) -> DataFrame:
    return df.where(F.col("lang").isin([x for x in languages if not (skip_chinese and x == "zh")]))


def tokenized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``tokens`` (null for a null text)."""
    return docs.withColumn("tokens", text.tokens(F.col("text")))


def doc_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, url, lang, len)``; len counts all tokens, empty ones included."""
    return tokenized(docs).select("doc_id", "url", "lang", F.size("tokens").alias("len")).where("len >= 0")


def lexicon(docs: DataFrame) -> DataFrame:
    """``(term, doc_id, tf)``; empty terms are dropped here, after the lengths are taken."""
    return (tokenized(docs).select("doc_id", F.explode("tokens").alias("term")).where("term <> ''")
            .groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")))


def term_table(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(doc_rows: DataFrame, postings: DataFrame) -> DataFrame:
    """One row. avgdl is distinct terms per document; avg_len is tokens per document."""
    d = doc_rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("sum_len"))
    p = term_table(postings).agg(F.sum("df").alias("n_postings"), F.count(F.lit(1)).alias("n_terms"))
    return d.join(F.broadcast(p)).select(  # one row each
        "n_docs", "n_postings", "n_terms", "sum_len", (F.col("n_postings") / F.col("n_docs")).alias("avgdl"),
        (F.col("sum_len") / F.col("n_docs")).alias("avg_len"))


def scored(lexicon_: DataFrame, doc_rows: DataFrame, avgdl: Column) -> DataFrame:
    """``(term, doc_id, tf, score, len)`` with the length-normalized impact score; len spares the second phase of a query its join."""
    norm = ranking.length_norm(F.col("len"), avgdl)
    return lexicon_.join(doc_rows.select("doc_id", "len"), "doc_id").select(
        "term", "doc_id", "tf", ranking.impact(F.col("tf"), norm).alias("score"), "len")


def blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """Posting lists cut into blocks of ``size`` in doc_id order, each stream delta- and byte-coded.

    The place of a posting in its list comes from counts of doc_id slices, so a list of any length is numbered by many tasks.
    """
    placed = number_in_lists(postings).withColumn("block_no", F.floor((F.col("rn") - 1) / size).cast("int"))
    grouped = placed.groupBy("term", "block_no").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "score"))).alias("p"))
    return grouped.select(
        "term", "block_no", F.col("p")[0]["doc_id"].alias("begin_id"), F.size("p").alias("n"),
        codecs.vbyte_encode(codecs.deltas(F.col("p.doc_id"))).alias("ids"),
        codecs.vbyte_encode(F.col("p.tf")).alias("tfs"), codecs.vbyte_encode(F.col("p.score")).alias("scores"))


def number_in_lists(postings: DataFrame, slice_ids: int = 65536) -> DataFrame:
    """``rn``: the place of each posting in its term's list, counted within slices of doc_id and offset by earlier slices' sizes."""
    s = postings.withColumn("slice", F.floor(F.col("doc_id") / slice_ids))
    sizes = s.groupBy("term", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("term").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("term", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("term", "slice").orderBy("doc_id")
    return (s.withColumn("rn", F.row_number().over(inner)).join(offsets, ["term", "slice"])
            .withColumn("rn", F.col("rn") + F.col("before")).drop("before", "slice"))


def decode_blocks(block_rows: DataFrame) -> DataFrame:
    """The postings of a block table."""
    gaps = block_rows.select("term", codecs.partial_sums(codecs.vbyte_decode(F.col("ids"))).alias("ids"),
                             codecs.vbyte_decode(F.col("tfs")).alias("tfs"), codecs.vbyte_decode(F.col("scores")).alias("scores"))
    return gaps.select("term", F.explode(F.arrays_zip("ids", "tfs", "scores")).alias("p")).select(
        "term", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.scores").cast("int").alias("score"))


def term_rows(block_rows: DataFrame) -> DataFrame:
    """``(term, count, begins, idOffs, tfOffs, bmOffs)``: byte ranges of a term's streams, relative to the term's own start."""
    sizes = ["ids", "tfs", "scores"]
    w = Window.partitionBy("term").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = sum((F.octet_length(c) for c in sizes), F.lit(0))
    placed = block_rows.withColumn("at", F.coalesce(F.sum(whole).over(w), F.lit(0)) + F.octet_length(F.encode("term", "UTF-8")))
    at, cols = F.col("at"), []
    for c in sizes:
        cols.append(F.struct(at.cast("bigint").alias("off"), F.octet_length(c).alias("len")).alias(c + "_at"))
        at = at + F.octet_length(c)
    rows = placed.select("term", "block_no", "begin_id", "n", *cols)
    g = rows.groupBy("term").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("block_no", "begin_id", *(c + "_at" for c in sizes)))).alias("b"))
    return g.select("term", "count", F.col("b.begin_id").alias("begins"), F.col("b.ids_at").alias("idOffs"),
                    F.col("b.tfs_at").alias("tfOffs"), F.col("b.scores_at").alias("bmOffs"))


def next_geq(postings: DataFrame, term: str, doc_id: int) -> DataFrame:
    """The first posting of ``term`` at or after ``doc_id``; both conditions reach the Parquet scan."""
    return postings.where((F.col("term") == term) & (F.col("doc_id") >= doc_id)).groupBy("term").agg(
        F.min("doc_id").alias("doc_id"))


def next_geq_many(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """The first posting at or after ``target`` for each of many ``(term, target)``; pairs without one have no row."""
    hits = postings.select("term", "doc_id").join(asked, "term").where(F.col("doc_id") >= F.col("target"))
    return hits.groupBy("term", "target").agg(F.min("doc_id").alias("doc_id"))


def file_ranges(docs: DataFrame, file: str = "source") -> DataFrame:
    return docs.groupBy(F.col(file).alias("file")).agg((F.min("doc_id") - 1).alias("start_id"), F.max("doc_id").alias("end_id"))


def locate(docs: DataFrame, ranges: DataFrame, max_ranges: int = 100_000) -> DataFrame:
    """``docs`` with the ``file`` whose ``start_id < doc_id <= end_id``; documents outside all ranges are left out.

    Up to ``max_ranges`` ranges (one row per input file) go to every task. Beyond that both sides are cut into equal strips of ids
    and joined on the strip, so that neither side is compared as a whole.
    """
    r = ranges.select("start_id", "end_id", F.col("file").alias("range_file"))
    inside = (F.col("doc_id") > F.col("start_id")) & (F.col("doc_id") <= F.col("end_id"))
    if r.count() <= max_ranges:
        out = docs.join(F.broadcast(r), inside)
    else:
        width = F.lit(1 << 16)
        strips = F.sequence(F.floor((F.col("start_id") + 1) / width), F.floor(F.col("end_id") / width))
        out = (docs.withColumn("_strip", F.floor(F.col("doc_id") / width))
               .join(r.withColumn("_strip", F.explode(strips)), "_strip").where(inside).drop("_strip"))
    return out.withColumnRenamed("range_file", "file").drop("start_id", "end_id")


@dataclass
class Index:
    """A written index. ``stats`` is the one row of corpus_stats."""

    path: str
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: dict
    _known: dict = field(default_factory=dict, repr=False)

    @classmethod
    def build(cls, documents: DataFrame, path: str | None = None, salt: int = 8, model: DataFrame | None = None) -> "Index":
        """Write ``docs``, ``terms``, ``postings`` (by term, long lists spread over ``salt`` files) and ``stats`` under ``path``.

        Terms and postings are sorted by term, and terms have a Bloom filter, so a lookup reads few row groups. With a language ``model`` (see
        language.train) a document's language is the detected one; its label counts only where nothing is detected.
        """
        spark = documents.sparkSession
        path = path or new_scratch(spark, "index")

        def put(df: DataFrame, name: str, **options) -> DataFrame:
            df.write.options(compression="zstd", **options).parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        rows = tokenized(documents.where("text IS NOT NULL"))
        docs = rows.select("doc_id", "url", "lang", F.size("tokens").alias("len"), text.title(F.col("text")).alias("title"), text.body(F.col("text")).alias("body"))
        if model is not None:
            found = language.detect(documents.where("text IS NOT NULL"), model, "doc_id", languages=list(INDEX_LANGUAGES)).groupBy("doc_id").agg(F.max("detected").alias("detected"))
            docs = docs.join(found, "doc_id", "left").withColumn("lang", F.coalesce("detected", "lang")).drop("detected")
        docs = put(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "docs")
        lex = put(lexicon(documents), "lexicon")
        terms = put(term_table(lex).repartitionByRange("term").sortWithinPartitions("term"), "terms", **{"parquet.bloom.filter.enabled#term": "true"})
        stats = put(corpus_stats(docs, lex), "stats").first().asDict()  # one row
        long_list = F.when(F.col("doc_id").isNotNull(), F.pmod(F.floor(F.col("doc_id") / 4096), F.lit(salt)))
        postings = put(scored(lex, docs, F.lit(float(stats["avgdl"] or 1.0)))
                       .repartition("term", long_list).sortWithinPartitions("term", "doc_id"), "postings")
        return cls(path, docs, postings, terms, stats)

    @classmethod
    def open(cls, spark, path: str) -> "Index":
        docs, terms, postings, stats = (spark.read.parquet(f"{path}/{n}") for n in ("docs", "terms", "postings", "stats"))
        return cls(path, docs, postings, terms, stats.first().asDict())

    def write_blocks(self) -> DataFrame:
        """Write the posting lists as blocks under ``path``, sorted by term."""
        path = f"{self.path}/blocks"
        blocks(self.postings).repartition("term", "block_no").sortWithinPartitions("term", "block_no").write.option("compression", "zstd").parquet(path)
        return self.docs.sparkSession.read.parquet(path)

    def served_from_blocks(self) -> "Index":
        """The same index with its postings decoded from the written blocks when they are asked for: a query's terms reach the scan of the
        blocks, and only their blocks are decoded."""
        rows = decode_blocks(self.docs.sparkSession.read.parquet(f"{self.path}/blocks"))
        return replace(self, postings=rows.join(self.docs.select("doc_id", "len"), "doc_id"), _known={})

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """Document counts of those of the words that the index holds: one lookup for all not asked before, one row a word at most."""
        new = [w for w in set(words) if w not in self._known]
        if new:
            if len(self._known) > 100_000:
                self._known.clear()
            found = {r["term"]: r["df"] for r in self.terms.where(F.col("term").isin(new)).select("term", "df").collect()}
            self._known.update({w: found.get(w) for w in new})
        return {w: self._known[w] for w in sorted(set(words)) if self._known.get(w) is not None}
