"""Queries of the training-data operators, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import table
from . import distinctive, mixing, packing, page_languages, pages, shared_spans, term_counts, top_per_group

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


_LINES = "l AS (SELECT DISTINCT term, doc_id, chunk_no, freq FROM lexicon WHERE term IS NOT NULL AND term <> '')"
_COUNTS = (_LINES + ", c AS (SELECT term, sum(freq)::BIGINT AS occurrences, count(DISTINCT doc_id) AS records FROM l GROUP BY term),"
           " n AS (SELECT count(DISTINCT doc_id) AS n FROM l)")
_MARK = "CASE WHEN records < 3 THEN 'rare' WHEN records > 0.30 * n THEN 'common' END AS mark"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = term_counts.count_terms(table(spark, sf_dir, "lexicon"))
    return term_counts.mark_terms(store.counts(), store.records)


@query("p1_found", f"WITH {_COUNTS} SELECT term, mark FROM (SELECT term, {_MARK} FROM c, n) WHERE mark IS NOT NULL")
def p1_found(spark, sf_dir):
    return _marked(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


@query("p1_term_counts", f"WITH {_COUNTS} SELECT term, occurrences, records, {_MARK} FROM c, n")
def p1_term_counts(spark, sf_dir):
    return _marked(spark, sf_dir)


@query("p1_incremental", f"WITH {_COUNTS} SELECT term, occurrences, records FROM c")
def p1_incremental(spark, sf_dir):
    """Two loads of the whole index: the records of its first file, then all others as added and those of the first file again as changed."""
    lines, ranges = table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "doc_ranges")
    end = ranges.agg(F.min("end_id").alias("e")).scalar()
    first = lines.where(F.col("doc_id") <= end)
    path = term_counts.new_scratch(spark, "term-counts")
    term_counts.CountStore(spark, path).apply(first)
    return term_counts.CountStore.open(spark, path).apply(lines, first).counts()


_TOP = ("SELECT *, row_number() OVER (PARTITION BY seg_id, term ORDER BY score DESC, freq DESC NULLS LAST, doc_id DESC NULLS LAST) AS rank"
        " FROM (SELECT DISTINCT * FROM postings WHERE score IS NOT NULL)")


def _top_postings(spark, sf_dir):
    return top_per_group.top_per_group(table(spark, sf_dir, "postings"), ["seg_id", "term"], ["doc_id"], "score", 10, ["freq"])


@query("p3_found", f"SELECT seg_id, term, doc_id FROM ({_TOP}) WHERE rank <= 10")
def p3_found(spark, sf_dir):
    return _top_postings(spark, sf_dir).select("seg_id", "term", "doc_id")


@query("p3_top_postings", f"SELECT seg_id, term, score, freq, doc_id, rank FROM ({_TOP}) WHERE rank <= 10")
def p3_top_postings(spark, sf_dir):
    return _top_postings(spark, sf_dir)


_TF = (_LINES + ", tf AS (SELECT doc_id, term, sum(freq) AS tf FROM l WHERE doc_id IS NOT NULL GROUP BY ALL),"
       " d AS (SELECT term, count(*) AS n, sum(tf) AS cf FROM tf GROUP BY term),"
       " s AS (SELECT count(DISTINCT doc_id) AS nn, sum(tf)::DOUBLE AS total FROM tf),"
       " g AS (SELECT DISTINCT * FROM docs), a AS (SELECT avg(len) AS avgdl FROM g),"
       " e AS (SELECT doc_id, max(len) AS len FROM g GROUP BY doc_id HAVING max(len) IS NOT NULL)")
_BM25 = (_TF + ", w AS (SELECT doc_id, term, round(ln((nn - n + 0.5) / (n + 0.5)) * 2.2 * tf / (1.2 * (0.25 + 0.75 * len / avgdl) + tf), 6) AS weight"
         " FROM tf JOIN d USING (term) JOIN e USING (doc_id), s, a WHERE n >= 3)")
_BEST = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM w"


def _weights(spark, sf_dir, how, digits=6):
    docs = table(spark, sf_dir, "docs")
    return distinctive.weigh(distinctive.term_statistics(table(spark, sf_dir, "lexicon"), docs), docs, how, digits=digits)


@query("p7_found", f"WITH {_BM25} SELECT doc_id, term FROM ({_BEST}) WHERE rank <= 3")
def p7_found(spark, sf_dir):
    return distinctive.best_terms(_weights(spark, sf_dir, "bm25")).select("doc_id", "term")


@query("p7_weights", f"WITH {_BM25} SELECT * FROM w")
def p7_weights(spark, sf_dir):
    return _weights(spark, sf_dir, "bm25")


def _llr_cell(o: str, r: str, c: str) -> str:
    return f"CASE WHEN {o} > 0 THEN {o} * ln({o} * t / (({r}) * ({c}))) ELSE 0 END"


_LLR = (_TF + ", x AS (SELECT doc_id, term, tf::DOUBLE AS o, greatest(len, tf)::DOUBLE AS r, cf::DOUBLE AS c, greatest(total, greatest(len, tf) + cf - tf) AS t"
        " FROM tf JOIN d USING (term) JOIN e USING (doc_id), s WHERE n >= 3), w AS (SELECT doc_id, term, round(CASE WHEN o * t < r * c THEN -2 ELSE 2 END * ("
        + " + ".join([_llr_cell("o", "r", "c"), _llr_cell("(r - o)", "r", "t - c"), _llr_cell("(c - o)", "t - r", "c"), _llr_cell("(t - r - c + o)", "t - r", "t - c")])
        + "), 3) AS weight FROM x)")


@query("p7_llr", f"WITH {_LLR} SELECT * FROM w")
def p7_llr(spark, sf_dir):
    """Log-likelihood ratios of all terms; 3 decimals, as sums near 1e7 differ in their last digits between engines."""
    return _weights(spark, sf_dir, "llr", 3)


@query("p8_packed")
def p8_packed(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


@query("p8_fill")
def p8_fill(spark, sf_dir):
    return packing.fill_report(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


@query("p9_mixture")
def p9_mixture(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p9_shares")
def p9_shares(spark, sf_dir):
    return mixing.shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


#: Every run of 200 characters of every text, cut from overlapping pieces of 299, as its MD5.
_RUNS = ("WITH c AS (SELECT doc_id, text, unnest(range(1, length(text) - 198, 100)) AS a FROM documents WHERE length(text) >= 200),"
         " p AS (SELECT doc_id, substr(text, a, 299) AS piece FROM c),"
         " g AS (SELECT DISTINCT doc_id, md5(substr(piece, i, 200)) AS gram FROM (SELECT doc_id, piece, unnest(range(1, length(piece) - 198)) AS i FROM p)),"
         " s AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1), m AS (SELECT doc_id, gram FROM g SEMI JOIN s USING (gram))")


@query("p10_found", _RUNS + " SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b USING (gram) WHERE a.doc_id < b.doc_id")
def p10_found(spark, sf_dir):
    return shared_spans.document_pairs(*shared_spans.shared_runs(table(spark, sf_dir, "documents")))


#: The same with places, over one document of each class of equal texts.
_PLACED = ("WITH u AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) >= 200 GROUP BY text),"
           " c AS (SELECT doc_id, text, unnest(range(1, length(text) - 198, 100)) AS a FROM u),"
           " p AS (SELECT doc_id, a, substr(text, a, 299) AS piece FROM c),"
           " g AS (SELECT doc_id, a + i - 1 AS pos, md5(substr(piece, i, 200)) AS gram FROM (SELECT doc_id, a, piece, unnest(range(1, length(piece) - 198)) AS i FROM p)),"
           " s AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1), m AS (SELECT doc_id, pos, gram FROM g SEMI JOIN s USING (gram))")


@query("p10_runs", _PLACED + ", j AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, x.pos AS pa, y.pos AS pb FROM m x JOIN m y USING (gram) WHERE x.doc_id < y.doc_id),"
       " n AS (SELECT *, pa - row_number() OVER (PARTITION BY doc_a, doc_b, pa - pb ORDER BY pa) AS island FROM j)"
       " SELECT doc_a, doc_b, (min(pa) - 1)::INT AS start_a, (min(pb) - 1)::INT AS start_b, (count(*) + 199)::INT AS length FROM n GROUP BY doc_a, doc_b, pa - pb, island")
def p10_runs(spark, sf_dir):
    """Every maximal run between different texts, by the representatives of their classes."""
    return shared_spans.shared_runs(table(spark, sf_dir, "documents"))[0]


@query("p10_shared", _PLACED + ", v AS (SELECT doc_id, sum(least(200, nxt - pos)) AS n FROM (SELECT doc_id, pos, lead(pos, 1, pos + 200) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM m) GROUP BY doc_id),"
       " k AS (SELECT text FROM documents WHERE length(text) >= 200 GROUP BY text HAVING count(DISTINCT doc_id) > 1),"
       " z AS (SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, CASE WHEN k.text IS NOT NULL THEN length(d.text) ELSE coalesce(v.n, 0) END::BIGINT AS shared_chars"
       " FROM documents d LEFT JOIN k ON d.text = k.text LEFT JOIN v USING (doc_id))"
       " SELECT doc_id, n_chars, shared_chars, round(shared_chars / greatest(n_chars, 1), 6) AS share FROM z")
def p10_shared(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return shared_spans.shared_per_document(docs, *shared_spans.shared_runs(docs))


def _pages(spark, sf_dir):
    return pages.read_pages(table(spark, sf_dir, "wet_records"), table(spark, sf_dir, "lang_samples"))


@query("p4_found")
def p4_found(spark, sf_dir):
    return pages.spam_records(_pages(spark, sf_dir))


@query("p5_found")
def p5_found(spark, sf_dir):
    return pages.boilerplate(_pages(spark, sf_dir))


@query("p5_main_text")
def p5_main_text(spark, sf_dir):
    return pages.main_text(_pages(spark, sf_dir), table(spark, sf_dir, "wet_records"))


def _languages(spark, sf_dir):
    return page_languages.languages(table(spark, sf_dir, "wet_records"), table(spark, sf_dir, "lang_samples"))


@query("p6_found")
def p6_found(spark, sf_dir):
    return page_languages.wrong_or_mixed(_languages(spark, sf_dir))


@query("p6_languages")
def p6_languages(spark, sf_dir):
    """Every record's language with its confidence."""
    return _languages(spark, sf_dir).select("record_id", "label", "lang", "confidence").distinct()


@query("p6_passages")
def p6_passages(spark, sf_dir):
    """Every passage of one language, with its lines and confidence."""
    each = _languages(spark, sf_dir).select("record_id", F.explode("passages").alias("p")).distinct()
    return each.select("record_id", "p.*")
