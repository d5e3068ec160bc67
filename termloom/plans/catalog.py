"""Queries of the search engine's operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codecs, ids, ranking, text
from ..operators import gcs, heavy_keys, index, language, search
from ..runtime import table
from ..sources import lexicon_files, wet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_INDEXES: dict[tuple[str, str], index.Index] = {}
_BLOCKS: set[str] = set()

TERMS = ["the", "and"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def the_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of documents, written once per session and folder, as a search engine keeps one."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = index.Index.build(table(spark, sf_dir, "documents"))
    return _INDEXES[key]


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# --- SQL pieces ---
_SPLIT = r"regexp_split_to_array(text, '[^\p{L}\p{N}_]+')"
_HAN = (r"flatten(list_transform(regexp_extract_all(text, '\p{Han}+|(?:[\p{L}\p{N}_]--\p{Han})+'), lambda r: [r]))")
_TOKENS = """CASE WHEN regexp_matches(text, '\\p{Han}') THEN
 flatten(list_transform(regexp_extract_all(regexp_replace(text, '(\\p{Han}+)', ' \\1 ', 'g'), '[\\p{L}\\p{N}_]+'),
   lambda r: CASE WHEN regexp_matches(r, '^\\p{Han}{2,}') THEN list_transform(range(1, len(r)), lambda i: substr(r, i, 2)) ELSE [r] END))
 ELSE """ + _SPLIT + " END"
_TOK = f"tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)"
_POST = _TOK + ", post AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term <> '' GROUP BY ALL)"
_DOCS = f"d AS (SELECT doc_id, url, lang, len({_TOKENS}) AS len FROM documents WHERE text IS NOT NULL)"
_ALL = (f"WITH {_POST}, {_DOCS}, terms_ AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term),"
        " st AS (SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM post) AS n_postings),"
        " sc AS (SELECT term, doc_id, tf, df, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf,"
        "  1.2::DOUBLE * (1 - 0.75::DOUBLE) + len * (1.2::DOUBLE * 0.75::DOUBLE) / (n_postings / n_docs) AS k FROM post JOIN terms_ USING (term) JOIN d USING (doc_id), st),"
        " im AS (SELECT *, floor(tf / (tf + k) * 16384)::INT AS score, idf * 2.2::DOUBLE * tf / (k + tf) AS w FROM sc)")


def _ranked(terms: list[str], mode: str = "or", page: int = 0, need: int | None = None) -> str:
    lst = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    having = f" HAVING count(*) = {len(set(terms)) if need is None else need}" if mode == "and" else ""
    return (f"SELECT doc_id, round(sum(idf * score), 6) AS est, round(sum(w), 6) AS bm25, sum(tf)::BIGINT AS count FROM im WHERE term IN ({lst})"
            f" GROUP BY doc_id{having} ORDER BY est DESC, doc_id DESC LIMIT 10 OFFSET {page * 10}")


# --- problem 2: a few keys holding most rows ---
_TOTALS = "SELECT term, count(*) AS lines, count(DISTINCT doc_id) AS records, sum(freq)::BIGINT AS weight_sum FROM lexicon GROUP BY term"


@query("p2_found", f"SELECT term FROM ({_TOTALS}) WHERE term <> '' AND lines >= 0.01 * (SELECT count(*) FROM lexicon)")
def p2_found(spark, sf_dir):
    return heavy_keys.heavy_keys(table(spark, sf_dir, "lexicon")).select("term")


@query("p2_term_totals", _TOTALS)
def p2_term_totals(spark, sf_dir):
    return heavy_keys.per_key_totals(table(spark, sf_dir, "lexicon"))


# --- index construction ---
@query("tokenize_docs", f"WITH {_TOK} SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM tok GROUP BY doc_id")
def tokenize_docs(spark, sf_dir):
    t = index.tokenized(_documents(spark, sf_dir)).where("text IS NOT NULL")
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("terms")).where("tokens > 0")


@query("doc_table", f"WITH {_DOCS} SELECT * FROM d")
def doc_table(spark, sf_dir):
    return index.doc_table(_documents(spark, sf_dir))


@query("lexicon_tf", f"WITH {_POST} SELECT * FROM post")
def lexicon_tf(spark, sf_dir):
    return index.lexicon(_documents(spark, sf_dir))


@query("term_table", _ALL + " SELECT * FROM terms_")
def term_table(spark, sf_dir):
    return the_index(spark, sf_dir).terms


@query("corpus_stats", _ALL + " SELECT n_docs, n_postings, (SELECT count(*) FROM terms_) AS n_terms, (SELECT sum(len)::BIGINT FROM d) AS sum_len,"
       " n_postings / n_docs AS avgdl, (SELECT sum(len) FROM d) / n_docs AS avg_len FROM st")
def corpus_stats(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return index.corpus_stats(index.doc_table(docs), index.lexicon(docs))


@query("has_content_filter", "SELECT doc_id FROM documents WHERE length(text) > 0 AND url IS NOT NULL AND url <> ''")
def has_content_filter(spark, sf_dir):
    return index.with_url(index.with_content(_documents(spark, sf_dir))).select("doc_id")


@query("lang_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de', 'it', 'la', 'es', 'zh')")
def lang_filter(spark, sf_dir):
    return index.in_languages(_documents(spark, sf_dir)).select("doc_id", "lang")


@query("lang_filter_skip_chinese", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de', 'it', 'la', 'es')")
def lang_filter_skip_chinese(spark, sf_dir):
    return index.in_languages(_documents(spark, sf_dir), skip_chinese=True).select("doc_id", "lang")


@query("title_body", r"SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents")
def title_body(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.title(F.col("text")).alias("title"), text.body(F.col("text")).alias("body"))


@query("postings_impact", _ALL + " SELECT term, doc_id, tf, score FROM im")
def postings_impact(spark, sf_dir):
    return the_index(spark, sf_dir).postings.select("term", "doc_id", "tf", "score")


@query("idf_table", _ALL + " SELECT term, round(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM terms_, st")
def idf_table(spark, sf_dir):
    ix = the_index(spark, sf_dir)
    return ix.terms.select("term", F.round(ranking.idf(F.lit(float(ix.stats["n_docs"])), F.col("df")), 6).alias("idf"))


@query("expected_rows", "SELECT count(*) AS n FROM lexicon")
def expected_rows(spark, sf_dir):
    return table(spark, sf_dir, "lexicon").agg(F.count(F.lit(1)).alias("n"))


@query("lexicon_validate", "SELECT count(*) FILTER (WHERE term IS NULL) AS nulls, count(*) FILTER (WHERE term = '') AS empties, 0 AS invalid FROM lexicon")
def lexicon_validate(spark, sf_dir):
    return table(spark, sf_dir, "lexicon").agg(
        F.count_if(F.col("term").isNull()).alias("nulls"), F.count_if(F.col("term") == "").alias("empties"),
        F.count_if(~F.is_valid_utf8("term")).cast("int").alias("invalid"))


# --- posting blocks and codecs ---
_GAPS = "SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, block_no ORDER BY doc_id) AS delta FROM (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block_no FROM p)"
_P = "WITH p AS (SELECT term, doc_id, max(freq)::BIGINT AS tf, max(score) AS score FROM postings WHERE doc_id IS NOT NULL AND term IS NOT NULL AND score IS NOT NULL GROUP BY ALL)"


def _segment(spark, sf_dir, scored: bool = True):
    """The lists of all index segments as one index, each posting once; only those with a score, unless all are asked for."""
    p = table(spark, sf_dir, "postings").where("doc_id IS NOT NULL AND term IS NOT NULL")
    p = p.where("score IS NOT NULL") if scored else p
    return p.groupBy("term", "doc_id").agg(F.max("freq").cast("bigint").alias("tf"), F.max("score").alias("score"))


@query("posting_deltas", f"{_P} {_GAPS}")
def posting_deltas(spark, sf_dir):
    b = (index.number_in_lists(_segment(spark, sf_dir)).withColumn("block", F.floor((F.col("rn") - 1) / 128))
         .groupBy("term", "block").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")))
    return b.select("term", F.explode(F.arrays_zip("ids", codecs.deltas(F.col("ids")).alias("gaps"))).alias("z")).select(
        "term", F.col("z.ids").alias("doc_id"), F.col("z.gaps").alias("delta"))


@query("posting_undelta", f"{_P} SELECT term, doc_id FROM p")
def posting_undelta(spark, sf_dir):
    b = index.blocks(_segment(spark, sf_dir), 128)
    return b.select("term", F.explode(codecs.partial_sums(codecs.vbyte_decode(F.col("ids")))).alias("doc_id"))


@query("posting_blocks_meta", f"{_P} SELECT term, block_no, min(doc_id) AS begin_id, count(*)::INT AS n FROM (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 2048)::INT AS block_no FROM p) GROUP BY ALL")
def posting_blocks_meta(spark, sf_dir):
    return index.blocks(_segment(spark, sf_dir)).select("term", "block_no", "begin_id", "n")


@query("term_rows", f"{_P}, b AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 2048 AS block_no FROM p),"
       " z AS (SELECT *, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, block_no ORDER BY doc_id) AS gap FROM b)"
       " SELECT term, count(*) AS count, sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END)::BIGINT AS id_bytes FROM z GROUP BY term")
def term_rows(spark, sf_dir):
    t = index.term_rows(index.blocks(_segment(spark, sf_dir)))
    return t.select("term", F.col("count").cast("bigint").alias("count"),
                    F.aggregate("idOffs", F.lit(0).cast("bigint"), lambda a, x: a + x["len"]).alias("id_bytes"))


@query("vbyte_roundtrip", f"{_P} SELECT * FROM p")
def vbyte_roundtrip(spark, sf_dir):
    return index.decode_blocks(index.blocks(_segment(spark, sf_dir), 512))


@query("next_geq", f"{_P} SELECT term, min(doc_id) AS doc_id FROM p WHERE term = 'the' AND doc_id >= 100 GROUP BY term")
def next_geq(spark, sf_dir):
    return index.next_geq(_segment(spark, sf_dir), "the", 100)


@query("next_geq_many", f"{_P}, t AS (SELECT DISTINCT term, count AS target FROM terms WHERE term IS NOT NULL AND count IS NOT NULL)"
       " SELECT term, target, min(doc_id) AS doc_id FROM t JOIN p USING (term) WHERE doc_id >= target GROUP BY ALL")
def next_geq_many(spark, sf_dir):
    """The seek for every term at once, each from an id of its own."""
    asked = table(spark, sf_dir, "terms").where("term IS NOT NULL AND count IS NOT NULL").select("term", F.col("count").alias("target")).distinct()
    return index.next_geq_many(_segment(spark, sf_dir), asked)


def _lists(spark, sf_dir, size=index.BLOCK):
    """Each term's doc_ids in order, in blocks, so that no list is held whole."""
    b = index.blocks(_segment(spark, sf_dir), size)
    return b.select("term", "block_no", codecs.vbyte_decode(F.col("ids")).alias("gaps"))


def _sql_groups(bits: int) -> str:
    return " + ".join(["1"] + [f"(gap >= {1 << (bits * k)})::INT" for k in range(1, 32 // bits + 1)])


@query("codec_sizes", f"{_P}, b AS (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 2048)::INT AS block_no FROM p),"
       " z AS (SELECT *, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, block_no ORDER BY doc_id) AS gap FROM b)"
       f" SELECT term, block_no, sum({_sql_groups(7)})::BIGINT AS varint, ((sum({_sql_groups(3)}) + 1) // 2)::BIGINT AS varnibble,"
       " (1 + (count(*) * length(bin(max(gap))) + 7) // 8)::BIGINT AS minbits, (4 * count(*))::BIGINT AS dword,"
       f" least(sum({_sql_groups(7)}), (sum({_sql_groups(3)}) + 1) // 2)::BIGINT AS smaller FROM z GROUP BY term, block_no")
def codec_sizes(spark, sf_dir):
    g = F.col("gaps")
    return _lists(spark, sf_dir).select(
        "term", "block_no", codecs.varint_size(g).alias("varint"), codecs.varnibble_size(g).alias("varnibble"), codecs.minbits_size(g).alias("minbits"),
        codecs.dword_size(g).alias("dword"), codecs.smaller(codecs.varint_size(g), codecs.varnibble_size(g)).alias("smaller"))


_BLOCK_GAPS = (f"{_P}, b AS (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 2048)::INT AS block_no FROM p),"
               " z AS (SELECT term, block_no, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, block_no ORDER BY doc_id) AS gap FROM b)")


def _width_sql(b: int) -> str:
    return "sum(1" + "".join(f" + (gap >= {1 << (b * k)})::INT" for k in range(1, 62 // b + 1)) + f") * {b + 1} * 32 + {b}"


@query("codec_varbits", f"{_BLOCK_GAPS}, w AS (SELECT term, block_no, least({', '.join(_width_sql(b) for b in range(1, 17))}) AS best FROM z GROUP BY term, block_no)"
       " SELECT term, block_no, (1 + (best // 32 + best % 32 - 1) // 8)::BIGINT AS varbits FROM w")
def codec_varbits(spark, sf_dir):
    return _lists(spark, sf_dir).select("term", "block_no", codecs.varbits_size("gaps").alias("varbits"))


def _digits(x: str) -> str:
    return f"length(bin({x}))"


def _omega_sql(x: str, steps: int = 4) -> str:
    return f"CASE WHEN {x} > 1 THEN {_digits(x)} + {_omega_sql(f'({_digits(x)} - 1)', steps - 1)} ELSE 0 END" if steps else "0"


def _fibonacci(upto: int) -> list[int]:
    out = [1, 2]
    while out[-1] < upto:
        out.append(out[-1] + out[-2])
    return out


@query("codec_bit_codes", f"{_BLOCK_GAPS}, x AS (SELECT term, block_no, gap + 1 AS n FROM z) SELECT term, block_no, sum(2 * {_digits('n')} - 1)::BIGINT AS gamma,"
       f" sum(1 + {_omega_sql('n')})::BIGINT AS omega, sum(1 + {' + '.join(f'(n >= {f})::INT' for f in _fibonacci(1 << 40))})::BIGINT AS fibonacci FROM x GROUP BY term, block_no")
def codec_bit_codes(spark, sf_dir):
    one_up = F.transform("gaps", lambda g: g + 1)
    return _lists(spark, sf_dir).select("term", "block_no", *(codecs.code_sizes_udf(n)(one_up).alias(n) for n in ("gamma", "omega", "fibonacci")))


_VARINT_HEX = ("CASE WHEN gap < 128 THEN printf('%02X', gap) WHEN gap < 16384 THEN printf('%02X%02X', gap % 128 + 128, gap // 128)"
               " ELSE printf('%02X%02X%02X', gap % 128 + 128, gap // 128 % 128 + 128, gap // 16384) END")
_VBYTE_HEX = ("CASE WHEN gap < 128 THEN printf('%02X', gap + 128) WHEN gap < 16384 THEN printf('%02X%02X', gap // 128, gap % 128 + 128)"
              " ELSE printf('%02X%02X%02X', gap // 16384, gap // 128 % 128, gap % 128 + 128) END")


@query("codec_bytes", f"{_BLOCK_GAPS} SELECT term, block_no, string_agg({_VARINT_HEX}, '' ORDER BY doc_id) AS varint, string_agg({_VBYTE_HEX}, '' ORDER BY doc_id) AS vbyte FROM z GROUP BY term, block_no")
def codec_bytes(spark, sf_dir):
    """The bytes themselves, as hexadecimal digits."""
    return _lists(spark, sf_dir).select("term", "block_no", F.hex(codecs.varint_encode(F.col("gaps"))).alias("varint"), F.hex(codecs.vbyte_encode(F.col("gaps"))).alias("vbyte"))


@query("varint_roundtrip", f"{_P} SELECT term, doc_id FROM p")
def varint_roundtrip(spark, sf_dir):
    b = _lists(spark, sf_dir).select("term", codecs.varint_encode(F.col("gaps")).alias("data"))
    return b.select("term", F.explode(codecs.partial_sums(codecs.varint_decode("data"))).alias("doc_id"))


@query("integer_codes", "WITH n AS (SELECT DISTINCT doc_id + 1 AS n FROM docs), a AS (SELECT n, n AS x1, length(bin(n)) - 1 AS x2 FROM n), b AS (SELECT *, CASE WHEN x2 > 1 THEN length(bin(x2)) - 1 ELSE 1 END AS x3 FROM a),"
       " c AS (SELECT *, CASE WHEN x3 > 1 THEN length(bin(x3)) - 1 ELSE 1 END AS x4 FROM b)"
       " SELECT n, substr(bin(n), 2) AS headless, CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END::INT AS ceil_log2, repeat('0', length(bin(n)) - 1) || bin(n) AS gamma,"
       " CASE WHEN x4 > 1 THEN bin(x4) ELSE '' END || CASE WHEN x3 > 1 THEN bin(x3) ELSE '' END || CASE WHEN x2 > 1 THEN bin(x2) ELSE '' END || CASE WHEN x1 > 1 THEN bin(x1) ELSE '' END || '0' AS omega,"
       " array_to_string(list_transform(list_filter(range(30, -1, -1), lambda i: n >= (3 ** i)::BIGINT), lambda i: lpad(bin(n // (3 ** i)::BIGINT % 3), 2, '0')), '') || '11' AS thirds FROM c")
def integer_codes(spark, sf_dir):
    n = F.col("n")
    return table(spark, sf_dir, "docs").select((F.col("doc_id") + 1).alias("n")).distinct().select(
        "n", codecs.headless(n).alias("headless"), codecs.ceil_log2(n).cast("int").alias("ceil_log2"), codecs.gamma_code(n).alias("gamma"), codecs.omega_code(n).alias("omega"), codecs.digit_code(n, 2).alias("thirds"))


_RUN_SQL = "repeat('1', length(r) // 4) || '0' || lpad(bin(length(r) % 4), 2, '0')"


@query("golomb_run_lengths", f"WITH d AS (SELECT DISTINCT doc_id, bin(doc_id * 257) AS bits FROM docs) SELECT doc_id, array_to_string(list_transform(string_split(bits, '1'), lambda r: {_RUN_SQL}), '') AS code, bits AS back FROM d")
def golomb_run_lengths(spark, sf_dir):
    """Bit strings (of a multiple of each id) by their runs of zeroes, and back."""
    code = codecs.run_lengths_encode(F.bin(F.col("doc_id") * 257), 2)
    return table(spark, sf_dir, "docs").select("doc_id").distinct().select("doc_id", code.alias("code")).withColumn("back", codecs.run_lengths_decode(F.col("code"), 2))


@query("golomb_roundtrip", f"{_P} SELECT term, doc_id FROM p")
def golomb_roundtrip(spark, sf_dir):
    bits = F.greatest(F.lit(0), F.floor(F.log2(F.array_max("gaps") / F.size("gaps") + 1))).cast("int")
    b = _lists(spark, sf_dir).select("term", codecs.golomb_encode("gaps", bits).alias("data"), bits.alias("bits"), F.size("gaps").alias("n"))
    return b.select("term", F.explode(codecs.partial_sums(codecs.golomb_decode("data", "bits", "n"))).alias("doc_id"))


@query("bitmap_roundtrip", f"{_P} SELECT term, doc_id FROM p")
def bitmap_roundtrip(spark, sf_dir):
    return _lists(spark, sf_dir).select("term", F.explode(codecs.bitmap_round_trip(codecs.partial_sums(F.col("gaps")))).alias("doc_id"))


@query("gcs_membership", "WITH t AS (SELECT DISTINCT term FROM lexicon WHERE term <> '') SELECT term, term IN (SELECT term FROM terms WHERE term IS NOT NULL) AS contained FROM t"
       " UNION ALL SELECT term || '†' AS term, false AS contained FROM t")
def gcs_membership(spark, sf_dir):
    """Words of the lexicon and as many that nothing holds, asked of the set of the segments' terms; at 32 bits a wrong yes has odds of 1 in 4 billion."""
    held = table(spark, sf_dir, "terms").where("term IS NOT NULL").select("term").distinct()
    words = table(spark, sf_dir, "lexicon").where("term <> ''").select("term").distinct()
    asked = words.unionByName(words.select(F.concat("term", F.lit("†")).alias("term")))
    return gcs.contains(gcs.build(held, "term", 32), asked, "term", 32).select("term", "contained")


@query("spelling_check", f"WITH {_POST} SELECT DISTINCT term FROM post WHERE term NOT IN (SELECT term FROM terms WHERE term IS NOT NULL)")
def spelling_check(spark, sf_dir):
    """Words of the documents that the compact set of the segments' terms denies."""
    held = table(spark, sf_dir, "terms").where("term IS NOT NULL").select("term").distinct()
    words = index.lexicon(_documents(spark, sf_dir)).select("term").distinct()
    return gcs.contains(gcs.build(held, "term", 32), words, "term", 32).where("NOT contained").select("term")


# --- retrieval ---
@query("or_topk", _ALL + " " + _ranked(TERMS))
def or_topk(spark, sf_dir):
    return search.top_documents(the_index(spark, sf_dir), TERMS, "or")


@query("or_from_blocks", _ALL + " " + _ranked(TERMS))
def or_from_blocks(spark, sf_dir):
    """The same page from the coded blocks of the stored lists."""
    ix = the_index(spark, sf_dir)
    if ix.path not in _BLOCKS:
        ix.write_blocks()
        _BLOCKS.add(ix.path)
    return search.top_documents(ix.served_from_blocks(), TERMS, "or")


@query("or_page2", _ALL + " " + _ranked(["the", "der"], page=1))
def or_page2(spark, sf_dir):
    return search.top_documents(the_index(spark, sf_dir), ["the", "der"], "or", 1)


@query("explicit_or", _ALL + " " + _ranked(["der", "les"]))
def explicit_or(spark, sf_dir):
    mode, words = search.SearchEngine(the_index(spark, sf_dir)).plan("der | les")
    return search.top_documents(the_index(spark, sf_dir), words, mode)


@query("and_topk", _ALL + " " + _ranked(TERMS, "and"))
def and_topk(spark, sf_dir):
    return search.top_documents(the_index(spark, sf_dir), TERMS, "and")


@query("and_strict_unknown", _ALL + " " + _ranked(["the", "xyzzyplugh"], "and"))
def and_strict_unknown(spark, sf_dir):
    return search.top_documents(the_index(spark, sf_dir), ["the", "xyzzyplugh"], "and", strict=True)


@query("and_nonstrict_unknown", _ALL + " " + _ranked(["the", "xyzzyplugh"], "and", need=1))
def and_nonstrict_unknown(spark, sf_dir):
    return search.top_documents(the_index(spark, sf_dir), ["the", "xyzzyplugh"], "and")


def _single_sql(page: int) -> str:
    return (_ALL + " SELECT doc_id, score, tf AS count, round(w, 6) AS bm25 FROM im WHERE term = 'the' ORDER BY score DESC, tf DESC, doc_id DESC"
            f" LIMIT 10 OFFSET {page * 10}")


@query("single_topk", _single_sql(0))
def single_topk(spark, sf_dir):
    return search.single_term(the_index(spark, sf_dir), "the")


@query("single_page2", _single_sql(1))
def single_page2(spark, sf_dir):
    return search.single_term(the_index(spark, sf_dir), "the", 1)


_AUTO = "SELECT CASE WHEN sum(df) > 0.03 * max(n_docs) AND min(df) > 200 THEN 'and' ELSE 'or' END AS mode FROM terms_, st WHERE term IN ({})"


@query("auto_mode_decision", _ALL + " " + _AUTO.format("'the', 'and'"))
def auto_mode_decision(spark, sf_dir):
    return spark.createDataFrame([(search.auto_mode(the_index(spark, sf_dir), TERMS),)], "mode string")


@query("auto_query", _ALL + ", md AS (" + _AUTO.format("'the', 'der'") + ") SELECT doc_id, round(sum(idf * score), 6) AS est, round(sum(w), 6) AS bm25,"
       " sum(tf)::BIGINT AS count FROM im, md WHERE term IN ('the', 'der') GROUP BY doc_id, mode HAVING mode = 'or' OR count(*) = 2 ORDER BY est DESC, doc_id DESC LIMIT 10")
def auto_query(spark, sf_dir):
    ix = the_index(spark, sf_dir)
    return search.top_documents(ix, ["the", "der"], search.auto_mode(ix, ["the", "der"]))


@query("hit_counts", _ALL + ", h AS (SELECT doc_id, count(*) AS k FROM im WHERE term IN ('the', 'and') GROUP BY doc_id)"
       " SELECT count(*) AS or_hits, count(*) FILTER (WHERE k = 2) AS and_hits, ceil(count(*) / 10)::BIGINT AS or_pages FROM h")
def hit_counts(spark, sf_dir):
    m = search.matches(the_index(spark, sf_dir), TERMS, "or")
    return m.agg(F.count(F.lit(1)).alias("or_hits"), F.count_if(F.col("k") == 2).alias("and_hits"), F.ceil(F.count(F.lit(1)) / 10).alias("or_pages"))


@query("df_sum_min", _ALL + " SELECT sum(df)::BIGINT AS s, min(df) AS m FROM terms_ WHERE term IN ('the', 'and')")
def df_sum_min(spark, sf_dir):
    return search.known_terms(the_index(spark, sf_dir), TERMS).agg(F.sum("df").alias("s"), F.min("df").alias("m"))


@query("two_phase_rank", _ALL + ", pg AS (" + _ranked(["und", "les"], page=0) + ") SELECT doc_id, est, bm25, row_number() OVER (ORDER BY est DESC, doc_id DESC) AS rank FROM pg")
def two_phase_rank(spark, sf_dir):
    from pyspark.sql import Window

    top = search.top_documents(the_index(spark, sf_dir), ["und", "les"], "or")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("est"), F.desc("doc_id")))).select("doc_id", "est", "bm25", "rank")


@query("postings_union", _ALL + " SELECT DISTINCT doc_id FROM im WHERE term IN ('the', 'and')")
def postings_union(spark, sf_dir):
    return search.union_of(the_index(spark, sf_dir).postings, TERMS)


@query("postings_intersect", _ALL + " SELECT doc_id FROM im WHERE term = 'the' INTERSECT SELECT doc_id FROM im WHERE term = 'and'")
def postings_intersect(spark, sf_dir):
    return search.intersection_of(the_index(spark, sf_dir).postings, TERMS)


@query("boolean_nested", _ALL + " (SELECT doc_id FROM im WHERE term IN ('the', 'der')) EXCEPT (SELECT doc_id FROM im WHERE term = 'and')")
def boolean_nested(spark, sf_dir):
    return search.boolean(the_index(spark, sf_dir), ("not", ("or", "the", "der"), "and"))


@query("search_results", _ALL + ", pg AS (" + _ranked(TERMS) + ") SELECT doc_id, url, lang, split_part(text, chr(10), 1) AS title, bm25, count FROM pg JOIN documents USING (doc_id)")
def search_results(spark, sf_dir):
    ix = the_index(spark, sf_dir)
    return search.present(ix, search.top_documents(ix, TERMS, "or"), TERMS).select("doc_id", "url", "lang", "title", "bm25", "count")


#: Lines of each body as lists of words and separators (Chinese: characters), cut into pieces for two budgets: the usual one, and one thrice as large for a single piece.
_SNIPPETS = (r", b AS (SELECT doc_id, coalesce(lang, 'en') AS lang, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM pg JOIN documents USING (doc_id)),"
             r" l AS (SELECT doc_id, lang, CASE WHEN lang = 'zh' THEN 30 ELSE 20 END AS budget, unnest(string_split(body, chr(10))) AS line, len(string_split(body, chr(10))) AS n_lines FROM b WHERE length(body) > 1),"
             r" w AS (SELECT *, regexp_split_to_array(line, '[^\p{L}\p{N}_]+') AS ws, regexp_extract_all(line, '[^\p{L}\p{N}_]+') AS ss FROM l),"
             " r AS (SELECT doc_id, n_lines, k, budget * k AS budget, CASE WHEN lang = 'zh' THEN (CASE WHEN line = '' THEN [] ELSE string_split(line, '') END)"
             "  ELSE list_transform(range(0, 2 * len(ws) - 1), lambda i: CASE WHEN i % 2 = 0 THEN ws[i // 2 + 1] ELSE ss[i // 2 + 1] END) END AS x FROM w, (SELECT unnest([1, 3]) AS k)),"
             " h AS (SELECT doc_id, n_lines, k, x, budget, budget // 2 AS half, unnest(CASE WHEN len(x) <= budget THEN [0] ELSE range(0, (len(x) - 1) // (budget // 2)) END) AS i FROM r),"
             " p AS (SELECT doc_id, n_lines, k, CASE WHEN len(x) <= budget THEN [x] ELSE [list_slice(x, i * half + 1, i * half + half), list_slice(x, i * half + half + 1, i * half + 2 * half)] END AS parts FROM h),"
             " c AS (SELECT DISTINCT doc_id, n_lines, k, list_sum(list_transform(parts, lambda q: len(list_distinct(list_filter(q, lambda v: v IN ('the', 'and')))))) AS score, flatten(parts) AS t FROM p),"
             " o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY score DESC, t DESC) AS rank FROM c),"
             " m AS (SELECT doc_id, CASE WHEN max(n_lines) < 3 OR count(*) FILTER (WHERE k = 1) < 3 OR max(score) FILTER (WHERE k = 1 AND rank = 2) < 2 THEN 3 ELSE 1 END AS k FROM o GROUP BY doc_id),"
             " f AS (SELECT doc_id, list(array_to_string(t, '') ORDER BY rank) AS snippets FROM o JOIN m USING (doc_id, k) WHERE rank <= CASE WHEN k = 3 THEN 1 ELSE 3 END GROUP BY doc_id)"
             " SELECT doc_id, coalesce(snippets, []) AS snippets FROM pg LEFT JOIN f USING (doc_id)")


@query("snippets", _ALL + ", pg AS (" + _ranked(TERMS) + ")" + _SNIPPETS)
def snippets(spark, sf_dir):
    ix = the_index(spark, sf_dir)
    return search.present(ix, search.top_documents(ix, TERMS, "or"), TERMS).select("doc_id", "snippets")


# --- documents, ids, files ---
@query("doc_range_lookup", "SELECT doc_id, file FROM docs JOIN doc_ranges ON doc_id > start_id AND doc_id <= end_id")
def doc_range_lookup(spark, sf_dir):
    return index.locate(table(spark, sf_dir, "docs"), table(spark, sf_dir, "doc_ranges")).select("doc_id", "file")


@query("doc_range_names", r"SELECT regexp_replace(file, '\.gz$', '') AS file, regexp_replace(regexp_extract(file, '[^/]*$'), '\.warc\.wet\.gz$', '') AS base, (SELECT (max(end_id) - min(start_id)) / count(*) FROM doc_ranges) AS mean_ids FROM doc_ranges")
def doc_range_names(spark, sf_dir):
    r = table(spark, sf_dir, "doc_ranges")
    mean = r.agg(((F.max("end_id") - F.min("start_id")) / F.count(F.lit(1))).alias("m")).scalar()
    return r.select(text.strip_gz(F.col("file")).alias("file"), text.base_name(F.col("file")).alias("base"), mean.alias("mean_ids"))


@query("file_ranges", "SELECT source AS file, min(doc_id) - 1 AS start_id, max(doc_id) AS end_id FROM documents GROUP BY source")
def file_ranges(spark, sf_dir):
    return index.file_ranges(_documents(spark, sf_dir))


@query("docid_skip_numbering", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), x AS (SELECT doc_id, n, n % 253 AS a, n // 253 % 253 AS b, n // 64009 AS c FROM r)"
       " SELECT doc_id, n, a + CASE WHEN a < 9 THEN 0 WHEN a < 30 THEN 2 ELSE 3 END + 256 * (b + CASE WHEN b < 9 THEN 0 WHEN b < 30 THEN 2 ELSE 3 END)"
       " + 65536 * (c + CASE WHEN c < 9 THEN 0 WHEN c < 30 THEN 2 ELSE 3 END) AS new_id FROM x")
def docid_skip_numbering(spark, sf_dir):
    n = ids.number_rows(_documents(spark, sf_dir).select("doc_id"), ["doc_id"])
    return n.select("doc_id", "n", ids.skip_byte_id(F.col("n")).alias("new_id"))


@query("id_bytes_roundtrip", "SELECT doc_id, printf('%08X', doc_id) AS bytes, doc_id AS back FROM docs")
def id_bytes_roundtrip(spark, sf_dir):
    b = ids.id_bytes(F.col("doc_id"))
    return table(spark, sf_dir, "docs").select("doc_id", F.hex(b).alias("bytes"), ids.id_from_bytes(b).alias("back"))


@query("record_slugs", "SELECT record_id, record_id AS back, substr(translate(to_base64(unhex(replace(record_id, '-', ''))), '+/', '-_'), 1, 22) AS slug FROM wet_records")
def record_slugs(spark, sf_dir):
    s = ids.slug(F.col("record_id"))
    return table(spark, sf_dir, "wet_records").select("record_id", ids.uuid_from_slug(s).alias("back"), s.alias("slug"))


@query("doc_point_read", "SELECT DISTINCT doc_id, url, lang, len, off FROM docs WHERE doc_id = 100")
def doc_point_read(spark, sf_dir):
    return table(spark, sf_dir, "docs").where("doc_id = 100").distinct()


@query("random_access", "SELECT record_id, octet_length(content) AS bytes FROM wet_records WHERE source_file = (SELECT min(source_file) FROM wet_records) AND off = 0 AND url IS NOT NULL")
def random_access(spark, sf_dir):
    w = table(spark, sf_dir, "wet_records")
    first = w.agg(F.min("source_file").alias("f")).scalar()
    return w.where((F.col("source_file") == first) & (F.col("off") == 0) & F.col("url").isNotNull()).select("record_id", F.octet_length("content").cast("bigint").alias("bytes"))


# --- text functions ---
@query("keyword_line_coverage", rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, max(len(list_intersect(list_distinct(regexp_split_to_array(line, '[^\p{{L}}\p{{N}}_]+')), ['the', 'and', 'of'])))::INT AS best FROM l GROUP BY doc_id")
def keyword_line_coverage(spark, sf_dir):
    keywords = F.array(F.lit("the"), F.lit("and"), F.lit("of"))
    best = F.array_max(F.transform(text.lines(F.col("text")), lambda x: text.keyword_coverage(x, keywords)))
    return _documents(spark, sf_dir).select("doc_id", best.alias("best"))


@query("sliding_window_tokens", f"WITH t AS (SELECT doc_id, {_SPLIT} AS x FROM documents), w AS (SELECT doc_id, x, unnest(range(1, len(x) + 1, 10)) AS i FROM t)"
       " SELECT doc_id, ((i - 1) // 10)::INT AS n, array_to_string(list_concat(list_slice(x, i, i + 9), list_resize([]::VARCHAR[], greatest(0, i + 9 - len(x))::INT, '')), ' ') AS chunk FROM w")
def sliding_window_tokens(spark, sf_dir):
    w = text.sliding(text.words(F.col("text")), 10, 10)
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(w).alias("n", "c")).select("doc_id", "n", F.array_join("c", " ").alias("chunk"))


@query("words_and_separators", r"SELECT doc_id, md5(text) AS joined, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INT AS words, len(regexp_extract_all(text, '[^\p{L}\p{N}_]+'))::INT AS separators FROM documents")
def words_and_separators(spark, sf_dir):
    """Whole texts as words and what stands between them, which join back to the text."""
    parts = text.let(text.words_and_separators(F.col("text")), lambda p: F.struct(
        F.md5(F.array_join(p, "").cast("binary")).alias("joined"), F.size(F.filter(p, lambda x: x.rlike(r"^[\p{L}\p{N}_]"))).alias("words"),
        F.size(F.filter(p, lambda x: x.rlike(r"^[^\p{L}\p{N}_]"))).alias("separators")))
    return _documents(spark, sf_dir).select("doc_id", parts.alias("p")).select("doc_id", "p.*")


@query("highlighted", r"SELECT doc_id, md5(regexp_replace(text, '\b(and|the)\b', '<mark>\1</mark>', 'gi')) AS marked FROM documents")
def highlighted(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.highlight(F.col("text"), TERMS).cast("binary")).alias("marked"))


@query("readable_urls", "SELECT doc_id, url, url_decode(url) AS shown, format('{:,}', n_chars) AS chars FROM documents")
def readable_urls(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "url", text.readable_url(F.col("url")).alias("shown"), text.thousands(F.col("n_chars")).alias("chars"))


_PADDED = r"' ' || regexp_replace(lower(trim(text)), '\s+', ' ', 'g') || ' '"
_KNOWN = ", ".join(f"'{x}'" for x in language.LANGUAGES)
_MODEL = (f"WITH s AS (SELECT lang, {_PADDED} AS t FROM lang_samples WHERE lang IN ({_KNOWN}) AND text IS NOT NULL),"
          " g AS (SELECT lang, substr(t, i, 3) AS gram FROM (SELECT lang, t, unnest(range(1, length(t) - 1)) AS i FROM s)),"
          f" c AS (SELECT gram, lang, count(*) AS c FROM g GROUP BY ALL), k AS (SELECT unnest([{_KNOWN}]) AS lang),"
          " t AS (SELECT k.lang, count(g.gram) AS total FROM k LEFT JOIN g USING (lang) GROUP BY ALL), v AS (SELECT count(DISTINCT gram) AS v FROM g),"
          " m AS (SELECT a.gram, t.lang, ln((coalesce(c.c, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * v)) AS logp FROM (SELECT DISTINCT gram FROM g) a CROSS JOIN t CROSS JOIN v"
          " LEFT JOIN c ON c.gram = a.gram AND c.lang = t.lang)")


def _detected(languages) -> str:
    return (_MODEL + f", d AS (SELECT doc_id, {_PADDED} AS t FROM documents WHERE text IS NOT NULL),"
            " p AS (SELECT doc_id, substr(t, a, 302) AS piece FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1, 300)) AS a FROM d)),"
            " x AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, substr(piece, i, 3) AS gram FROM (SELECT doc_id, piece, unnest(range(1, length(piece) - 1)) AS i FROM p)) GROUP BY ALL),"
            f" z AS (SELECT doc_id, lang, sum(n * logp) AS score FROM x JOIN m USING (gram) WHERE lang IN ({', '.join(repr(x) for x in languages)}) GROUP BY ALL)"
            " SELECT doc_id, lang AS detected FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) = 1")


@query("detect_language", _detected(language.LANGUAGES))
def detect_language(spark, sf_dir):
    model = language.train(table(spark, sf_dir, "lang_samples"))
    return language.detect(_documents(spark, sf_dir), model, "doc_id")


@query("detect_language_restricted", _detected(index.INDEX_LANGUAGES))
def detect_language_restricted(spark, sf_dir):
    model = language.train(table(spark, sf_dir, "lang_samples"))
    return language.detect(_documents(spark, sf_dir), model, "doc_id", languages=list(index.INDEX_LANGUAGES))


# --- further forms ---
@query("average_list_length", _ALL + " SELECT sum(df) / count(*) AS mean FROM terms_")
def average_list_length(spark, sf_dir):
    return the_index(spark, sf_dir).terms.agg((F.sum("df") / F.count(F.lit(1))).alias("mean"))


@query("sorted_lexicon", f"WITH {_POST} SELECT term, doc_id, tf, row_number() OVER (ORDER BY term, doc_id) AS n FROM post")
def sorted_lexicon(spark, sf_dir):
    """The merged, globally sorted stream with the place of each line, sorted by range partitions."""
    return ids.number_rows(index.lexicon(_documents(spark, sf_dir)), ["term", "doc_id"])


@query("run_merge", "SELECT term, doc_id, freq FROM lexicon WHERE chunk_no % 2 = 0 UNION ALL SELECT term, doc_id, freq FROM lexicon WHERE chunk_no % 2 <> 0 OR chunk_no IS NULL")
def run_merge(spark, sf_dir):
    """Two sorted runs as one sorted stream; together they are the whole table."""
    lex = table(spark, sf_dir, "lexicon").select("term", "doc_id", "freq", "chunk_no")
    even = F.coalesce(F.col("chunk_no") % 2 == 0, F.lit(False))
    runs = [lex.where(c).drop("chunk_no").sortWithinPartitions("term", "doc_id") for c in (even, ~even)]
    return runs[0].unionByName(runs[1]).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


@query("unscored_postings", "WITH p AS (SELECT term, doc_id, max(freq)::BIGINT AS tf FROM postings WHERE doc_id IS NOT NULL AND term IS NOT NULL GROUP BY ALL),"
       " b AS (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 2048)::INT AS block_no FROM p) SELECT term, block_no, doc_id, tf FROM b")
def unscored_postings(spark, sf_dir):
    """Blocks without the score stream, as written before scores are known: all postings, read back from their bytes."""
    b = index.blocks(_segment(spark, sf_dir, scored=False).withColumn("score", F.lit(0)))
    gaps = b.select("term", "block_no", codecs.partial_sums(codecs.vbyte_decode(F.col("ids"))).alias("ids"), codecs.vbyte_decode(F.col("tfs")).alias("tfs"))
    return gaps.select("term", "block_no", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("term", "block_no", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"))


@query("unknown_terms", "SELECT DISTINCT term FROM lexicon WHERE term <> '' AND term NOT IN (SELECT term FROM terms WHERE term IS NOT NULL)")
def unknown_terms(spark, sf_dir):
    """Words of the lexicon that no index segment holds, as a spelling check finds them."""
    words = table(spark, sf_dir, "lexicon").where("term <> ''").select("term").distinct()
    return words.join(table(spark, sf_dir, "terms").where("term IS NOT NULL").select("term"), "term", "left_anti")


@query("joined_lengths", "SELECT l.term, l.doc_id, sum(l.freq)::BIGINT AS tf, max(d.len) AS len FROM lexicon l JOIN (SELECT DISTINCT doc_id, len FROM docs WHERE len IS NOT NULL) d USING (doc_id) WHERE l.term <> '' GROUP BY ALL")
def joined_lengths(spark, sf_dir):
    """Posting with its document's length; the lexicon is aggregated before the join."""
    tf = table(spark, sf_dir, "lexicon").where("term <> ''").groupBy("term", "doc_id").agg(F.sum("freq").cast("bigint").alias("tf"))
    lengths = table(spark, sf_dir, "docs").where("len IS NOT NULL").select("doc_id", "len").distinct()
    return tf.join(lengths, "doc_id").groupBy("term", "doc_id", "tf").agg(F.max("len").alias("len"))


@query("codec_diff_sizes", f"{_P}, b AS (SELECT *, ((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 2048)::INT AS block_no FROM p)"
       f" SELECT term, block_no, sum({_sql_groups(7).replace('gap', 'doc_id')})::BIGINT AS plain FROM b GROUP BY term, block_no")
def codec_diff_sizes(spark, sf_dir):
    """Bytes of each block without gaps, to set against ``codec_sizes``."""
    return _lists(spark, sf_dir).select("term", "block_no", codecs.varint_size(codecs.partial_sums(F.col("gaps"))).alias("plain"))


@query("bitmap_greedy", f"{_P} SELECT term, doc_id FROM p")
def bitmap_greedy(spark, sf_dir):
    """Bitmaps of the densest runs first, and back."""
    return _lists(spark, sf_dir).select("term", F.explode(codecs.bitmap_round_trip(codecs.partial_sums(F.col("gaps")), greedy=True)).alias("doc_id"))


@query("pair_roundtrip", f"{_P} SELECT term, doc_id FROM p")
def pair_roundtrip(spark, sf_dir):
    """Gaps through a pair grammar and back, in blocks of 256: the codec is quadratic in a block."""
    b = _lists(spark, sf_dir, 256)
    return b.select("term", F.explode(codecs.partial_sums(codecs.pair_round_trip("gaps"))).alias("doc_id"))


@query("base_62_ids", "SELECT DISTINCT doc_id, CASE WHEN doc_id < 62 THEN [doc_id] WHEN doc_id < 3844 THEN [doc_id // 62, doc_id % 62] WHEN doc_id < 238328 THEN [doc_id // 3844, doc_id // 62 % 62, doc_id % 62]"
       " ELSE [doc_id // 238328, doc_id // 3844 % 62, doc_id // 62 % 62, doc_id % 62] END AS digits FROM docs")
def base_62_ids(spark, sf_dir):
    return table(spark, sf_dir, "docs").select("doc_id").distinct().select("doc_id", codecs.base_digits(F.col("doc_id"), 62).alias("digits"))


@query("adjacent_chunks", f"WITH t AS (SELECT doc_id, {_SPLIT} AS x FROM documents), w AS (SELECT doc_id, x, unnest(range(1, len(x) + 1, 10)) AS i FROM t),"
       " c AS (SELECT doc_id, (i - 1) // 10 AS n, len(list_filter(list_slice(x, i, i + 9), lambda v: v = 'the')) AS hits FROM w)"
       " SELECT doc_id, max(pair)::INT AS best FROM (SELECT doc_id, hits + lead(hits, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS pair FROM c) GROUP BY doc_id")
def adjacent_chunks(spark, sf_dir):
    """The most occurrences of a keyword in two neighbouring chunks of ten words."""
    counts = F.transform(text.sliding(text.words(F.col("text")), 10, 10), lambda c: F.size(F.filter(c, lambda v: v == "the")))
    best = text.let(counts, lambda c: F.array_max(F.zip_with(c, F.concat(F.slice(c, 2, F.size(c)), F.array(F.lit(0))), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))))
    return _documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", best.alias("best"))


@query("batch_search", _ALL + ", qs AS (SELECT * FROM (VALUES (1, 'the'), (1, 'and'), (2, 'der'), (2, 'und'), (3, 'les')) AS v(query_id, term)),"
       " s AS (SELECT query_id, doc_id, round(sum(idf * score), 6) AS est FROM qs JOIN im USING (term) GROUP BY ALL)"
       " SELECT query_id, doc_id, est, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY est DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 10")
def batch_search(spark, sf_dir):
    """Many queries at once, each with its ten best documents."""
    queries = spark.createDataFrame([(1, "the"), (1, "and"), (2, "der"), (2, "und"), (3, "les")], "query_id int, term string")
    return search.batch(the_index(spark, sf_dir), queries)


def _engine(spark, sf_dir):
    return search.SearchEngine(the_index(spark, sf_dir))


_HITS = ", n AS (SELECT count(DISTINCT doc_id) AS results FROM im WHERE term IN ({}))"


@query("engine_search", _ALL + ", pg AS (" + _ranked(["der", "les"]) + ")" + _HITS.format("'der', 'les'")
       + " SELECT doc_id, url, lang, split_part(text, chr(10), 1) AS title, bm25, count, results, ceil(results / 10)::BIGINT AS pages, row_number() OVER (ORDER BY est DESC, doc_id DESC)::BIGINT AS place"
       " FROM pg JOIN documents USING (doc_id), n")
def engine_search(spark, sf_dir):
    """A whole search from its text: page, total and order of the results."""
    got = _engine(spark, sf_dir).search("der | les")
    rows = [(r["doc_id"], r["url"], r["lang"], r["title"], r["bm25"], r["count"], got["meta"]["results"], got["meta"]["pages"], i) for i, r in enumerate(got["results"], 1)]
    return spark.createDataFrame(rows, "doc_id bigint, url string, lang string, title string, bm25 double, count bigint, results bigint, pages bigint, place bigint")


@query("engine_auto", _ALL + ", md AS (" + _AUTO.format("'the', 'and'") + "), h AS (SELECT doc_id, round(sum(idf * score), 6) AS est, round(sum(w), 6) AS bm25, sum(tf)::BIGINT AS count"
       " FROM im, md WHERE term IN ('the', 'and') GROUP BY doc_id, mode HAVING mode = 'or' OR count(*) = 2)"
       " SELECT doc_id, bm25, count, (SELECT count(*) FROM h) AS results FROM h ORDER BY est DESC, doc_id DESC LIMIT 10")
def engine_auto(spark, sf_dir):
    """Two words without a sign: the engine takes AND where both are frequent, else OR."""
    got = _engine(spark, sf_dir).search("and the")
    return spark.createDataFrame([(r["doc_id"], r["bm25"], r["count"], got["meta"]["results"]) for r in got["results"]], "doc_id bigint, bm25 double, count bigint, results bigint")


@query("engine_single", "WITH x AS (" + _single_sql(0) + ") SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id DESC)::BIGINT AS place FROM x")
def engine_single(spark, sf_dir):
    """One word: the page is chosen by impact and then sorted by its exact weights."""
    got = _engine(spark, sf_dir).search("the")
    return spark.createDataFrame([(r["doc_id"], r["bm25"], i) for i, r in enumerate(got["results"], 1)], "doc_id bigint, bm25 double, place bigint")


@query("engine_chinese", _ALL + " SELECT DISTINCT doc_id FROM im WHERE term = '我们'")
def engine_chinese(spark, sf_dir):
    """Chinese is found by its characters in every document that holds them, whatever the label; with and without a sign the words are the same."""
    e = _engine(spark, sf_dir)
    _, words = e.plan("我们 | zzz")
    assert e.plan("我们")[1] == ["我们"] and words == ["zzz", "我们"]
    return search.matches(e.index, words, "or").select("doc_id")


@query("engine_commands", "SELECT * FROM (VALUES (':cache', 'cached', '1'), (':cache', 'hits', '1'), (':cache', 'misses', '1'), (':cache', 'size', '512'), (':cache-clear', 'cached', '0'), (':nonsense', 'error', 'unknown command :nonsense'), ('', 'results', '0'), ('|', 'results', '0')) AS v(command, key, value)")
def engine_commands(spark, sf_dir):
    """The commands of the prompt, after one search asked twice, and empty queries."""
    e = _engine(spark, sf_dir)
    e.search("les")
    e.search("les")
    rows = [(c, k, str(v)) for c in (":cache", ":cache-clear", ":nonsense") for k, v in e.command(c).items()]
    rows += [(q, "results", str(e.search(q)["meta"]["results"])) for q in ("", "|")]
    return spark.createDataFrame(rows, "command string, key string, value string")


@query("query_words", "WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents), x AS (SELECT doc_id, unnest(" + _TOKENS + ") AS w FROM t)"
       " SELECT doc_id, list_sort(list(DISTINCT w)) AS words FROM x WHERE w <> '' GROUP BY doc_id")
def query_words(spark, sf_dir):
    """All titles as queries: their words, each once and sorted."""
    words = text.query_words(text.title(F.col("text")))
    return _documents(spark, sf_dir).select("doc_id", words.alias("words")).where(F.size("words") > 0)


def _folder(spark, name: str) -> str:
    from ..runtime import new_scratch

    return new_scratch(spark, name)


_WET = "FROM wet_records WHERE source_file IS NOT NULL"


@query("wet_scan", f"SELECT record_id, url, coalesce(octet_length(content), 0)::BIGINT AS bytes, md5(coalesce(content, ''::BLOB)) AS digest {_WET}")
def wet_scan(spark, sf_dir):
    """The page records as compressed WET files and read again from all of them."""
    path = _folder(spark, "wet")
    wet.write_wet(table(spark, sf_dir, "wet_records"), path)
    return wet.read_wet(spark, path).select("record_id", "url", F.octet_length("content").cast("bigint").alias("bytes"), F.md5("content").alias("digest"))


@query("wet_projection", f"SELECT record_id, url {_WET}")
def wet_projection(spark, sf_dir):
    """Records without their bodies, which the readers skip."""
    path = _folder(spark, "wet")
    wet.write_wet(table(spark, sf_dir, "wet_records"), path)
    return wet.read_wet(spark, path, content=False).select("record_id", "url")


@query("wet_seek", f"SELECT record_id, md5(coalesce(content, ''::BLOB)) AS digest {_WET} AND url IS NOT NULL")
def wet_seek(spark, sf_dir):
    """Every record with a url fetched alone by its file and offset, its url checked there."""
    path = _folder(spark, "wet")
    wet.write_wet(table(spark, sf_dir, "wet_records"), path, compress=False)
    places = wet.read_wet(spark, path, content=False).where("url IS NOT NULL").select("record_id", "url", "source_file", "off")
    return wet.fetch(places).select("record_id", F.md5("content").alias("digest"))


@query("lexicon_text", "SELECT term, doc_id, sum(freq)::INT AS tf FROM lexicon WHERE term <> '' AND doc_id IS NOT NULL AND freq IS NOT NULL GROUP BY ALL")
def lexicon_text(spark, sf_dir):
    """The lexicon as sorted text lines and read again."""
    lex = table(spark, sf_dir, "lexicon").where("term <> '' AND doc_id IS NOT NULL AND freq IS NOT NULL").groupBy("term", "doc_id").agg(F.sum("freq").alias("tf"))
    path = _folder(spark, "lexicon-text")
    lexicon_files.write_lexicon(lex, path)
    return lexicon_files.read_lexicon(spark, path)


@query("range_text", r"SELECT start_id, end_id, regexp_replace(file, '\.gz$', '') AS file FROM doc_ranges")
def range_text(spark, sf_dir):
    path = _folder(spark, "ranges-text")
    lexicon_files.write_ranges(table(spark, sf_dir, "doc_ranges"), path)
    return lexicon_files.read_ranges(spark, path)


@query("url_text", "SELECT DISTINCT doc_id, url FROM docs WHERE url <> ''")
def url_text(spark, sf_dir):
    path = _folder(spark, "urls-text")
    lexicon_files.write_url_table(table(spark, sf_dir, "docs").where("url <> ''").select("doc_id", "url").distinct(), path)
    return spark.read.schema("doc_id bigint, url string").option("sep", "\t").csv(path)


@query("scan_probe", "SELECT count(*) AS n, count(url) AS urls, sum(octet_length(content))::BIGINT AS bytes FROM wet_records")
def scan_probe(spark, sf_dir):
    return table(spark, sf_dir, "wet_records").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("urls"), F.sum(F.octet_length("content")).alias("bytes"))


@query("index_languages", _detected(index.INDEX_LANGUAGES).replace("SELECT doc_id, lang AS detected FROM z", "SELECT doc_id, lang FROM z"))
def index_languages(spark, sf_dir):
    """An index built with a language model: what it detects replaces missing and wrong labels. Texts without a letter keep theirs and are left out here."""
    docs = _documents(spark, sf_dir)
    ix = index.Index.build(docs, model=language.train(table(spark, sf_dir, "lang_samples")))
    some = docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id")
    return ix.docs.join(some, "doc_id", "left_semi").select("doc_id", "lang")
