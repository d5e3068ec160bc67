"""Keyword search over a written index: single-term, AND, OR and automatic queries, ranked in two phases."""

from __future__ import annotations

import math
import re
import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions import ranking
from .index import Index
from .snippet import snippets_udf

PAGE = 10
#: The automatic mode takes AND where the terms' postings exceed this share of all documents and the rarest has more than MIN_DF.
AUTO_SHARE = 0.03
MIN_DF = 200


def known_terms(index: Index, terms: list[str]) -> DataFrame:
    """``(term, df, idf)`` of the query's terms that the index holds; one row per query term at most."""
    n = F.lit(float(index.stats["n_docs"]))
    return index.terms.where(F.col("term").isin(terms)).select("term", "df", ranking.idf(n, F.col("df")).alias("idf"))


def idf_of(index: Index, known: dict[str, int]) -> Column:
    """The weight of a posting's term, from the query's few document counts."""
    n, out = index.stats["n_docs"], F.lit(None).cast("double")
    for w, df in known.items():
        out = F.when(F.col("term") == w, F.lit(math.log((n - df + 0.5) / (df + 0.5)))).otherwise(out)
    return out


def matches(index: Index, terms: list[str], mode: str = "or", strict: bool = False) -> DataFrame:
    """``(doc_id, est, k, bm25, count)`` of each matching document: summed estimate, terms matched, exact weight, occurrences. ``and`` needs all
    known terms, ``strict`` all given ones.

    Both modes are one aggregation by doc_id over the lists of the query's terms, which the scan selects by pushed-down ``IN``; the term
    weights are literals and a document's length is in its postings, so nothing is joined.
    """
    known = index.frequencies(terms)
    idf = idf_of(index, known)
    norm = ranking.length_norm(F.col("len"), F.lit(float(index.stats["avgdl"] or 1.0)))
    docs = index.postings.where(F.col("term").isin(list(known))).groupBy("doc_id").agg(
        F.round(F.sum(idf * F.col("score")), 6).alias("est"), F.count(F.lit(1)).alias("k"),
        F.round(F.sum(ranking.bm25(idf, F.col("tf"), norm)), 6).alias("bm25"), F.sum("tf").alias("count"))
    return docs if mode == "or" else docs.where(F.col("k") == (len(set(terms)) if strict else len(known)))


def batch(index: Index, queries: DataFrame, length: int = PAGE, max_terms: int = 1_000_000) -> DataFrame:
    """``(query_id, doc_id, est, rank)``: the best documents of each of many OR queries, given as rows ``(query_id, term)``.

    The queries' terms are broadcast up to ``max_terms`` rows and shuffled beyond; a query's page is cut by the group limit before
    the exchange. Repeated and unknown terms don't count.
    """
    asked = queries.where("term IS NOT NULL").select("query_id", "term").distinct()
    n = F.lit(float(index.stats["n_docs"]))
    wanted = asked.join(index.terms, "term").select("query_id", "term", ranking.idf(n, F.col("df")).alias("idf"))
    side = F.broadcast(wanted) if queries.count() <= max_terms else wanted
    scores = index.postings.join(side, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * F.col("score")), 6).alias("est"))
    w = Window.partitionBy("query_id").orderBy(F.desc("est"), F.desc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= length)


def page_of(ranked: DataFrame, page: int = 0, length: int = PAGE) -> DataFrame:
    return ranked.orderBy(F.desc("est"), F.desc("doc_id")).offset(page * length).limit(length)


def top_documents(index: Index, terms: list[str], mode: str = "or", page: int = 0, strict: bool = False, length: int = PAGE) -> DataFrame:
    """``(doc_id, est, bm25, count)`` of one page."""
    return page_of(matches(index, terms, mode, strict), page, length).select("doc_id", "est", "bm25", "count")


def single_term(index: Index, term: str, page: int = 0, length: int = PAGE) -> DataFrame:
    """One list ordered by (score, tf, doc_id): no aggregation is needed to find the page."""
    known = index.frequencies([term])
    rows = index.postings.where(F.col("term") == term).orderBy(F.desc("score"), F.desc("tf"), F.desc("doc_id")).offset(page * length).limit(length)
    norm = ranking.length_norm(F.col("len"), F.lit(float(index.stats["avgdl"] or 1.0)))
    return rows.select("doc_id", "score", F.col("tf").alias("count"), F.round(ranking.bm25(idf_of(index, known), F.col("tf"), norm), 6).alias("bm25"))


def auto_mode(index: Index, terms: list[str], share: float = AUTO_SHARE, min_df: int = MIN_DF) -> str:
    """``and`` or ``or``, from the document counts of the known terms."""
    df = index.frequencies(terms).values()
    return "and" if df and sum(df) > share * index.stats["n_docs"] and min(df) > min_df else "or"


def present(index: Index, page_rows: DataFrame, keywords: list[str]) -> DataFrame:
    """Url, language, title and snippets, fetched for one page's documents only."""
    rows = F.broadcast(page_rows).join(index.docs.select("doc_id", "url", "lang", "title", "body"), "doc_id")
    words = F.array(*(F.lit(k) for k in keywords)) if keywords else F.array().cast("array<string>")
    return rows.select("doc_id", "url", "lang", "title", *(c for c in ("est", "score", "bm25", "count") if c in page_rows.columns),
                       snippets_udf(F.col("body"), words, F.coalesce(F.col("lang"), F.lit("en"))).alias("snippets"))


def union_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    return postings.where(F.col("term").isin(terms)).select("doc_id").distinct()


def intersection_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    terms = sorted(set(terms))
    return (postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
            .where(F.col("k") == len(terms)).select("doc_id"))


def boolean(index: Index, tree) -> DataFrame:
    """Nested boolean queries, an addition: ``("and"|"or", a, b, ...)``, ``("not", a, b)`` (a without b) or a term."""
    if isinstance(tree, str):
        return index.postings.where(F.col("term") == tree).select("doc_id")
    op, *parts = tree
    out = boolean(index, parts[0])
    for p in parts[1:]:
        q = boolean(index, p)
        out = {"and": lambda a, b: a.join(b, "doc_id", "left_semi"), "or": lambda a, b: a.unionByName(b).distinct(),
               "not": lambda a, b: a.join(b, "doc_id", "left_anti")}[op](out, q)
    return out


_HAN = re.compile(r"[㐀-䶿一-鿿]")
_SEP = re.compile(r"\W+")


def query_words(query: str) -> list[str]:
    """The words of a query: as documents are tokenized, without empty ones, sorted."""
    out: list[str] = []
    for w in _SEP.split(query):
        runs = re.findall(r"[㐀-䶿一-鿿]+|[^㐀-䶿一-鿿]+", w)
        for r in runs:
            out += [r[i:i + 2] for i in range(len(r) - 1)] if _HAN.match(r) and len(r) > 1 else [r]
    return sorted({w for w in out if w})


class SearchEngine:
    """``search(text, page)`` over one index, with a bounded result cache and the ``:`` commands."""

    def __init__(self, index: Index, cache_size: int = 512, page: int = PAGE):
        self.index, self.cache_size, self.page = index, cache_size, page
        self._results: OrderedDict[tuple, dict] = OrderedDict()
        self.hits = self.misses = 0

    def plan(self, query: str) -> tuple[str, list[str]]:
        """``(mode, words)``: ``or`` where the query has a ``|``, ``single`` for one word, else ``auto``."""
        if "|" in query:
            parts = [x.strip() for x in query.split("|")]
            return "or", sorted({w for x in parts for w in (query_words(x) if _HAN.search(x) else [x]) if w})
        words = query_words(query)
        return ("single" if len(words) == 1 else "auto"), words

    def search(self, query: str, page: int = 0) -> dict:
        if query.startswith(":"):
            return self.command(query)
        mode, words = self.plan(query)
        key = (mode, tuple(words), page)
        if key in self._results:
            self.hits += 1
            self._results.move_to_end(key)
            return self._results[key]
        self.misses += 1
        began = time.process_time()
        if not words:
            total, rows = 0, []
        else:
            if mode == "auto":
                mode = auto_mode(self.index, words)
            if mode == "single":
                total, order = self.index.frequencies(words).get(words[0], 0), ("bm25", "doc_id")
                top = single_term(self.index, words[0], page, self.page)
            else:
                order = ("est", "doc_id")
                total, top = self._page(matches(self.index, words, mode), page) if self.index.frequencies(words) else (0, None)
            rows = [r.asDict(True) for r in present(self.index, top, words).orderBy(*(F.desc(c) for c in order)).collect()] if total else []  # one page
        out = {"meta": {"results": total, "time": time.process_time() - began, "query": query, "keywords": words,
                        "pages": math.ceil(total / self.page), "page": page}, "results": rows}
        self._results[key] = out
        if len(self._results) > self.cache_size:
            self._results.popitem(last=False)
        return out

    def _page(self, found: DataFrame, page: int) -> tuple[int, DataFrame]:
        """All matches counted and one page of them, by one aggregation."""
        seen = Observation()
        counted = found.observe(seen, F.count(F.lit(1)).alias("n"))
        top = page_of(counted, page, self.page).select("doc_id", "est", "bm25", "count")
        rows = top.collect()  # one page
        return seen.get["n"], self.index.postings.sparkSession.createDataFrame(rows, top.schema)

    def command(self, query: str) -> dict:
        spark = self.index.postings.sparkSession
        if query == ":cache":
            return {"cached": len(self._results), "hits": self.hits, "misses": self.misses, "size": self.cache_size}
        if query == ":cache-clear":
            self._results.clear()
            for df in (self.index.terms, self.index.docs, self.index.postings):
                df.unpersist()
            return {"cached": 0}
        if query == ":reload":
            self._results.clear()
            self.index = Index.open(spark, self.index.path)
            return {"reloaded": self.index.path}
        return {"error": f"unknown command {query}"}

    def warm(self) -> None:
        """Keep the term table in executor memory."""
        self.index.terms.persist()
