"""How distinctive each term is of its record, against the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize

#: Terms that hold this share of all (record, term) rows go to every task: at most 1 / HOT_SHARE of them, whatever the collection's size.
HOT_SHARE = 2e-6


def chunk_sets(lines: DataFrame) -> DataFrame:
    """``(doc_id, term, freq, block, chunks)``: the distinct lines as sets of chunk numbers, each a bit of ``chunks``, 64 to a block; placed by ``doc_id``.

    A set takes each line but once, so that few rows are kept to find repeated lines. A null chunk is the only one of its block.
    """
    rows = lines.where("term IS NOT NULL AND term <> '' AND doc_id IS NOT NULL").select("term", "doc_id", "chunk_no", "freq").repartition("doc_id")
    bit = F.expr("shiftleft(1L, cast(coalesce(chunk_no, 0) & 63 AS int))")
    return rows.groupBy("doc_id", "term", "freq", F.shiftright("chunk_no", 6).alias("block")).agg(F.bit_or(bit).alias("chunks"))


def term_statistics(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, len)`` over the distinct lines, written once; ``len`` is null where docs has none.

    Everything is placed by ``doc_id`` in one exchange: de-duplication, sums, the join with docs and, as each record lies in one
    file of the written table, the later per-record ranking all stay local. Null and empty terms and null ids are dropped.
    A doc_id with several lengths gets the largest.
    """
    tf = chunk_sets(lines).groupBy("doc_id", "term").agg(F.sum(F.col("freq").cast("bigint") * F.bit_count("chunks")).alias("tf"))
    length = docs.groupBy("doc_id").agg(F.max("len").cast("bigint").alias("len"))
    return materialize(tf.join(length, "doc_id", "left"), "term-statistics")


def weigh(stats: DataFrame, docs: DataFrame, how: str = "bm25", min_records: int = 3, digits: int = 6, hot_share: float = HOT_SHARE) -> DataFrame:
    """``(doc_id, term, weight)`` for every term found in at least ``min_records`` records, of records with a length.

    ``how``: ``llr`` is the signed log-likelihood ratio of the two-by-two table (term or other token, this record or the rest);
    ``bm25`` is the ranking weight with K = 1.2(0.25 + 0.75 len/avgdl). Both are rounded to ``digits`` decimals.
    """
    per_term = stats.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("cf"))
    per_term = materialize(per_term.where(F.col("n") >= min_records), "term-frequencies")
    limit = max(stats.count() * hot_share, min_records)
    hot, cold = F.broadcast(per_term.where(F.col("n") >= limit)), per_term.where(F.col("n") < limit)
    rows = stats.where("len IS NOT NULL AND tf IS NOT NULL")
    # The terms that own most rows are joined where the rows are; none of the others is large enough to hold up a task.
    rest = rows.join(F.broadcast(per_term.where(F.col("n") >= limit).select("term")), "term", "left_anti")
    rows = rows.join(hot, "term").unionByName(rest.join(cold, "term")) if limit > min_records else rows.join(hot, "term")
    if how == "bm25":
        n_all = stats.select("doc_id").distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
        avgdl = docs.select("doc_id", "url", "lang", "len", "off").distinct().agg(F.avg("len").alias("a")).scalar()
        weight = bm25(n_all, avgdl)
    elif how == "llr":
        weight = llr(stats.agg(F.sum("tf").cast("double").alias("t")).scalar())
    else:
        raise ValueError(f"unknown weight {how!r}")
    return rows.select("doc_id", "term", F.round(weight, digits).alias("weight"))


def bm25(n_all: Column, avgdl: Column) -> Column:
    n, tf, k = F.col("n").cast("double"), F.col("tf").cast("double"), F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("len") / avgdl)
    return F.log((n_all - n + 0.5) / (n + 0.5)) * 2.2 * tf / (k + tf)


def llr(total: Column) -> Column:
    """2 sum(O ln(O/E)), negative where the record holds less of the term than the collection would lead to expect.

    ``len`` of docs also counts tokens without a term, so it is raised to tf where smaller.
    """
    a = F.col("tf").cast("double")
    row, col = F.greatest(F.col("len").cast("double"), a), F.col("cf").cast("double")
    total = F.greatest(total, row + col - a)
    cells = [(a, row, col), (row - a, row, total - col), (col - a, total - row, col), (total - row - col + a, total - row, total - col)]

    def part(o: Column, r: Column, c: Column) -> Column:
        return F.when(o > 0, o * F.log(o * total / (r * c))).otherwise(0.0)

    g = F.lit(2.0) * sum((part(*x) for x in cells[1:]), part(*cells[0]))
    return F.when(a * total < row * col, -g).otherwise(g)


def best_terms(weights: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` terms of the highest weight per record; equal weights go by the smaller term in byte order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.asc("term"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
