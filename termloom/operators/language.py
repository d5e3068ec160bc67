"""Language identification for indexing and queries: character-trigram naive Bayes. Trained by aggregates, applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import char_grams, let

#: The languages an index knows; a model has one column per language, so their number is fixed.
LANGUAGES = ("de", "en", "es", "fr", "it", "la", "nl", "pt", "zh")


def padded(text: Column) -> Column:
    """The lower-cased text with one space around it; white space runs count as one space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), F.lit(" "))


def trigrams(text: Column) -> Column:
    return let(padded(text), lambda t: char_grams(t, 3))


def train(samples: DataFrame, smooth: float = 0.5) -> DataFrame:
    """One row per trigram of the labelled ``(lang, text)`` with its log probability in each language; languages weigh alike."""
    counts = (samples.where(F.col("lang").isin(*LANGUAGES)).select("lang", F.explode(trigrams(F.col("text"))).alias("gram"))
              .groupBy("gram").pivot("lang", list(LANGUAGES)).count().na.fill(0))
    totals = counts.agg(*(F.sum(c).alias(c) for c in LANGUAGES), F.count(F.lit(1)).alias("v")).first()  # one row

    def logp(c: str) -> Column:
        return F.log((F.col(c) + smooth) / F.lit((totals[c] or 0) + smooth * totals["v"])).alias(c)

    return counts.select("gram", *(logp(c) for c in LANGUAGES))


def detect(docs: DataFrame, model: DataFrame, key: str, text: str = "text", languages: list[str] | None = None,
           broadcast_rows: int = 500_000) -> DataFrame:
    """``(key, detected)``; no row for a text without a known trigram. ``languages`` restricts the answer; of equal scores the last name wins.

    A model of up to ``broadcast_rows`` trigrams goes to every task as two arrays and is looked up there for all letters of many texts at
    once, so no trigram becomes a row; a larger one is joined by shuffle.
    """
    use = sorted(languages or LANGUAGES, reverse=True)
    rows = model.limit(broadcast_rows + 1).toPandas()
    if len(rows) > broadcast_rows:
        grams = docs.select(F.col(key).alias("k"), F.explode(trigrams(F.col(text))).alias("gram"))
        sums = grams.join(model, "gram").groupBy("k").agg(*(F.sum(c).alias(c) for c in use))
        best = F.array_max(F.array(*(F.struct(F.col(c).alias("score"), F.lit(c).alias("lang")) for c in use)))
        return sums.select(F.col("k").alias(key), best["lang"].alias("detected"))
    codes = [_codes(g) for g in rows["gram"]]
    packed = np.array([c[0] | c[1] << 21 | c[2] << 42 for c in codes if len(c) == 3], np.int64)
    weights = rows.loc[[len(c) == 3 for c in codes], use].to_numpy(float)
    order = np.argsort(packed)
    packed, weights = packed[order], weights[order]
    spark_type = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 200):
                part = b.slice(a, 200)
                found = _scores(part.column(1).to_pylist(), packed, weights)
                at = np.flatnonzero(found[1])
                names = pa.array([use[i] for i in found[0][at].argmax(axis=1)] if len(at) else [], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), names], names=["k", "detected"])

    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), padded(F.col(text)).alias("t")).mapInArrow(
        run, f"k {spark_type}, detected string").withColumnRenamed("k", key)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _scores(texts: list[str], packed: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(summed log probabilities, known trigrams)`` of each text."""
    codes = _codes("".join(texts))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams = codes[:-2] | codes[1:-1] << 21 | codes[2:] << 42
    inside = owner[:-2] == owner[2:]
    if not len(packed) or not len(grams):
        return np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    i = np.minimum(np.searchsorted(packed, grams), len(packed) - 1)
    hit = np.flatnonzero(inside & (packed[i] == grams))
    i, who = i[hit], owner[hit]
    sums = np.stack([np.bincount(who, weights[i, c], len(texts)) for c in range(weights.shape[1])], axis=1)
    return sums, np.bincount(who, minlength=len(texts))
