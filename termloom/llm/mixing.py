"""Mixing sources to target shares of all tokens, by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize
from .tokens import VOCABULARY, token_count

BLOCK_ROWS = 20_000
FAN_IN = 16
_ROUNDED = "doc_id bigint, source string, tokens int, copies int, p double, block int"


def pivotal(p: list[float], sizes: list[int], rng: random.Random) -> tuple[list[int | None], int | None, float]:
    """Round probabilities one against the next: ``(0 or 1 for each, index of the one left open, its probability)``.

    Each step moves expected tokens (probability times size) from one item to the other, in a direction drawn so that both keep their
    expectation, until one of the two is 0 or 1. So the expected tokens stay as they are in every draw, and every item is
    1 with its own probability. At most one item stays open (None); sizes must be positive.
    """
    eps = 1e-12
    out: list[int | None] = [None] * len(p)
    held, ph = None, 0.0
    for i, q in enumerate(p):
        if held is None:
            held, ph = i, q
        else:
            a, b = sizes[held], sizes[i]
            up, down = min((1 - ph) * a, q * b), min(ph * a, (1 - q) * b)
            move = up if rng.random() * (up + down) < down else -down
            ph, q = ph + move / a, q - move / b
            if eps < q < 1 - eps:
                out[held], held, ph = int(ph > 0.5), i, q
            else:
                out[i] = int(q > 0.5)
        if not eps < ph < 1 - eps:
            out[held], held, ph = int(ph > 0.5), None, 0.0
    return out, held, ph


def pooled(q: float, sizes: list[int], rng: random.Random) -> tuple[list[int | None], int | None, float]:
    """``pivotal`` for items of equal probability: each is paired with the pool of all items after it, which share theirs.

    With sizes in falling order a large item is settled against many smaller ones, and the one that stays open is the smallest
    (unless the pool as a whole becomes 0 or 1 first; then it is the pool's partner).
    """
    eps, n = 1e-12, len(sizes)
    out: list[int | None] = [None] * n
    rest = sum(sizes)
    for i, a in enumerate(sizes):
        if not eps < q < 1 - eps:
            out[i:] = [int(q > 0.5)] * (n - i)
            return out, None, 0.0
        rest -= a
        if not rest:
            return out, i, q
        up, down = min((1 - q) * a, q * rest), min(q * a, (1 - q) * rest)
        move = up if rng.random() * (up + down) < down else -down
        p, q = q + move / a, q - move / rest
        if eps < p < 1 - eps:
            out[i + 1:] = [int(q > 0.5)] * (n - i - 1)
            return out, i, p
        out[i] = int(p > 0.5)
    return out, None, 0.0


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """Per target source: available tokens and expected copies per document. A few rows (one per target).

    ``total_tokens`` is the size of the mixture; without it, or where a source could not fill its share within ``max_repeats``, it is the
    largest that all sources can fill. Sources without any token are left out of that rule and reach a share of 0.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("docs"))
    want = targets.where("source IS NOT NULL AND weight > 0 AND max_repeats > 0").groupBy("source").agg(
        F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in want.join(have, "source", "left").collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    all_weights = sum(r["weight"] for r in rows) or 1.0
    limits = [r["max_repeats"] * r["available"] / (r["weight"] / all_weights) for r in rows if r["available"]]
    total = min([*limits, *([total_tokens] if total_tokens else [])], default=0.0)
    for r in rows:
        r["expected"] = min(float(r["max_repeats"]), total * r["weight"] / all_weights / r["available"]) if r["available"] else 0.0
    return rows


def mix(docs: DataFrame, targets: DataFrame, size: Column | None = None, total_tokens: float | None = None, seed: int = 11,
        block_rows: int = BLOCK_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, copies)`` for every document; 0 copies for sources without a target and for texts without tokens.

    All documents of a source have the same expected number of copies; its whole part is given, its fraction is rounded by the pivotal
    method within blocks of a source (hashed, so that a source of any size spreads over tasks), largest first, so that what stays open is
    small and a source misses its share by a small document at most. The open one of each block goes up a tree of FAN_IN blocks a node.
    """
    sizes = materialize(docs.select("doc_id", "source", (size if size is not None else token_count(F.col("text"), vocabulary)).cast("int").alias("tokens")), "token-sizes")
    plan = budgets(sizes.where("tokens > 0"), targets, total_tokens)
    spark = docs.sparkSession
    table = spark.createDataFrame([(r["source"], r["expected"], max(1, -(-(r["docs"] or 1) // block_rows))) for r in plan],
                                  "source string, expected double, blocks int")
    drawn = sizes.where("tokens > 0").join(F.broadcast(table), "source").select(  # one row per target
        "doc_id", "source", "tokens", F.floor("expected").cast("int").alias("copies"), (F.col("expected") - F.floor("expected")).alias("p"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))

    def round_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = random.Random(f"{seed}/{pdf['source'].iat[0]}/{pdf['block'].iat[0]}/{len(pdf)}")
        p, sizes_ = pdf["p"].tolist(), pdf["tokens"].tolist()
        done, held, left = pooled(p[0], sizes_, rng) if min(p) == max(p) else pivotal(p, sizes_, rng)
        pdf["copies"] = [c + (x or 0) for c, x in zip(pdf["copies"].tolist(), done)]
        pdf["p"] = [left if i == held else None for i in range(len(pdf))]
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf[["doc_id", "source", "tokens", "copies", "p", "block"]]

    level = materialize(drawn.groupBy("source", "block").applyInPandas(round_block, _ROUNDED), "rounded")
    closed = [level.where("p IS NULL")]
    blocks = max((-(-(r["docs"] or 1) // block_rows) for r in plan), default=1)
    open_ = level.where("p IS NOT NULL")  # one row per block at most
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        up = open_.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int"))
        level = materialize(up.groupBy("source", "block").applyInPandas(round_block, _ROUNDED), "rounded")
        closed.append(level.where("p IS NULL"))
        open_ = level.where("p IS NOT NULL")
    draw = F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    closed.append(open_.withColumn("copies", F.col("copies") + (draw < F.col("p")).cast("int")))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    rest = sizes.join(F.broadcast(table.select("source")), "source", "left_anti").unionByName(
        sizes.join(F.broadcast(table.select("source")), "source", "left_semi").where("tokens <= 0"))
    return out.select("doc_id", "source", "tokens", "copies").unionByName(rest.select("doc_id", "source", "tokens", F.lit(0).alias("copies")))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: wanted and reached share of all tokens, tokens, documents used and the most copies of one."""
    used = mixture.where("copies > 0").groupBy("source").agg(
        F.sum(F.col("tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("tokens")).scalar()
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    return want.join(used, "source", "left").select(
        "source", "weight", F.round(F.coalesce(F.col("tokens"), F.lit(0)) / total, 6).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
