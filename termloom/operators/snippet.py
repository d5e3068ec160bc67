"""Keyword-focused snippets of a document body."""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

_PARTS = re.compile(r"(\W+)")
#: Chinese words are shorter, so a snippet may have so many times as many.
ZH_FACTOR = 1.54


def sliding_window(items: list, size: int = 2, step: int = 1, fill=None) -> list[tuple]:
    return [tuple(items[i:i + size]) + (fill,) * (size - len(items[i:i + size])) for i in range(0, len(items), step)]


def _split(line: str, lang: str) -> list[str]:
    return list(line) if lang == "zh" else _PARTS.split(line)


def snippets(content: str | None, keywords: list[str], sentences: int = 3, budget: int = 20, lang: str = "en") -> list[str]:
    """Up to ``sentences`` pieces of at most ``budget`` tokens holding most distinct keywords.

    Long lines are cut into half-budget chunks and scored in overlapping pairs. With too few lines, fewer than three candidates or a
    second best below two keywords, one longer piece is taken instead. Null or one-character content gives no snippet.
    """
    if content is None or len(content) < 2:
        return []
    if lang == "zh":
        budget = int(budget * ZH_FACTOR)
    rows = [_split(line, lang) for line in content.split("\n")]
    if len(rows) < sentences:
        return _best(rows, keywords, 1, sentences * budget)[1]
    scores, out = _best(rows, keywords, sentences, budget)
    if sentences > 1 and (len(scores) < 3 or scores[1] < 2):
        return _best(rows, keywords, 1, sentences * budget)[1]
    return out


def _best(rows: list[list[str]], keywords: list[str], n: int, budget: int) -> tuple[list[int], list[str]]:
    wanted, half, found = set(keywords), max(1, budget // 2), set()
    for row in rows:
        if len(row) <= budget:
            found.add((len(wanted.intersection(row)), tuple(row)))
            continue
        chunks = [(len(wanted.intersection(c)), c) for c in sliding_window(row, half, half, "")]
        found.update((a[0] + b[0], a[1] + b[1]) for a, b in zip(chunks, chunks[1:]))
    top = heapq.nlargest(n, found)
    return [c for c, _ in heapq.nlargest(3, found)], ["".join(t) for _, t in top]


@F.pandas_udf(T.ArrayType(T.StringType()))
def snippets_udf(content: pd.Series, keywords: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([snippets(c, list(k), lang=g) for c, k, g in zip(content, keywords, lang)])
