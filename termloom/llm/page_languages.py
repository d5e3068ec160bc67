"""The language of each record's main text, and of its passages in other languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import langid
from .lines import LANGUAGES, label
from .pages import NOT_MAIN, PROSE, PageReader, function_words, pages_of, small, vote, with_own_paths

#: So many sentences in a row make a passage count as a language of its record.
PASSAGE = 3
_LETTERS = 700_000
_MODELS: dict[tuple, langid.Model] = {}
_PASSAGES = "array<struct<first_line:int,last_line:int,sentences:int,lang:string,confidence:double>>"


def train(samples: DataFrame, limit: int = langid.MAX_SAMPLES) -> langid.Model:
    """The model of ``(lang, text)`` rows, of which at most ``limit`` are fetched to the driver, by the order of their hash."""
    rows = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").orderBy(F.xxhash64("text")).limit(limit).collect()
    key = tuple((r["lang"], r["text"]) for r in rows)
    if key not in _MODELS:  # training takes seconds, so the last model is kept
        _MODELS.clear()
        _MODELS[key] = langid.train(list(key))
    return _MODELS[key]


def languages(records: DataFrame, samples: DataFrame, model: langid.Model | None = None) -> DataFrame:
    """``(record_id, label, lang, confidence, mixed, passages)`` of every record with content, repeated rows included.

    ``label`` is the two-letter code of the given label, ``lang`` the language that most of the main text is in, ``confidence`` the mean
    calibrated probability of its sentences, ``mixed`` the languages with PASSAGE sentences in a row where there are two or more of
    them, ``passages`` the runs of sentences of one language with their lines. Headings, lists and the title weigh in for ``lang``, each by its
    probabilities; where there are no sentences they alone decide, and without any main text all lines do. Null labels are kept as null; bytes that
    aren't UTF-8 are replaced; null, empty and blank content has no row.
    """
    winners, of_host = vote(records)
    words_ = function_words(samples)
    model = model or train(samples)
    rows = with_own_paths(records, of_host, ["record_id", "lang"])
    known = tuple(sorted({*LANGUAGES, *model.languages}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PageReader(winners, words_)
        passage = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("sentences", pa.int32()),
                                      ("lang", pa.string()), ("confidence", pa.float64())]))
        types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), passage]
        for b in small(batches, letters=_LETTERS):
            at, texts, p, kinds = pages_of(reader, b)
            ids, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
            bounds = np.searchsorted(p.page, np.arange(len(texts) + 1)).tolist()
            main, prose_ = (~np.isin(kinds, NOT_MAIN)).tolist(), (kinds == PROSE).tolist()
            numbers = p.number.tolist()
            parts = [_main(t, numbers[i:j], prose_[i:j], main[i:j]) for t, i, j in zip(texts, bounds, bounds[1:])]
            flat = [s for x in parts for s in x[0]]
            logp = model.log_probabilities(model.logits(flat)) if flat else np.zeros((0, len(model.languages)))
            prob, best, size = np.exp(logp), logp.argmax(axis=1), np.fromiter(map(len, flat), float, len(flat))
            got, k = [], 0
            for row, (ss, lines, prose) in zip(at, parts):
                if ss:
                    j = k + len(ss)
                    got.append((ids[row], label(labels[row], known), *_judge(model.languages, lines, prose, logp[k:j], prob[k:j], best[k:j], size[k:j])))
                    k = j
            cols = list(zip(*got)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                             names=["record_id", "label", "lang", "confidence", "mixed", "passages"])

    return rows.mapInArrow(run, f"record_id string, label string, lang string, confidence double, mixed array<string>, passages {_PASSAGES}")


def _main(text: str, numbers: list[int], prose_lines: list[bool], main: list[bool]) -> tuple[list[str], list[int], np.ndarray]:
    """Sentences and other lines of the main text, their line numbers and whether they are sentences of prose."""
    rows = text.split("\n")
    every = not any(main)  # key words alone tell little, so the title alone decides before them
    ss, at, prose = [], [], []
    for n, is_prose, use in zip(numbers, prose_lines, main):
        if use or every:
            line = rows[n - 1].strip()
            parts = langid.sentences(line) if is_prose else [line]
            ss += parts
            at += [n] * len(parts)
            prose += [is_prose] * len(parts)
    return ss, at, np.array(prose, bool)


def _judge(languages: tuple[str, ...], at: list[int], prose: np.ndarray, logp: np.ndarray, p: np.ndarray, best: np.ndarray, size: np.ndarray) -> tuple:
    sure = prose if prose.any() else np.ones(len(at), bool)
    amount = size[~sure] @ p[~sure]
    where, p, size, best = np.flatnonzero(sure), p[sure], size[sure], best[sure]
    same = bool((best == best[0]).all())
    path = best if same else langid.smooth(logp[sure])
    amount += np.bincount(path, weights=size, minlength=len(languages))
    main = int(amount.argmax())
    own = path == main
    own = own if own.any() else ~own
    confidence = float(p[own, main] @ size[own] / max(size[own].sum(), 1.0))
    cuts = [] if same else (np.flatnonzero(np.diff(path)) + 1).tolist()
    passages, long_ = [], set()
    for a, b in zip([0, *cuts], [*cuts, len(path)]):
        c = int(path[a])
        passages.append({"first_line": at[where[a]], "last_line": at[where[b - 1]], "sentences": int(b - a), "lang": languages[c],
                         "confidence": round(float(p[a:b, c].mean()), 6)})
        if prose[where[a]] and b - a >= PASSAGE:
            long_.add(languages[c])
    return languages[main], round(confidence, 6), sorted(long_) if len(long_) > 1 else [], passages


def wrong_or_mixed(found: DataFrame) -> DataFrame:
    """``(record_id, lang)``: records whose label is missing, none or wrong, with their language, and mixed ones with each of theirs."""
    cases = found.where("label IS NULL OR label <> lang OR size(mixed) > 1")
    return cases.select("record_id", F.explode(F.array_union(F.array("lang"), "mixed")).alias("lang")).distinct()
