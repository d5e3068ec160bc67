"""Tokenizing and other text expressions; all of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What separates words. Java's \W would be ASCII only.
SEPARATORS = r"[^\p{L}\p{N}_]+"
_WORD_OR_SEPARATOR = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: Runs of Han characters, or words of anything else.
_HAN_OR_WORD = r"\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also where ``use`` refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words of a text in order, with ``''`` at either end where it starts or ends with a separator."""
    return F.split(text, SEPARATORS, -1)


def char_grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters. Cut from an array of characters: substr would walk the string anew for each."""
    def grams(c: Column) -> Column:
        at = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1)))
        return F.transform(at, lambda i: F.concat(*(F.element_at(c, i + k) for k in range(n))))

    return let(F.filter(F.split(text, "", -1), lambda x: x != ""), grams)


def han_words(text: Column) -> Column:
    """Chinese text without a dictionary: overlapping character pairs of each Han run, other words whole."""
    def pairs(run: Column) -> Column:
        return F.when(run.rlike(r"^\p{IsHan}{2,}"), char_grams(run, 2)).otherwise(F.array(run))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({_HAN_OR_WORD})"), 1), pairs))


def tokens(text: Column) -> Column:
    """The tokenizer of documents: words, and character pairs where a text holds Chinese characters, whatever its label says."""
    return F.when(text.rlike(r"\p{IsHan}"), F.filter(han_words(text), searchable)).otherwise(words(text))


def query_words(query: Column) -> Column:
    """The words of a query, tokenized as documents are: each once, sorted, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(tokens(query), lambda w: w != "")))


def searchable(word: Column) -> Column:
    """Words whose first character is not ASCII or is a word character; full-width punctuation passes."""
    return word.rlike(r"^([^\x00-\x7F]|[\p{L}\p{N}_])")


def words_and_separators(line: Column) -> Column:
    """Tokens of a line that join back to it, starting and ending with a word (maybe ``''``)."""
    found = F.regexp_extract_all(line, F.lit(f"({_WORD_OR_SEPARATOR})"), 1)
    empty = F.array(F.lit(""))
    head = F.when(line.rlike(r"^[^\p{L}\p{N}_]"), empty).otherwise(F.slice(empty, 1, 0))
    tail = F.when(line.rlike(r"[^\p{L}\p{N}_]$"), empty).otherwise(F.slice(empty, 1, 0))
    return F.when(line == "", empty).otherwise(F.concat(head, found, tail))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def title(text: Column) -> Column:
    return F.split(text, "\n", 2)[0]


def body(text: Column) -> Column:
    """All after the first line end; ``''`` where there is none."""
    return F.coalesce(F.try_element_at(F.split(text, "\n", 2), F.lit(2)), F.lit(""))


def or_operands(query: Column) -> Column:
    return F.transform(F.split(query, r"\|", -1), lambda x: F.trim(x))


def strip_gz(file: Column) -> Column:
    return F.regexp_replace(file, r"\.gz$", "")


def base_name(file: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.warc\.wet\.gz$", "")


def highlight(text: Column, keywords: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Whole-word occurrences of the keywords, in any case, put between two marks."""
    import re

    if not keywords:
        return text
    alternatives = "|".join(re.escape(k) for k in sorted(keywords, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({alternatives})(?![\p{{L}}\p{{N}}_])", f"{before}$1{after}")


def readable_url(url: Column) -> Column:
    """The percent-decoded url, or the url itself where it can't be decoded."""
    return F.coalesce(F.try_url_decode(url), url)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def keyword_coverage(line: Column, keywords: Column) -> Column:
    """How many distinct keywords are words of the line."""
    return F.size(F.array_intersect(words(line), keywords))


def sliding(xs: Column, size: int, step: int = 1, fill: str = "") -> Column:
    """Windows of ``size`` items every ``step`` items; the last ones are padded on the right."""
    def windows(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(step)))
        padded = F.concat(xs, F.array_repeat(F.lit(fill), size - 1))
        return let(padded, lambda p: F.transform(starts, lambda i: F.slice(p, i, size)))

    return let(xs, windows)
