"""Names of languages, as labels spell them."""

from __future__ import annotations

import re

#: Three-letter codes (fixed values of ISO 639-2).
_LABELS = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "lat": "la",
           "zho": "zh", "chi": "zh"}
LANGUAGES = ("de", "en", "es", "fr", "it", "la", "nl", "pt", "zh")


def label(lang: str | None, known: tuple[str, ...] = LANGUAGES) -> str | None:
    """The code of a ``known`` language that a label names in some spelling (case, region, three letters, spaces); null if none."""
    if lang is None:
        return None
    code = re.split(r"[-_]", lang.strip().lower())[0]
    code = _LABELS.get(code, code)
    return code if code in known else None
