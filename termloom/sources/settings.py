"""Settings from an INI file with the sections ``InvertedIndex`` and ``Query``."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    page_length: int = 10
    cache_size: int = 512

    @classmethod
    def load(cls, path: str) -> "Settings":
        ini = configparser.ConfigParser()
        ini.read(path)
        given = {k.lower(): v for s in ini.sections() for k, v in ini[s].items()}
        return cls(**{f.name: int(given[f.name]) if f.type == "int" else given[f.name] for f in fields(cls) if f.name in given})
