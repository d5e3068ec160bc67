"""``python -m termloom DOCUMENTS.parquet [SETTINGS.ini]``: index a table of documents and answer queries from the keyboard."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .operators.index import Index
from .operators.search import SearchEngine
from .sources.settings import Settings


def main(path: str, settings_file: str | None = None) -> None:
    settings = Settings.load(settings_file) if settings_file else Settings()
    spark = SparkSession.builder.appName("termloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = SearchEngine(Index.build(spark.read.parquet(path)), settings.cache_size, settings.page_length)
    for line in sys.stdin:
        query, _, page = line.rstrip("\n").partition("\t")
        print(json.dumps(engine.search(query, int(page or 0)), ensure_ascii=False, default=str), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:3])
