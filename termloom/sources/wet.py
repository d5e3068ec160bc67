"""WET crawl files as a Spark data source: ``spark.read.format("wet").load(path)``."""

from __future__ import annotations

import fnmatch
import gzip
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, content binary, record_id string, warc_date string, source_file string, off bigint"


def records(stream, url_only: bool = False) -> Iterator[tuple[dict, bytes | None, int]]:
    """``(headers, content, offset)`` of each record of an uncompressed stream; header names in lower case.

    A record ends by its Content-Length, whatever its content looks like; a truncated last record is dropped.
    """
    at = 0
    while True:
        start, line = at, stream.readline()
        if not line:
            return
        at += len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {start}")
        headers = {}
        while True:
            line = stream.readline()
            at += len(line)
            if not line.strip():
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        content = stream.read(length)
        at += len(content)
        if len(content) < length:
            return
        yield headers, None if url_only else content, start


def _located(path: str):
    """``(file system, path in it)``: any that pyarrow knows by its URI, else this machine's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _opened(path: str):
    system, inner = _located(path)
    raw = system.open_input_file(inner)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)


def files_of(pattern: str) -> list[str]:
    """The WET files of a folder, of a pattern in the last part of a path, or the file itself."""
    from pyarrow import fs

    system, inner = _located(pattern)
    prefix = pattern[:len(pattern) - len(inner)] if pattern.endswith(inner) else ""
    wild = any(c in inner for c in "*?[")
    if not wild and system.get_file_info(inner).type != fs.FileType.Directory:
        return [pattern]
    folder, name = inner.rsplit("/", 1) if wild else (inner, "*.wet*")
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WetReader(DataSourceReader):
    """One partition per file: gzip members can't be split."""

    def __init__(self, options):
        self.pattern, self.content = options.get("path"), options.get("content", "true").lower() == "true"

    def partitions(self):
        files = files_of(self.pattern)
        if not files:
            raise FileNotFoundError(self.pattern)
        return [_File(f) for f in files]

    def read(self, part):
        with _opened(part.path) as f:
            for h, content, off in records(f, not self.content):
                if h.get("warc-type", "conversion") != "conversion":
                    continue
                rest = (h.get("warc-record-id", "").strip("<>").removeprefix("urn:uuid:") or None, h.get("warc-date"), part.path, off)
                yield (h.get("warc-target-uri"), content, *rest) if self.content else (h.get("warc-target-uri"), *rest)


class WetDataSource(DataSource):
    @classmethod
    def name(cls):
        return "wet"

    def schema(self):
        return SCHEMA if self.options.get("content", "true").lower() == "true" else SCHEMA.replace(" content binary,", "")

    def reader(self, schema):
        return WetReader(self.options)


def read_wet(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Without ``content`` the bodies are skipped in the readers and never sent to the JVM."""
    spark.dataSource.register(WetDataSource)
    return spark.read.format("wet").option("content", str(content).lower()).load(path)


def record_at(path: str, offset: int, url: str | None = None) -> bytes | None:
    """One record of an uncompressed or gzip file by its uncompressed offset; null unless ``url`` (if given) matches."""
    with _opened(path) as f:
        f.seek(offset)
        for h, content, _ in records(f):
            return content if url is None or h.get("warc-target-uri") == url else None
    return None


def fetch(places: DataFrame) -> DataFrame:
    """``places`` (source_file, off, url, ...) with the ``content`` found there by a seek, null unless the record has that url."""
    def run(batches):
        for pdf in batches:
            pdf["content"] = [record_at(p, int(o), u) for p, o, u in zip(pdf["source_file"], pdf["off"], pdf["url"])]
            yield pdf

    return places.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in places.dtypes) + ", content binary")


def write_wet(rows: DataFrame, path: str, compress: bool = True) -> int:
    """Write records (url, content, record_id, warc_date, source_file, off) as one WET file for each ``source_file``, in order of ``off``; returns their number.

    A file is written under another name and moved when it is complete, so a task that is run again does no harm. Null urls and dates are
    left out, null content is empty.
    """
    def run(batches):
        now, out, system, temp, final, n = None, None, None, None, None, 0

        def close():
            out.close()
            system.move(temp, final)

        for pdf in batches:
            for url, content, rid, date, file in zip(pdf["url"], pdf["content"], pdf["record_id"], pdf["warc_date"], pdf["source_file"]):
                if file != now:
                    if out is not None:
                        close()
                    name = file.rsplit("/", 1)[-1].removesuffix(".gz") + (".gz" if compress else "")
                    system, final = _located(f"{path}/{name}")
                    temp = f"{final.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
                    system.create_dir(final.rsplit("/", 1)[0])
                    out, now = system.open_output_stream(temp, compression=None), file
                body = bytes(content) if content is not None else b""
                head = ["WARC/1.0", "WARC-Type: conversion", *([f"WARC-Target-URI: {url}"] if url is not None else []), f"WARC-Record-ID: <urn:uuid:{rid}>",
                        *([f"WARC-Date: {date}"] if date is not None else []), f"Content-Length: {len(body)}"]
                data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
                out.write(gzip.compress(data) if compress else data)
                n += 1
        if out is not None:
            close()
        yield pd.DataFrame({"n": [n]})

    cols = rows.select("url", "content", "record_id", F.col("warc_date").cast("string").alias("warc_date"), "source_file", "off").where("source_file IS NOT NULL")
    return cols.repartition("source_file").sortWithinPartitions("source_file", "off", "record_id").mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0
