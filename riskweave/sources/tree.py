"""A source tree as a DataFrame: a Python data source that prunes folders before it descends and reads files in parallel.

Spark's own file sources hide names that start with ``_`` or ``.``, so ``__init__.py`` and ``.env`` would vanish there.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders never entered, suffixes read, files skipped, greatest size.
SKIP_DIRS = frozenset(".git node_modules .venv venv __pycache__ .mypy_cache dist build .idea .pytest_cache site-packages _static .next out vendor coverage .docusaurus .turbo target cassettes __snapshots__ assets".split())
SUFFIXES = frozenset(".py .js .ts .tsx .jsx .go .java .kt .cs .rb .php .rs .txt .md .json .yaml .yml .toml .env .cfg .ini .sh .ipynb .prompt".split())
SKIP_FILE = re.compile(r"(?i)(\.min\.(js|css)$|\.bundle\.|-lock\.json$|package-lock\.json$|yarn\.lock$|\.map$|\.d\.ts$|\.chunk\.)")
MOST_BYTES = 2_000_000
SCHEMA = "path string, name string, suffix string, bytes long, text string"


def wanted(name: str) -> bool:
    """Whether a file name is read at all."""
    suffix = os.path.splitext(name)[1].lower()
    return (suffix in SUFFIXES or name == ".env") and not SKIP_FILE.search(name)


def excluded(rel: str, pattern: str) -> bool:
    """Whether a path matches a pattern as a whole, lies below a folder of that name at any depth, or has it as a segment."""
    p = pattern.rstrip("/")
    return fnmatch.fnmatch(rel, p) or f"/{p}/" in f"/{rel}/"


def walk(root: str, exclude: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(relative path, size) of the files to read, sorted; a single file is taken whatever it is."""
    if os.path.isfile(root):
        return [(".", os.path.getsize(root))]
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIP_DIRS)
        for n in sorted(names):
            full = os.path.join(folder, n)
            rel = os.path.relpath(full, root)
            if not wanted(n) or any(excluded(rel, p) for p in exclude):
                continue
            try:
                size = os.path.getsize(full)
            except OSError:
                continue
            if size <= MOST_BYTES:
                out.append((rel, size))
    return sorted(out)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.exclude = tuple(x for x in options.get("exclude", "").split(",") if x)
        self.size = int(options.get("partitionBytes", 8 << 20))
        self.listed = [x for x in options.get("files", "").split(",") if x]

    def partitions(self) -> list[_Part]:
        files = [(p, 0) for p in self.listed if wanted(os.path.basename(p))] if self.listed else walk(self.root, self.exclude)
        parts, now, size = [], [], 0
        for p, n in files:
            now.append(p)
            size += n
            if size >= self.size:
                parts.append(_Part(now))
                now, size = [], 0
        return [*parts, _Part(now)] if now or not parts else parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        for p in partition.paths:
            full = self.root if p == "." else os.path.join(self.root, p)
            try:
                with open(full, "rb") as f:
                    raw = f.read()
            except OSError:
                raw = b""
            name = os.path.basename(full)
            yield p, name, os.path.splitext(name)[1].lower(), len(raw), raw.decode("utf-8", "replace")


class SourceTree(DataSource):
    """``spark.read.format("srctree").option("exclude", "docs,*.md").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), files: tuple[str, ...] = ()) -> DataFrame:
    """The files of a tree, or the listed ones of it (without size or folder filter). Undecodable bytes are replaced."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("srctree").option("exclude", ",".join(exclude)).option("files", ",".join(files)).load(root)
