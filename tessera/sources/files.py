"""Readers of files: gold and result documents, LaTeX and PDF sources, archives, pages and feeds.

Each reader is a DataFrame source with an explicit schema, so columns are pruned
and nothing is inferred. Parsers of binary formats are functions the caller gives:
``bytes -> list of page texts``.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, IntegerType, StringType, StructType

from tessera import schemas
from tessera.functions import text as T

Parser = Callable[[bytes], list[str]]
CORRUPT = "_corrupt_record"
MODES = ("markdown", "html")


def _json(spark: SparkSession, paths: str | list[str], kind: StructType, mode: str = "PERMISSIVE") -> DataFrame:
    read = spark.read.schema(kind).option("multiLine", True).option("mode", mode).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return read.json(paths).withColumn("path", F.col("_metadata.file_path"))


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    """``<folder>/<schema>/<split>/<name>.json`` as ``(schema_name, split, path, metadata, annotations_from_paper)``.

    ``Language`` may be a text or a list; a list goes to ``Languages``. Broken files are dropped.
    """
    kind = StructType([f for f in schemas.record_schema() if f.name != "Languages"]).add("annotations_from_paper", MapType(StringType(), IntegerType()))
    rows = _json(spark, folder, kind, "DROPMALFORMED")
    return _with_parts(rows).select("schema_name", "split", "path", record_column().alias("metadata"), "annotations_from_paper")


def _with_parts(rows: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return rows.withColumns({"schema_name": F.try_element_at(parts, F.lit(-3)), "split": F.try_element_at(parts, F.lit(-2))})


def record_column():
    """The superset record of flat columns: a ``Language`` that holds a list moves to ``Languages``."""
    listed = F.col("Language").startswith("[")
    items = []
    for name in schemas.RECORD_FIELDS:
        c = F.col(schemas.quoted(name)) if name != "Languages" else F.when(listed, F.from_json("Language", "array<string>"))
        items.append((F.when(~listed, c) if name == "Language" else c).alias(name))
    return F.struct(*items)


def read_results(spark: SparkSession, folder: str, sets: str | list[str] | None = None, keep_broken: bool = False) -> DataFrame:
    """``<folder>/<set>/<paper>/(zero_shot|few_shot/<k>)/<model>-results.json`` with the columns of its path.

    ``sets`` names one or several result sets, else all are read; zero-shot and few-shot files alike. Broken files have a
    null record, or, without ``keep_broken``, are left out. A null ``error`` is success.
    """
    base = folder.rstrip("/")
    names = [sets] if isinstance(sets, str) else sets
    paths = [f"{base}/{n}" for n in names] if names else base
    inner = StructType([f for f in schemas.record_schema() if f.name != "Languages"])
    kind = StructType([f if f.name != "metadata" else f.__class__("metadata", inner) for f in schemas.result_schema()]).add(CORRUPT, StringType())
    rows = _json(spark, paths, kind)
    listed = F.col("metadata.Language").startswith("[")
    moved = F.struct(*(
        (F.when(listed, F.from_json("metadata.Language", "array<string>")) if n == "Languages" else F.when(~listed, schemas.field("metadata", n)) if n == "Language" else schemas.field("metadata", n)).alias(n)
        for n in schemas.RECORD_FIELDS
    ))
    rows = rows.withColumn("metadata", F.when(F.col("metadata").isNotNull(), moved))
    at = F.regexp_extract
    path = F.col("path")
    shape = r"/([^/]+)/([^/]+)/(?:zero_shot|few_shot/(\d+))/([^/]+)-results\.json$"
    rows = rows.withColumns({"result_set": at(path, shape, 1), "paper_id": F.replace(F.replace(at(path, shape, 2), F.lit("_arXiv"), F.lit("")), F.lit(".pdf"), F.lit("")), "shot": F.coalesce(at(path, shape, 3).try_cast("int"), F.lit(0)), "model": at(path, shape, 4)})
    rows = rows.where("result_set <> ''").withColumn("is_browsing", F.col("model").contains(T.BROWSING))
    return (rows if keep_broken else rows.where(F.col(CORRUPT).isNull())).drop(CORRUPT)


def read_latex(spark: SparkSession, folder: str) -> DataFrame:
    """``(paper, text, n_files)``: the ``.tex`` files of each folder under ``folder``, joined without a separator in the order of their paths.

    The group of a paper is its own source folder, a few files.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").option("wholetext", True).text(folder).withColumn("path", F.col("_metadata.file_path"))
    base = folder.rstrip("/") + "/"
    paper = F.substring_index(F.substring_index(F.col("path"), base, -1), "/", 1)
    parts = F.array_sort(F.collect_list(F.struct("path", "value")))
    return files.groupBy(paper.alias("paper")).agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("text"), F.count("*").alias("n_files"))


def read_binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def parse_pages(files: DataFrame, parser: Parser, separator: str = " ", max_pages: int | None = None) -> DataFrame:
    """``(path, text)``: the page texts of each file joined; a file that the parser can't read has an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    pages = parser(bytes(content))
                    texts.append(separator.join(p or "" for p in pages[:max_pages]))
                except Exception:  # noqa: BLE001 - any parser, any error
                    texts.append("")
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def parse_layout(files: DataFrame, parser: Callable[[bytes, str], str], mode: str = "markdown", cached: DataFrame | None = None) -> DataFrame:
    """``(path, text)`` by a layout parser in ``markdown`` or ``html``; files in ``cached`` ``(path, text)`` are not parsed again."""
    if mode not in MODES:
        raise ValueError(f"unknown output mode: {mode}")
    todo = files if cached is None else files.join(cached.select("path"), "path", "left_anti")
    made = parse_pages(todo, lambda content: [parser(content, mode)], "")
    return made if cached is None else made.unionByName(cached.select("path", "text"))


def sniff(files: DataFrame) -> DataFrame:
    """``(path, file_type)`` by signature."""
    return files.select("path", T.file_type(F.col("content")).alias("file_type"))


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular members of an archive whose path stays inside it; a plain gzip is one file."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
            for member in tar:
                parts = member.name.split("/")
                if member.isfile() and not member.name.startswith("/") and ".." not in parts:
                    yield member.name, tar.extractfile(member).read()
    except tarfile.ReadError:
        if content[:2] == b"\x1f\x8b":
            yield "source.tex", gzip.decompress(content)
        elif content[:4] == b"%PDF":
            yield "source.pdf", content
        else:
            yield "source.tex", content


def extract_archives(files: DataFrame) -> DataFrame:
    """``(path, member, content)``: what the archives hold; members that point outside are skipped, broken archives give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = list(_members(bytes(content)))
                except (OSError, EOFError, tarfile.TarError):
                    continue
                if found:
                    yield pd.DataFrame({"path": path, "member": [n for n, _ in found], "content": [c for _, c in found]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def fetch(links: DataFrame, fetcher: Callable[[str], bytes | None], link: str = "link") -> DataFrame:
    """``(link, content)`` by a function of the caller; null where it fails. Nothing here opens a connection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["link"]:
                try:
                    out.append(None if x is None else fetcher(x))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({"link": batch["link"], "content": out})

    return links.select(F.col(link).alias("link")).distinct().mapInPandas(run, "link string, content binary")


def repository_readme(links: DataFrame, fetcher: Callable[[str], bytes | None], link: str = "link") -> DataFrame:
    """``(link, kind, readme)``: the raw description of a hub or git repository, or the text of a page."""
    got = fetch(links, fetcher, link)
    kind, body = T.repository_kind(F.col("link")), F.try_validate_utf8("content")
    return got.select("link", kind.alias("kind"), F.when(kind == "page", T.page_text(body)).otherwise(body).alias("readme"))


def read_feed(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """The first entry of each Atom document: ``title``, ``authors``, ``year`` and ``summary``; null for broken ones."""
    kind = "entry struct<title: string, published: string, summary: string, author: array<struct<name: string>>>"
    e = F.from_xml(F.col(xml), kind, {"mode": "PERMISSIVE"})["entry"]
    return feeds.withColumn("_e", e).select(*feeds.columns, F.col("_e.title").alias("title"), F.transform("_e.author", lambda a: a["name"]).alias("authors"), F.substring("_e.published", 1, 4).try_cast("int").alias("year"), F.col("_e.summary").alias("summary"))


def timed_extraction(texts: DataFrame, methods: dict[str, Callable[[str], str]], key: str = "paper_id", text: str = "text") -> DataFrame:
    """``(key, method, n_chars, seconds)``: each method on each text, timed; a method that fails has no characters but keeps its time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                for name, method in methods.items():
                    began, n = time.perf_counter(), 0
                    try:
                        n = len(method(t or ""))
                    except Exception:  # noqa: BLE001
                        n = 0
                    rows.append((k, name, n, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=[key, "method", "n_chars", "seconds"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, method string, n_chars long, seconds double")
