"""Sources: folders, whole books, EPUB archives, JSON lines, search payloads."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import ids
from quillspan.functions import text as fx
from quillspan.operators import parse

SUFFIXES = ("txt", "html", "htm", "xhtml")
#: Bytes that one member of an archive, and all of them, may unpack to.
MEMBER_BYTES, TOTAL_BYTES = 10_000_000, 200_000_000


def directory_manifest(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files of a folder in natural order: ``ordinal, relative_path, byte_length, artifact_id``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    base = path.rstrip("/") + "/"
    rel = F.element_at(F.split("path", base, 2), -1)
    m = raw.select(rel.alias("relative_path"), F.col("length").alias("byte_length"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("artifact_id"))
    from quillspan.operators.rank import numbered

    return numbered(m, [fx.natural_key(F.col("relative_path")), F.col("relative_path")], "ordinal")


def read_directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Chapter files of a folder: ``ordinal, relative_path, media_type, declared_number, content``, natural order."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    base = path.rstrip("/") + "/"
    rel = F.element_at(F.split("path", base, 2), -1)
    f = raw.where(suffix.isin(*SUFFIXES)).select(rel.alias("relative_path"), F.when(suffix == "txt", "text/plain").otherwise("text/html").alias("media_type"), "content")
    stem = F.regexp_replace(F.regexp_extract("relative_path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    f = f.withColumn("declared_number", fx.directory_number(stem))
    from quillspan.operators.rank import numbered

    return numbered(f, [fx.natural_key(F.col("relative_path")), F.col("relative_path")], "ordinal")


def read_books(spark: SparkSession, path: str, heading: str = parse.HEADING) -> DataFrame:
    """Chapters of whole-book text files: decoded by detection, cut at headings. Undecodable files give no chapter."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), "content")
    t = parse.decoded(raw, "book", "content").where("text is not null")
    return parse.chapters(t, "book", "text", heading)


EPUB = "book string, ordinal int, member string, title string, properties string, content binary, error string, work_title string, creator string, language string"
_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}


class BadArchive(ValueError):
    pass


def _member(z: zipfile.ZipFile, name: str, budget: list[int]) -> bytes:
    if name.startswith("/") or ".." in name.split("/"):
        raise BadArchive("path outside the archive")
    try:
        info = z.getinfo(name)
    except KeyError:
        raise BadArchive("missing member") from None
    if info.file_size > MEMBER_BYTES:
        raise BadArchive("member too large")
    with z.open(info) as f:
        data = f.read(MEMBER_BYTES + 1)
    budget[0] -= len(data)
    if len(data) > MEMBER_BYTES or budget[0] < 0:
        raise BadArchive("archive too large")
    return data


def epub_rows(book: str, content: bytes) -> list[tuple]:
    """Spine items of an archive in reading order; one row with an error where it cannot be read."""
    try:
        budget = [TOTAL_BYTES]
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            container = ElementTree.fromstring(_member(z, "META-INF/container.xml", budget))
            root = container.find(".//c:rootfile", _NS)
            if root is None or not root.get("full-path"):
                raise BadArchive("no package")
            package_path = root.get("full-path")
            package = ElementTree.fromstring(_member(z, package_path, budget))
            folder = posixpath.dirname(package_path)
            items = {i.get("id"): i for i in package.findall(".//o:manifest/o:item", _NS)}
            said = lambda tag: next((x.text.strip() for x in package.findall(f".//d:{tag}", _NS) if x.text and x.text.strip()), None)
            about = (said("title"), said("creator"), said("language"))
            rows = []
            for ref in package.findall(".//o:spine/o:itemref", _NS):
                item = items.get(ref.get("idref"))
                if item is None or not item.get("href"):
                    raise BadArchive("broken spine")
                if item.get("media-type") not in ("application/xhtml+xml", "text/html"):
                    continue
                name = posixpath.normpath(posixpath.join(folder, unquote(item.get("href").split("#", 1)[0])))
                data = _member(z, name, budget)
                rows.append((book, len(rows) + 1, name, None, item.get("properties"), data, None, *about))
            return rows
    except (BadArchive, zipfile.BadZipFile, ElementTree.ParseError) as err:
        return [(book, None, None, None, None, None, str(err) or type(err).__name__, None, None, None)]


def read_epub(archives: DataFrame, book: str = "book", content: str = "content") -> DataFrame:
    """Documents of EPUB archives in spine order, with title, number and kind of each chapter; broken archives give one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for b, c in zip(pdf[book], pdf[content]) if c is not None for r in epub_rows(b, bytes(c))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EPUB.split(", ")])

    e = archives.select(book, content).mapInPandas(run, EPUB)
    title = F.coalesce(parse.html_title(F.col("content").cast("string")), F.regexp_extract("member", r"([^/]+)$", 1))
    e = e.withColumn("title", F.when(F.col("error").isNull(), title)).withColumn("declared_number", fx.chapter_number(F.col("title")))
    return e.withColumn("chapter_kind", F.when(F.col("error").isNull(), fx.chapter_kind(F.col("title"), F.col("declared_number"), F.split(F.coalesce("properties", F.lit("")), " "))))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON lines: ``line_no_hint, value, problem``; blank lines, repeated keys and NaN or Infinity are problems."""
    raw = spark.read.text(path)
    s = raw.select("value", ids.strict_json(F.col("value")).alias("_s"))
    bad = F.when(F.trim("value") == "", "blank").when(~F.col("_s.is_valid"), F.col("_s.problem")).when(~F.col("_s.is_object"), "no object")
    return s.select(F.col("value").alias("line"), F.when(bad.isNull(), F.from_json("value", schema)).alias("record"), bad.alias("problem"))


def search_hits(payloads: DataFrame, key: list[str], payload: str, page: str | None = None, limit: int | None = None) -> DataFrame:
    """Ranked hits of four-array search payloads ``[query, titles, snippets, urls]``.

    Payloads with arrays of unequal length give no hit. ``rank`` counts from
    1; ``global_rank`` adds the pages before when page and limit are given.
    """
    arr = F.from_json(F.col(payload), "array<string>")
    arrays = [F.from_json(F.get(arr, i), "array<string>").alias(n) for i, n in ((1, "titles"), (2, "snippets"), (3, "urls"))]
    p = payloads.select(*key, *([page] if page else []), *arrays).where("size(titles) = size(snippets) and size(titles) = size(urls)")
    h = p.select(*key, *([page] if page else []), F.posexplode(F.arrays_zip("titles", "snippets", "urls")).alias("_i", "_z"))
    rank = F.col("_i") + 1
    h = h.withColumn("rank", rank).withColumn("global_rank", (F.col(page) - 1) * limit + rank if page and limit else rank)
    return h.select(*key, *([page] if page else []), "rank", "global_rank", F.col("_z.titles").alias("title"), F.col("_z.snippets").alias("snippet"), F.col("_z.urls").alias("url"))


_READERS: dict[str, Callable] = {"txt": read_books, "directory": read_directory, "chapter-directory": read_directory}


def reader(kind: str) -> Callable:
    """Reader of a kind of source (letter case does not count)."""
    k = kind.casefold()
    if k == "epub":
        return lambda spark, path: read_epub(spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), "content"))
    if k not in _READERS:
        raise ValueError(f"unknown kind of source: {kind}")
    return _READERS[k]


def per_key_order(df: DataFrame, group: str, key: str) -> DataFrame:
    """Numbers the rows of a group in natural order of a key."""
    return df.withColumn("ordinal", F.row_number().over(W.partitionBy(group).orderBy(fx.natural_key(F.col(key)), key)))
