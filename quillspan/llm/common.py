"""Shared pieces of the text operators: tables, decoding, readable text, shingles.

Everything in this module runs either as a column expression or inside an
Arrow batch on an executor; nothing here collects rows to the driver.
"""

from __future__ import annotations

import html
import json
import os
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
NEAR_COPY_SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; only local masters have a default."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = os.path.abspath("spark-warehouse/_checkpoints")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions of heavy stages: the session's shuffle partitions, at least one for every core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a few input splits over all cores before Python-heavy work.

    Parquet inputs of a few megabytes arrive as one or two splits; the row
    payload is shuffled once (round robin or by key) so every core works.
    """
    n = parallelism(df.sparkSession)
    return df.repartition(n, *keys) if keys else df.repartition(n)


# ---------------------------------------------------------------- decoding

_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
# Charset labels that servers write, and the codec that reads them.
_CODEC = {
    "gb2312": "gb18030",
    "gbk": "gb18030",
    "x-gbk": "gb18030",
    "iso-8859-1": "latin-1",
    "latin1": "latin-1",
    "utf8": "utf-8",
    "big5-hkscs": "big5hkscs",
    "windows-1252": "cp1252",
    "windows-1251": "cp1251",
}


def declared_codec(content_type: str | None) -> str:
    """Codec named by a content type; UTF-8 when none (or an unknown one) is named."""
    m = _CHARSET.search(content_type or "")
    name = m.group(1).lower() if m else "utf-8"
    name = _CODEC.get(name, name)
    try:
        "".encode(name)
    except LookupError:
        return "utf-8"
    return name


def decode_declared(body: bytes | None, content_type: str | None) -> tuple[str, bool]:
    """(text as declared, whether the bytes end inside a character)."""
    if not body:
        return "", False
    import codecs

    codec = declared_codec(content_type)
    dec = codecs.getincrementaldecoder(codec)("replace")
    text = dec.decode(body, False)
    state = dec.getstate()[0]
    tail = dec.decode(b"", True)
    return text + tail, bool(state)


def decode_best(body: bytes | None, content_type: str | None) -> tuple[str, bool]:
    """UTF-8 when the bytes are valid UTF-8 up to a cut end, else as declared."""
    if not body:
        return "", False
    for back in range(4):
        part = body[: len(body) - back] if back else body
        try:
            return part.decode("utf-8") + ("�" if back else ""), back > 0
        except UnicodeDecodeError as err:
            if err.start < len(body) - 4:
                break
    return decode_declared(body, content_type)


# ------------------------------------------------------------ readable text

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>|<meta\b[^>]*>", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|mark|q|ruby|rb|rt|rp|s|small|strong|sub|sup|tt|u|wbr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_CUT_TAG = re.compile(r"<(?:[/!?a-zA-Z][^<>]*)?\Z")
_BLANKS = re.compile(r"[^\S\n]+")


_PAGE = re.compile("[\ufeff \t\r\n]*<[!?a-zA-Z]")


def is_markup(text: str) -> bool:
    return bool(_PAGE.match(text))


def _json_strings(value, out: list[str]) -> None:
    if isinstance(value, str):
        out.extend(value.split("\n"))
    elif isinstance(value, list):
        for v in value:
            _json_strings(v, out)
    elif isinstance(value, dict):
        for v in value.values():
            _json_strings(v, out)


def passages(text: str) -> list[str]:
    """Readable passages of a body: text blocks of a page, values of JSON, lines of plain text.

    Scripts, styles, comments and ``noscript`` are not readable. Inline tags
    join their text; every other tag ends a passage. Empty passages are left out.
    """
    if not text:
        return []
    if is_markup(text):
        t = _HIDDEN.sub("\n", text)
        t = _INLINE.sub("", t)
        t = _CUT_TAG.sub("", _TAG.sub("\n", t))
        lines = html.unescape(t).split("\n")
    else:
        head = text.lstrip("﻿ \t\r\n")[:1]
        lines = None
        if head in "{[":
            try:
                lines = []
                _json_strings(json.loads(text), lines)
            except ValueError:
                lines = None
        if lines is None:
            lines = text.split("\n")
    out = []
    for ln in lines:
        s = _BLANKS.sub(" ", ln).strip()
        if s:
            out.append(s)
    return out


# ------------------------------------------------------------ word shingles

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Per BMP code point: 0 separator, 1 part of a word, 2 a word of its own (ideograph, kana, hangul)."""
    global _CLASS
    if _CLASS is None:
        t = np.zeros(65536, np.uint8)
        for c in range(65536):
            if not 0xD800 <= c <= 0xDFFF and chr(c).isalnum():
                t[c] = 1
        for a, b in ((0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF)):
            t[a : b + 1] = 2
        _CLASS = t
    return _CLASS


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiply-xorshift hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and each text's start (one more entry than texts)."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def slices(sizes: list[int], most: int = 400_000) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` characters together (a longer text stands alone), so that arrays over characters stay small."""
    out, lo, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            out.append((lo, i))
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        out.append((lo, len(sizes)))
    return out


_TABLES: dict[str, np.ndarray] = {}


def per_char(cp: np.ndarray, name: str, value) -> np.ndarray:
    """``value(character)`` of every code point as int8, from a table over the basic plane that is made once under ``name``."""
    t = _TABLES.get(name)
    if t is None:
        t = _TABLES[name] = np.fromiter((value(chr(c)) for c in range(65536)), np.int8, 65536)
    out = t[np.minimum(cp, 65535)]
    far = np.flatnonzero(cp > 65535)
    if len(far):
        u, at = np.unique(cp[far], return_inverse=True)
        out[far] = np.fromiter((value(chr(c)) for c in u), np.int8, len(u))[at]
    return out


def letter_counts(texts: list[str]) -> np.ndarray:
    """Letters of each text; ideographs and what follows them in Unicode count two."""
    cp, starts = code_points(texts)
    upto = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(per_char(cp, "letters", lambda c: (2 if c > "⺀" else 1) * c.isalpha()), out=upto[1:])
    return upto[starts[1:]] - upto[starts[:-1]]


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A materialised table of at most ``most`` rows as a broadcast side of a join; a larger one as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def word_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text in order, and the index of the text each word belongs to."""
    cp, starts = code_points([t.lower() for t in texts])
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    small = np.minimum(cp, 65535)
    cls = _classes()[small]
    cls[cp > 65535] = 0
    cls[(cp >= 0x20000) & (cp < 0x40000)] = 2
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    begin = cls == 2
    word = cls == 1
    new = word.copy()
    new[1:] &= (cls[:-1] != 1) | (owner[1:] != owner[:-1])
    begin |= new
    keep = np.flatnonzero(cls)
    if not len(keep):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = begin[keep]
    first = np.flatnonzero(b)
    tok = np.cumsum(b) - 1
    pos = np.arange(len(keep)) - first[tok]
    h = mix64(cp[keep].astype(np.uint64) + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.add.reduceat(h, first), owner[keep][first]


def shingles(texts: list[str], n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words, with the index of the text of each run.

    A text of fewer than n words has none.
    """
    h, owner = word_tokens(texts)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x100000001B3) + h[j : j + m]
    ok = owner[:m] == owner[n - 1 :]
    return mix64(acc[ok]), owner[:m][ok]


# ------------------------------------------------------------ column helpers

def latest(df: DataFrame, key: str, *payload: str) -> DataFrame:
    """One row per key: repeated rows count once. Ties resolve to the smallest payload."""
    return df.groupBy(key).agg(F.min(F.struct(*payload)).alias("_p")).select(key, "_p.*")


def bucket_of(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n))
