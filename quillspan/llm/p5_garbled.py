"""Problem 5: text decoded with the wrong character encoding.

Method: every candidate decoding of a passage (the bytes read with another
codec, or the text written back and read again, up to two steps) is compressed
with zstandard dictionaries of the corpus languages. The chain with the least
description length, its own cost included, wins; otherwise the passage stays.
Runs inside a passage that alone can be read otherwise are tried too, their
saving measured against the run in its context.

The dictionaries are trained on a bounded sample of labelled documents
(``DICT_DOCS`` per language); all bodies are read whole, passage by passage.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import declared_codec, decode_declared, fan_out, table

#: Labelled documents per language that a dictionary is trained on, and its size in bytes.
DICT_DOCS = 250
DICT_BYTES = 48_000
#: Bytes that one step of a chain adds to its description.
STEP_COST = 3
#: A passage changes when the chain saves at least this share of its own description.
MIN_SAVING = 0.08

#: Characters of passages, with their bytes and results, that a worker remembers at once.
MEMO_CHARS = 16_000_000

#: Codecs that servers and editors confuse.
CODECS = ("utf-8", "gb18030", "big5hkscs", "cp1252", "latin-1", "cp1251", "mac_roman")
#: Codecs that text is written back with, and those it is then read as.
WRITE = ("cp1252", "latin-1", "gb18030", "big5hkscs", "cp1251", "mac_roman")
READ = ("utf-8", "gb18030", "big5hkscs")

# None of these bytes is part of a longer character in any of the codecs.
_CUT = re.compile(rb"([<>\n\r\"])")
_LOST = "�"


def train_dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, bytes]:
    """One zstandard dictionary per language, from at most ``DICT_DOCS`` documents each.

    A document's language is that of its source; documents without one are
    not used. The sample is the documents with the lowest hash of their id.
    """
    src = table(spark, sf_dir, "novel_source").where("source_lang is not null").groupBy(F.col("platform_id").alias("source")).agg(F.min("source_lang").alias("language"))
    docs = table(spark, sf_dir, "documents").where("text is not null").join(F.broadcast(src), "source")
    # Only ids are ranked; the sample's texts are then read whole.
    from pyspark.sql import Window

    w = Window.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = docs.select("language", "doc_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= DICT_DOCS)
    rows = docs.select("language", "doc_id", "text").join(F.broadcast(picked), ["language", "doc_id"]).orderBy("language", "k").collect()
    by: dict[str, list[bytes]] = {}
    for r in rows:
        for ln in r.text.split("\n"):
            if ln.strip():
                by.setdefault(r.language, []).append(ln.encode())
    out = {}
    for lang, parts in by.items():
        raw = b"\n".join(parts)
        try:
            d = zstandard.train_dictionary(min(DICT_BYTES, max(1024, len(raw) // 4)), parts)
            # A trained table of common strings, followed by plain text, serves short passages best.
            out[lang] = d.as_bytes()
        except zstandard.ZstdError:
            out[lang] = raw[-DICT_BYTES:]
    return out


class Describer:
    """Description length of text in bytes under the best of the languages that share its script."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.by = {}
        for lang, raw in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=3)
            self.by[lang] = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.wide = [v for k, v in self.by.items() if k.startswith(("zh", "ja", "ko"))] or list(self.by.values())
        self.narrow = [v for k, v in self.by.items() if not k.startswith(("zh", "ja", "ko"))] or list(self.by.values())
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    def cost(self, text: str) -> int:
        b = text.encode("utf-8", "surrogatepass")
        # One thing that compression cannot see: characters that text never holds.
        odd = sum(1 for c in text if c == _LOST or "\x80" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff")
        use = self.wide if any("⺀" <= c <= "鿿" for c in text) else self.narrow
        return min((len(c.compress(b)) for c in use), default=len(self.plain.compress(b))) + 2 * odd


def _strict(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except (UnicodeDecodeError, LookupError):
        return None


def _tolerant(data: bytes, codec: str) -> str | None:
    """Decoding that may lose a little: at most one character in three, so a damaged passage still comes back."""
    t = data.decode(codec, "replace")
    return t if t.count(_LOST) * 3 <= len(t) else None


@lru_cache(maxsize=4)
def _sloppy_table(codec: str) -> dict[int, int]:
    """Code points to bytes: a single-byte codec whose undefined bytes stand for themselves, as in browsers."""
    t = {}
    for b in range(256):
        try:
            t[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            t[b] = b
    return t


def _write_back(text: str, codec: str) -> bytes | None:
    """The bytes that would have been read as this text; lost characters become a byte that no codec accepts."""
    if codec in ("cp1252", "cp1251", "mac_roman"):
        t = _sloppy_table(codec)
        out = bytearray()
        for c in text:
            if c == _LOST:
                out.append(0xFF)
            elif (b := t.get(ord(c))) is None:
                return None
            else:
                out.append(b)
        return bytes(out)
    try:
        return b"\xff".join(p.encode(codec) for p in text.split(_LOST))
    except UnicodeEncodeError:
        return None


_NON_ASCII = re.compile(r"[^\x00-\x7f]+(?:[^\x00-\x7f]|[ -~](?=[^\x00-\x7f]))*")

# Characters of more than one byte in UTF-8, each byte shown as the character of its number.
_MULTIBYTE = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
# What short repairs may bring back, so that two letters of a text do not pass for one of a script that it never holds.
_PLAUSIBLE = re.compile("[\x00-\x7f\xa0-\xffŒœŠšŽžŸ\u200b-\u200f\u2010-\u2044\u20ac\u2122\ufeff\u3000-\u30ff\u3400-\u9fff\uff01-\uff5e]+")
# Bytes that are no UTF-8 (as lone surrogates) with the short characters that such bytes form by chance.
_BROKEN = re.compile("[\x80-\u07ff]*[\udc80-\udcff](?:[\x80-\u07ff\udc80-\udcff]|[@-~](?=[\udc80-\udcff]))*")


@lru_cache(maxsize=8)
def _as_bytes(codec: str) -> dict[int, str]:
    """Translation of text to the characters of its bytes' numbers."""
    if codec == "latin-1":
        return {c: chr(c) for c in range(256)}
    return {c: chr(b) for c, b in _sloppy_table(codec).items()}


def runs_of(text: str, data: bytes | None, declared: str) -> list[tuple[str, str, str]]:
    """(chain, text, rest) of every repair of single runs: the runs repaired, and the text without them; nothing is lost in one."""
    out: dict[str, tuple[str, str]] = {}
    for w in ("cp1252", "latin-1", "cp1251", "mac_roman"):
        t = _as_bytes(w)
        shown = "".join(t.get(ord(c), "\u0100") for c in text)
        _add_run(out, f"{w}>utf-8", text, [(m.span(), _strict(m.group().encode("latin-1"), "utf-8")) for m in _MULTIBYTE.finditer(shown)])
        for r in ("gb18030", "big5hkscs"):
            # Two letters can pass for an ideograph: only runs that hold nothing but such letters.
            _add_run(out, f"{w}>{r}", text, [(m.span(), _strict(m.group().encode("latin-1"), r)) for m in re.finditer("[\x81-\xfe]{4,}", shown)])
    for w in ("gb18030", "big5hkscs"):
        got = [(m.span(), _strict(raw, "utf-8") if (raw := _write_back(m.group(), w)) is not None else None) for m in _NON_ASCII.finditer(text)]
        _add_run(out, f"{w}>utf-8", text, got)
    found = [(k, t, rest) for k, (t, rest) in out.items()]
    if data is not None and declared == "utf-8" and _LOST in text:
        raw = data.decode("utf-8", "surrogateescape")
        # A single broken character at a cut end is no garble.
        broken = [m for m in _BROKEN.finditer(raw) if m.end() < len(raw.rstrip()) or len(m.group()) > 3]
        for r in CODECS[1:]:
            out = {}
            _add_run(out, r, raw, [(m.span(), _strict(m.group().encode("utf-8", "surrogateescape"), r)) for m in broken])
            for k, (t, rest) in out.items():
                found.append((k, t.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), rest.encode("utf-8", "surrogateescape").decode("utf-8", "replace")))
    return found


def _add_run(out: dict, chain: str, text: str, got: list) -> None:
    """Add the text with the runs of ``got`` that could be read and are plausible."""
    new, rest, at = [], [], 0
    for (lo, hi), u in got:
        if u is None or not _PLAUSIBLE.fullmatch(u) or u == text[lo:hi]:
            continue
        new += [text[at:lo], u]
        rest.append(text[at:lo])
        at = hi
    if at:
        out[chain] = ("".join(new) + text[at:], "".join(rest) + text[at:])


def chains_of(text: str, data: bytes | None, declared: str) -> list[tuple[str, str]]:
    """(chain, text) of every candidate that can be carried out; the text as declared is not among them."""
    out: dict[str, str] = {}
    if data is not None:
        # Bytes that are well-formed UTF-8 were written as UTF-8, losses included.
        for codec in ("utf-8",) if _strict(data, "utf-8") is not None else CODECS:
            if codec != declared:
                t = _strict(data, codec) if codec in ("cp1252", "latin-1", "cp1251", "mac_roman") else _tolerant(data, codec)
                if t is not None and t != text:
                    out[codec] = t
    seen = {text}
    level = [("", text)] + ([(k, v) for k, v in out.items() if k in ("utf-8",)])
    for depth in range(2):
        nxt = []
        for name, t in level:
            for w in WRITE:
                raw = _write_back(t, w)
                if raw is None:
                    continue
                for r in READ:
                    if r == w:
                        continue
                    u = _tolerant(raw, r)
                    if u is None or u in seen or len(u) > len(t):
                        continue
                    seen.add(u)
                    label = f"{name}>{w}>{r}" if name else f"{w}>{r}"
                    out[label] = u
                    nxt.append((label, u))
        # A second step only follows a first one that left single-byte letters behind.
        level = [(n, t) for n, t in nxt if any("\x80" <= c <= "ÿ" or c in "‚„…†‡ˆ‰‹›•–—˜™šœžŸŒŽŠ“”‘’€ƒ" for c in t)]
        if not level:
            break
    return list(out.items())


def chain_steps(chain: str) -> int:
    return chain.count(">") or 1


def likely_text(text: str, data: bytes | None, declared: str) -> str:
    """The candidate with the fewest characters that text never holds, then the shortest; needs no dictionary."""

    def oddness(t: str) -> tuple[int, int]:
        return sum(1 for c in t if c == _LOST or "\x80" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff" or c in "ÃÂ¤¥¦§¨©¬"), len(t)

    return min([text, *(t for _, t in chains_of(text, data, declared))], key=oddness)


class Repairer:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.describe = Describer(dictionaries)
        self.memo: dict = {}
        self.held = 0

    def passage(self, text: str, data: bytes | None, declared: str) -> tuple[str, str, int, int]:
        """(chain, text, description as declared, description of the choice) of one passage."""
        key = (text, data, declared)
        if (hit := self.memo.get(key)) is not None:
            return hit
        cands = chains_of(text, data, declared)
        own = self.describe.cost(text) if cands else 0
        best = ("", text, own)
        for chain, t in cands:
            c = self.describe.cost(t) + STEP_COST * chain_steps(chain)
            if c < best[2] and own - c >= MIN_SAVING * own:
                best = (chain, t, c)
        r = (best[0], best[1], own, best[2])
        # What is garbled in places only: the saving counts against the runs in their context. Repairs shorten a text, so they end.
        raw = data if not best[0] else None
        while runs := runs_of(r[1], raw, declared):
            now = self.describe.cost(r[1])
            best = ("", r[1], now)
            for chain, t, rest in runs:
                c = self.describe.cost(t) + STEP_COST * chain_steps(chain)
                if c < best[2] and now - c >= MIN_SAVING * (now - self.describe.cost(rest)):
                    best = (chain, t, c)
            if not best[0] or len(best[1].encode("utf-8", "replace")) >= len(r[1].encode("utf-8", "replace")):
                break
            r = (",".join(filter(None, (r[0], best[0]))), best[1], own or now, best[2])
            raw = None
        self.held += 4 * len(text)
        if self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        self.memo[key] = r
        return r

    def body(self, body: bytes, content_type: str | None) -> tuple[bool, bool, str, str]:
        """(is garbled, is wholly restored, restored text, chains used) of a body as its type declares it."""
        declared = declared_codec(content_type)
        whole, cut = decode_declared(body, content_type)
        parts = _CUT.split(body)
        texts, chains = [], []
        ends = whole.rstrip()
        for p in parts:
            if p.isascii():
                texts.append(p.decode("ascii"))
                chains.append("")
                continue
            chain, t, _, _ = self.passage(p.decode(declared, "replace"), p, declared)
            texts.append(t)
            chains.append(chain)
        text = "".join(texts)
        if "\\u" in text:
            text, more = self._escaped(text)
            chains += more
        used = sorted({k for c in chains if c for k in c.split(",")})
        lost_as_declared = whole.count(_LOST) - (1 if ends.endswith(_LOST) or cut else 0)
        if ends.endswith(_LOST + _LOST) or (cut and lost_as_declared <= 2 and whole.rstrip(_LOST).count(_LOST) == 0):
            lost_as_declared = whole.rstrip().rstrip(_LOST).count(_LOST)
        garbled = bool(used) or lost_as_declared > 0
        lost = text.rstrip().rstrip(_LOST).count(_LOST)
        return garbled, garbled and lost == 0, text if garbled else whole, ",".join(used)

    def _escaped(self, text: str) -> tuple[str, list[str]]:
        """JSON whose characters are escaped: its string values are judged as passages and written back."""
        used: list[str] = []

        def fix(v):
            if isinstance(v, str):
                out = []
                for ln in v.split("\n"):
                    if ln.isascii():
                        out.append(ln)
                        continue
                    chain, t, _, _ = self.passage(ln, None, "utf-8")
                    if chain:
                        used.append(chain)
                    out.append(t)
                return "\n".join(out)
            if isinstance(v, list):
                return [fix(x) for x in v]
            if isinstance(v, dict):
                return {k: fix(x) for k, x in v.items()}
            return v

        try:
            value = json.loads(text)
        except ValueError:
            return text, used
        fixed = fix(value)
        return (json.dumps(fixed), used) if used else (text, used)


REPAIRED = "retrieval_id string, is_garbled boolean, is_restored boolean, chains string, original_text string"


def repair_bodies(responses: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``retrieval_id, is_garbled, is_restored, chains, original_text`` of every response with a body.

    Null and empty bodies are left out; repeated rows count once. The
    dictionaries are broadcast; each is at most ``DICT_BYTES``, one a language.
    """
    shared = responses.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Repairer(shared.value)
        for pdf in batches:
            got = [r.body(b, c) for b, c in zip(pdf.body, pdf.content_type)]
            yield pd.DataFrame({"retrieval_id": pdf.retrieval_id, "is_garbled": [g[0] for g in got], "is_restored": [g[1] for g in got], "chains": [g[3] for g in got], "original_text": [g[2] for g in got]})

    one = responses.where("retrieval_id is not null and body is not null and octet_length(body) > 0").groupBy("retrieval_id").agg(F.min(F.struct("body", "content_type")).alias("b")).select("retrieval_id", "b.*")
    return fan_out(one, "retrieval_id").mapInPandas(run, REPAIRED)


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled responses with the chain that restores them and the original text where it can be had back."""
    out = repair_bodies(table(spark, sf_dir, "response"), train_dictionaries(spark, sf_dir)).where("is_garbled")
    return out.select("retrieval_id", "is_restored", "chains", F.expr("case when chains <> '' or is_restored then original_text end").alias("original_text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose body, decoded as declared, shows garbled text anywhere."""
    return repair_bodies(table(spark, sf_dir, "response"), train_dictionaries(spark, sf_dir)).where("is_garbled").select("retrieval_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
SQL: dict[str, str] = {}
