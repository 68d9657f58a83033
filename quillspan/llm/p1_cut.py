"""Problem 1: texts that lost their end.

Method: near-copies are found by min-hash banding over runs of five words. A
copy that lost its end is a beginning of its whole copy, so a text is banded
against the beginnings of others: each text at the largest of a geometric
series of lengths that fits it, the longer ones at every length that fits
them. Pairs in which at least 0.8 of the shorter text's runs stand in the
longer one are aligned, and the copy whose alignment ends early inside a
sentence is flagged. Records without such a copy are scored by the terminality
of their closing word: how much more often the word closes a record than it
would if records ended anywhere.

Closing words and their counts inside texts are taken over all records in one
Arrow pass; a vocabulary of hashed units is aggregated before any shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NEAR_COPY_SIMILARITY, SHINGLE_WORDS, _classes, code_points, cut_lineage, declared_codec, decode_best, fan_out, is_markup, letter_counts, mix64, passages, shingles, slices, small, table, word_tokens
from .p5_garbled import likely_text

#: Bands of rows. At a similarity of 0.8 a pair shares a band with probability 0.96, at 0.9 with 0.998.
BANDS, ROWS = 6, 4
#: Shortest beginning that is banded, in words (four runs; fewer show no near-copy), and the ratio of each length to the one before it.
LEAST_WORDS, RATIO = 8, 1.4
#: Bits of the filter that keeps keys of longer texts from moving where no shorter text has them; a false hit only moves a key in vain.
FILTER_BITS = 26
#: Pairs of one band key beyond which its texts are paired by their closing words as well.
HOT_PAIRS = 4096
#: Texts and characters of one side of a block of a hot class; both bound memory only, every pair stands in one block.
BLOCK_TEXTS, BLOCK_CHARS = 2048, 2_000_000
#: Hits of shared runs up to which they are added one by one, and beyond which by a product of matrices.
SPREAD = 4_000_000
#: Hash buckets of the closing-word vocabulary (a power of two).
UNITS = 1 << 22
#: A closing word below this lift over a chance ending is not terminal.
LIFT = 1.0
#: Below this lift a closing word alone makes an unfinished sentence of a text without other signs.
WEAK_LIFT = 0.1
#: Weight of the class of the closing character against the word's own counts.
BACKOFF = 3.0
#: Texts with fewer letters than this (ideographs count two) are short texts and never cases.
SHORT = 24

_VOID = re.compile(r"<(?:br|hr|img|input|meta|link|wbr|source)\b[^<>]*>$", re.I)
_OPEN_TAG = re.compile(r"<[a-zA-Z][^<>]*>$")
_BROKEN_TAG = re.compile(r"<(?:[/!a-zA-Z][^<>]*)?$")
_BROKEN_ENTITY = re.compile(r"&(?:#\d*|#x[0-9a-f]*|[a-zA-Z]{1,7})$")
_STOPS = re.compile(r"[。！？!?…]|\.(?:\s|[”\"’»])")
_MARKS = re.compile(r"[，、；,;“”«»„「」『』]")


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Closing units of the texts: (bucket, text, is last of its text, class bucket).

    A unit ends at every mark, at every ideograph (with the one before it) and
    at the last letter of every word; digits of any number are one unit with
    the unit before them. Blanks make no unit.
    """
    cp, starts = code_points([t.rstrip().lower() for t in texts])
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, bool), z
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    small = np.minimum(cp, 65535)
    cls = _classes()[small].astype(np.int64)
    cls[cp > 65535] = 0
    cls[(cp >= 0x20000) & (cp < 0x40000)] = 2
    digit = (cp >= 48) & (cp <= 57) | (cp >= 0xFF10) & (cp <= 0xFF19)
    blank = (cp == 32) | (cp == 9) | (cp == 10) | (cp == 13) | (cp == 0xA0) | (cp == 0x3000)
    cls[blank] = -1
    cls[digit] = 3
    same_next = np.zeros(n, bool)
    same_next[:-1] = owner[:-1] == owner[1:]
    # The code points of a word or number add up to its hash; marks and ideographs stand alone.
    run = np.zeros(n, bool)
    run[1:] = (owner[1:] == owner[:-1]) & (cls[1:] == cls[:-1]) & ((cls[1:] == 1) | (cls[1:] == 3))
    begin = np.flatnonzero(~run)
    lens = np.diff(np.r_[begin, n])
    pos = np.arange(n) - np.repeat(begin, lens)
    h = mix64(cp.astype(np.uint64) + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    h[digit] = 0
    whole = np.add.reduceat(h, begin)
    kind = cls[begin]
    own = owner[begin]
    seen = kind >= 0
    whole, kind, own, begin_cp = whole[seen], kind[seen], own[seen], cp[begin][seen]
    whole[kind == 3] = np.uint64(7)
    before = np.zeros(len(whole), np.uint64)
    if len(whole) > 1:
        near = own[1:] == own[:-1]
        before[1:] = np.where(near, whole[:-1], 0)
    pair = (kind == 2) | (kind == 3)
    unit = np.where(pair, mix64(whole * np.uint64(31) + before), whole)
    # Class: the mark itself, or ideograph, word, number.
    klass = np.where(kind == 0, mix64(begin_cp.astype(np.uint64) + np.uint64(1 << 40)), mix64(kind.astype(np.uint64) + np.uint64(1 << 50)))
    last = np.ones(len(whole), bool)
    last[:-1] = own[1:] != own[:-1]
    mask = np.uint64(UNITS - 1)
    return (unit & mask).astype(np.int64), own, last, (klass & mask).astype(np.int64)


def grade(text: str, lines: bool, letters: int | None = None) -> int:
    """How surely a text should close on a mark: 2 running text, 1 perhaps, 0 a heading, a name, a notice or too short.

    Running text holds a finished sentence before its end (``lines``: in its
    last line). One unfinished sentence may be a notice or a heading, so there
    the closing word itself must be unusual, and a Latin line must not close
    on a capital, as names and headings do. ``letters`` are those of the
    whole text, where they are known.
    """
    body = text.rstrip()
    at = body.rfind("\n") + 1 if lines else 0
    last = body[at:]
    if at or letters is None:
        letters = int(letter_counts([last])[0])
    if _STOPS.search(last[:-1]):
        return 2 if letters >= SHORT // 2 else 0
    if at and _STOPS.search(body[:at]):
        return 1
    if letters < SHORT:
        return 0
    tail = re.search(r"([^\W\d_]+)$", last)
    if tail and tail.group(1)[0] < "⺀" and not tail.group(1)[0].islower():
        return 0
    return 1 if _MARKS.search(last[:-1]) or tail and tail.group(1)[0] < "⺀" else 0


_ODD = re.compile("[\x80-\x9f\ufffd\ue000-\uf8ff]|[ÃÂåæçèé][^\x00-\x7f]")


def readable(body: bytes, content_type: str | None) -> tuple[str, bool]:
    """(text, whether it ends inside a character); a garbled closing line is read by its likeliest chain."""
    text, cut = decode_best(body, content_type)
    at = max(text.rstrip().rfind("\n"), text.rfind(">")) + 1
    if cut or len(_ODD.findall(text[at:].rstrip("\ufffd"))) < 3:
        return text, cut
    try:
        data = text[at:].encode(declared_codec(content_type))
    except UnicodeEncodeError:
        data = None
    return text[:at] + likely_text(text[at:], data, declared_codec(content_type)), cut


def ending(text: str, cut_char: bool) -> tuple[str, str, bool | None]:
    """(group, closing text, verdict) of a body: the verdict is None where the closing word decides."""
    if cut_char:
        return "char", "", True
    if is_markup(text):
        body = text.rstrip()
        tag = body[max(0, body.rfind("<")) :]
        if _BROKEN_TAG.match(tag):
            return "markup", "", True
        open_until = lambda begin, end: body.rfind(begin) > body.rfind(end)
        if open_until("<script", "</script") or open_until("<style", "</style") or open_until("<!--", "-->"):
            return "markup", "", True
        if body.endswith(">"):
            return "markup", "", bool(_OPEN_TAG.match(tag)) and not _VOID.match(tag)
        closing = body[body.rfind(">") + 1 :]
        return "markup", closing, None if not _BROKEN_ENTITY.search(closing) else True
    head = text.lstrip("﻿ \t\r\n")[:1]
    if head in ("{", "["):
        try:
            json.loads(text)
            return "json", "", False
        except ValueError as err:
            # Text that only looks like JSON fails early; cut JSON fails at its end.
            return "json", "", True if getattr(err, "pos", 0) > len(text) * 0.5 or "Unterminated" in str(err) else None
    return "plain", text, None


def lengths_upto(most: int) -> list[int]:
    """The series of lengths, in words, at which beginnings are banded."""
    out = [LEAST_WORDS]
    while out[-1] < most:
        out.append(max(out[-1] + 1, round(out[-1] * RATIO)))
    return out


def beginning_keys(texts: list[str], longest_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text of each row, its band keys): of the longest beginning of the series that fits a text, or of all that fit.

    The minima of a beginning follow from those of the shorter ones, so all
    lengths cost one pass over the runs of a text.
    """
    s, own = shingles(texts)
    none = np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64)
    if not len(s):
        return none
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    ids, n = own[first], np.diff(np.r_[first, len(own)])
    series = lengths_upto(int(n.max()) + SHINGLE_WORDS - 1)
    runs = np.asarray(series, np.int64) - (SHINGLE_WORDS - 1)
    fits = np.searchsorted(runs, n, "right")  # how many lengths of the series fit
    ids, first, fits = ids[fits > 0], first[fits > 0], fits[fits > 0]
    if not len(ids):
        return none
    # Rows (text, length); each adds the runs between the length before it and its own.
    text = np.repeat(np.arange(len(ids)), fits)
    step = np.arange(len(text)) - np.repeat(np.cumsum(fits) - fits, fits)
    lo, hi = first[text] + np.r_[0, runs][step], first[text] + runs[step]
    top = step == fits[text] - 1
    cuts = np.column_stack([lo, hi]).ravel()
    spare = np.r_[s, np.uint64(0)]  # the last end may lie behind the last run
    later = [np.flatnonzero(step == j) for j in range(1, int(fits.max()))]
    acc = np.empty((len(text), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            whole = mix64(step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1))
            for r in range(ROWS):
                odd = mix64(np.asarray([b * ROWS + r + 1]))[0] | np.uint64(1)
                low = np.minimum.reduceat(spare * odd, cuts)[::2]
                for at in later:
                    low[at] = np.minimum(low[at], low[at - 1])
                whole = mix64(whole * np.uint64(0x100000001B3) + low)
            acc[:, b] = whole
    if longest_only:
        text, acc = text[top], acc[top]
    return ids[text], acc.view(np.int64)


REC = "rec string, record_kind string, record_id string, grp string, unit bigint, klass bigint, n bigint, verdict boolean, grade int, body_hash bigint, bands array<bigint>, chars int"
_COLS = [c.split()[0] for c in REC.split(", ")]


def _measure(kind: str, finished: bool = False):
    """One Arrow pass: a row per record, and per partition a row for each bucket counted inside texts.

    Only texts that can stop inside a sentence get band keys as the shorter
    copy; with ``finished`` also those that close on a mark which only
    finishes one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside: dict[str, np.ndarray] = {}

        def count(group: str, unit: np.ndarray) -> None:
            t = inside.setdefault(group, np.zeros(UNITS, np.int32))
            t += np.bincount(unit, minlength=UNITS).astype(np.int32)

        waiting: dict[str, list[np.ndarray]] = {}
        held = 0
        for pdf in batches:
            for lo, hi in slices(pdf.body.map(len).tolist()):
                part = pdf.iloc[lo:hi]
                if kind == "segment":
                    texts = part.body.tolist()
                    ends = [("segment", t, None) for t in texts]
                    whole = texts
                else:
                    decoded = [readable(b, c) for b, c in zip(part.body, part.content_type)]
                    ends = [ending(t, cut) for t, cut in decoded]
                    whole = ["\n".join(passages(t)) for t, _ in decoded]
                closing = [e[1] for e in ends]
                unit, own, last, klass = units([w if e[2] is None and e[0] != "markup" else (w + "\n" + c if e[2] is None else w) for w, c, e in zip(whole, closing, ends)])
                groups = ["segment" if kind == "segment" else "response"] * len(part)
                waiting.setdefault(groups[0] if groups else "", []).extend((unit[~last], klass[~last]))
                held += 2 * len(unit)
                if held > 1_000_000:
                    for g, us in waiting.items():
                        count(g, np.concatenate(us))
                    waiting, held = {}, 0
                u = np.full(len(part), -1, np.int64)
                k = np.full(len(part), -1, np.int64)
                u[own[last]], k[own[last]] = unit[last], klass[last]
                bands: list = [[]] * len(part)
                letters = letter_counts(whole)
                long = [i for i, w in enumerate(whole) if letters[i] >= SHORT and (finished or not is_finished(w))]
                for i, row in zip(*beginning_keys([whole[i] for i in long], True)):
                    bands[long[i]] = row
                yield pd.DataFrame(
                    {
                        "rec": "record",
                        "record_kind": kind,
                        "record_id": part.record_id.values,
                        "grp": groups,
                        "unit": u,
                        "klass": k,
                        "n": 1,
                        "verdict": pd.array([e[2] for e in ends], dtype="boolean"),
                        "grade": [0 if e[2] is not None else 2 * bool(e[1].strip()) if e[0] == "markup" else grade(e[1], kind == "segment", n if e[1] is w else None) for e, w, n in zip(ends, whole, letters)],
                        "body_hash": part.body_hash.values,
                        "bands": bands,
                        "chars": [len(w.rstrip()) for w in whole],
                    }
                )
        for g, us in waiting.items():
            count(g, np.concatenate(us))
        for g, t in inside.items():
            at = np.flatnonzero(t)
            for lo in range(0, len(at), 50_000):
                b = at[lo : lo + 50_000]
                yield pd.DataFrame({"rec": "inside", "record_kind": None, "record_id": None, "grp": g, "unit": b, "klass": -1, "n": t[b].astype(np.int64), "verdict": None, "grade": None, "body_hash": 0, "bands": [[]] * len(b), "chars": 0})[_COLS]

    return run


def bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segments, responses) with text; null and empty texts are whole by definition.

    Repeated rows are measured again rather than shuffled away with their
    texts; results name each record once.
    """
    seg = table(spark, sf_dir, "segment").select(F.col("segment_id").alias("record_id"), F.col("normalized_text").alias("body")).where("record_id is not null and body is not null and body <> ''")
    res = table(spark, sf_dir, "response").select(F.col("retrieval_id").alias("record_id"), "body", "content_type").where("record_id is not null and body is not null and octet_length(body) > 0")
    return seg.withColumn("body_hash", F.xxhash64("body")), res.withColumn("body_hash", F.xxhash64("body", "content_type"))


def _whole(kind: str, part: pd.DataFrame) -> list[str]:
    """Readable texts as they were measured."""
    return part.body.tolist() if kind == "segment" else ["\n".join(passages(readable(b, c)[0])) for b, c in zip(part.body, part.content_type)]


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"body_hash": pdf.body_hash.values, "text": _whole("response", pdf)})


def _longer(kind: str, shared):
    """Band keys of all beginnings of the texts, as far as the filter of the shorter texts' keys has them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for pdf in batches:
            for lo, hi in slices(pdf.body.map(len).tolist()):
                part = pdf.iloc[lo:hi]
                whole = _whole(kind, part)
                ids, keys = beginning_keys(whole, False)
                bit = (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hit = (words[bit >> 6] >> (bit & 63) & 1).astype(bool)
                row, _ = np.nonzero(hit)
                chars = np.fromiter((len(w.rstrip()) for w in whole), np.int64, len(whole))
                yield pd.DataFrame({"key": keys[hit], "hash_b": part.body_hash.values[ids[row]], "chars_b": chars[ids[row]]})

    return run


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the leading ``FILTER_BITS`` of all keys: a fixed size, whatever the number of keys."""
    bit = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def closing_words(text: str) -> list[int]:
    """Hashes of the last run of four words, and of the one before it (the last word may be broken)."""
    return _fours(word_tokens([text])[0])[-1:-3:-1].tolist()


def _fours(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of four words."""
    m = max(0, len(h) - 3)
    acc = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(4):
            acc = acc * np.uint64(0x100000001B3) + h[j : j + m]
    return mix64(acc).view(np.int64)


def _word_runs(closing: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [closing_words(t) if closing else np.unique(_fours(word_tokens([t])[0])) for t in pdf.text]
            yield pd.DataFrame({"body_hash": pdf.body_hash.values, "four": got})

    return run


def near_pairs(a: DataFrame, b: DataFrame, text_of) -> tuple[DataFrame, DataFrame | None]:
    """Texts and longer ones that share a band: ``hash_a, hash_b``, and blocks (``key, four, i, j, is_a, body_hash``) of hot classes.

    ``a`` has ``key, hash_a, chars_a``, ``b`` has ``key, hash_b, chars_b``. A
    band with more than ``HOT_PAIRS`` pairs is paired by (key, run of four
    words) as well: the aligned end must be a run of the longer text, so
    nothing is lost. A class that is hot even so is not expanded into pairs:
    its texts are cut into blocks, and each two blocks of shorter and longer
    texts are compared as a whole (``ends_early_any``). Several classes of the
    same texts are compared once.
    """
    side = a.select("key", F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(b.select("key", F.lit(0).alias("na"), F.lit(1).alias("nb")))
    size = side.groupBy("key").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    hot = cut_lineage(size.where(F.col("na") * F.col("nb") > HOT_PAIRS).select("key"))
    pairs = lambda x: x.join(b, "key").where("chars_a < chars_b").select("hash_a", "hash_b")
    if hot.isEmpty():
        return pairs(a).distinct(), None
    few = small(hot)
    plain = pairs(a.join(few, "key", "left_anti"))
    ha, hb = cut_lineage(a.join(few, "key", "left_semi")), cut_lineage(b.join(few, "key", "left_semi"))
    runs = lambda df, h, closing: fan_out(text_of(df.select(F.col(h).alias("body_hash")).distinct())).mapInPandas(_word_runs(closing), "body_hash bigint, four array<bigint>").withColumnRenamed("body_hash", h)
    on = ["key", "four"]
    ha = cut_lineage(ha.join(runs(ha, "hash_a", True), "hash_a").withColumn("four", F.explode(F.array_distinct("four"))))
    hb = cut_lineage(hb.join(runs(hb, "hash_b", False), "hash_b").withColumn("four", F.explode("four")).join(ha.select(*on).distinct(), on, "left_semi"))
    of = lambda df, x: df.groupBy(*on).agg(F.count("*").alias(f"n{x}"), F.sum(f"chars_{x}").alias(f"c{x}"), F.bit_xor(F.xxhash64(f"hash_{x}")).alias(f"x{x}"))
    size = cut_lineage(of(ha, "a").join(of(hb, "b"), on).withColumn("hot", F.col("na") * F.col("nb") > HOT_PAIRS))
    some = ha.join(size.where("not hot").select(*on), on, "left_semi").join(hb, on).where("chars_a < chars_b").select("hash_a", "hash_b")
    parts = [F.ceil(F.greatest(F.col(f"n{x}") / BLOCK_TEXTS, F.col(f"c{x}") / BLOCK_CHARS)).cast("int").alias(f"parts_{x}") for x in "ab"]
    big = cut_lineage(size.where("hot").groupBy("na", "nb", "ca", "cb", "xa", "xb").agg(F.min(F.struct(*on)).alias("on")).select("on.*", *parts))
    if big.isEmpty():
        return plain.unionByName(some).distinct(), None
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(f"parts_{x}") - 1))
    own = lambda x: F.pmod(F.xxhash64(f"hash_{x}"), F.col(f"parts_{x}")).cast("int")
    left = ha.join(big, on).select(*on, own("a").alias("i"), every("b").alias("j"), F.lit(True).alias("is_a"), F.col("hash_a").alias("body_hash"))
    right = hb.join(big, on).select(*on, every("a").alias("i"), own("b").alias("j"), F.lit(False).alias("is_a"), F.col("hash_b").alias("body_hash"))
    return plain.unionByName(some).distinct(), left.unionByName(right)


def _verify_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """``_verify`` for every pair of a block."""
    a, b = pdf[pdf.is_a], pdf[~pdf.is_a]
    early = ends_early_any(a.text.tolist(), b.text.tolist())
    return pd.DataFrame({"hash_a": a.body_hash.values, "early": early})[early > 0]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Align pairs of a text and a longer near-copy; keep those where the first ends before the second does."""
    for pdf in batches:
        sizes = (pdf.text_a.map(len) + pdf.text_b.map(len)).tolist()
        for lo, hi in slices(sizes):
            part = pdf.iloc[lo:hi]
            early = ends_early_all(part.text_a.tolist(), part.text_b.tolist())
            yield pd.DataFrame({"hash_a": part.hash_a.values, "early": early})[early > 0]


def ends_early(a: str, b: str) -> int:
    """Whether a is a near-copy of a beginning of b whose alignment ends before b does: 2 inside a sentence, 1 behind one, else 0.

    Near-copy: at least 0.8 of the five-word runs of a stand in b. Where b
    goes on behind a finished sentence or on another line, a may be whole and
    b have a sentence or a line more.
    """
    return int(ends_early_all([a], [b])[0])


def ends_early_all(left: list[str], right: list[str]) -> np.ndarray:
    """The same for many pairs at once; only those that are near-copies are looked at one by one."""
    n = len(left)
    out = np.zeros(n, np.int64)
    h, own = word_tokens(left + right)
    words = np.bincount(own, minlength=2 * n)
    begin = np.cumsum(words) - words
    fours = _fours(h)
    inside = own[: len(fours)] == own[3:] if len(h) > 3 else np.zeros(0, bool)
    at = np.flatnonzero(inside & (own[: len(fours)] >= n))
    pair = own[at] - n
    # The last run of four words of a that stands in b fixes the end of the alignment; the cut word itself may be broken.
    last = np.full((2, n), -1, np.int64)
    for skip in (0, 1):
        has = words[:n] >= 4 + skip
        tail = np.zeros(n, np.int64)
        tail[has] = fours[(begin[:n] + words[:n] - 4 - skip)[has]]
        hit = (fours[at] == tail[pair]) & has[pair]
        np.maximum.at(last[skip], pair[hit], at[hit] - begin[pair[hit] + n])
    s, sown = shingles(left + right)
    with np.errstate(over="ignore"):
        key = s ^ mix64(np.where(sown >= n, sown - n, sown).astype(np.uint64) + np.uint64(1))
    ka = np.unique(key[sown < n], return_index=True)
    of = sown[sown < n][ka[1]]
    total, both = np.bincount(of, minlength=n), np.bincount(of[np.isin(ka[0], key[sown >= n])], minlength=n)
    longer = np.fromiter((len(b.rstrip()) > len(a.rstrip()) for a, b in zip(left, right)), bool, n)
    for i in np.flatnonzero((last.max(0) >= 0) & (both > 0) & (both >= NEAR_COPY_SIMILARITY * total) & longer & (letter_counts(left) >= SHORT)):
        skip = 0 if last[0][i] >= 0 else 1
        out[i] = _breaks_off(left[i].rstrip(), _behind(left[i], int(words[i]) - 1 - skip), _behind(right[i], int(last[skip][i]) + 3))
    return out


def _shared_runs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct five-word runs of each left text, how many of them stand in each right one).

    Runs that the same left texts have are counted together: few such groups
    are shared by many texts, and those of few texts cost what they hit.
    """
    n, m = len(left), len(right)
    s, own = _runs(left)
    v, at = np.unique(s, return_inverse=True)
    total, both = np.bincount(own, minlength=n), np.zeros((n, m), np.float32)
    if not len(v):
        return total, both
    order = np.argsort(at, kind="stable")
    holders, first = own[order], np.r_[0, np.cumsum(np.bincount(at))]
    # A group of runs is known by the summed hashes of the texts that have them.
    _, one, group = np.unique(np.add.reduceat(mix64(holders + 1), first[:-1]), return_index=True, return_inverse=True)
    by_size = np.argsort(np.diff(first)[one], kind="stable")
    one, group = one[by_size], np.argsort(by_size)[group]
    lo, size = first[one], np.diff(first)[one]
    s, own = _runs(right)
    at = np.minimum(np.searchsorted(v, s), len(v) - 1)
    hit = v[at] == s
    # Rows (group, right text) with the number of the group's runs in the text.
    code, times = np.unique(group[at[hit]] * m + own[hit], return_counts=True)
    g, b = code // m, code % m
    step = 1024
    for low in range(0, len(one), step):
        rows = slice(*np.searchsorted(g, [low, low + step]))
        spread = size[g[rows]]
        if spread.sum() <= SPREAD:
            which = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(lo[g[rows]], spread)
            np.add.at(both, (holders[which], np.repeat(b[rows], spread)), np.repeat(times[rows], spread).astype(np.float32))
        else:
            have, found = np.zeros((n, step), np.float32), np.zeros((step, m), np.float32)
            for k in range(low, min(low + step, len(one))):
                have[holders[lo[k] : lo[k] + size[k]], k - low] = 1
            found[g[rows] - low, b[rows]] = times[rows]
            both += have @ found
    return total, both


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word runs of each text, and the index of the text of each."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for lo, hi in slices([len(t) for t in texts]):
        s, own = shingles(texts[lo:hi])
        order = np.lexsort((s, own))
        s, own = s[order], own[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (own[1:] != own[:-1])][: len(s)]
        out.append((s[new], own[new] + lo))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def ends_early_any(left: list[str], right: list[str]) -> np.ndarray:
    """For each left text the largest ``ends_early`` over all right ones: the same as over all pairs, without listing them."""
    n, m = len(left), len(right)
    out = np.zeros(n, np.int64)
    closing = [closing_words(a) for a in left]
    tails = np.unique(np.asarray([t for c in closing for t in c], np.int64))
    if not len(tails) or not m:
        return out
    # Where the last of each closing run stands in each right text.
    last = np.full((m, len(tails)), -1, np.int32)
    for j, b in enumerate(right):
        fours = _fours(word_tokens([b])[0])
        at = np.minimum(np.searchsorted(tails, fours), len(tails) - 1)
        hit = np.flatnonzero(tails[at] == fours)
        np.maximum.at(last[j], at[hit], hit.astype(np.int32))
    total, both = _shared_runs(left, right)
    least = np.maximum(np.ceil(NEAR_COPY_SIMILARITY * total), 1).astype(np.float32)
    size_a, size_b = (np.fromiter((len(t.rstrip()) for t in x), np.int64, len(x)) for x in (left, right))
    both[letter_counts(left) < SHORT] = 0
    copies = (both >= least[:, None]) & (size_b > size_a[:, None])
    del both
    todo = np.flatnonzero(copies.any(1))
    rest_a = {(i, skip): _behind(left[i], -1 - skip) for i in todo for skip in range(len(closing[i]))}
    reach = max(map(len, rest_a.values()), default=0)
    words: dict[int, tuple] = {}
    rests: list[str] = []
    ids: dict[str, int] = {}
    rest_b = np.full(last.shape, -1, np.int32)
    known: dict[tuple, int] = {}
    for i in todo:
        a = left[i].rstrip()
        body = a.rstrip("”\"’»」』）)")
        tail = a[max(0, len(body) - 1) :]  # what _breaks_off sees of a
        free = np.flatnonzero(copies[i])
        for skip, t in enumerate(np.searchsorted(tails, closing[i]).tolist()):
            free, mine = free[last[free, t] < 0], free[last[free, t] >= 0]
            for lo in range(0, len(mine), 256):
                part = mine[lo : lo + 256]
                for j in part[rest_b[part, t] < 0].tolist():
                    if j not in words:
                        words[j] = _word_starts(right[j])
                    rest = _behind(right[j], int(last[j, t]) + 3, words[j])
                    # No more of it counts than up to the first letter behind any left rest.
                    end = next((k for k in range(reach, len(rest)) if rest[k].isalnum()), len(rest))
                    rest_b[j, t] = ids.setdefault(rest[: end + 1], len(ids))
                    if len(ids) > len(rests):
                        rests.append(rest[: end + 1])
                for r in np.unique(rest_b[part, t]).tolist():
                    what = (tail, rest_a[i, skip], r)
                    if what not in known:
                        known[what] = _breaks_off(tail, what[1], rests[r])
                    out[i] = max(out[i], known[what])
                if out[i] == 2:
                    break
            if out[i] == 2:
                break
    return out


_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]+|[^\\S\n]+")
_FINISHED = re.compile(r"[。！？!?….]([”\"’»」』）)]*)$")


def is_finished(a: str) -> bool:
    """Whether a text closes on a mark that only finishes a sentence (a quotation mark behind it may close speech within one)."""
    done = _FINISHED.search(a.rstrip()[-2:])
    return bool(done) and not done.group(1)


def _word_starts(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(text whose characters are counted, class of each, where its words start)."""
    low = text.lower()
    text = text if len(low) == len(text) else low
    cp, _ = code_points([low])
    cls = _classes()[np.minimum(cp, 65535)]
    cls[cp > 65535] = 0
    cls[(cp >= 0x20000) & (cp < 0x40000)] = 2
    begin = (cls == 2) | (cls == 1) & (np.r_[0, cls[:-1]] != 1)
    return text, cls, np.flatnonzero(begin).astype(np.int32)


def _behind(text: str, k: int, words: tuple[str, np.ndarray, np.ndarray] | None = None) -> str:
    """What stands behind the k-th word of a text, as ``word_tokens`` counts them, without blanks and invisible characters."""
    text, cls, begin = words or _word_starts(text)
    at = int(begin[k])
    end = at + 1
    while cls[at] == 1 and end < len(cls) and cls[end] == 1:
        end += 1
    return _UNSEEN.sub("", text[end:].rstrip())


def _breaks_off(a: str, rest_a: str, rest_b: str) -> int:
    """How a, with ``rest_a`` behind the last words that it shares with its copy, stops: 2 inside a sentence of the copy, 1 behind one, 0 where the copy does not go on."""
    if not rest_b.startswith(rest_a):
        return 0
    more = rest_b[len(rest_a) :]
    word = next((i for i, c in enumerate(more) if c.isalnum()), -1)
    if word < 0 or word == 0 and more[0].isdigit() and a[-1:].isdigit():
        # No word is missing, or the copies only count differently.
        return 0
    done = _FINISHED.search(a)
    gap = more[:word].split("\n")
    if len(gap) > 1:
        return 2 if re.search(r"[。！？!?….]", gap[0]) and not done else 1
    # Speech may end on a mark within its sentence.
    return 2 if not done or done.group(1) and not more[word].isupper() else 1


def scored(spark: SparkSession, sf_dir: str, finished: bool = False) -> DataFrame:
    """Every record with its verdict, closing-word lift, near-copy flag and decision.

    ``record_kind, record_id, lift, by_copy, is_cut``. ``by_copy`` says that a
    longer near-copy goes on where the record ends; where that is behind a
    finished sentence it alone makes no case, and texts that close so are
    looked at only with ``finished``. Records that end inside a character, tag
    or value carry their verdict from the bytes alone.
    """
    seg, res = bodies(spark, sf_dir)
    measured = cut_lineage(seg.mapInPandas(_measure("segment", finished), REC).unionByName(res.mapInPandas(_measure("response", finished), REC)))
    rec = measured.where("rec = 'record'").drop("rec", "n")
    inside = measured.where("rec = 'inside'").groupBy("grp", "unit").agg(F.sum("n").alias("inside"))
    open_rec = rec.where("verdict is null")
    ends = open_rec.groupBy("grp", "unit").agg(F.count("*").alias("ends"))
    # One class per mark and three more: as many as Unicode has marks at most.
    klass_ends = F.broadcast(open_rec.groupBy("grp", "klass").agg(F.count("*").alias("k_ends")))
    base = inside.groupBy("grp").agg(F.sum("inside").alias("all_inside")).join(rec.groupBy("grp").agg(F.count("*").alias("all_ends")), "grp")
    u = ends.join(inside, ["grp", "unit"], "left").select("grp", "unit", F.col("ends").alias("u_ends"), F.coalesce("inside", F.lit(0)).alias("u_inside"))
    k = klass_ends.join(inside.select("grp", F.col("unit").alias("klass"), F.col("inside").alias("k_inside")).join(klass_ends.select("grp", "klass"), ["grp", "klass"]), ["grp", "klass"], "left").fillna(0, ["k_inside"])
    # Units and classes are both counted inside, so a chance ending has half the summed count to fall on.
    rate = F.col("all_ends") / (F.col("all_inside") / 2 + F.col("all_ends"))
    klass_rate = (F.col("k_ends") - 1 + rate) / (F.col("k_ends") + F.col("k_inside"))
    own_rate = (F.col("u_ends") - 1 + BACKOFF * klass_rate) / (F.col("u_ends") - 1 + F.col("u_inside") + BACKOFF)
    out = rec.drop("bands", "chars").join(u, ["grp", "unit"], "left").join(F.broadcast(k), ["grp", "klass"], "left").join(F.broadcast(base), "grp", "left")
    out = out.select("record_kind", "record_id", "verdict", "grade", "body_hash", (own_rate / rate).alias("lift"), (klass_rate / rate).alias("klass_lift"))
    # Running text is judged by its closing mark: a cut leaves pieces of words that recur as such and would pass for words.
    lift = F.coalesce("lift", F.lit(0.0))
    by_word = F.when(F.col("grade") == 2, (F.coalesce("klass_lift", F.lit(0.0)) < LIFT) | (lift < 2 * WEAK_LIFT)).otherwise(lift < WEAK_LIFT)
    out = out.withColumn("open_ended", F.col("verdict").isNull() & by_word)

    # Near-copies: distinct texts that can be cut beside every longer one; bodies that end whole or broken show where others end.
    a = rec.where("size(bands) > 0").groupBy("body_hash").agg(F.first("bands").alias("bands"), F.first("chars").alias("chars_a"))
    a = cut_lineage(a.select(F.explode("bands").alias("key"), F.col("body_hash").alias("hash_a"), "chars_a"))
    shared = spark.sparkContext.broadcast(key_filter(a))
    keyed = "key bigint, hash_b bigint, chars_b bigint"
    b = cut_lineage(seg.mapInPandas(_longer("segment", shared), keyed).unionByName(res.mapInPandas(_longer("response", shared), keyed)).distinct())

    def text_of(need: DataFrame) -> DataFrame:
        need = small(cut_lineage(need), 1_000_000)
        seg_text = seg.select("body_hash", F.col("body").alias("text")).join(need, "body_hash", "left_semi").groupBy("body_hash").agg(F.min("text").alias("text"))
        res_body = res.select("body_hash", F.struct("body", "content_type").alias("b")).join(need, "body_hash", "left_semi").groupBy("body_hash").agg(F.min("b").alias("b"))
        return seg_text.unionByName(res_body.select("body_hash", "b.*").mapInPandas(_texts, "body_hash bigint, text string"))

    pairs, blocks = near_pairs(a, b, text_of)
    pairs = cut_lineage(pairs)
    need = pairs.select(F.explode(F.array("hash_a", "hash_b")).alias("body_hash"))
    if blocks is not None:
        blocks = cut_lineage(blocks)
        need = need.unionByName(blocks.select("body_hash"))
    body_text = cut_lineage(text_of(need.distinct()))
    early = fan_out(pairs.join(body_text.withColumnsRenamed({"body_hash": "hash_a", "text": "text_a"}), "hash_a").join(body_text.withColumnsRenamed({"body_hash": "hash_b", "text": "text_b"}), "hash_b")).mapInPandas(_verify, "hash_a bigint, early int")
    if blocks is not None:
        early = early.unionByName(blocks.join(body_text, "body_hash").groupBy("key", "four", "i", "j").applyInPandas(_verify_block, "hash_a bigint, early int"))
    verified = cut_lineage(early.groupBy(F.col("hash_a").alias("body_hash")).agg(F.max("early").alias("early")))
    out = out.join(small(verified), "body_hash", "left")
    by_copy = F.coalesce(F.col("early") > 0, F.lit(False))
    # A copy that does not go on proves no end: both may be cut there, so the closing word still decides.
    is_cut = F.coalesce("verdict", F.lit(False)) | F.coalesce(F.col("early") == 2, F.lit(False)) | F.col("open_ended") & (F.col("grade") > 0)
    return out.select("record_kind", "record_id", F.round("lift", 6).alias("lift"), by_copy.alias("by_copy"), is_cut.alias("is_cut"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses and segments whose text breaks off before its end."""
    return scored(spark, sf_dir).where("is_cut").select("record_kind", "record_id").distinct()


def p1_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut records per source, segments through the chapter reference of their document.

    Records without a known source are reported under a null source_id.
    """
    s = scored(spark, sf_dir)
    res = table(spark, sf_dir, "response").select(F.col("retrieval_id").alias("record_id"), "source_id").groupBy("record_id").agg(F.min("source_id").alias("source_id"))
    doc = table(spark, sf_dir, "chapter_ref").groupBy("document_id").agg(F.min("source_id").alias("source_id"))
    seg = table(spark, sf_dir, "segment").select(F.col("segment_id").alias("record_id"), "document_id").groupBy("record_id").agg(F.min("document_id").alias("document_id"))
    src = res.withColumn("record_kind", F.lit("response")).unionByName(seg.join(doc, "document_id", "left").select("record_id", "source_id").withColumn("record_kind", F.lit("segment")))
    s = s.groupBy("record_kind", "record_id").agg(F.max("is_cut").alias("is_cut"))
    j = s.join(src, ["record_kind", "record_id"], "left")
    return j.groupBy("source_id", "record_kind").agg(F.count("*").alias("n_records"), F.count_if("is_cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_records"), 6))


QUERIES = {"p1_found": p1_found, "p1_source_rates": p1_source_rates}
SQL: dict[str, str] = {}
