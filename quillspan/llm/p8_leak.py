"""Problem 8: evaluation texts inside training documents.

Method: q-gram lemma filtering. A window of ``w`` characters with at most
``k`` edits shares at least ``w + 1 - q(k + 1)`` q-grams with its counterpart,
all within a band of diagonals. Q-gram hits of a document against the items
are counted in overlapping bands of diagonals; regions that meet the bound are
verified by banded alignment. The items are the query set: they go to the
executors in blocks of bounded size, the documents are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, mix64, table

Q = 8
#: Characters of item text that one broadcast block may hold.
BLOCK_CHARS = 2_000_000
_KEEP: np.ndarray | None = None


def _kept() -> np.ndarray:
    """Which code points are letters or digits (categories L and N)."""
    global _KEEP
    if _KEEP is None:
        _KEEP = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    return _KEEP


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the texts after NFKC and case folding: code points and each text's start."""
    cp, starts = code_points([unicodedata.normalize("NFKC", t).casefold() if t else "" for t in texts])
    keep = _kept()[cp]
    run = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=run[1:])
    return cp[keep], run[starts]


def qgrams(cp: np.ndarray, q: int = Q) -> np.ndarray:
    m = len(cp) - q + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + cp[j : j + m].astype(np.uint64) + np.uint64(1)
    return mix64(acc)


class ItemIndex:
    """Q-grams of a block of items: sorted hashes with item and offset, and a bitmap in front of them."""

    BITS = 22

    def __init__(self, ids: list[int], texts: list[str], min_run: list[int], edits: int = 1):
        self.ids, self.min_run, self.edits = np.asarray(ids, np.int64), np.asarray(min_run, np.int64), edits
        self.cp, self.starts = folded(texts)
        h = qgrams(self.cp)
        item = np.searchsorted(self.starts, np.arange(len(h)), "right") - 1
        off = np.arange(len(h)) - self.starts[item]
        inside = np.arange(len(h)) + Q <= self.starts[item + 1]
        h, item, off = h[inside], item[inside], off[inside]
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.off = h[order], item[order], off[order]
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self.hash >> np.uint64(64 - self.BITS)] = True

    def hits(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset in the item) of every q-gram shared with the items."""
        h = qgrams(cp)
        at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - self.BITS)])
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        pos, first = np.repeat(at, n), np.repeat(lo, n)
        k = first + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
        return pos, self.item[k], self.off[k]


def dense_regions(pos: np.ndarray, diag: np.ndarray, group: np.ndarray, window: np.ndarray, edits: int) -> np.ndarray:
    """Groups (document and item) that pass the q-gram lemma in some band of diagonals.

    Bands are ``2(edits+1)`` wide and overlap by half, so every run of
    diagonals of width ``edits+1`` lies wholly in one of them. A band passes
    where ``window + 1 - q(edits+1)`` hits lie within a window's q-grams.
    """
    passed = []
    width = edits + 1
    need = np.maximum(1, window + 1 - Q * (edits + 1))
    for shift in (0, width):
        band = (diag + shift) // (2 * width)
        order = np.lexsort((pos, band, group))
        g, b, p = group[order], band[order], pos[order]
        k = need[order]
        j = np.arange(len(p)) + k - 1
        ok = j < len(p)
        i = np.flatnonzero(ok)
        j = j[ok]
        same = (g[i] == g[j]) & (b[i] == b[j]) & (p[j] - p[i] <= window[order][i] + edits - Q)
        passed.append(g[i[same]])
    return np.unique(np.concatenate(passed)) if passed else np.zeros(0, np.int64)


def banded_distance(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Edit distance of two code-point arrays, computed within ``width`` diagonals of the main one.

    Exact when the distance is at most ``width``; larger otherwise.
    """
    if abs(len(a) - len(b)) > width:
        return width + 1
    big = width + 1
    n = 2 * width + 1
    prev = np.full(n, big, np.int64)
    for k in range(n):
        if 0 <= k - width <= len(b):
            prev[k] = k - width
    for i in range(1, len(a) + 1):
        cur = np.full(n, big, np.int64)
        for k in range(n):
            j = i + k - width
            if j < 0 or j > len(b):
                continue
            best = prev[k + 1] + 1 if k + 1 < n else big
            if j == 0:
                best = min(best, i)
            else:
                best = min(best, prev[k] + (a[i - 1] != b[j - 1]))
                if k > 0:
                    best = min(best, cur[k - 1] + 1)
            cur[k] = min(best, big)
        prev = cur
    k = len(b) - len(a) + width
    return int(prev[k]) if 0 <= k < n else big


def reach(doc: np.ndarray, item: np.ndarray, edits: int, most: int) -> list[tuple[int, int]]:
    """(characters of the item, of the document) covered from the starts of both with 0, 1 .. ``edits`` edits, the item's as many as can be.

    Furthest points per diagonal, within ``edits`` diagonals of the main one;
    no more than ``most`` characters of the item.
    """
    n_item, n_doc = min(len(item), most), len(doc)

    def slide(i: int, p: int) -> int:
        n = min(n_item - i, n_doc - p)
        wrong = np.flatnonzero(item[i : i + n] != doc[p : p + n])
        return i + (int(wrong[0]) if len(wrong) else n)

    # Per diagonal (document minus item): the furthest place in the item.
    far = {0: slide(0, 0)}
    best = (far[0], far[0])
    out = [best]
    for _ in range(edits):
        new = dict(far)
        for d, i in far.items():
            for di, dd in ((1, 0), (1, -1), (0, 1)):
                j, e = i + di, d + dd
                if j > n_item or not 0 <= j + e <= n_doc:
                    continue
                to = slide(j, j + e)
                new[e] = max(new.get(e, -1), to)
                # A character of the item behind the document's last is no part of the window.
                if to > best[0] and not (dd < 0 and to == j and j + e == n_doc):
                    best = (to, to + e)
        far = new
        out.append(best)
    return out


def verify(doc: np.ndarray, item: np.ndarray, pos: np.ndarray, off: np.ndarray, window: int, edits: int) -> tuple[int, int, int, int]:
    """Best aligned window of one document and item: (matched window start, its edits, longest exact run, its start).

    Every window of the item within ``edits`` edits holds a run of hits, so
    each run is extended to both sides in a band of ``edits`` diagonals, the
    edits shared out between the sides in every way. The exact run is the
    longest chain of consecutive hits on one diagonal.
    """
    diag = pos - off
    order = np.lexsort((pos, diag))
    p, d = pos[order], diag[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, len(p)])
    best = int(np.argmax(runs))
    run, run_at = int(runs[best]) + Q - 1, int(p[first[best]])
    if run >= window:
        return run_at, 0, run, run_at
    found = (-1, edits + 1)
    for k in np.argsort(-runs, kind="stable"):
        s, o, n = int(p[first[k]]), int(p[first[k]] - d[first[k]]), int(runs[k]) + Q - 1
        left = reach(doc[:s][::-1], item[:o][::-1], edits, window)
        right = reach(doc[s + n :], item[o + n :], edits, window)
        for e in range(min(found[1], edits + 1)):
            got = [j for j in range(e + 1) if left[j][0] + n + right[e - j][0] >= window]
            if got:
                found = (s - left[got[0]][1], e)
                break
        if found[1] <= 1:
            break
    return found[0], found[1], run, run_at


MATCHES = "doc_id bigint, item_id bigint, run_chars int, min_run int, window_start int, window_edits int, coverage double"


def _scan(index_bytes, edits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: ItemIndex = index_bytes.value
        names = [c.split()[0] for c in MATCHES.split(", ")]
        for pdf in batches:
            rows = []
            texts = pdf.text.tolist()
            for lo in range(0, len(texts), 1000):
                ids = pdf.doc_id.values[lo : lo + 1000]
                cp, starts = folded(texts[lo : lo + 1000])
                pos, item, off = index.hits(cp)
                if not len(pos):
                    continue
                doc = np.searchsorted(starts, pos, "right") - 1
                ok = pos + Q <= starts[doc + 1]
                pos, item, off, doc = pos[ok], item[ok], off[ok], doc[ok]
                if not len(pos):
                    continue
                group = doc * len(index.ids) + item
                local = pos - starts[doc]
                keep = dense_regions(local, local - off, group, index.min_run[item], edits)
                order = np.argsort(group, kind="stable")
                sorted_group = group[order]
                for g in keep:
                    a, b = np.searchsorted(sorted_group, (g, g + 1))
                    sel = order[a:b]
                    k, i = divmod(int(g), len(index.ids))
                    text = cp[starts[k] : starts[k + 1]]
                    it = index.cp[index.starts[i] : index.starts[i + 1]]
                    at, e, longest, _ = verify(text, it, local[sel], off[sel], int(index.min_run[i]), edits)
                    if e <= edits or longest >= index.min_run[i]:
                        seen = np.zeros(len(it), bool)
                        for j in range(Q):
                            seen[off[sel] + j] = True
                        rows.append((int(ids[k]), int(index.ids[i]), longest, int(index.min_run[i]), at, e, float(seen.mean())))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "int64", "item_id": "int64"}) if rows else pd.DataFrame({n: [] for n in names})

    return run


def find_leaks(docs: DataFrame, items: DataFrame, edits: int = 1, zh_run: int = 24, other_run: int = 60) -> DataFrame:
    """Every document with every item of which it holds a run within ``edits`` edits.

    ``docs`` has ``doc_id, text``; ``items`` has ``item_id, lang, text``. Rows
    with a null id or text, and items shorter than a q-gram after folding,
    match nothing. Items are counted first and taken in as many blocks as
    keep each below ``BLOCK_CHARS``; each block is one scan of the documents.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null and text is not null").select("item_id", "lang", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total * 2 // BLOCK_CHARS))
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "lang").collect() if total else []
        index = ItemIndex([r.item_id for r in rows], [r.text for r in rows], [zh_run if (r.lang or "").lower().startswith("zh") else other_run for r in rows], edits)
        part = docs.mapInPandas(_scan(spark.sparkContext.broadcast(index), edits), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they contain, exactly or within one edit a window."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share an exact run of the length the item's language asks for."""
    return p8_matches(spark, sf_dir).where("run_chars >= min_run").select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item: in how many documents it was found and how much of it at most."""
    m = p8_matches(spark, sf_dir)
    return m.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("run_chars").alias("longest_run"), F.round(F.max("coverage"), 4).alias("max_coverage"))


QUERIES = {"p8_found": p8_found, "p8_matches": p8_matches, "p8_leaked_items": p8_leaked_items}
SQL: dict[str, str] = {}
