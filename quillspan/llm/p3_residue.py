"""Problem 3: template residue, filler, error pages and demands for scripts.

Method: a naive Bayes model over the passages of the bodies is learned from
trusted records only (bodies of error responses, passages with an unfilled
placeholder) against all unlabelled ones, by expectation-maximisation. It
scores every passage; a record's decision is the sum over its passages. A
passage with a placeholder is a trusted one in scoring too: its evidence is
certain, and so outweighs the real text of its record.

Each EM step is one pass over all passages that sums expected feature counts
per partition; what reaches the driver is one row per feature bucket, at most
``BUCKETS`` of them whatever the size of the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, cut_lineage, decode_best, fan_out, mix64, passages, per_char, slices, table

BUCKETS = 1 << 15
#: Most steps of the fit, and the mean change of the log-odds at which it ends.
EM_STEPS, CLOSE = 12, 0.001
#: Share below which a feature tells nothing; weight of a text that a page shows in ``noscript``.
SMOOTHING, NOSCRIPT_WEIGHT = 2e-4, 0.05
#: First share of residue among unlabelled records (each step estimates it again), the most that one passage adds to its record, and what one with a placeholder adds.
PRIOR = 0.1
CLIP, CERTAIN = 12.0, 1e6

_NAME = r"[A-Za-z_一-鿿][\w.一-鿿]*"
#: Unfilled placeholders: a name alone between the marks of a template language. Formulas and other uses of braces are none.
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%-?\s*\w+(?:\s+{_NAME})*\s*-?%\}}|<%[=-]?\s*{_NAME}\s*-?%>|[$#]\{{\s*{_NAME}\s*\}}|\{{\${_NAME}\}}|\[\[\s*{_NAME}\s*\]\]"
    rf"|@@{_NAME}?@@|(?<![\w%])%[A-Z][A-Z_]+%(?![\w%])|(?<!\w)__[A-Z][A-Z_]*__(?!\w)|\{{[a-z]+[_.][a-z_.]+\}}"
)
_MAY_HOLD = re.compile(r"[{\[%<$#@_]")


def _kind(c: str) -> int:
    """0 blank, 1 part of a word, 2 an ideograph, 3 part of a number, 4 a mark."""
    if "㐀" <= c <= "䶿" or "一" <= c <= "鿿":
        return 2
    return 1 if c.isalpha() else 3 if c.isdecimal() else 0 if c.isspace() or c == "_" or c.isalnum() else 4


_PAIR, _BEGIN, _END, _NUMBER = (np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in (3, 5, 7, 11))


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of the passages one after another, number of features of each).

    Features are words of two letters or more, numbers (all alike) and marks,
    pairs of neighbours with the ends of the passage, how many there are, and
    how much of them repeats itself. Each counts once in a passage, so long
    passages do not outvote others by repetition. Blank passages have none.
    """
    n = len(texts)
    cp, starts = code_points([t.lower() for t in texts])
    if not len(cp):
        return np.zeros(0, np.uint16), np.zeros(n, np.int64)
    kind = per_char(cp, "p3", _kind)
    owner = np.repeat(np.arange(n), np.diff(starts))
    begin = (kind == 2) | (kind == 4)
    for k in (1, 3):
        run = kind == k
        new = run.copy()
        new[1:] &= ~run[:-1] | (owner[1:] != owner[:-1])
        begin |= new
    keep = np.flatnonzero(kind)
    if not len(keep):
        return np.zeros(0, np.uint16), np.zeros(n, np.int64)
    at = np.flatnonzero(begin[keep])
    tok = np.cumsum(begin[keep]) - 1
    pos = (np.arange(len(keep)) - at[tok]).astype(np.uint64)
    with np.errstate(over="ignore"):
        word = np.add.reduceat(mix64(cp[keep].astype(np.uint64) + (pos + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), at)
        own, what, size = owner[keep][at], kind[keep][at], np.diff(np.r_[at, len(keep)])
        word[what == 3] = _NUMBER
        first = np.r_[True, own[1:] != own[:-1]]
        last = np.r_[first[1:], True]
        before = np.where(first, _BEGIN, np.r_[_BEGIN, word[:-1]])
        single = (what != 2) & ((size > 1) | (what != 1))
        count = np.bincount(own, minlength=n)
        # Distinct words of each passage.
        order = np.lexsort((word, own))
        w, o = word[order], own[order]
        kinds = np.bincount(o[np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])]], minlength=n)
        some = np.flatnonzero(count)
        many = np.flatnonzero(count >= 6)
        bits = np.minimum(6, np.floor(np.log2(np.maximum(count[some], 1))).astype(np.int64) + 1)
        parts = [
            (own[single], mix64(word[single])),
            (own, mix64(before * _PAIR + word)),
            (own[last], mix64(word[last] * _PAIR + _END)),
            (some, mix64(bits.astype(np.uint64) + np.uint64(1 << 40))),
            (many, mix64((4 * kinds[many] // count[many]).astype(np.uint64) + np.uint64(1 << 41))),
        ]
    key = np.concatenate([i.astype(np.int64) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64) for i, h in parts])
    key = np.unique(key)
    return (key % BUCKETS).astype(np.uint16), np.bincount(key // BUCKETS, minlength=n)


def size_feature(chars: int) -> int:
    """Bucket of how much there is to read in a record: evidence too."""
    return int(mix64(np.asarray([min(14, int(3 * np.log10(1 + chars))) + (1 << 42)]))[0] % np.uint64(BUCKETS))


_BETWEEN = str.maketrans("", "", " \t\n.,;!。，；！—-")


def repeats_itself(passage: str) -> bool:
    """A passage that says one thing three times or more and nothing else; marks between do not count."""
    t = passage.lower().translate(_BETWEEN)
    n = len(t)
    if n < 6:
        return False
    period = (t + t).find(t, 1)
    return n // period >= 3


#: A passage that begins with the customary dummy text is trusted filler.
DUMMY = re.compile(r"^\W*lorem ipsum\b", re.I)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript", re.I | re.S)

#: Passages of a record: numbers of features (32 bits each), whether trusted (one byte each), buckets of the features (16 bits each).
RECORDS = "retrieval_id string, trusted boolean, weight double, holes int, lens binary, sure binary, feats binary"
_NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def _packed(records: list[tuple]) -> pd.DataFrame:
    """Rows of ``(id, failed, weight, texts, sizes to add)`` with the features of their passages.

    ``sure`` is 2 for a passage with a placeholder, 1 for other trusted ones.
    """
    texts = [t for r in records for t in r[3]]
    flat, lens = features_of(texts)
    at = np.r_[0, np.cumsum(lens)]
    rows, k = [], 0
    for ident, failed, weight, own, extra in records:
        m = len(own)
        f, n = flat[at[k] : at[k + m]], lens[k : k + m]
        if extra is None:
            sure = np.ones(m, np.uint8)
        else:
            sure = np.fromiter((2 if _MAY_HOLD.search(p) and PLACEHOLDER.search(p) else 1 if DUMMY.match(p) or repeats_itself(p) else 0 for p in own), np.uint8, m)
            if m:
                # How much there is to read stands as a passage without text.
                f, n, sure = np.r_[f, np.uint16(extra)], np.r_[n, 1], np.r_[sure, np.uint8(0)]
        rows.append((ident, failed, weight, int((sure == 2).sum()), n.astype(np.uint32).tobytes(), sure.tobytes(), f.astype(np.uint16).tobytes()))
        k += m
    return pd.DataFrame(rows, columns=_NAMES)


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per record with the features of its passages, and one per distinct ``noscript`` text of a batch.

    What a page says in ``noscript`` is a demand for scripts by its markup, so
    these texts are trusted examples although no reader sees them.
    """
    for pdf in batches:
        demands: dict[str, int] = {}
        for lo, hi in slices(pdf.body.map(len).tolist()):
            rows = []
            for ident, status, body, ctype in zip(pdf.retrieval_id[lo:hi], pdf.status[lo:hi], pdf.body[lo:hi], pdf.content_type[lo:hi]):
                text, _ = decode_best(body, ctype)
                own = passages(text)
                failed = bool(status == status and status is not None and status >= 400)
                rows.append((ident, failed, 1.0, own, size_feature(sum(map(len, own)))))
                if "noscript" in text or "NOSCRIPT" in text:
                    for m in _NOSCRIPT.finditer(text):
                        for p in passages(_TAGS.sub("\n", m.group(1))):
                            demands[p] = demands.get(p, 0) + 1
            yield _packed(rows)
        if demands:
            yield _packed([(None, True, NOSCRIPT_WEIGHT * n, [p], None) for p, n in demands.items()])


_TAGS = re.compile(r"<[^<>]*>")


def passage_scores(odds: np.ndarray | None, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score of each passage, its record, how sure it is, passage of each feature, features) of a batch of records.

    A passage's log-odds are divided by the root of its number of features,
    which are far from independent, and clipped.
    """
    per = pdf.lens.map(len).to_numpy() // 4
    lens = np.frombuffer(b"".join(pdf.lens), np.uint32).astype(np.int64)
    sure = np.frombuffer(b"".join(pdf.sure), np.uint8)
    flat = np.frombuffer(b"".join(pdf.feats), np.uint16)
    record = np.repeat(np.arange(len(pdf)), per)
    own = np.repeat(np.arange(len(lens)), lens)
    z = np.zeros(len(lens)) if odds is None else np.bincount(own, odds[flat], len(lens)) / np.sqrt(np.maximum(lens, 1))
    return np.clip(z, -CLIP, CLIP), record, sure, own, flat


def _sums(weights):
    """E and M step of a partition: expected counts of each bucket under residue and under content.

    A passage belongs to residue as far as its record does; trusted records
    and passages belong to it wholly. Bucket ``BUCKETS`` counts passages,
    the next one unlabelled records.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds = weights.value
        pos, neg = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
        for pdf in batches:
            if not len(pdf):
                continue
            z, record, sure, own, flat = passage_scores(odds, pdf)
            trusted = pdf.trusted.to_numpy(bool)
            if odds is None:
                p = np.zeros(len(pdf))
            else:
                p = 1 / (1 + np.exp(-np.clip(np.bincount(record, z, len(pdf)) + odds[BUCKETS], -30, 30)))
            pos[-1] += p[~trusted].sum()
            neg[-1] += (1 - p[~trusted]).sum()
            p = np.where(trusted, 1.0, p)[record]
            p = np.where(sure > 0, 1.0, p)
            w = pdf.weight.to_numpy(float)[record]
            pos[:-1] += np.r_[np.bincount(flat, (w * p)[own], BUCKETS), (w * p).sum()]
            neg[:-1] += np.r_[np.bincount(flat, (w * (1 - p))[own], BUCKETS), (w * (1 - p)).sum()]
        at = np.flatnonzero(pos + neg)
        yield pd.DataFrame({"bucket": at, "pos": pos[at], "neg": neg[at]})

    return run


def fit(records: DataFrame) -> np.ndarray:
    """Log-odds of residue per bucket; the last entry is the prior."""
    sc = records.sparkSession.sparkContext
    odds = None
    used = records.select("trusted", "weight", "lens", "sure", "feats")
    for _ in range(EM_STEPS):
        sums = used.mapInPandas(_sums(sc.broadcast(odds)), "bucket bigint, pos double, neg double").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        got = sums.toArrow()  # at most BUCKETS + 2 rows
        pos, neg = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
        at = got["bucket"].to_numpy()
        pos[at], neg[at] = got["pos"].to_numpy(), got["neg"].to_numpy()
        # Shares of the passages of a class that hold the bucket; the floor is a share too, so that the model is the same at every size.
        rate = lambda c: c[:BUCKETS] / max(c[BUCKETS], 1e-9) + SMOOTHING
        share = PRIOR if odds is None else float(np.clip(pos[-1] / max(pos[-1] + neg[-1], 1e-9), 0.001, 0.5))
        new = np.r_[np.log(rate(pos)) - np.log(rate(neg)), np.log(share / (1 - share))]
        seen = np.flatnonzero(pos[:BUCKETS] + neg[:BUCKETS])
        done = odds is not None and (not len(seen) or np.abs(new[seen] - odds[seen]).mean() <= CLOSE)
        odds = new
        if done:
            break
    return odds


SCORED = "retrieval_id string, score double, n_placeholders int, passage_scores array<double>"


def _score(weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds = weights.value
        for pdf in batches:
            pdf = pdf[pdf.retrieval_id.notna()].reset_index(drop=True)
            if not len(pdf):
                continue
            z, record, sure, _, _ = passage_scores(odds, pdf)
            z = np.where(sure == 2, CERTAIN, z)
            cuts = np.cumsum(pdf.lens.map(len).to_numpy() // 4)[:-1]
            yield pd.DataFrame({"retrieval_id": pdf.retrieval_id, "score": np.bincount(record, z, len(pdf)), "n_placeholders": pdf.holes, "passage_scores": np.split(z, cuts)})

    return run


def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response with a body: its score, its placeholders and the score of each passage.

    Responses count once; null and empty bodies are left out; a body without
    readable text has score 0.
    """
    res = table(spark, sf_dir, "response").where("retrieval_id is not null and body is not null and octet_length(body) > 0")
    one = res.groupBy("retrieval_id").agg(F.min(F.struct("status", "body", "content_type")).alias("b")).select("retrieval_id", "b.*")
    records = cut_lineage(fan_out(one, "retrieval_id").mapInPandas(_explode, RECORDS))
    return records.mapInPandas(_score(spark.sparkContext.broadcast(fit(records))), SCORED)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``retrieval_id, score, n_placeholders, is_residue``: the sum over the passages decides."""
    d = scored_records(spark, sf_dir).select("retrieval_id", "score", "n_placeholders")
    return d.withColumn("is_residue", F.col("score") > 0)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that show a placeholder, or filler, an error or a notice instead of a chapter or entry."""
    return decisions(spark, sf_dir).where("is_residue").select("retrieval_id")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses without those found; responses without a body stay, they show nothing."""
    found = p3_found(spark, sf_dir)
    res = table(spark, sf_dir, "response").where("retrieval_id is not null").groupBy("retrieval_id").agg(F.min(F.struct("source_id", "requested_url", "status", "content_type")).alias("b")).select("retrieval_id", "b.*")
    return res.join(found, "retrieval_id", "left_anti")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
SQL: dict[str, str] = {}
