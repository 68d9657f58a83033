"""Problem 10: abusive, hateful or sexually explicit language.

Method: a bidirectional gated recurrent network with attention pooling over
character and word inputs, trained in numpy and scoring all overlapping windows
of every document. Labels belong to whole documents while an abusive passage is
a sentence or two, so training is multiple-instance: a document is as abusive
as its worst window.

The network is fitted on at most ``LABEL_DOCS`` labelled documents; every
document is scored over its whole text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fan_out, table

#: Bounds on the labelled documents that the network is fitted on, abusive and other; together ``LABEL_DOCS``.
ABUSIVE_DOCS, OTHER_DOCS = 850, 1150
LABEL_DOCS = ABUSIVE_DOCS + OTHER_DOCS
WORDS, GRAMS = 1 << 14, 1 << 12
DIM, HID, ATT = 16, 12, 8
WINDOW, STEP = 24, 1
#: Tokens of a chunk in training and in scoring; chunks overlap so that every window lies whole in one.
TRAIN_CHUNK, CHUNK = 48, 160
EPOCHS = 10
#: Words of fewer documents have no embedding of their own; share of tokens left out at random; weight decay; epochs before labels are doubted.
RARE, DROP, DECAY, TRUST_AFTER = 3, 0.2, 2e-3, 3
#: Logits below and above which a positive and a negative document are then taken for errors of their annotators.
DOUBT = (-0.5, 1.0)
THRESHOLD = 0.7

_TOKEN = re.compile(r"[⺀-鿿\U00020000-\U0003ffff]|[^\W_⺀-鿿]+(?:[*@$!|'’]+[^\W_⺀-鿿]+)*")
_RUN = re.compile(r"([^\W\d_⺀-鿿])\1{2,}")
_FORMAT = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]+")
# Digits and signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})


def normalised(text: str) -> str:
    """Compatibility form without letter case and invisible characters."""
    if text.isascii():
        return text.lower()
    return _FORMAT.sub("", unicodedata.normalize("NFKC", text).casefold())


def canonical(token: str) -> str:
    """One spelling for a word: numbers alike, letters for the signs that stand for them, drawn-out letters once."""
    if token.isdigit():
        return "0"
    if not token.isalpha():
        token = token.translate(_LEET)
    return _RUN.sub(r"\1", token)


def words_of(text: str) -> list[str]:
    """Words and ideographs of a text; marks between them fall away, so that split spellings of ideographs join again."""
    return _TOKEN.findall(normalised(text))


def joined(words: list[str]) -> list[str]:
    """Runs of four or more single letters as one word: letters that were set apart."""
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha() and w < "⺀":
            run.append(w)
            continue
        out += ["".join(run)] if len(run) >= 4 else run
        run = []
        if w:
            out.append(w)
    return out


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def inputs_of(token: str) -> tuple[int, list[int]]:
    """(word bucket, character buckets) of a token: single ideographs, or three-letter pieces of a word."""
    if token[-1] >= "⺀":
        chars = [_hash("c" + token[-1]) % GRAMS]
    else:
        w = f"<{token}>"
        chars = [_hash(w[i : i + 3]) % GRAMS for i in range(max(1, len(w) - 2))]
    return _hash("w" + token) % WORDS, chars


class Vocabulary:
    """Tokens met so far with their inputs; index 0 is padding. Spellings of one word share an index."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.word: list[int] = [0]
        self.grams: list[list[int]] = [[]]
        self.letter: list[bool] = [False]
        self._alone, self._filled = np.zeros(1024, bool), 0

    def _add(self, token: str) -> int:
        c = canonical(token)
        k = self.index.get(c)
        if k is None:
            w, g = inputs_of(c)
            k = self.index[c] = len(self.word)
            self.word.append(w)
            self.grams.append(g)
            self.letter.append(len(c) == 1 and c.isalpha() and c < "⺀")
        self.index[token] = k
        return k

    def ids(self, text: str) -> np.ndarray:
        """Indexes of the tokens of a text; an ideograph carries the one before it, so that pairs are words too."""
        out = self._ids(words_of(text))
        if len(self._alone) < len(self.letter):
            self._alone = np.zeros(2 * len(self.letter), bool)
            self._filled = 0
        self._alone[self._filled : len(self.letter)] = self.letter[self._filled :]
        self._filled = len(self.letter)
        alone = self._alone[out] if len(out) >= 4 else np.zeros(0, bool)
        if len(alone) and (alone[:-3] & alone[1:-2] & alone[2:-1] & alone[3:]).any():
            out = self._ids(joined(words_of(text)))
        return out

    def _ids(self, words: list[str]) -> np.ndarray:
        get, add, out, before = self.index.get, self._add, [], ""
        for w in words:
            if w >= "⺀" and len(w) == 1:
                key = before + w
                before = w
            else:
                key, before = w, ""
            k = get(key)
            out.append(add(key) if k is None else k)
        return np.asarray(out, np.int32)

    def vectors(self, p: dict, lo: int = 0) -> np.ndarray:
        """Input vectors of the tokens from index ``lo`` on: word embedding plus the mean of the character embeddings."""
        lens = np.asarray([len(g) for g in self.grams[lo:]], np.int64)
        flat = np.asarray([v for g in self.grams[lo:] for v in g], np.int64)
        x = p["Ew"][np.asarray(self.word[lo:], np.int64)] + mean_rows(p["Ec"][flat], lens)
        if lo == 0:
            x[0] = 0
        return x


def mean_rows(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Means of consecutive runs of rows; the mean of no rows is zero."""
    out = np.zeros((len(lens), rows.shape[1]), np.float32)
    some = lens > 0
    if some.any():
        at = np.cumsum(lens) - lens
        out[some] = np.add.reduceat(rows, at[some], 0) / lens[some][:, None].astype(np.float32)
    return out


def add_rows(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """``out[index] += rows`` with repeated indexes."""
    order = np.argsort(index, kind="stable")
    idx = index[order]
    first = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]]) if len(idx) else idx
    if len(idx):
        out[idx[first]] += np.add.reduceat(rows[order], first, 0)


def init(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)

    def w(*s):
        return (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)

    p = {"Ew": (0.1 * r.standard_normal((WORDS, DIM))).astype(np.float32), "Ec": (0.1 * r.standard_normal((GRAMS, DIM))).astype(np.float32)}
    for d in "fb":
        p["W" + d], p["U" + d], p["b" + d] = w(DIM, 3 * HID), w(HID, 3 * HID), np.zeros(3 * HID, np.float32)
    p["A"], p["a"], p["v"] = w(2 * HID, ATT), np.zeros(ATT, np.float32), w(ATT, 1)[:, 0]
    p["w"], p["b"] = w(2 * HID, 1)[:, 0], np.full(1, -2.0, np.float32)
    return p


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def gru(proj: np.ndarray, u: np.ndarray, keep: bool = False):
    """States of a gated recurrent layer over time-major projections [T, B, 3H]; with what its gradient needs."""
    t_len, b = proj.shape[:2]
    h = np.zeros((b, HID), np.float32)
    out = np.empty((t_len, b, HID), np.float32)
    tape = []
    for t in range(t_len):
        g = proj[t]
        a = h @ u
        zr = _sigmoid(g[:, : 2 * HID] + a[:, : 2 * HID])
        z, r = zr[:, :HID], zr[:, HID:]
        n = np.tanh(g[:, 2 * HID :] + r * a[:, 2 * HID :])
        if keep:
            tape.append((h, z, r, n, a[:, 2 * HID :]))
        h = n + z * (h - n)
        out[t] = h
    return out, tape


def gru_gradient(dout: np.ndarray, tape: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the projections, gradient of u) from the gradient of the states."""
    t_len, b = dout.shape[:2]
    dproj = np.empty((t_len, b, 3 * HID), np.float32)
    du = np.zeros_like(u)
    dh = np.zeros((b, HID), np.float32)
    for t in range(t_len - 1, -1, -1):
        h, z, r, n, an = tape[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dproj[t] = np.concatenate([dz, dr, dn], 1)
        da = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dproj, du


def window_logits(p: dict, hs: np.ndarray, real: np.ndarray):
    """(logit of every window [n, B], attention score, value) from states [T, B, 2H] and the mask of real tokens."""
    act = np.tanh(hs @ p["A"] + p["a"])
    s = act @ p["v"]
    e = np.where(real, np.exp(np.clip(s, -15, 15)), np.float32(0))
    u = hs @ p["w"]
    t_len = hs.shape[0]
    at = np.arange(0, max(1, t_len - WINDOW + 1), STEP)
    zero = np.zeros((1, hs.shape[1]))
    ce, cu = np.concatenate([zero, np.cumsum(e, 0, dtype=np.float64)]), np.concatenate([zero, np.cumsum(e * u, 0, dtype=np.float64)])
    hi = np.minimum(at + WINDOW, t_len)
    den = ce[hi] - ce[at]
    logit = np.where(den > 1e-9, (cu[hi] - cu[at]) / np.maximum(den, 1e-9) + p["b"][0], -30.0)
    return logit, e, u, act, at, hi, den


def states(p: dict, table_f: np.ndarray, table_b: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Both directions over chunks ``ids`` [B, T]."""
    tm = ids.T
    f, tf = gru(table_f[tm], p["Uf"], keep)
    bk, tb = gru(table_b[tm[::-1]], p["Ub"], keep)
    return np.concatenate([f, bk[::-1]], 2), tf, tb


def chunked(docs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunks [n, size] padded with 0, document of each): every window of a document lies whole in one chunk."""
    hop = size - (WINDOW - STEP)
    parts, own = [], []
    for i, d in enumerate(docs):
        for at in range(0, max(1, len(d) - (WINDOW - STEP)), hop):
            c = np.zeros(size, np.int32)
            s = d[at : at + size]
            c[: len(s)] = s
            parts.append(c)
            own.append(i)
    return (np.stack(parts) if parts else np.zeros((0, size), np.int32)), np.asarray(own, np.int64)


def chunk_scores(p: dict, tf: np.ndarray, tb: np.ndarray, chunks: np.ndarray, batch: int = 1024) -> np.ndarray:
    """Highest window logit of each chunk."""
    out = np.empty(len(chunks), np.float32)
    for lo in range(0, len(chunks), batch):
        c = chunks[lo : lo + batch]
        hs, _, _ = states(p, tf, tb, c)
        out[lo : lo + batch] = window_logits(p, hs, c.T > 0)[0].max(0)
    return out


def gradient(p: dict, x: np.ndarray, chunks: np.ndarray, target: np.ndarray, weight: np.ndarray):
    """(gradients, gradient of the input vectors) of the chunks' highest windows against their targets.

    ``chunks`` index the rows of ``x``; row 0 is padding.
    """
    b, t_len = chunks.shape
    tf, tb = x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]
    hs, tape_f, tape_b = states(p, tf, tb, chunks, True)
    real = chunks.T > 0
    logit, e, u, act, at, hi, den = window_logits(p, hs, real)
    k = logit.argmax(0)
    best = logit[k, np.arange(b)]
    prob = 1 / (1 + np.exp(-best))
    dl = (weight * (prob - target) / b).astype(np.float32)
    steps = np.arange(t_len)[:, None]
    inside = (steps >= at[k]) & (steps < hi[k]) & real
    alpha = np.where(inside, e / np.maximum(den[k, np.arange(b)], 1e-9), 0).astype(np.float32)
    du = alpha * dl
    ds = (alpha * (u - (best - p["b"][0])) * dl).astype(np.float32)
    g = {"b": np.array([dl.sum()], np.float32), "w": np.einsum("tbh,tb->h", hs, du), "v": np.einsum("tba,tb->a", act, ds)}
    dact = ds[:, :, None] * p["v"] * (1 - act * act)
    g["A"], g["a"] = np.einsum("tbh,tba->ha", hs, dact), dact.sum((0, 1))
    dhs = du[:, :, None] * p["w"] + dact @ p["A"].T
    dpf, g["Uf"] = gru_gradient(np.ascontiguousarray(dhs[:, :, :HID]), tape_f, p["Uf"])
    dpb, g["Ub"] = gru_gradient(np.ascontiguousarray(dhs[::-1, :, HID:]), tape_b, p["Ub"])
    tm = chunks.T
    dtf, dtb = np.zeros_like(tf), np.zeros_like(tb)
    add_rows(dtf, tm.ravel(), dpf.reshape(-1, 3 * HID))
    add_rows(dtb, tm[::-1].ravel(), dpb.reshape(-1, 3 * HID))
    dtf[0] = dtb[0] = 0
    g["Wf"], g["bf"], g["Wb"], g["bb"] = x.T @ dtf, dtf.sum(0), x.T @ dtb, dtb.sum(0)
    return g, dtf @ p["Wf"].T + dtb @ p["Wb"].T


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of the network from labelled documents (labels from 0 to 1, the mean of the annotators).

    Words of fewer than ``RARE`` documents are known by their characters only.
    Annotators err: once the network has learned the common cases, documents
    that contradict it clearly no longer count. Weights that no example
    touched are set to zero, so unknown words add nothing by chance.
    """
    vocab = Vocabulary()
    docs = [vocab.ids(t) for t in texts]
    p = init(seed)
    rng = np.random.default_rng(seed)
    hard = labels >= 0.5
    y = np.where(labels == 0.5, 0.5, np.where(hard, 0.95, 0.03)).astype(np.float32)
    chunks, own = chunked(docs, TRAIN_CHUNK)
    n = len(vocab.word)
    if not len(chunks) or hard.all() or not hard.any():
        return p
    pos, neg = np.zeros(n), np.zeros(n)
    for d, h in zip(docs, hard):
        (pos if h else neg)[np.unique(d)] += 1
    words, lens = np.asarray(vocab.word, np.int64), np.asarray([len(g) for g in vocab.grams], np.int64)
    rare = pos + neg < RARE
    flat = np.asarray([v for g in vocab.grams for v in g], np.int64)
    gram_at = np.cumsum(lens) - lens
    used_w, used_c = np.zeros(WORDS, bool), np.zeros(GRAMS, bool)
    used_w[words[~rare]] = True
    used_c[flat] = True
    p["Ew"][~used_w] = 0
    p["Ec"][~used_c] = 0

    def vectors(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ln = lens[ids]
        at = np.repeat(gram_at[ids] - (np.cumsum(ln) - ln), ln) + np.arange(ln.sum())
        x = np.where(rare[ids][:, None], np.float32(0), p["Ew"][words[ids]]) + mean_rows(p["Ec"][flat[at]], ln)
        x[ids == 0] = 0
        return x, ln, flat[at]

    # Where to look first: chunks whose tokens are commoner in labelled documents of their class.
    odds = np.log((pos + 0.3) / (hard.sum() + 1)) - np.log((neg + 0.3) / ((~hard).sum() + 1))
    odds[rare] = 0
    odds[0] = 0
    first = np.sort(odds[chunks], 1)[:, -6:].sum(1)
    m, v2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    starts = np.searchsorted(own, np.arange(len(docs) + 1))
    every = np.arange(n)
    for epoch in range(epochs):
        if epoch == 0:
            score = first
        else:
            x = vectors(every)[0]
            score = chunk_scores(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], chunks)
        pick, target = [], []
        for i in range(len(docs)):
            c = np.arange(starts[i], starts[i + 1])
            if not len(c):
                continue
            rank = c[np.argsort(-score[c], kind="stable")]
            if epoch >= TRUST_AFTER and (hard[i] and score[rank[0]] < DOUBT[0] or not hard[i] and score[rank[0]] > DOUBT[1]):
                continue
            take = rank[:1] if hard[i] else np.r_[rank[:2], rng.choice(c, 1)]
            pick += list(take)
            target += [y[i]] * len(take)
        pick, target = np.asarray(pick), np.asarray(target, np.float32)
        weight = np.where(target > 0.3, max(1.0, (target <= 0.3).sum() / max(1, (target > 0.3).sum()) * 0.5), 1.0).astype(np.float32)
        for lo_perm in range(2):
            perm = rng.permutation(len(pick))
            for lo in range(0, len(perm), 128):
                sel = perm[lo : lo + 128]
                c = chunks[pick[sel]]
                c = np.where(rng.random(c.shape) < DROP, 0, c)
                ids, inv = np.unique(np.r_[0, c.ravel()], return_inverse=True)
                x, ln, gr = vectors(ids)
                g, dx = gradient(p, x, inv[1:].reshape(c.shape), target[sel], weight[sel])
                dx[0] = 0
                g["Ew"], g["Ec"] = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
                add_rows(g["Ew"], words[ids][~rare[ids]], dx[~rare[ids]])
                add_rows(g["Ec"], gr, np.repeat(dx / np.maximum(ln, 1)[:, None].astype(np.float32), ln, 0))
                step += 1
                rate = 0.01 * min(1.0, 2 * (1 - epoch / epochs))
                for k in p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.01 * (g[k] * g[k] - v2[k])
                    p[k] -= (rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6) + (DECAY * p[k] if k[0] in "WUE" else 0))).astype(np.float32)
    return p


class Scorer:
    """Scores documents; tables of projected inputs grow with the tokens met."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.vocab = p, Vocabulary()
        self.tf = np.zeros((1, 3 * HID), np.float32) + p["bf"]
        self.tb = np.zeros((1, 3 * HID), np.float32) + p["bb"]

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.vocab.word) > 400_000:
            self.__init__(self.p)
        docs = [self.vocab.ids(t) if t else np.zeros(0, np.int32) for t in texts]
        known = len(self.tf)
        if len(self.vocab.word) > known:
            x = self.vocab.vectors(self.p, known)
            self.tf = np.concatenate([self.tf, x @ self.p["Wf"] + self.p["bf"]])
            self.tb = np.concatenate([self.tb, x @ self.p["Wb"] + self.p["bb"]])
        out = np.full(len(texts), -30.0, np.float32)
        chunks, own = chunked(docs, CHUNK)
        if len(chunks):
            np.maximum.at(out, own, chunk_scores(self.p, self.tf, self.tb, chunks))
        return out


def labelled(spark: SparkSession, sf_dir: str) -> tuple[list[str], np.ndarray, float]:
    """(texts, mean labels, shift of the log-odds) of the labelled documents that the network is fitted on.

    At most ``ABUSIVE_DOCS`` and ``OTHER_DOCS`` of each class, those with the
    lowest hash of their id. Where that changes the share of abusive documents
    among the labels, the shift takes it back.
    """
    lab = table(spark, sf_dir, "abuse_label").where("doc_id is not null and is_abusive is not null")
    lab = lab.groupBy("doc_id", "annotator").agg(F.max("is_abusive").alias("v")).groupBy("doc_id").agg(F.avg("v").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos, neg = F.col("label") >= 0.5, F.col("label") < 0.5
    pick = lab.where(pos).orderBy(*order).limit(ABUSIVE_DOCS).unionByName(lab.where(neg).orderBy(*order).limit(OTHER_DOCS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    rows = docs.join(F.broadcast(pick), "doc_id").orderBy("doc_id").collect()
    n_pos, n_neg = lab.agg(F.count_if(pos), F.count_if(neg)).first()
    y = np.asarray([r.label for r in rows], np.float64)
    k_pos, k_neg = int((y >= 0.5).sum()), int((y < 0.5).sum())
    shift = float(np.log(n_pos / n_neg) - np.log(k_pos / k_neg)) if min(n_pos, n_neg, k_pos, k_neg) > 0 else 0.0
    return [r.text for r in rows], y, shift


def score_documents(docs: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, score``: probability that the document's worst window is abusive; null and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(shared.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                z = s.logits(part.text.tolist())
                yield pd.DataFrame({"doc_id": part.doc_id.values, "score": 1 / (1 + np.exp(-z.astype(float)))})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    texts, labels, shift = labelled(spark, sf_dir)
    p = fit(texts, labels)
    p["b"] = p["b"] + np.float32(shift)
    return score_documents(fan_out(table(spark, sf_dir, "documents").select("doc_id", "text")), p)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexually explicit passage."""
    return p10_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents and mean score per source; documents without a source under null."""
    s = p10_scores(spark, sf_dir).groupBy("doc_id").agg(F.max("score").alias("score"))
    src = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("source").alias("source"))
    j = src.join(s, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= THRESHOLD).alias("n_abusive"), F.round(F.avg("score"), 6).alias("mean_score")).withColumn("abusive_share", F.round(F.col("n_abusive") / F.col("n_docs"), 6))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_source_rates": p10_source_rates}
SQL: dict[str, str] = {}
