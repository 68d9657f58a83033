"""Problem 9: combine sources so that each gives a target share of all tokens.

Method: soft-membership mixing. A classifier fitted on a labelled table
(documents whose source is known) gives every document of unknown source a
posterior over domains; distributed projected-gradient least squares then fits
nonnegative document rates whose expected token totals per domain match the
targets, each rate at most the repeats its domain allows. Rates become whole
repeats by thresholds on a hash of the document, set from token sums per hash
bucket so that the totals stay on target.

What reaches the driver: one vector of domain totals per step, and the token
sums of ``ROUND_BUCKETS`` hash buckets per domain.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fan_out, table

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled documents per domain that the classifier is fitted on, and its features.
CLASS_DOCS, FEATURES = 300, 1 << 14
#: Most steps of the descent, and the share of all tokens within which every source must then lie.
STEPS, CLOSE = 40, 1e-4
ROUND_BUCKETS = 2048
#: Posteriors are whole numbers of such parts, so that documents fall into few classes; classes that the driver fits by itself.
PARTS, FEW_CLASSES = 20, 200_000
OTHER = "(other)"

_WORD = re.compile(r"[⺀-鿿]|[^\W\d_⺀-鿿]+|[^\w\s]")


def hashed_words(text: str) -> np.ndarray:
    """Distinct hashed words and pairs of neighbours of a text."""
    toks = _WORD.findall(text.casefold())
    out = set()
    for t in toks:
        out.add(_bucket(t))
    for a, b in zip(toks, toks[1:]):
        out.add(_bucket(a + "\x1f" + b))
    return np.fromiter(out, np.int64, len(out))


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % FEATURES


def fit_classifier(texts: list[str], y: np.ndarray, k: int) -> np.ndarray:
    """Weights [FEATURES + 1, k] of naive Bayes over the hashed words that a text holds; the last row is the prior."""
    counts = np.full((FEATURES, k), 0.5)
    for t, c in zip(texts, y):
        counts[hashed_words(t), c] += 1
    w = np.zeros((FEATURES + 1, k))
    w[:FEATURES] = np.log(counts / (np.bincount(y, minlength=k) + 1.0))
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def in_parts(p: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Posteriors rounded to whole parts that still add up to one: the parts left over go to the largest remainders."""
    base = np.floor(p * parts + 1e-9)
    order = np.argsort(base - p * parts, axis=1, kind="stable")
    extra = np.arange(p.shape[1])[None, :] < (parts - base.sum(1))[:, None]
    np.put_along_axis(base, order, np.take_along_axis(base, order, 1) + extra, 1)
    return base / parts


def posteriors(w: np.ndarray, texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), w.shape[1]))
    # Words are far from independent: the evidence counts with the root of their number.
    for i, t in enumerate(texts):
        f = hashed_words(t)
        out[i] = w[f].sum(0) / np.sqrt(max(1, len(f))) + w[FEATURES]
    return _softmax(out)


_ENCODER = None


def token_count(text: str, path: str) -> int:
    global _ENCODER
    if _ENCODER is None or _ENCODER[0] != path:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODER = (path, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return len(_ENCODER[1].encode_ordinary(text))


def targets(spark: SparkSession, sf_dir: str) -> pd.DataFrame:
    """One row per source of the mix: share (scaled to sum to 1) and repeats; of repeated rows the smallest hold."""
    t = table(spark, sf_dir, "mix_target").where("source is not null and target_share > 0 and max_repeats > 0")
    pdf = t.groupBy("source").agg(F.min("target_share").alias("share"), F.min("max_repeats").alias("cap")).orderBy("source").toPandas()
    pdf["share"] = pdf.share.astype(float) / pdf.share.astype(float).sum() if len(pdf) else pdf.share
    return pdf


def memberships(spark: SparkSession, sf_dir: str, mix: pd.DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, source, n_tokens, q``: tokens and domain posterior (the mix's sources, then all others) of each document.

    A document of known source belongs to it wholly. Null texts have no
    tokens and are left out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").where("doc_id is not null and text is not null")
    names = list(mix.source)
    domain = F.when(F.col("source").isin(names), F.col("source")).otherwise(F.lit(OTHER))
    from pyspark.sql import Window

    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Only ids are ranked; the sample's texts are then read whole.
    known = docs.where("source is not null").select("doc_id", domain.alias("domain"))
    picked = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= CLASS_DOCS)
    texts = docs.where("source is not null").select("doc_id", "text", domain.alias("domain"))
    sample = texts.join(F.broadcast(picked), ["doc_id", "domain"]).orderBy("domain", "k").collect()
    labels = names + [OTHER]
    w = fit_classifier([r.text for r in sample], np.asarray([labels.index(r.domain) for r in sample]), len(labels)) if sample else np.zeros((FEATURES + 1, len(labels)))
    shared = spark.sparkContext.broadcast((w, labels, tokenizer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, classes, path = shared.value
        at = {c: i for i, c in enumerate(classes)}
        for pdf in batches:
            q = np.zeros((len(pdf), len(classes)))
            src = pdf.source.tolist()
            open_rows = [i for i, s in enumerate(src) if s is None or s != s]
            for i, s in enumerate(src):
                if s is not None and s == s:
                    q[i, at.get(s, len(classes) - 1)] = 1
            if open_rows:
                q[open_rows] = in_parts(posteriors(weights, [pdf.text.iloc[i] for i in open_rows]))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "n_tokens": [token_count(t, path) for t in pdf.text], "q": list(q)})

    return fan_out(docs).mapInPandas(run, "doc_id bigint, source string, n_tokens bigint, q array<double>")


def fit_rates(mem: DataFrame, mix: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(push of each domain after the descent, token totals at rate 1, tokens of the mix).

    The update of a document depends on the data only through the residuals of
    the domains, so a document's rate is a function of its posterior and the
    accumulated residuals: no rate is ever stored. Distinct posteriors are
    grouped once; every step is one aggregate over the groups.
    """
    k = len(mix)
    groups = cut_lineage(mem.groupBy("q").agg(F.sum("n_tokens").alias("n")))
    share, cap = mix.share.to_numpy(float), mix.cap.to_numpy(float)
    rows = groups.limit(FEW_CLASSES + 1).count()
    few = groups.toArrow() if rows <= FEW_CLASSES else None
    if few is not None:
        q, n = np.asarray(few["q"].to_pylist(), float).reshape(-1, k + 1), np.asarray(few["n"].to_pylist(), float)

    def totals(push: np.ndarray | None) -> np.ndarray:
        if few is not None:
            return (n * (1.0 if push is None else rates(q, push, cap))) @ q
        weight = F.col("n") if push is None else F.col("n") * rate_column(push, cap)
        return np.asarray([x or 0.0 for x in groups.agg(*[F.sum(weight * F.element_at("q", i + 1)).alias(f"s{i}") for i in range(k + 1)]).first()], float)

    full = totals(None)
    size = float(np.min(np.where(share > 0, full[:k] * cap / share, np.inf))) if k else 0.0
    want = np.r_[share * size, 0.0]
    scale = np.maximum(full, 1.0)
    push = np.r_[np.clip(want[:k] / scale[:k], 0, cap), 0.0]
    for _ in range(STEPS):
        got = totals(push)
        gap = (want - got) / scale
        if np.abs(gap[:k] * scale[:k]).max(initial=0) <= CLOSE * max(size, 1.0):
            break
        push = push + gap
        push[:k] = np.clip(push[:k], -cap, 2 * cap)
        push[k] = np.clip(push[k], -2 * cap.max(initial=1), 0.0)
    return push, want, size


def rates(q: np.ndarray, push: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates of classes of documents, as ``rate_column`` has them."""
    most = np.where(q[:, :-1] > 0, cap, cap.max(initial=1)).min(1, initial=cap.max(initial=1)) if len(cap) else np.zeros(len(q))
    alone = q[:, -1] >= q[:, :-1].max(1, initial=0)
    return np.where(alone, 0.0, np.clip(q @ push, 0.0, most))


def rate_column(push: np.ndarray, cap: np.ndarray):
    """Rate of a document: its posterior's mix of the domains' pushes, projected between nought and the repeats its domains allow.

    A document is taken for its likeliest domain; one whose likeliest domain is
    outside of the mix is not taken.
    """
    r = sum((F.element_at("q", i + 1) * float(v) for i, v in enumerate(push)), F.lit(0.0))
    # The least cap of the domains that the document belongs to holds; other sources have none.
    most = F.least(*[F.when(F.element_at("q", i + 1) > 0, F.lit(float(c))).otherwise(F.lit(float(cap.max(initial=1)))) for i, c in enumerate(cap)], F.lit(float(cap.max(initial=1)))) if len(cap) else F.lit(0.0)
    alone = F.element_at("q", len(cap) + 1) >= (F.array_max(F.slice("q", 1, len(cap))) if len(cap) else F.lit(0.0))
    return F.when(alone, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(r, most)))


def mixed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER_PATH) -> tuple[DataFrame, pd.DataFrame]:
    mix = targets(spark, sf_dir)
    mem = cut_lineage(memberships(spark, sf_dir, mix, tokenizer))
    push, _, _ = fit_rates(mem, mix)
    cap = mix.cap.to_numpy(float)
    names = F.array(*[F.lit(s) for s in mix.source], F.lit(OTHER))
    main = F.element_at(names, F.array_position("q", F.array_max("q")).cast("int"))
    rated = mem.withColumn("rate", rate_column(push, cap)).withColumn("domain", main).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ROUND_BUCKETS)))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    # Token sums per hash bucket: the documents of the lowest buckets get the extra copy, up to the tokens still wanted.
    sums = rated.where("part > 0").groupBy("domain", "bucket").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("part") * F.col("n_tokens")).alias("want")).toPandas()
    cut = {}
    for d, g in sums.groupby("domain"):
        g = g.sort_values("bucket")
        before = np.r_[0.0, np.cumsum(g.n.to_numpy(float))]
        goal = float(g.want.sum())
        i = int(np.searchsorted(before, goal, "right")) - 1
        i = min(i, len(g) - 1)
        inside = (goal - before[i]) / max(float(g.n.iloc[i]), 1.0)
        cut[d] = float(g.bucket.iloc[i]) + min(1.0, max(0.0, inside))
    spot = F.col("bucket") + F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) / float(1 << 20)
    limit = F.coalesce(*[F.when(F.col("domain") == d, F.lit(c)) for d, c in cut.items()], F.lit(0.0)) if cut else F.lit(0.0)
    out = rated.withColumn("repeats", (F.col("whole") + F.when((F.col("part") > 0) & (spot < limit), 1).otherwise(0)).cast("int"))
    return out, mix


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats; documents that are not chosen are left out."""
    out, _ = mixed(spark, sf_dir)
    return out.where("repeats > 0").select("doc_id", "source", F.col("domain").alias("mix_source"), "n_tokens", "repeats")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of the mix, and the share that the posteriors of the chosen documents let expect.

    ``actual_share`` books a document wholly to its likeliest domain,
    ``expected_share`` in the parts of its posterior.
    """
    out, mix = mixed(spark, sf_dir)
    out = cut_lineage(out.where("repeats > 0").select("domain", "q", "repeats", "n_tokens"))
    used = F.col("repeats") * F.col("n_tokens")
    got = out.groupBy("domain").agg(F.sum(used).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    hoped = out.groupBy("q").agg(F.sum(used).alias("n")).select(F.posexplode("q").alias("at", "part"), "n").groupBy("at").agg(F.sum(F.col("part") * F.col("n")).alias("hoped"))
    goal = spark.createDataFrame([(i, r.source, float(r.share), int(r.cap)) for i, r in enumerate(mix.itertuples())], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("domain", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType())]))
    j = F.broadcast(goal).join(got, "domain", "left").join(hoped, "at", "left").fillna(0, ["tokens", "n_docs", "most_repeats", "hoped"])
    whole = j.agg(F.sum("tokens").alias("all_tokens"), F.sum("hoped").alias("all_hoped"))
    share = lambda x, of: F.round(F.expr(f"{x} / nullif({of}, 0)"), 6)
    return j.crossJoin(F.broadcast(whole)).select(
        F.col("domain").alias("source"), "target_share", share("tokens", "all_tokens").alias("actual_share"), share("hoped", "all_hoped").alias("expected_share"), "tokens", "n_docs", "most_repeats", "max_repeats"
    )


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
