"""Problem 6: lines repeated across the documents of one site.

Method: numbers, dates and names are masked, the masked lines of each site are
clustered by locality-sensitive hashing, and clusters of near-duplicates that
stand in a large share of the site's documents are removed from each document.
The lines that are repeated exactly are those of such clusters that reach the
share by themselves, on their letters alone; clusters without such a line
stay.

Hot sites and hot lines are pre-aggregated map-side on (site, line, document);
nothing is ever gathered per site or cluster.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, cut_lineage, mix64, table

MIN_DOCS = 3
MIN_SHARE = 0.03
#: Min-hash values of a line (two bytes each), taken as bands of rows; share of them that a line has in common with its cluster's commonest.
SIGNATURE, BANDS, ROWS = 12, 6, 2
CLUSTER_AGREEMENT = 0.8

# Names of months in the languages of the sites, with customary short forms.
_MONTHS = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sept sep oct nov dec "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "januar februar märz juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
)
_DATE = re.compile(r"\d+|(?<!\w)(?:" + "|".join(sorted(_MONTHS.split(), key=len, reverse=True)) + r")(?!\w)|[〇零一二三四五六七八九十百千万]+(?=[年月日号时点分章回节卷第])", re.I)
_NAME = re.compile(r"《[^》]*》|「[^」]*」|(?<=[^\W\d_] )[A-ZÀ-ÖØ-Þ][a-zß-ÿ][\w’'-]*(?: [A-ZÀ-ÖØ-Þ][a-zß-ÿ][\w’'-]*)*")


def masked_letters(line: str, letters: str) -> str:
    """Letters of a line without its dates, quoted titles and capitalised names; those of the whole line where less than half is left.

    A capitalised word counts as a name behind another word, so the first word
    of a line stays.
    """
    t = unicodedata.normalize("NFKC", line)
    cut = _NAME.sub(" ", _DATE.sub(" ", t))
    rest = letters if cut == t else letters_of(cut)
    return rest if 2 * len(rest) >= len(letters) else letters


def site_of(locator):
    """Host without letter case, port and a leading ``www.`` or ``m.``; null for other locators."""
    host = F.lower(F.regexp_extract(locator, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.lit(""))


def letters_of(line: str) -> str:
    """Letters (category L) of a line after NFKC and case folding."""
    t = unicodedata.normalize("NFKC", line).casefold()
    return "".join(c for c in t if unicodedata.category(c)[0] == "L")


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def letters_of_all(lines: list[str]) -> list[str]:
    """The same for many lines at once."""
    cp, starts = code_points([unicodedata.normalize("NFKC", t).casefold() for t in lines])
    keep = _letters()[cp]
    run = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=run[1:])
    text = cp[keep].tobytes().decode("utf-32-le", "surrogatepass")
    at = run[starts]
    return [text[at[i] : at[i + 1]] for i in range(len(lines))]


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each text, its min-hash values [n, SIGNATURE] over runs of five letters); shorter texts use their own hash."""
    n = len(texts)
    cp, starts = code_points(texts)
    lens = np.diff(starts)
    owner = np.repeat(np.arange(n), lens)
    pos = np.arange(len(cp)) - np.repeat(starts[:-1], lens)
    own = np.zeros(n, np.uint64)
    some = lens > 0
    with np.errstate(over="ignore"):
        if some.any():
            h = mix64(cp.astype(np.uint64) + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            own[some] = mix64(np.add.reduceat(h, starts[:-1][some]) + lens[some].astype(np.uint64))
        sig = np.repeat((own >> np.uint64(48)).astype(np.uint16)[:, None], SIGNATURE, 1)
        m = len(cp) - 4
        if m > 0:
            acc = np.zeros(m, np.uint64)
            for j in range(5):
                acc = acc * np.uint64(0x100000001B3) + cp[j : j + m]
            ok = owner[:m] == owner[4:]
            s, o = mix64(acc[ok]), owner[:m][ok]
            if len(s):
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                for k in range(SIGNATURE):
                    c = np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15)
                    low = np.minimum.reduceat((s ^ c) * np.uint64(0xD6E8FEB86659FD93), first)
                    sig[o[first], k] = (mix64(low) >> np.uint64(48)).astype(np.uint16)
    return own.view(np.int64), sig


def document_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``doc, site`` of the chapter references; ``doc`` is the hash of the document."""
    c = table(spark, sf_dir, "chapter_ref").where("document_id is not null").select(F.xxhash64("document_id").alias("doc"), site_of(F.col("source_locator")).alias("site"))
    return c.where("site is not null").distinct()


LINES = "doc bigint, segment_id string, line_no int, letters bigint, masked bigint, sig binary"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 4000):
            part = pdf.iloc[lo : lo + 4000]
            split = [t.split("\n") for t in part.normalized_text]
            counts = np.fromiter((len(x) for x in split), np.int64, len(split))
            at = np.repeat(np.arange(len(split)), counts)
            line_no = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            lines = [ln for x in split for ln in x]
            letters = letters_of_all(lines)
            kept = np.flatnonzero(np.fromiter((len(t) > 0 for t in letters), bool, len(letters)))
            if not len(kept):
                continue
            letters = [letters[i] for i in kept]
            own = signatures_hash(letters)
            masked, sig = signatures([masked_letters(lines[i], t) for i, t in zip(kept, letters)])
            raw = sig.astype(">u2").tobytes()
            width = 2 * SIGNATURE
            yield pd.DataFrame(
                {"doc": part.doc.values[at[kept]], "segment_id": part.segment_id.values[at[kept]], "line_no": line_no[kept].astype(np.int32), "letters": own, "masked": masked, "sig": [raw[k * width : (k + 1) * width] for k in range(len(kept))]}
            )


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site, doc, segment_id, line_no, letters, masked, sig`` of every line with letters of a document with a site.

    ``doc``, ``letters`` and ``masked`` are hashes of 64 bits; ``sig`` is the
    min-hash signature of the masked line. Texts are read once, in one Arrow
    pass; only hashes move on. A document on two sites counts on both.
    """
    seg = table(spark, sf_dir, "segment").select("document_id", "segment_id", "normalized_text").where("segment_id is not null and document_id is not null and normalized_text is not null")
    seg = seg.select(F.xxhash64("document_id").alias("doc"), "segment_id", "normalized_text")
    return seg.mapInPandas(_lines, LINES).join(document_sites(spark, sf_dir), "doc")


def signatures_hash(texts: list[str]) -> np.ndarray:
    """Hash of each text alone."""
    cp, starts = code_points(texts)
    lens = np.diff(starts)
    pos = np.arange(len(cp)) - np.repeat(starts[:-1], lens)
    own = np.zeros(len(texts), np.uint64)
    some = lens > 0
    with np.errstate(over="ignore"):
        if some.any():
            h = mix64(cp.astype(np.uint64) + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            own[some] = mix64(np.add.reduceat(h, starts[:-1][some]) + lens[some].astype(np.uint64))
    return own.view(np.int64)


def _limit():
    """Documents in which a line or cluster of a site must stand."""
    return F.greatest(F.lit(MIN_DOCS), F.ceil(F.col("site_docs") * MIN_SHARE - 1e-9))


def clusters(per: DataFrame, sizes: DataFrame) -> DataFrame:
    """``site, masked, cluster_id``: masked lines in clusters that may have a high document frequency.

    ``per`` has ``site, masked, n_docs, sig``. Lines of a site that share an
    LSH band are clustered around the band's commonest line when they agree
    with it in ``CLUSTER_AGREEMENT`` of their min-hash values; any other line
    is a cluster of its own. Bands and clusters whose lines together cannot
    reach the limit are left out (a document counts once for each of its lines
    here, so none is lost).
    """
    width = 2 * ROWS
    keys = F.array(*[F.substring("sig", b * width + 1, width) for b in range(BANDS)])
    band = per.select("site", "masked", "n_docs", F.posexplode(keys).alias("band", "key"))
    on = ["site", "band", "key"]
    heads = (
        band.groupBy(*on)
        .agg(F.sum("n_docs").alias("docs"), F.count("*").alias("n_lines"), F.max_by("masked", F.struct("n_docs", "masked")).alias("head"))
        .where("n_lines > 1")
        .join(sizes, "site")
        .where(F.col("docs") >= _limit())
        .select(*on, "head")
    )
    member = band.join(heads, on).where("masked <> head").select("site", "masked", "head").distinct()
    own = per.select("site", "masked", "sig")
    near = member.join(own, ["site", "masked"]).join(own.withColumnsRenamed({"masked": "head", "sig": "head_sig"}), ["site", "head"])
    agree = sum((F.substring("sig", 2 * i + 1, 2) == F.substring("head_sig", 2 * i + 1, 2)).cast("int") for i in range(SIGNATURE))
    near = near.where(agree >= CLUSTER_AGREEMENT * SIGNATURE).groupBy("site", "masked").agg(F.min("head").alias("cluster_id"))
    placed = per.join(near, ["site", "masked"], "left").select("site", "masked", "n_docs", F.coalesce("cluster_id", "masked").alias("cluster_id"))
    heavy = placed.groupBy("site", "cluster_id").agg(F.sum("n_docs").alias("docs")).join(sizes, "site").where(F.col("docs") >= _limit()).select("site", "cluster_id")
    return placed.drop("n_docs").join(heavy, ["site", "cluster_id"])


def site_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sites(spark, sf_dir).groupBy("site").agg(F.count("*").alias("site_docs"))


def repeated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(all lines, those of heavy clusters with an exactly repeated line: ``site, letters, n_docs, site_docs, cluster_id, is_exact``).

    ``n_docs`` counts the documents of the site that hold the line's letters;
    ``is_exact`` says that it reaches the limit by itself. One line of each
    letters speaks for its masked form.
    """
    lines = cut_lineage(lines_of(spark, sf_dir))
    sizes = site_sizes(spark, sf_dir)
    form = F.min(F.struct("masked", "sig")).alias("form")
    per = lines.groupBy("site", "letters", "doc").agg(form).groupBy("site", "letters").agg(F.count("*").alias("n_docs"), F.min("form").alias("form"))
    per = cut_lineage(per.select("site", "letters", "n_docs", "form.*"))
    nodes = cut_lineage(per.groupBy("site", "masked").agg(F.sum("n_docs").alias("n_docs"), F.min("sig").alias("sig")))
    found = per.drop("sig").join(clusters(nodes, sizes), ["site", "masked"]).join(sizes, "site").withColumn("is_exact", F.col("n_docs") >= _limit())
    found = cut_lineage(found.drop("masked"))
    # Sentences of one pattern are near-duplicates too: a cluster counts where one of its lines is repeated enough letter by letter.
    return lines, found.join(found.where("is_exact").select("site", "cluster_id").distinct(), ["site", "cluster_id"], "left_semi")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence of a line that stands in at least 3 documents and 3 % of the documents of its site.

    Lines are those of the heavy clusters whose own letters reach the limit.
    """
    lines, rep = repeated(spark, sf_dir)
    return lines.join(rep.where("is_exact"), ["site", "letters"], "left_semi").select("segment_id", "line_no").distinct()


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines of each site with a place where each stands, their counts and cluster; near-duplicates have ``is_exact`` false."""
    lines, rep = repeated(spark, sf_dir)
    place = cut_lineage(lines.join(rep.select("site", "letters", "cluster_id"), ["site", "letters"]).select("site", "letters", "cluster_id", "doc", "segment_id", "line_no"))
    docs = place.select("site", "cluster_id", "doc").distinct().groupBy("site", "cluster_id").agg(F.count("*").alias("cluster_docs"))
    first = place.groupBy("site", "letters").agg(F.min(F.struct("segment_id", "line_no")).alias("p")).select("site", "letters", "p.*")
    out = rep.join(first, ["site", "letters"]).join(docs, ["site", "cluster_id"])
    text = table(spark, sf_dir, "segment").join(first.select("segment_id").distinct(), "segment_id", "left_semi").groupBy("segment_id").agg(F.min("normalized_text").alias("t"))
    return out.join(text, "segment_id").select(
        "site", F.get(F.split("t", "\n"), F.col("line_no") - 1).alias("line"), "segment_id", "line_no", "n_docs", "site_docs", F.round(F.col("n_docs") / F.col("site_docs"), 6).alias("share"), "cluster_id", "cluster_docs", "is_exact"
    )


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment without the lines of heavy clusters, near-duplicates included; a segment of nothing else comes out empty."""
    lines, rep = repeated(spark, sf_dir)
    cut = lines.join(rep, ["site", "letters"], "left_semi").groupBy("segment_id").agg(F.collect_set("line_no").alias("cut"))
    seg = table(spark, sf_dir, "segment").where("segment_id is not null").groupBy("segment_id", "document_id").agg(F.min("normalized_text").alias("normalized_text"))
    kept = F.filter(F.split("normalized_text", "\n"), lambda _, i: ~F.array_contains("cut", i + 1))
    return seg.join(cut, "segment_id", "left").select(
        "document_id", "segment_id", F.when(F.col("cut").isNull(), F.col("normalized_text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_removed")
    )


QUERIES = {"p6_found": p6_found, "p6_lines": p6_lines, "p6_clean": p6_clean}
SQL: dict[str, str] = {}
