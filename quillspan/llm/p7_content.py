"""Problem 7: the chapter or entry of a page without menus, notices, side blocks, comments and footers.

Method: site style tree. The DOMs of one host are merged by style path (tags
and class or id of an element and its ancestors, with the make-up of its
block children). Content importance of a text is high when few pages of the
host carry it; presentation importance of a style is the important text it
holds per page. The most important style of a page is its main branch; branches
and texts of low importance are removed.

One Arrow pass turns pages into text nodes with hashed style and content keys;
all merging over hosts is aggregation in the JVM, combined before any shuffle,
so a hot host is never gathered.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, small, table
from .p6_lines import site_of

#: A text carried by this share of the pages of a host (and at least three) is not content; short texts need more.
NOISE_SHARE, SHORT_SHARE, MIN_PAGES = 0.12, 0.5, 3
#: Beside the main style of a region, a style is kept when this share of its texts is not noise.
STYLE_IMPORTANCE = 0.75

_FORMAT = {"b", "i", "em", "strong", "font", "u", "small", "sup", "sub", "mark", "ruby", "rt", "rb", "abbr", "cite", "q", "s", "tt", "code", "big"}
_EMPTY = {"br", "wbr", "hr", "img"}
_HIDDEN = {"head", "title", "style", "script", "noscript", "template", "meta", "link", "svg"}
_NEVER = {"nav", "footer", "aside", "button", "form", "select", "option"}
_SPACE = re.compile(r"\s+")
_QUOTED = re.compile(r"《[^》]*》|「[^」]*」")
_NUMBER = re.compile(r"[0-9０-９]+|[一二三四五六七八九十百千零〇]{2,}")
_CAPITAL = re.compile(r"\b[^\W\d_a-zß-öø-ÿ一-鿿][\w’'-]*(?: [^\W\d_a-zß-öø-ÿ一-鿿][\w’'-]*)*")


def content_key(text: str) -> tuple[int, int]:
    """(hash, words) of a text with numbers, quoted titles and capitalised names masked."""
    t = _SPACE.sub(" ", unicodedata.normalize("NFKC", text)).strip()
    t = _QUOTED.sub("《》", t)
    t = _NUMBER.sub("0", t)
    first = t[:1]
    t = first + _CAPITAL.sub("N", t[1:])
    words = sum(1 for w in re.findall(r"[一-鿿]|[^\W\d_]+", t) if w != "N")
    return hash_text(t), words


def _h(parts) -> int:
    return hash_text("\x1f".join(parts))


def hash_text(t: str) -> int:
    """Signed 64-bit hash of a text, the same on every executor."""
    return int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_nodes(nos, parents, tags, classes, texts) -> list[tuple]:
    """Text nodes of a page: ``(node_no, region, region_end, place, group, style, key, words, chars, heading, blocked, is_block)``.

    Elements are numbered in document order from the roots, however deep they
    stand: ``place`` is the node's number, ``region`` and ``region_end`` are
    the first number of the element that holds the text's block (or of the
    block itself when it mixes text with blocks) and the first behind it.
    ``group`` is the style path of region and block. Parents that are missing,
    or that lead back to their own node, make a root.
    """
    at = {n: k for k, n in enumerate(nos)}
    kids: list[list[int]] = [[] for _ in nos]
    up = [-1] * len(nos)
    for k, p in enumerate(parents):
        j = at.get(p, -1) if p is not None else -1
        if j >= 0 and j != k:
            up[k] = j
            kids[j].append(k)
    # Numbers in document order, from the roots down; what only a circle of parents holds begins at its first node.
    place, leave, order = [-1] * len(nos), [0] * len(nos), []
    for root in [*(k for k in range(len(nos)) if up[k] < 0), *range(len(nos))]:
        if place[root] >= 0:
            continue
        up[root] = -1
        todo = [root]
        while todo:
            k = todo.pop()
            if k < 0:
                leave[~k] = len(order)
                continue
            place[k] = len(order)
            order.append(k)
            todo.append(~k)
            kids[k] = [c for c in kids[k] if place[c] < 0 and up[c] == k]
            todo += reversed(kids[k])
    has_text = [t is not None and bool(t.strip()) for t in texts]
    title = ""
    for k, t in enumerate(tags):
        if t == "title" and has_text[k]:
            title = _SPACE.sub("", unicodedata.normalize("NFKC", texts[k]))
            break

    def inline(k: int) -> bool:
        """Part of its parent's running text: formatting always, a link or span where the parent has text of its own."""
        return tags[k] in _FORMAT or tags[k] in ("a", "span") and up[k] >= 0 and has_text[up[k]] and tags[up[k]] not in ("body", "td", "main", "article", "section", "html")

    sig = []
    for k, t in enumerate(tags):
        made = sorted({tags[c] + ("+" if tags[c] in ("span", "a") and inline(c) else "") for c in kids[k] if tags[c] not in _FORMAT and tags[c] not in _EMPTY})
        if t in ("p", "span", "li", "div") and made and all(m == "a+" for m in made):
            made = []  # a link within a paragraph is no style of its own
        sig.append(f"{t}.{classes[k] or ''}({','.join(made) if len(made) <= 6 else '*'})")
    # What a node has from its ancestors: hidden, blocked, the block it belongs to and the style path above it.
    hidden, blocked, block, above = [False] * len(nos), [False] * len(nos), list(range(len(nos))), [0] * len(nos)
    for k in order:
        j = up[k]
        hidden[k] = tags[k] in _HIDDEN or j >= 0 and hidden[j]
        blocked[k] = tags[k] in _NEVER or j >= 0 and blocked[j]
        if j >= 0:
            above[k] = _h([str(above[j]), f"{tags[j]}.{classes[j] or ''}"])
            if inline(k):
                block[k] = block[j]
    out = []
    for k in range(len(nos)):
        if not has_text[k] or hidden[k]:
            continue
        b = block[k]
        mixed = any(tags[c] not in _FORMAT and tags[c] not in _EMPTY and not inline(c) for c in kids[b])
        region = b if mixed or up[b] < 0 else up[b]
        group = _h([sig[b], f"{tags[region]}.{classes[region] or ''}", str(above[region])])
        own = _SPACE.sub("", unicodedata.normalize("NFKC", texts[k]))
        heading = tags[b] in ("h1", "h2") or (len(own) >= 2 and bool(title) and title.startswith(own) and tags[b] in ("div", "p", "h3", "h4", "header", "center", "td"))
        key, words = content_key(texts[k])
        style = _h([sig[b] if k == b else sig[b] + "/" + tags[k], sig[region]])
        out.append((nos[k], place[region], leave[region], place[k], group, style, key, words, len(own), heading and not blocked[k], blocked[k], k == b))
    return out


TEXTS = "host string, retrieval_id string, node_no int, region int, region_end int, place int, grp bigint, style bigint, key bigint, words int, chars int, heading boolean, blocked boolean, is_block boolean"


def _flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in TEXTS.split(", ")]
    for pdf in batches:
        rows = []
        for host, ident, nos, parents, tags, classes, texts in zip(pdf.host, pdf.retrieval_id, pdf.nos, pdf.parents, pdf.tags, pdf.classes, pdf.texts):
            for r in page_nodes(list(nos), [None if p is None or p != p else int(p) for p in parents], list(tags), list(classes), list(texts)):
                rows.append((host, ident, *r))
        yield pd.DataFrame(rows, columns=names)


def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable text nodes with their style and content keys; pages without a response have their own host.

    Repeated node rows count once; nodes without a number are left out.
    """
    dom = table(spark, sf_dir, "dom_node").where("retrieval_id is not null and node_no is not null")
    cls = F.concat_ws("#", F.coalesce(F.element_at("attrs", F.lit("class")), F.lit("")), F.element_at("attrs", F.lit("id")))
    node = F.struct("node_no", "parent_no", F.lower("tag").alias("tag"), cls.alias("cls"), F.col("node_text"))
    one = dom.groupBy("retrieval_id", "node_no").agg(F.min(node).alias("n"))
    page = one.groupBy("retrieval_id").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    res = table(spark, sf_dir, "response").where("retrieval_id is not null").groupBy("retrieval_id").agg(F.min(site_of(F.col("requested_url"))).alias("host"))
    page = page.join(res, "retrieval_id", "left").select(
        F.coalesce("host", F.concat(F.lit("?"), "retrieval_id")).alias("host"), "retrieval_id", F.col("ns.node_no").alias("nos"), F.col("ns.parent_no").alias("parents"), F.col("ns.tag").alias("tags"), F.col("ns.cls").alias("classes"), F.col("ns.node_text").alias("texts")
    )
    return page.mapInPandas(_flatten, TEXTS)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text node with its importance and whether it is content.

    Counts per host, style and text are far fewer than nodes; where they are
    few enough they are broadcast, so that no host's nodes meet in one task.
    """
    t = cut_lineage(text_nodes(spark, sf_dir).drop("is_block"))
    pages = cut_lineage(t.select("host", "retrieval_id").distinct().groupBy("host").agg(F.count("*").alias("n_pages")))
    # A text on one page of its host needs no row: it is never noise.
    keys = t.select("host", "key", "retrieval_id").distinct().groupBy("host", "key").agg(F.count("*").alias("key_pages")).where("key_pages > 1")
    t = t.join(small(cut_lineage(keys)), ["host", "key"], "left").fillna(1, ["key_pages"]).join(small(pages), "host")
    share = F.col("key_pages") / F.col("n_pages")
    short = F.col("words") < 4
    noise = (F.col("key_pages") >= MIN_PAGES) & (share >= F.when(short, SHORT_SHARE).otherwise(NOISE_SHARE))
    # Entropy of a text that stands once in each of n of m pages, over the greatest possible: log n / log m.
    importance = F.when(F.col("n_pages") > 1, 1 - F.log("key_pages") / F.log("n_pages")).otherwise(1.0)
    t = cut_lineage(t.withColumn("noise", noise).withColumn("importance", importance))
    style = t.groupBy("host", "style").agg(F.avg(F.when(F.col("noise"), 0.0).otherwise(1.0)).alias("style_importance"))
    weight = F.when(F.col("noise") | F.col("blocked"), 0.0).otherwise(F.col("importance") * F.col("chars"))
    per = cut_lineage(t.groupBy("host", "retrieval_id", "grp", "region", "region_end").agg(F.sum(weight).alias("mass")))
    # Presentation importance: important text per region of the style, over all pages of the host.
    group = per.groupBy("host", "grp").agg((F.sum("mass") / F.count("*")).alias("group_mass"))
    rank = F.struct((F.col("mass") > 0).alias("has"), F.sqrt(F.col("group_mass") * F.col("mass")).alias("m"), F.col("region").alias("main"), F.col("grp").alias("main_grp"), F.col("region_end").alias("main_end"))
    best = per.join(small(cut_lineage(group)), ["host", "grp"]).groupBy("retrieval_id").agg(F.max(rank).alias("b"))
    t = t.join(small(cut_lineage(style)), ["host", "style"]).join(best.select("retrieval_id", "b.main", "b.main_end", "b.main_grp"), "retrieval_id")
    inside = (F.col("place") >= F.col("main")) & (F.col("place") < F.col("main_end")) & ~F.col("blocked")
    clean = ~F.col("noise") & ((F.col("style_importance") >= STYLE_IMPORTANCE) | (F.col("grp") == F.col("main_grp")))
    return t.withColumn("is_content", (inside & clean) | (F.col("heading") & (~F.col("noise") | short | (F.col("key_pages") < F.col("n_pages") * 0.9))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose text belongs to the chapter or entry itself."""
    return marked(spark, sf_dir).where("is_content").select("retrieval_id", "node_no")


def p7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page, its nodes joined in document order; a page without content comes out empty."""
    dom = table(spark, sf_dir, "dom_node").where("retrieval_id is not null and node_no is not null").groupBy("retrieval_id", "node_no").agg(F.min("node_text").alias("node_text"))
    body = dom.join(p7_found(spark, sf_dir).withColumn("kept", F.lit(True)), ["retrieval_id", "node_no"], "left")
    part = F.when(F.col("kept"), F.struct("node_no", "node_text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["node_text"]), "\n")
    return body.groupBy("retrieval_id").agg(joined.alias("main_text"), F.count("kept").alias("n_nodes"))


QUERIES = {"p7_found": p7_found, "p7_pages": p7_pages}
SQL: dict[str, str] = {}
