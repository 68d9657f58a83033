import hashlib
import json
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions import ids
from quillspan.functions import text as fx
from quillspan.operators import urls


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def numeral(n):
    """Usual Chinese numeral of a number below a hundred million."""
    digits, out, zero = "零一二三四五六七八九", "", False
    if n >= 10000:
        return numeral(n // 10000) + "万" + (("零" if n % 10000 < 1000 else "") + numeral(n % 10000) if n % 10000 else "")
    for unit, mark in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = n // unit % 10
        if d:
            out += ("零" if zero and out else "") + digits[d] + mark
            zero = False
        else:
            zero = True
    return out


def test_chapter_numbers(spark):
    titles = ["第一百零二章 入山", "第万章", "第 12 回", "第两千三百章", "第十节", "序章", "", None, "第三万零五章"]
    assert col(spark, titles, fx.chapter_number) == [102, None, 12, 2300, 10, None, None, None, 30005]


def test_numerals_round_trip(spark):
    numbers = [*range(1, 130), 200, 205, 999, 1000, 1001, 1010, 9999, 10000, 10001, 10100, 99999, 123456]
    assert col(spark, [numeral(n) for n in numbers], fx.chinese_integer) == numbers


def test_kinds(spark):
    titles = ["楔子 风起", "Epilogue: Home", "番外 旧事", "版权信息", "page-nav", "随笔", None]
    got = col(spark, titles, lambda c: fx.chapter_kind(c, F.lit(None).cast("int")))
    assert got == ["PROLOGUE", "EPILOGUE", "EXTRA", "FRONTMATTER", "NAVIGATION", "UNKNOWN", "UNKNOWN"]
    assert col(spark, ["x"], lambda c: fx.chapter_kind(c, F.lit(3))) == ["MAIN"]


def test_titles(spark):
    assert col(spark, ["《凡人修仙传》", "凡人修仙传 - 维基百科，自由的百科全书", "剑来（小说）", "  A   b "], fx.work_title) == ["凡人修仙传", "凡人修仙传", "剑来", "A b"]


def test_natural_key(spark):
    names = ["a10", "a2", "2b", "10b", "a", "第2章", "第10章", "A02"]
    keyed = dict(zip(names, col(spark, names, fx.natural_key)))
    assert sorted(names, key=lambda n: keyed[n])[:2] == ["2b", "10b"]
    assert keyed["a2"] < keyed["a10"] and keyed["第2章"] < keyed["第10章"] and keyed["a2"] == keyed["A02"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c\t\n　 \x1ćéＡ", max_size=12), min_size=1, max_size=20))
def test_normal_text(spark, values):
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v)).strip() for v in values]
    assert col(spark, values, fx.normalize_text) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(alphabet="甲乙ab", max_size=9), st.text(alphabet="甲乙ab", max_size=9)), min_size=1, max_size=15))
def test_edit_distance(spark, pairs):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(fx.bounded_levenshtein(F.col("a"), F.col("b"))).collect()]
    assert got == [plain(a, b) for a, b in pairs]


def test_edit_budget(spark):
    df = spark.createDataFrame([("xxabc", "xxdefg"), ("same", "same"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(fx.bounded_levenshtein(F.col("a"), F.col("b"), 11)).collect()] == [None, 0, None]


def test_file_names(spark):
    title = '长' * 80 + ': "end"'
    got = col(spark, [title, "...", "a/b"], lambda c: fx.safe_filename(F.lit(7), c, F.lit("key")))
    tail = hashlib.sha256(b"key").hexdigest()[:10]
    assert got == [f"000007__{'长' * 53}__{tail}.txt", f"000007__untitled__{tail}.txt", f"000007__a b__{tail}.txt"]


def test_strict_json(spark):
    values = ['{"a":1}', '{"a":1,"a":2}', '{"b": 1, "a": 2}', "[1]", "{", "NaN", '{"a":1.5}', None, '{"a":"\\u001f"}']
    got = col(spark, values, lambda c: F.struct(ids.strict_json(c)["is_valid"].alias("v"), ids.strict_json(c)["is_object"].alias("o"), ids.strict_json(c)["is_canonical"].alias("c")))
    assert [tuple(g) for g in got] == [(True, True, True), (False, False, False), (True, True, False), (True, False, True), (False, False, False), (False, False, False), (True, True, False), (False, False, False), (True, True, True)]


def test_pointers():
    doc = {"a": [10, {"b/c": 1, "~": 2}], "": 3}
    assert ids.resolve_pointer(doc, "") == doc
    assert ids.resolve_pointer(doc, "/a/1/b~1c") == 1
    assert ids.resolve_pointer(doc, "/a/1/~0") == 2
    assert ids.resolve_pointer(doc, "/") == 3
    for bad in ("a", "/a/01", "/a/9", "/x", "/a/1/~2"):
        with pytest.raises((ValueError, KeyError, IndexError)):
            ids.resolve_pointer(doc, bad)


def test_derived_id(spark):
    df = spark.createDataFrame([("题", None)], "t string, a string")
    text = json.dumps({"a": None, "t": "题"}, ensure_ascii=False, separators=(",", ":"))
    got = df.select(ids.derived_id("NWK", ids.canonical_json(("t", F.col("t")), ("a", F.col("a"))))).first()[0]
    assert got == "NWK-" + hashlib.sha256(text.encode()).hexdigest().upper()[:20]


def test_urls(spark):
    given_urls = ["HTTPS://Ex.Org:443/a?b=2&a=1#x", "http://ex.org:8080", "https://ex.org/p?x=", "/library/a.txt"]
    arrow = col(spark, given_urls, urls.canonicalize)
    assert arrow == ["https://ex.org/a?a=1&b=2", "http://ex.org:8080/", "https://ex.org/p?x=", None]
    assert col(spark, given_urls, urls.canonical_native) == arrow


def test_links_and_crawl(spark):
    pages = spark.createDataFrame([("https://e.org/i", '<a href="/1.html">一</a><a href="#x">n</a><a href="mailto:a@b">m</a><a>none</a><a href="2.html" rel="next">二</a>')], "url string, html string")
    got = urls.page_links(pages, "url", "html").orderBy("position").collect()
    assert [(r.url, r.label, r.rel) for r in got] == [("https://e.org/1.html", "一", ""), ("https://e.org/2.html", "二", "next")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "from_url string, url string")
    seen = urls.reachable(edges, spark.createDataFrame([("a",)], "url string"))
    assert {(r.url, r.depth) for r in seen.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    chain = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(6)], "from_url string, url string")
    assert urls.reachable(chain, spark.createDataFrame([("p0",)], "url string"), max_depth=3).count() == 4


def test_crawl_plan(spark):
    links = [
        ("https://e.org/i", 0, "/c/2", "https://e.org/c/2", "二", ""), ("https://e.org/i", 1, "/c/1", "https://e.org/c/1", "一", ""), ("https://e.org/i", 2, "/i2", "https://e.org/i2", "more", "nofollow next"),
        ("https://e.org/i", 3, "x", "https://x.org/c/9", "elsewhere", ""), ("https://e.org/i2", 0, "/c/1", "https://e.org/c/1", "again", ""), ("https://e.org/i2", 1, "/c/3", "https://e.org/c/3", "三", ""),
        ("https://e.org/i2", 2, "/about", "https://e.org/about", "about", ""), ("https://e.org/other", 0, "/c/7", "https://e.org/c/7", "七", ""),
    ]
    df = spark.createDataFrame(links, urls.LINKS)
    seeds = spark.createDataFrame([("https://e.org/i",)], "url string")
    assert [(r.ordinal, r.url, r.label, r.depth) for r in urls.crawl_plan(df, seeds, r"^/c/\d+$").orderBy("ordinal").collect()] == [(1, "https://e.org/c/2", "二", 0), (2, "https://e.org/c/1", "一", 0), (3, "https://e.org/c/3", "三", 1)]
    with pytest.raises(ValueError):
        urls.crawl_plan(df, seeds, "c", max_pages=1)
