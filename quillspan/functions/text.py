"""Scalar text functions as column expressions; Arrow functions only where Spark has no built-in (Unicode normal forms)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# Chinese numerals and their weights.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
# What the words of a title say of its kind, in order of precedence.
KIND_WORDS = {
    "PROLOGUE": "序章|楔子|引子|prologue",
    "EPILOGUE": "尾声|epilogue",
    "EXTRA": "番外|后记|後記|附录|附錄|extra|appendix",
    "FRONTMATTER": "封面|版权|版權|目录|目錄|书名页|書名頁|title.?page|copyright|cover",
}


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


def collapse_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_text(c: Column) -> Column:
    """Compatibility form with collapsed white space."""
    return collapse_space(nfkc(c))


def comparison_text(c: Column) -> Column:
    """Composed form with collapsed white space, for comparing sources."""
    return collapse_space(nfc(c))


def squashed(c: Column) -> Column:
    """Lower case without white space. ``lower`` differs from case folding on a few letters such as ß."""
    return F.regexp_replace(F.lower(c), SPACE, "")


def text_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def chinese_integer(c: Column) -> Column:
    """Value of a numeral in ASCII digits or Chinese numerals; null when it is neither or begins with 万."""
    digit = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("section"), F.lit(0).cast("bigint").alias("number"))

    def step(acc, ch):
        d, u = F.try_element_at(digit, ch).cast("bigint"), F.try_element_at(unit, ch).cast("bigint")
        part = F.when(acc["number"] == 0, F.lit(1).cast("bigint")).otherwise(acc["number"])
        myriad = F.struct((acc["total"] + (acc["section"] + acc["number"]) * 10000).alias("total"), F.lit(0).cast("bigint").alias("section"), F.lit(0).cast("bigint").alias("number"))
        other = F.struct(acc["total"].alias("total"), (acc["section"] + part * u).alias("section"), F.lit(0).cast("bigint").alias("number"))
        return F.when(d.isNotNull(), F.struct(acc["total"].alias("total"), acc["section"].alias("section"), d.alias("number"))).when(u == 10000, myriad).otherwise(other)

    chars = F.filter(F.split(c, ""), lambda x: x != "")
    value = F.aggregate(chars, zero, step, lambda a: a["total"] + a["section"] + a["number"])
    valid = c.rlike("^[零〇一二两三四五六七八九十百千][零〇一二两三四五六七八九十百千万]*$")
    return F.when(c.rlike("^[0-9]{1,18}$"), c.try_cast("bigint")).when(valid, value)


def chapter_number(title: Column) -> Column:
    """Number in 第…章, 第…节 or 第…回; null when there is none."""
    return chinese_integer(F.nullif(F.regexp_extract(title, r"(?U)第\s*([0-9零〇一二两三四五六七八九十百千万]+)\s*[章节回]", 1), F.lit("")))


def directory_number(title: Column) -> Column:
    """Chapter number of a file name: as in a title, else the number of ``chapter N`` or ``N`` alone."""
    plain = F.nullif(F.regexp_extract(title, r"(?i)^(?:chapter[\s._-]*)?([0-9]{1,18})$", 1), F.lit(""))
    return F.coalesce(chapter_number(title), plain.try_cast("bigint"))


def chapter_kind(title: Column, number: Column, properties: Column | None = None) -> Column:
    """NAVIGATION, MAIN (numbered), PROLOGUE, EPILOGUE, EXTRA, FRONTMATTER or UNKNOWN, in this order."""
    t = F.lower(collapse_space(title))
    nav = t.rlike(r"(?:^|[-_])(nav|toc)(?:$|[-_])")
    if properties is not None:
        nav = nav | F.coalesce(F.array_contains(properties, "nav"), F.lit(False))
    out = F.when(nav, "NAVIGATION").when(number.isNotNull(), "MAIN")
    for kind, words in KIND_WORDS.items():
        out = out.when(t.rlike(words), kind)
    return out.otherwise("UNKNOWN")


def work_title(title: Column) -> Column:
    """Title without book marks, encyclopaedia suffix and genre note, blanks collapsed."""
    t = F.regexp_replace(F.trim(title), "[《》]", "")
    t = F.regexp_replace(t, r"(?iU)\s*[-—_]\s*(维基百科|Wikipedia).*$", "")
    t = F.regexp_replace(t, r"(?U)\s*[（(](小说|网络小说|作品)[）)]\s*$", "")
    return collapse_space(t)


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits compare as numbers: text and number parts alternate, text first."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    parts = F.when(c.rlike("^[0-9]"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 24, "0")).otherwise(F.lower(p)))


def chapter_key(ordinal: Column, title: Column) -> Column:
    slug = F.left(F.regexp_replace(F.regexp_replace(title, r"[^0-9A-Za-z\x{3400}-\x{9fff}]+", "-"), "^-+|-+$", ""), F.lit(48))
    return F.concat(F.lit("chapter-"), F.lpad(ordinal.cast("string"), 6, "0"), F.lit("-"), F.when(slug == "", "untitled").otherwise(slug))


def byte_cut(c: Column, most: int) -> Column:
    """Longest prefix of at most ``most`` bytes in UTF-8."""
    short = F.aggregate(
        F.split(F.substring(c, 1, most), ""),
        F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda a, x: F.when(a["go"] & (a["n"] + F.octet_length(x) <= most), F.struct(F.concat(a["t"], x).alias("t"), (a["n"] + F.octet_length(x)).alias("n"), F.lit(True).alias("go"))).otherwise(
            F.struct(a["t"].alias("t"), a["n"].alias("n"), F.lit(False).alias("go"))
        ),
        lambda a: a["t"],
    )
    return F.when(F.octet_length(c) <= most, c).otherwise(short)


def safe_filename(ordinal: Column, title: Column, key: Column, compose: bool = True) -> Column:
    """``%06d__title__sha10.txt``; the title without characters that file systems refuse, at most 160 bytes."""
    t = nfc(title) if compose else title
    t = F.regexp_replace(F.regexp_replace(t, r'[<>:"/\\|?*\x00-\x1f]', " "), SPACE, " ")
    t = byte_cut(F.regexp_replace(t, r"^[ .]+|[ .]+$", ""), 160)
    return F.concat(F.lpad(ordinal.cast("string"), 6, "0"), F.lit("__"), F.when(t == "", "untitled").otherwise(t), F.lit("__"), F.left(F.sha2(key.cast("binary"), 256), F.lit(10)), F.lit(".txt"))


def file_stem(name: Column) -> Column:
    """Slug and twelve hex digits of the hash of a name."""
    slug = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(slug == "", "task").otherwise(slug), F.lit("--"), F.left(F.sha2(name.cast("binary"), 256), F.lit(12)))


def bounded_levenshtein(a: Column, b: Column, max_cells: int = 20_000_000) -> Column:
    """Edit distance, null where the texts without their common ends span more than ``max_cells`` cells.

    The common prefix is found by bisection over substring equality, the
    common suffix by the same on the reversed rest, so the test costs
    logarithmically many comparisons and no cell.
    """
    pre = _common_prefix(a, b)
    ra, rb = F.substr(a, pre + 1), F.substr(b, pre + 1)
    suf = _common_prefix(F.reverse(ra), F.reverse(rb))
    ta, tb = F.left(ra, F.length(ra) - suf), F.left(rb, F.length(rb) - suf)
    cells = F.length(ta).cast("bigint") * F.length(tb).cast("bigint")
    return F.when(cells <= max_cells, F.levenshtein(ta, tb))


def _common_prefix(a: Column, b: Column) -> Column:
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(30), F.lit(0), F.lit(-1))
    # Add descending powers of two as long as the longer prefix still agrees.
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + F.pow(F.lit(2), k).cast("int") <= most) & (F.left(a, n + F.pow(F.lit(2), k).cast("int")) == F.left(b, n + F.pow(F.lit(2), k).cast("int"))), n + F.pow(F.lit(2), k).cast("int")).otherwise(n))


def ratio(n: Column, d: Column, zero: float | None = None) -> Column:
    """n / d; ``zero`` (null by default) when d is 0."""
    r = F.try_divide(n, d)
    return r if zero is None else F.coalesce(r, F.lit(zero))


def is_sha256(c: Column) -> Column:
    """A written-out hash that is no placeholder of one repeated digit."""
    return c.rlike("^sha256:[0-9a-f]{64}$") & ~c.rlike(r"^sha256:([0-9a-f])\1{63}$")


def is_id(c: Column, prefix: str, hex_digits: int = 20) -> Column:
    return c.rlike(f"^{prefix}-[0-9A-F]{{{hex_digits}}}$")
