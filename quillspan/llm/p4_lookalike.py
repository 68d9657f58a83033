"""Problem 4: one form for texts that read the same but are spelled with other characters.

Method: texts are exploded to positioned pieces (an affected code point, a base
with its combining marks, or a run that nothing maps), decomposition and
look-alike mappings are joined by broadcast, combining marks are ordered by
class and recomposed, and the texts are rebuilt from their positions.

The tables come from rules over the Unicode character database: one row per
code point whose consistent form differs from itself, so their size is bound
by Unicode and does not grow with the data.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, parallelism, table

# Letters of other scripts, and rarer Latin letters, that look like a letter of the Latin alphabet.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "г": "r", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "հ": "h", "ո": "n", "ս": "u", "ց": "g", "օ": "o", "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O",
    # Coptic
    "ⲟ": "o", "ⲥ": "c", "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
# Dashes and marks drawn alike.
MARK_ALIKES = {"‐": "-", "‑": "-", "−": "-", "ʼ": "’", "․": ".", "∕": "/", "⁄": "/", "∶": ":", "ː": ":", "·": "·", "・": "·", "‧": "·", "•": "•"}

# Compatibility forms that look different from what they stand for: x² is not x2.
_SEEN = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")


def _invisible(c: str) -> bool:
    """Format characters, variation selectors and fillers: nothing of them is seen."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D)


@lru_cache(maxsize=200_000)
def _parts(c: str) -> str:
    """Full decomposition of one code point into what is seen of it."""
    if _invisible(c):
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in MARK_ALIKES:
        return MARK_ALIKES[c]
    if c != "\n" and (c.isspace() or unicodedata.category(c) == "Zs"):
        return " "
    d = unicodedata.decomposition(c)
    if "\u3131" <= c <= "\u318e":  # letters of Hangul that stand alone are no part of a syllable
        return c
    if not d or d.startswith(_SEEN):
        return unicodedata.normalize("NFD", c)
    out = [chr(int(x, 16)) for x in d.split() if not x.startswith("<")]
    if d.startswith("<compat> 0020 ") and len(out) > 1:  # a mark standing alone keeps its own form
        return c
    return "".join(_parts(x) for x in out)


@lru_cache(maxsize=1)
def single_map() -> dict[str, str]:
    """Code points whose consistent form is another string."""
    out = {}
    for o in range(0x20, sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0xAC00 <= o <= 0xD7A3:
            continue
        c = chr(o)
        if o < 0x7F:
            continue
        to = unicodedata.normalize("NFC", _parts(c))
        if to != c:
            out[c] = to
    out["\t"] = out["\r"] = out["\x0b"] = out["\x0c"] = " "
    return out


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Base + mark -> composed letter, by the database's canonical compositions."""
    out = {}
    for o in range(0xC0, 0x20000):
        if 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xDFFF:
            continue
        d = unicodedata.decomposition(chr(o))
        if d and not d.startswith("<") and " " in d:
            pair = "".join(chr(int(x, 16)) for x in d.split())
            if unicodedata.normalize("NFC", pair) == chr(o) and unicodedata.combining(pair[1]):
                out[pair] = chr(o)
    return out


@lru_cache(maxsize=1)
def joined_signs() -> dict[str, str]:
    """Pairs that compose although the second sign is of class 0 (vowel signs in two parts)."""
    out = {}
    for o in range(0x900, 0x20000):
        d = "" if 0xAC00 <= o <= 0xDFFF else unicodedata.decomposition(chr(o))
        if d and not d.startswith("<") and " " in d:
            pair = "".join(chr(int(x, 16)) for x in d.split())
            if unicodedata.normalize("NFC", pair) == chr(o) and not unicodedata.combining(pair[1]):
                out[pair] = chr(o)
    return out


#: A syllable of Hangul in parts: two or three letters, or a syllable without a last letter and that letter.
_HANGUL = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11a8}-\x{11c2}]?|[\x{ac00}-\x{d7a3}][\x{11a8}-\x{11c2}]"


@lru_cache(maxsize=1)
def mark_class() -> str:
    """Combining marks of a class above 0, as a Java regular expression; other marks move nowhere."""
    return f"[{_ranges([o for o in range(0x300, 0x20000) if not 0xD800 <= o <= 0xDFFF and unicodedata.combining(chr(o))])}]"


@lru_cache(maxsize=1)
def joined() -> str:
    """What composes before any mark is looked at, as a Java regular expression."""
    return "|".join([_HANGUL, *(f"\\x{{{ord(a):x}}}\\x{{{ord(b):x}}}" for a, b in sorted(joined_signs()))])


def syllables() -> dict[str, str]:
    """Syllables of Hangul in parts -> composed, by the arithmetic of the standard."""
    out = {}
    for lead in range(19):
        for vowel in range(21):
            whole = 0xAC00 + (lead * 21 + vowel) * 28
            parts = chr(0x1100 + lead) + chr(0x1161 + vowel)
            out[parts] = chr(whole)
            for last in range(1, 28):
                out[parts + chr(0x11A7 + last)] = out[chr(whole) + chr(0x11A7 + last)] = chr(whole + last)
    return out


@lru_cache(maxsize=1)
def composed_at() -> tuple[str, str, str]:
    """(bases, marks, table): the composed letter of base i and mark j is entry ``i * len(marks) + j`` of the table, split at commas."""
    pairs = compositions()
    bases, marks = "".join(sorted({p[0] for p in pairs})), "".join(sorted({p[1] for p in pairs}))
    return bases, marks, ",".join(pairs.get(b + m, "") for b in bases for m in marks)


def _ranges(cps: list[int]) -> str:
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:x}}}" + (f"-\\x{{{cps[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


#: Ranges of which most characters of a text are.
_COMMON = ((0x20, 0x7F), (0xA1, 0x180), (0x2013, 0x2027), (0x3001, 0x3030), (0x4E00, 0xA000))


@lru_cache(maxsize=1)
def patterns() -> tuple[str, str, str, str]:
    """Java regular expressions: what is mapped alone and the pieces of texts without more; what may compose and the pieces of texts that hold it."""
    mapped = _ranges(sorted(ord(c) for c in single_map() if not unicodedata.combining(c)))
    second = _ranges(sorted({ord(p[1]) for p in joined_signs()} | set(range(0x11A8, 0x11C3))))
    first = _ranges(sorted({ord(p[0]) for p in joined_signs()} | set(range(0x1100, 0x1113))))
    mark = mark_class()
    some = mark[1:-1]
    # A run that nothing maps ends before a base with marks and before a sign that composes with what stands before it.
    run = rf"(?:[^{some}{mapped}{first}](?![{some}{second}]))+"
    piece = rf"{run}|(?:{joined()}|[^{some}]){mark}+|{mark}+|{joined()}|[^{some}]"
    # The large classes are only asked about characters outside of a few common ranges, which nothing maps.
    common = _ranges([o for a, b in _COMMON for o in range(a, b) if chr(o) not in single_map()])
    return rf"(?![{common}])[{mapped}]", rf"[{common}]++|[^{common}]", rf"(?![{common}])[{some}{second}\x{{1161}}-\x{{1175}}]", piece


@lru_cache(maxsize=1)
def unseen() -> str:
    """Characters of which nothing is seen, marks of a class above 0 left out, as a Java regular expression."""
    return f"[{_ranges(sorted(ord(c) for c, to in single_map().items() if not to and not unicodedata.combining(c)))}]+"


def _maps(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    single = spark.createDataFrame(sorted(single_map().items()), T.StructType([T.StructField("piece", T.StringType()), T.StructField("to_piece", T.StringType())]))
    rows = [(chr(o), unicodedata.combining(chr(o))) for o in range(0x300, 0x20000) if not 0xD800 <= o <= 0xDFFF and unicodedata.combining(chr(o))]
    return single, spark.createDataFrame(rows, "cp string, ccc int")


def _joined_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted((joined_signs() | syllables()).items()), "piece string, to_piece string")


def canonical_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, canon`` from ``keys, pos, piece``: maps, orders, recomposes and rebuilds.

    Pieces with combining marks are exploded once more to single code points;
    a mark moves only within its own base, by class and then by position.
    """
    spark = pieces.sparkSession
    single, classes = _maps(spark)
    single, classes = F.broadcast(single.unionByName(_joined_map(spark))), F.broadcast(classes)
    mapped = pieces.join(single, "piece", "left").withColumn("form", F.coalesce("to_piece", "piece"))
    marked = F.col("piece").rlike(mark_class())
    bases, marks, letters = composed_at()
    # Folded to one literal array: the entry of a base and a mark is read at its place.
    letters = F.split(F.lit(letters), ",")

    def composed_of(head, mark):
        i, j = F.instr(F.lit(bases), F.right(head, F.lit(1))), F.instr(F.lit(marks), mark)
        return F.when((i > 0) & (j > 0), F.nullif(F.get(letters, (i - 1) * len(marks) + j - 1), F.lit("")))

    # Clusters of a base and its marks: positioned code points, mapped one by one.
    cps = (
        mapped.where(marked)
        .select(*keys, "pos", F.posexplode(F.regexp_extract_all("piece", F.lit(rf"{joined()}|[\s\S]"), 0)).alias("sub", "piece"))
        .join(single, "piece", "left")
        .withColumn("form", F.coalesce("to_piece", "piece"))
        .select(*keys, "pos", "sub", F.posexplode(F.split("form", "")).alias("part", "cp"))
        .join(classes, "cp", "left")
        .withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    )
    # Pieces of which nothing is seen keep their place, so that no text is lost.
    ordered = F.array_sort(F.collect_list(F.when(F.col("cp") != "", F.struct((F.col("ccc") > 0).alias("late"), "ccc", "sub", "part", "cp"))))
    composed = F.aggregate(
        "cps",
        F.struct(F.lit("").alias("head"), F.lit("").alias("tail"), F.lit(0).alias("last")),
        lambda acc, x: F.when(
            (x["ccc"] > 0) & ((acc["last"] < x["ccc"]) | (acc["tail"] == "")) & (F.length(acc["head"]) > 0) & composed_of(acc["head"], x["cp"]).isNotNull(),
            F.struct(F.concat(F.left(acc["head"], F.length(acc["head"]) - 1), composed_of(acc["head"], x["cp"])).alias("head"), acc["tail"].alias("tail"), acc["last"].alias("last")),
        ).otherwise(
            F.when(x["ccc"] == 0, F.struct(F.concat(acc["head"], acc["tail"], x["cp"]).alias("head"), F.lit("").alias("tail"), F.lit(0).alias("last"))).otherwise(
                F.struct(acc["head"].alias("head"), F.concat(acc["tail"], x["cp"]).alias("tail"), x["ccc"].alias("last"))
            )
        ),
        lambda acc: F.concat(acc["head"], acc["tail"]),
    )
    clusters = cps.groupBy(*keys, "pos").agg(ordered.alias("cps")).select(*keys, "pos", composed.alias("form"))
    whole = mapped.where(~marked).select(*keys, "pos", "form").unionByName(clusters)
    return rebuilt(whole, keys)


def canonicalise(texts: DataFrame, keys: list[str], text: str = "normalized_text") -> DataFrame:
    """``keys, canon``: the consistent form of each text.

    ``keys`` must be unique. Null texts stay null, empty texts empty. Texts
    without an affected code point are their own form and are not exploded.
    """
    alone, simple_piece, composing, piece = patterns()
    single = F.broadcast(_maps(texts.sparkSession)[0])
    t = texts.select(*keys, F.col(text).alias("_t"))
    hit = F.coalesce(F.col("_t").rlike(alone), F.lit(False))
    marks = F.coalesce(F.col("_t").rlike(composing), F.lit(False))
    plain = t.where(~hit & ~marks).select(*keys, squeezed(F.col("_t")).alias("canon"))
    explode = lambda df, by, of: df.select(*keys, F.posexplode(F.regexp_extract_all(of, F.lit(by), 0)).alias("pos", "piece"))
    # Texts in which nothing composes need no ordering of marks: one explode, one join, one rebuild.
    simple = explode(t.where(hit & ~marks), simple_piece, F.col("_t")).join(single, "piece", "left").select(*keys, "pos", F.coalesce("to_piece", "piece").alias("form"))
    # Unseen characters would part a base from its marks; a blank piece in front keeps texts of nothing else.
    seen = F.concat(F.lit(" "), F.regexp_replace("_t", unseen(), ""))
    return plain.unionByName(rebuilt(simple, keys)).unionByName(canonical_pieces(explode(t.where(marks), piece, seen), keys))


def squeezed(c):
    """Blanks of any kind and number between words read as one; none at the ends is seen."""
    return F.trim(F.regexp_replace(c, " +", " "))


def rebuilt(parts: DataFrame, keys: list[str]) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"]), "")
    return parts.groupBy(*keys).agg(text.alias("canon")).withColumn("canon", squeezed(F.col("canon")))


def canonical_reference(text: str) -> str:
    """The same form in plain Python, for tests."""
    m = single_map()
    out = unicodedata.normalize("NFC", "".join(m.get(c, c) for c in text))
    out = "".join(m.get(c, c) for c in out)
    return re.sub(" +", " ", out).strip(" ")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, each id once (of repeated rows the smallest text holds)."""
    s = table(spark, sf_dir, "segment").where("segment_id is not null")
    return s.select("segment_id", "work_id", "chapter_ordinal", "document_id", "normalized_text")


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's text in the consistent form."""
    # A fixed number of partitions: exploding is heavy, and partitions that are merged by their bytes make stragglers.
    s = segments(spark, sf_dir).repartition(parallelism(spark), "segment_id").groupBy("segment_id").agg(F.min("normalized_text").alias("normalized_text"))
    return canonicalise(s, ["segment_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments of one work and chapter, in two documents, that read the same and are not the same string.

    The texts are placed by work and chapter once; exploding, mapping,
    rebuilding and pairing all stay on that placement. Chapters with one
    document have no pair and are not exploded. Null works, ordinals,
    documents and texts match nothing.
    """
    chapter = ["work_id", "chapter_ordinal"]
    s = segments(spark, sf_dir).where("work_id is not null and chapter_ordinal is not null and document_id is not null and normalized_text is not null")
    # Which chapters stand in two documents is a small aggregate over three columns.
    two = s.groupBy(*chapter).agg((F.min("document_id") < F.max("document_id")).alias("two")).where("two").select(*chapter)
    s = s.join(two, chapter, "left_semi")
    keys = [*chapter, "document_id", "segment_id"]
    s = s.groupBy(*keys).agg(F.min("normalized_text").alias("normalized_text"))
    form = canonicalise(s.withColumn("_h", F.xxhash64("normalized_text")), [*keys, "_h"]).where("canon <> ''")
    # Forms are compared by two independent hashes of 64 bits; what is written and read again is a few columns a segment.
    form = cut_lineage(form.select(*keys, "_h", F.xxhash64("canon").alias("f1"), F.xxhash64(F.lit(1), "canon", F.length("canon")).alias("f2")))
    # Only forms spelled in two ways in two documents can pair.
    group = [*chapter, "f1", "f2"]
    mixed = form.groupBy(*group).agg((F.min("_h") < F.max("_h")).alias("a"), (F.min("document_id") < F.max("document_id")).alias("b")).where("a and b").select(*group)
    form = form.join(mixed, group, "left_semi")
    x = form.select(*group, F.col("document_id").alias("da"), F.col("segment_id").alias("segment_id_a"), F.col("_h").alias("ha"))
    y = form.select(*group, F.col("document_id").alias("db"), F.col("segment_id").alias("segment_id_b"), F.col("_h").alias("hb"))
    return x.join(y, group).where("da <> db and ha <> hb and segment_id_a < segment_id_b").select("segment_id_a", "segment_id_b").distinct()


QUERIES = {"p4_found": p4_found, "p4_canonical": p4_canonical}
SQL: dict[str, str] = {}
