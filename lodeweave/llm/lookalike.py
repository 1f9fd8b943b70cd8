"""Visually identical text brought to one form.

White space and characters without visible form are settled by two expressions
over the whole text. What remains is done by code point: words with a
character outside ASCII are exploded to positioned code points, broadcast
tables of decompositions (look-alikes among them) and of combining classes are joined,
combining marks are ordered by class behind their base, words are rebuilt and
recomposed by Unicode's canonical algorithm. Only distinct words are worked
on, so a word that a third of all documents use costs as much as any other.

Look-alikes are those listed below, and letters and signs of other scripts that the
public confusables data of Unicode give the same skeleton as an ASCII character
of the same kind and case; that data comes with the ICU library among
Spark's own. Left out is what a reader can tell apart (``DISTINCT``), Latin letters
of their own (dotless i, phonetic letters), quotation marks and dashes. Where the driver has no
JVM at hand only the list holds.

All tables follow from Unicode's character data, so their size is bounded by
Unicode and does not grow with the data.

Null texts give a null form; texts that show nothing give an empty form.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.llm.pairs import group_pairs
from lodeweave.runtime import cut_lineage, written

#: Letters and signs that look like the letter they are listed under; they go before the public data.
LOOKALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ", "N": "Ν",
    "O": "ΟО", "P": "ΡР", "S": "Ѕ", "T": "ΤТ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "G": "Ԍ", "Q": "Ԛ", "W": "Ԝ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ", "o": "οо", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уү", "k": "κ",
    "-": "‐‑﹣",
}
#: What the public data hold to be confusable, but a reader tells apart; and the signs that they are asked about.
DISTINCT, SIGNS = "αγσгҽѡᴦⲅ", "/\\:~|*"
#: Compatibility forms of these kinds look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Compatibility characters that look different from their decomposition.
DIFFERENT = "ſϐϑϕϖϰϱϵϒ"
#: What has no visible form: format and control characters, variation selectors, fillers, tags.
INVISIBLE = r"[\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F]"
SPACE = r"[\s\x1C-\x1F\x85\p{Z}\x{2800}]"


def _expand(char: str, folds: dict[str, str]) -> str:
    """Full decomposition of a character into what looks the same, look-alikes replaced."""
    if char in folds:
        return folds[char]
    how = unicodedata.decomposition(char)
    if how and char not in DIFFERENT:
        kind, _, rest = how.rpartition(">")
        if not kind or kind + ">" in SAME_LOOK:
            parts = "".join(chr(int(x, 16)) for x in rest.split())
            if not (kind and parts[0] == " "):
                return "".join(_expand(c, folds) for c in parts)
    if 0xAC00 <= ord(char) <= 0xD7A3:
        return unicodedata.normalize("NFD", char)
    return char


def _kind(char: str) -> str | None:
    """Capital, small letter or sign; other characters are compared with nothing."""
    category = unicodedata.category(char)
    return category if category in ("Lu", "Ll") else "S" if category[0] in "PS" else None


@lru_cache(maxsize=4)
def confusables(spark: SparkSession) -> dict[str, str]:
    """Character to the ASCII character it looks like: the public data, then the list above."""
    out: dict[str, str] = {}
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except Exception:  # no JVM at hand, or none with that library
        checker = None
    if checker is not None:
        chars = [c for c in map(chr, (*range(0x21, 0xD800), *range(0xE000, 0x20000))) if _kind(c)]
        ascii_of: dict[tuple[str, str], str] = {}
        for char, skeleton in zip(chars, checker.getSkeleton("\n".join(chars)).split("\n")):
            kind = _kind(char)
            if char.isascii():
                if kind != "S" or char in SIGNS:
                    ascii_of.setdefault((skeleton, kind), char)
            elif (skeleton, kind) in ascii_of and char not in DISTINCT and not unicodedata.decomposition(char) and not unicodedata.name(char, "").startswith("LATIN"):
                out[char] = ascii_of[skeleton, kind]
    return out | {other: base for base, others in LOOKALIKES.items() for other in others}


@lru_cache(maxsize=4)
def tables(spark: SparkSession) -> tuple[list[tuple[str, str]], list[tuple[str, int]]]:
    """(character, what it is made of) of every character that is not simply itself, and (mark, combining class)."""
    folds = confusables(spark)
    every = [chr(code) for code in (*range(0x80, 0xD800), *range(0xE000, 0x30000))]
    made = [(char, parts) for char in every if (parts := _expand(char, folds)) != char]
    return made, [(char, unicodedata.combining(char)) for char in every if unicodedata.combining(char)]


def visible(text: Column) -> Column:
    """The text without invisible characters, each run of white space one space, none at the ends.

    Printable ASCII without runs of spaces is left as it is; elsewhere each character is first
    asked whether it is printable ASCII, which is much cheaper than the classes.
    """
    shown = F.regexp_replace(text, r"(?![\x20-\x7E])" + INVISIBLE, "")
    clean = F.trim(F.regexp_replace(shown, r"(?:(?![\x21-\x7E])" + SPACE + ")+", " "))
    return F.when(F.rlike(text, F.lit(r"[^\x20-\x7E]|  |^ | $")), clean).otherwise(text)


def _foreign(word: Column) -> Column:
    """Whether a word has a character outside ASCII."""
    return F.octet_length(word) != F.length(word)


@F.arrow_udf(T.StringType())
def _recomposed(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else unicodedata.normalize("NFC", w) for w in words.to_pylist()], pa.string())


def _canonical_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, form) of distinct words."""
    made, marks = tables(spark)
    made = F.broadcast(spark.createDataFrame(made, "char string, made string"))
    marks = F.broadcast(spark.createDataFrame(marks, "part string, class int"))
    points = lambda text: F.regexp_extract_all(text, F.lit("(?s)."), 0)
    chars = words.select("word", F.posexplode(points(F.col("word"))).alias("pos", "char")).join(made, "char", "left")
    whole = F.coalesce("made", "char")
    parts = chars.select("word", "pos", F.posexplode(F.when(F.length(whole) == 1, F.array(whole)).otherwise(points(whole))).alias("k", "part"))
    classed = parts.join(marks, "part", "left").select("word", "pos", "k", "part", F.coalesce("class", F.lit(0)).alias("class"))
    # A base and the marks behind it are one segment.
    upto = Window.partitionBy("word").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = classed.withColumn("segment", F.count(F.when(F.col("class") == 0, 1)).over(upto))
    rebuilt = placed.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("segment", "class", "pos", "k", "part"))).alias("ordered"))
    return rebuilt.select("word", _recomposed(F.array_join(F.transform("ordered", lambda x: x["part"]), "")).alias("form"))


def _placed(words: Column) -> Column:
    """Words outside ASCII with their places."""
    return F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("word"))), lambda x: _foreign(x["word"]))


def canonical_text(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, form): every row with its one form; texts in ASCII never leave their task."""
    spark = documents.sparkSession
    base = documents.select(F.col(key), F.col(text), visible(F.col(text)).alias("_v"))
    foreign = F.coalesce(_foreign(F.col("_v")), F.lit(False))
    plain = base.where(~foreign).select(key, text, F.col("_v").alias("form"))
    # The form depends on the text alone: equal texts share one row below, under a hash of 96 bits.
    split = base.where(foreign).select(key, text, F.xxhash64(text).alias("_h"), F.hash(text).alias("_g"), F.split("_v", " ").alias("_w"))
    # Words outside ASCII with their places; the rest of a text is never exploded.
    placed = split.select("_h", "_g", F.explode(_placed(F.col("_w"))).alias("_x")).select("_h", "_g", "_x.i", "_x.word").distinct()
    placed = written(placed)  # read twice, and much smaller than the texts
    forms = _canonical_words(spark, placed.select("word").distinct())
    patches = placed.join(forms, "word").groupBy("_h", "_g").agg(F.map_from_entries(F.collect_list(F.struct("i", "form"))).alias("_patch"))
    # No form is empty or has blanks at its ends, so the words joined are clean.
    rebuilt = split.join(patches, ["_h", "_g"]).select(key, text, F.array_join(F.transform("_w", lambda w, i: F.coalesce(F.try_element_at("_patch", i), w)), " ").alias("form"))
    return plain.unionByName(rebuilt)


def form_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, group, variant) of the documents that show something: equal forms share a group, equal texts a variant.

    Forms are not built: a form is known by the number of its words, the number of its characters and a hash of
    64 bits of each word with its place, added up without carry. So each text is read once,
    and only its words outside ASCII travel.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text", visible(F.col("text")).alias("_v")).where("_v <> ''")
    split = docs.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"), F.length("_v").alias("chars"), F.split("_v", " ").alias("_w"))
    none = F.lit(0).cast("long")
    added = F.aggregate(F.transform("_w", lambda w, i: F.when(_foreign(w), none).otherwise(F.xxhash64(i, w))), none, lambda a, x: a.bitwiseXOR(x))
    read = written(split.select("doc_id", "h", "g", F.size("_w").alias("words"), "chars", added.alias("x"), _placed(F.col("_w")).alias("placed")))
    placed = written(read.select("h", "g", F.explode("placed").alias("p")).select("h", "g", "p.i", "p.word").distinct())
    forms = _canonical_words(spark, placed.select("word").distinct())
    rest = placed.join(forms, "word").groupBy("h", "g").agg(F.bit_xor(F.xxhash64("i", "form")).alias("p"), F.sum(F.length("form") - F.length("word")).alias("longer"))
    rows = read.select("doc_id", "h", "g", "words", "chars", "x").distinct().join(rest, ["h", "g"], "left")
    group = F.concat_ws(" ", "words", F.col("chars") + F.coalesce("longer", none), F.col("x").bitwiseXOR(F.coalesce("p", none)))
    return rows.select("doc_id", group.alias("group"), F.concat_ws(" ", "h", "g").alias("variant"))


def lookalike_pairs(documents: DataFrame, expand: int | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b): all documents of one form whose texts differ in code points; see ``group_pairs`` for ``expand``."""
    keyed = cut_lineage(form_keys(documents))  # narrow, and read by each of the steps that follow
    return group_pairs(keyed, "doc_id", expand)
