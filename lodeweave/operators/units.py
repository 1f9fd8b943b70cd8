"""Quantities recorded in different units, brought to one unit.

A unit spelling such as ``Mbytes``, ``Go`` or ``kbit`` is cut into prefix, root
and exponent by dynamic programming over three tries. Spellings with several
readings (``M`` is mega- with the root left out, or metre; ``t`` is tera- or
tonne) are decided by the weights of the parts plus a prior that the field
gives to each dimension: a size field expects information.

Spark only ever sees Arrow batches of strings: one vectorised UDF per column,
no shuffle, so the cost is linear and skew cannot arise.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefixes with the power of 1,000 they stand for, symbol forms first, then words.
PREFIXES = {
    "k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6,
    "ki": 1, "mi": 2, "gi": 3, "ti": 4, "pi": 5, "ei": 6,
    "kilo": 1, "mega": 2, "giga": 3, "tera": 4, "peta": 5, "exa": 6,
    "kibi": 1, "mebi": 2, "gibi": 3, "tebi": 4, "pebi": 5, "exbi": 6,
    "kilo-": 1, "mega-": 2, "giga-": 3, "tera-": 4,
    "к": 1, "м": 2, "г": 3, "т": 4, "кило": 1, "мега": 2, "гига": 3, "тера": 4,
    "milli": -1, "micro": -2, "nano": -3,
}
#: Roots with dimension, factor to the dimension's base unit, and log weight.
ROOTS = {
    "": ("information", 1.0, -4.0),
    "b": ("information", 1.0, -0.5), "o": ("information", 1.0, -1.5),
    "byte": ("information", 1.0, 0.0), "bytes": ("information", 1.0, 0.0),
    "octet": ("information", 1.0, 0.0), "octets": ("information", 1.0, 0.0),
    "octeto": ("information", 1.0, 0.0), "octetos": ("information", 1.0, 0.0),
    "oktett": ("information", 1.0, 0.0), "ottetti": ("information", 1.0, 0.0),
    "б": ("information", 1.0, -0.5), "байт": ("information", 1.0, 0.0),
    "байта": ("information", 1.0, 0.0), "байтов": ("information", 1.0, 0.0),
    "bit": ("information", 0.125, 0.0), "bits": ("information", 0.125, 0.0),
    "бит": ("information", 0.125, 0.0),
    "m": ("length", 1.0, -0.5), "metre": ("length", 1.0, 0.0), "metres": ("length", 1.0, 0.0),
    "meter": ("length", 1.0, 0.0), "meters": ("length", 1.0, 0.0),
    "g": ("mass", 0.001, -0.5), "gram": ("mass", 0.001, 0.0), "grams": ("mass", 0.001, 0.0),
    "t": ("mass", 1000.0, -0.5), "tonne": ("mass", 1000.0, 0.0), "tonnes": ("mass", 1000.0, 0.0),
    "s": ("time", 1.0, -0.5), "sec": ("time", 1.0, 0.0), "second": ("time", 1.0, 0.0),
    "seconds": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "minutes": ("time", 60.0, 0.0),
    "h": ("time", 3600.0, -0.5), "hour": ("time", 3600.0, 0.0), "hours": ("time", 3600.0, 0.0),
    "hz": ("frequency", 1.0, 0.0),
}
#: Exponent spellings.
EXPONENTS = {"": 1, "1": 1, "2": 2, "3": 3, "²": 2, "³": 3, "^2": 2, "^3": 3}
#: Log prior of each dimension for a field that holds sizes of files.
SIZE_PRIORS = {"information": 0.0, "length": -8.0, "mass": -8.0, "time": -8.0, "frequency": -8.0}
#: No dimension is likelier than another, as behind a stroke.
NEUTRAL = tuple({d: 0.0 for d in SIZE_PRIORS}.items())
#: In information every prefix is a power of 1,024; elsewhere of 1,000.
BASES = {"information": 1024.0}


class Trie:
    """Prefix tree; ``matches`` yields every stored key that starts at a position."""

    def __init__(self, keys: dict) -> None:
        self.root: dict = {}
        for key, value in keys.items():
            node = self.root
            for char in key:
                node = node.setdefault(char, {})
            node[None] = (key, value)

    def matches(self, text: str, start: int):
        node = self.root
        if None in node:
            yield start, node[None]
        for at in range(start, len(text)):
            node = node.get(text[at])
            if node is None:
                return
            if None in node:
                yield at + 1, node[None]


_PREFIX, _ROOT, _EXPONENT = Trie(PREFIXES), Trie(ROOTS), Trie(EXPONENTS)


@dataclass(frozen=True)
class Unit:
    dimension: str
    factor: float
    exponent: int
    score: float


def _fold(text: str) -> str:
    """Lower case without accents; superscript digits stay."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@lru_cache(maxsize=65536)
def parse_unit(spelling: str, priors: tuple[tuple[str, float], ...] = tuple(SIZE_PRIORS.items())) -> Unit | None:
    """The likeliest reading of a unit spelling, or None if no reading covers it.

    ``best[stage][position]`` holds the best partial decompositions; stages are
    prefix (may be empty), root (may be empty after a prefix) and exponent.
    """
    text, prior = _fold(spelling.strip()), dict(priors)
    if not text:
        return None
    after_prefix: dict[int, list[tuple[float, int, bool]]] = {0: [(0.0, 0, False)]}
    for end, (key, power) in _PREFIX.matches(text, 0):
        after_prefix.setdefault(end, []).append((-0.2 if len(key) > 1 else -0.4, power, True))
    best: Unit | None = None
    for middle, heads in after_prefix.items():
        for end, (root, (dimension, factor, weight)) in _ROOT.matches(text, middle):
            for score, power, has in heads:
                if not root and not has:
                    continue
                for stop, (_, exponent) in _EXPONENT.matches(text, end):
                    if stop != len(text) or (exponent != 1 and dimension == "information"):
                        continue
                    total = score + weight + prior.get(dimension, -20.0)
                    size = (BASES.get(dimension, 1000.0) ** power * factor) ** exponent
                    if best is None or (total, -size) > (best.score, -best.factor):
                        best = Unit(dimension, size, exponent, total)
    return best


def parse_compound(spelling: str, priors: tuple[tuple[str, float], ...] = tuple(SIZE_PRIORS.items())) -> Unit | None:
    """A product or quotient of units, such as ``MB/s``, ``kg·m²`` or ``GB per hour``; its dimension names the parts in order."""
    parts = re.split(r"\s*(/|·|\*|\bper\b)\s*", spelling.strip(), flags=re.I)
    whole = parse_unit(parts[0], priors)
    for sign, part in zip(parts[1::2], parts[2::2]):
        unit = parse_unit(part, NEUTRAL)
        if whole is None or unit is None:
            return None
        over = sign in "/" or sign.lower() == "per"
        whole = Unit(f"{whole.dimension}{'/' if over else '·'}{unit.dimension}", whole.factor / unit.factor if over else whole.factor * unit.factor, 1, whole.score + unit.score)
    return whole


_SPACES = "      　"
_GROUP = f"[{_SPACES}'’]"
_NUMBER = rf"\d{{1,3}}(?:{_GROUP}\d{{3}}(?!\d))+(?:[.,]\d+)?|\d[\d.,]*(?:[eE][+-]?\d+)?"
_UNIT = r"[^\W\d_]+(?:-[^\W\d_]+)?"
_TIMES = rf"(?:(?P<times>\d+)[{_SPACES}]*[x×*][{_SPACES}]*)?"
_TERM = re.compile(rf"(?<![\w.,]){_TIMES}(?P<number>{_NUMBER})[{_SPACES}\t]*-?[{_SPACES}]*(?P<unit>{_UNIT})?")
_BARE = re.compile(rf"(?:[~≈]|(?:about|approx|approximately|roughly|ca|circa|around|env|environ|etwa|rund|unos|aprox)\b\.?)*[\s{_SPACES}]*{_TIMES}(?P<number>{_NUMBER})[\s.]*$", re.I)
_BOUND = re.compile(r"[<>≤≥]|\b(?:up to|at least|at most|less than|more than|over|under|below|above|max|min|maximum|minimum|bis zu|jusqu|hasta)\b", re.I)
_RANGE = re.compile(rf"\d[{_SPACES}]*[\w]*[{_SPACES}]*(?:-|–|—|\.\.+|\bto\b|\band\b|\bbis\b)[{_SPACES}]*[~≈]?\d|\bbetween\b", re.I)
_NEGATIVE = re.compile(rf"(?:^|[\s(~≈])[-−–][{_SPACES}]*\d")
#: What holds or carries data: an amount beside one of these is its capacity and not the size of an item.
HOLDERS = r"memory|ram|vram|disks?|drives?|cards?|gpus?|cpus?|caches?|bandwidth"
_HOLDERS = re.compile(rf"\b(?:{HOLDERS})\b", re.I)
_PER = re.compile(rf"[{_SPACES}]*(?:/|\bper\b)[{_SPACES}]*({_UNIT})", re.I)
_CLAUSES = re.compile(r";|\.(?=\s|$)")
_WORD = re.compile(rf"(?<![\w.-]){_UNIT}(?![\w-])")
#: Words and marks after which a letter or two mean a unit.
_CUES = re.compile(r"(?:\b(?:in|en|holds?|are|is|reported|reports|unit|given|as|size)|[\[(:=])\s*$", re.I)
_SIZE_ROOT = re.compile(r"(?:b|byte|bytes|bit|bits|octets?|octetos?|oktett|ottetti|б|байт\w*|бит)$")


def parse_number(text: str) -> float | None:
    """A number by the rule that a point or comma before exactly three digits groups thousands.

    A spelling with an exponent is decimal throughout.
    """
    text = re.sub(_GROUP, "", text.strip())
    text = text.rstrip(".,")
    if not text:
        return None
    if re.search("[eE]", text):
        mantissa, exponent = re.split("[eE]", text)
        try:
            return float(mantissa.replace(",", ".")) * 10.0 ** int(exponent)
        except (ValueError, OverflowError):
            return None
    text = re.sub(r"[.,](?=\d{3}(?!\d))", "", text)
    text = text.replace(",", ".")
    try:
        return float(text)
    except ValueError:
        return None


def _size_unit(word: str | None) -> Unit | None:
    unit = parse_unit(word) if word else None
    return unit if unit and unit.dimension == "information" else None


def _terms(clause: str) -> list[tuple[int, int, float]]:
    """(start, end, value in bytes) of every amount with a unit."""
    out = []
    for m in _TERM.finditer(clause):
        unit, number = _size_unit(m["unit"]), parse_number(m["number"])
        if unit is None or number is None:
            continue
        out.append((m.start(), m.end(), number * unit.factor * (float(m["times"]) if m["times"] else 1.0)))
    return out


@lru_cache(maxsize=65536)
def stated_amount(text: str | None) -> float | None:
    """Bytes of the size that a free text states, or None.

    Clauses about capacities, rates and other quantities are passed over; bounded,
    ranged, negative and zero sizes count as not stated. Terms joined by ``+``
    are added.
    """
    for clause in _clauses(text):
        found = _terms(clause)
        if not found:
            continue
        if _BOUND.search(clause) or _RANGE.search(clause) or _NEGATIVE.search(clause):
            return None
        total, last = found[0][2], found[0][1]
        for start, end, value in found[1:]:
            if clause[last:start].strip() != "+":
                break
            total, last = total + value, end
        return total if total > 0 else None
    return None


def _clauses(text: str | None) -> list[str]:
    if not text:
        return []
    return [c for c in _CLAUSES.split(text) if c.strip() and not _of_another_quantity(c)]


def _of_another_quantity(clause: str) -> bool:
    """A clause speaks of something else than a size if it names a holder, or an amount in it has another dimension (a rate, a frequency)."""
    if _HOLDERS.search(clause):
        return True
    for m in _TERM.finditer(clause):
        per = _PER.match(clause, m.end())
        unit = parse_compound(m["unit"] + (f"/{per[1]}" if per else "")) if m["unit"] else None
        if unit is not None and unit.dimension != "information":
            return True
    return False


def stated_unit(text: str | None) -> str | None:
    """The unit that a text names for a size without giving a number."""
    for clause in _clauses(text):
        spans = [(m.start(), m.end()) for m in _TERM.finditer(clause) if _size_unit(m["unit"])]
        for m in _WORD.finditer(clause):
            if any(a <= m.start() < b for a, b in spans) or _size_unit(m[0]) is None:
                continue
            if _SIZE_ROOT.search(_fold(m[0])) and len(m[0]) > 1 or _CUES.search(clause[: m.start()]):
                return m[0]
    return None


@lru_cache(maxsize=65536)
def quantity(value: str | None, context: str | None, default_unit: str | None) -> float | None:
    """Bytes of an entered size: its own unit, else the stated one, else the default.

    None for null, blank, zero, negative, bounded, ranged and unknown entries.
    """
    if value is None:
        return None
    text = value.strip()
    bare = _BARE.match(text)
    if bare is None:
        return stated_amount(text)
    if _NEGATIVE.search(text):
        return None
    number = parse_number(bare["number"])
    unit = _size_unit(stated_unit(context) or default_unit)
    if number is None or unit is None:
        return None
    total = number * unit.factor * (float(bare["times"]) if bare["times"] else 1.0)
    return total if total > 0 and math.isfinite(total) else None


@F.pandas_udf(T.DoubleType())
def quantity_bytes(value: pd.Series, context: pd.Series, default_unit: pd.Series) -> pd.Series:
    """Vectorised ``quantity``."""
    clean = lambda s: [None if x is None or x != x else x for x in s]
    return pd.Series([quantity(*x) for x in zip(clean(value), clean(context), clean(default_unit))], dtype="float64")


@F.pandas_udf(T.DoubleType())
def amount_bytes(text: pd.Series) -> pd.Series:
    """Vectorised ``stated_amount``."""
    return pd.Series([stated_amount(x) if isinstance(x, str) else None for x in text], dtype="float64")


def _kb(size: Column) -> Column:
    return F.round(size / 1024).cast("long")


def published_at(text: Column) -> Column:
    """Timestamp of the date spellings of the catalogue; null where none fits."""
    clean = F.regexp_replace(F.trim(text), "Z$", "")
    return F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd")), F.try_to_timestamp(clean)).cast("timestamp_ntz")


def asset_sizes(assets: DataFrame, platform_units: DataFrame) -> DataFrame:
    """(record_key, item_no, size_kb) of the distribution entries.

    A bare number takes the unit its description states, else the platform's
    by the latest ``valid_from`` up to the date of publication (for a null date
    any row of the platform), else KB. Null content takes the size stated in
    the description. Repeated rows count once; null structs give no row.
    """
    history = platform_units.where(F.col("platform").isNotNull()).groupBy("platform").agg(F.sort_array(F.collect_set(F.struct("valid_from", "unit"))).alias("_history"))
    items = assets.select("identifier", "platform", published_at(F.col("date_published")).alias("_at"), F.posexplode("distribution").alias("_no", "_item"))
    items = items.select("identifier", "platform", "_at", "_no", F.col("_item.description").alias("_said"), F.col("_item.content_size_kb").alias("_size")).where(F.col("_size").isNotNull() | F.col("_said").isNotNull())
    joined = items.join(history, "platform", "left")
    fit = F.when(F.col("_at").isNull(), F.element_at("_history", -1)).otherwise(F.try_element_at(F.filter("_history", lambda x: x["valid_from"] <= F.col("_at")), F.lit(-1)))
    unit = F.coalesce(fit["unit"], F.lit("KB"))
    size = F.when(F.col("_size").isNull(), amount_bytes("_said")).otherwise(quantity_bytes(F.col("_size").cast("string"), F.col("_said"), unit))
    out = joined.select(F.col("identifier").alias("record_key"), F.col("_no").cast("int").alias("item_no"), _kb(size).alias("size_kb"))
    return out.where("record_key is not null and size_kb is not null").distinct()


def metadata_sizes(metadata: DataFrame) -> DataFrame:
    """(record_key, item_no = -1, size_kb) of ``size_in_mb``; the note may state the unit of a bare number."""
    size = quantity_bytes("size_in_mb", "note", F.lit("MB"))
    out = metadata.where("size_in_mb is not null").select(F.col("meta_id").cast("string").alias("record_key"), F.lit(-1).alias("item_no"), _kb(size).alias("size_kb"))
    return out.where("record_key is not null and size_kb is not null").distinct()


def sizes_in_kb(assets: DataFrame, metadata: DataFrame, platform_units: DataFrame) -> DataFrame:
    """Every size that can be told, in whole KB, of both tables."""
    return asset_sizes(assets, platform_units).unionByName(metadata_sizes(metadata))
