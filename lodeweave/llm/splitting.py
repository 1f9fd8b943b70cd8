"""Splitting oversized texts at natural boundaries.

Balanced targets: the fewest pieces that can cover a text are counted, equal
target ends are placed once, and each end is snapped to the strongest boundary
nearby (paragraph, then line, sentence, word). Where a piece cannot reach its
target within the limit, or the last one would exceed it, the pieces that are
missing are added: the rest of the text gets new targets. A cut inside an unbroken run happens only where the run
itself is longer than the limit, or behind a sentence mark that needs no blank (as in Chinese). Each piece starts ``overlap`` characters
before the end of the one before it, at the next word start if one is near; only
where a run of nearly the limit follows is the repetition cut down, so that the
run fits.

All lengths are code points. Only the neighbourhoods of targets are looked at,
so a text costs little more than its copy; texts of any length are worked off
in one pass over an Arrow batch.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 2000, 200
#: The characters that end a word.
BREAKS = " \t\r\n"
_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n\s*")
_LINE = re.compile(r"[\r\n]+\s*")
_SENTENCE = re.compile(r"[.!?…]['\"»”’)\]]*[ \t\r\n]+|[。！？｡][」』”’）)\]]*\s*")
_WORD = re.compile(r"[ \t\r\n]+")
#: Boundary kinds from strongest to weakest, with how far from the target each may lie, as a part of the piece.
KINDS = (("paragraph", _PARAGRAPH, 0.25), ("line", _LINE, 0.2), ("sentence", _SENTENCE, 0.2), ("word", _WORD, 0.1))
_RUN = re.compile(r"[^ \t\r\n]+")


def _nearest(pattern: re.Pattern, text: str, low: int, high: int, target: int) -> int | None:
    """The match end in (low, high] that is nearest to the target; the text before it is kept."""
    best = None
    for m in pattern.finditer(text, max(0, low - 4), high):
        end = m.end()
        if low < end <= high and (best is None or abs(end - target) < abs(best - target)):
            best = end
        if end > target and best is not None:
            break
    return best


def _last_break(text: str, low: int, high: int) -> int | None:
    """The last place in (low, high] that is not inside a word, if there is one."""
    if high < len(text) and text[high] in BREAKS and high > low:
        return high
    at = max(text.rfind(c, low, high) for c in BREAKS)
    return at + 1 if at >= low and at + 1 > low else None


def _targets(start: int, n: int, limit: int, overlap: int) -> list[int]:
    """Ends of the fewest pieces of equal length that can cover the text from ``start`` on, but the last."""
    left = n - start
    count = 1 + -(-(left - limit) // (limit - overlap))
    length = -(-(left + (count - 1) * overlap) // count)
    return [start + length + k * (length - overlap) for k in range(count - 1)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, boundary kind at the end) of each piece; one piece if the text fits."""
    n = len(text)
    out: list[tuple[int, int, str]] = []
    start, done = 0, 0  # piece start; end of the text covered so far
    targets, at = _targets(0, n, limit, overlap) if n > limit else [], 0
    while n - start > limit:
        top = start + limit
        if at == len(targets) or not done < targets[at] <= top:
            targets, at = _targets(start, n, limit, overlap), 0
        target, at = targets[at], at + 1
        end, kind = None, ""
        for name, pattern, part in KINDS:
            reach = int(part * limit)
            end = _nearest(pattern, text, max(done, target - reach), min(top, target + reach), target)
            if end is not None:
                kind = name
                break
        if end is None:
            end, kind = _last_break(text, done, top), "word"
        if end is None:
            run = _RUN.match(text, done)
            if run is not None and run.end() - done <= limit:
                end, start = run.end(), max(start, run.end() - limit)
            else:
                end, kind = top, "forced"
        if end == n:
            break
        out.append((start, end, kind))
        start, done = _restart(text, start, end, overlap), end
    return [*out, (start, n, "end")]


def _restart(text: str, begun: int, end: int, overlap: int) -> int:
    """Start of the next piece: about ``overlap`` before ``end``, at a word start if one is near, after ``begun``."""
    wish = max(begun + 1, end - overlap)
    if wish >= end or wish == 0 or text[wish - 1] in BREAKS:
        return min(wish, end)
    m = _WORD.search(text, wish, min(end, wish + overlap // 4 + 1))
    if m is not None and m.end() < end:
        return m.end()
    back = _last_break(text, max(begun + 1, wish - overlap // 4), wish)
    return wish if back is None else back


def cuts_long_run(text: str, end: int, limit: int) -> bool:
    """Whether ``end`` lies inside an unbroken run longer than ``limit``."""
    if not 0 < end < len(text) or text[end - 1] in BREAKS or text[end] in BREAKS:
        return False
    first = 1 + max(text.rfind(c, 0, end) for c in BREAKS)
    return _RUN.match(text, first, first + limit + 1).end() - first > limit


def plain_text(column: str) -> Column:
    """``plain``, or, where that is null, ``html`` with each tag replaced by one space."""
    c = F.col(column)
    return F.coalesce(c["plain"], F.regexp_replace(c["html"], "<[^>]*>", " "))


_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("boundary", T.StringType()), T.StructField("hard", T.BooleanType()), T.StructField("piece", T.StringType())]))


def _splitter(limit: int, overlap: int, with_text: bool):
    @F.arrow_udf(_PIECES)
    def split(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text = value.as_py()
            out.append(None if text is None else [{"start": a, "end": b, "boundary": kind, "hard": cuts_long_run(text, b, limit), "piece": text[a:b] if with_text else None} for a, b, kind in pieces(text, limit, overlap)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("boundary", pa.string()), ("hard", pa.bool_()), ("piece", pa.string())])))

    return split


def _oversized(assets: DataFrame, fields: tuple[str, ...], limit: int) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), plain_text(f).alias("text")) for f in fields]))
    rows = assets.where("identifier is not null").select("identifier", each.alias("_f")).select("identifier", "_f.field_name", "_f.text")
    return rows.where(F.length("text") > limit)


def split_assets(assets: DataFrame, fields: tuple[str, ...] = ("description", "content"), limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(identifier, field_name, piece_no, start, end, boundary, piece) of the texts above the limit.

    Null texts and null identifiers give no row; texts of at most ``limit``
    characters are not oversized and give none either. A row delivered twice
    counts once. ``boundary`` is what the piece ends at: paragraph, line,
    sentence, word, forced, or end of text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    once = _oversized(assets, fields, limit).withColumn("_h", F.xxhash64("text")).dropDuplicates(["identifier", "field_name", "_h"])
    cut = once.withColumn("_p", _splitter(limit, overlap, with_text)("text"))
    out = cut.select("identifier", "field_name", F.posexplode("_p").alias("piece_no", "_p"))
    return out.select("identifier", "field_name", "piece_no", "_p.start", "_p.end", "_p.boundary", "_p.piece")


def oversized_texts(assets: DataFrame, fields: tuple[str, ...] = ("description", "content"), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(identifier, field_name, hard): hard = 1 where a piece had to end inside an unbroken run longer than the limit."""
    cut = _oversized(assets, fields, limit).withColumn("_p", _splitter(limit, overlap, False)("text"))
    hard = F.exists("_p", lambda p: p["hard"]).cast("int")
    return cut.select("identifier", "field_name", hard.alias("hard")).distinct()
