"""Freely typed values mapped to the entries of a reference list.

A symmetric-delete dictionary of the list is broadcast: every spelling of an
entry (value, title, turned forms) is stored under itself and under all forms
with up to two letters of its words deleted. A typed value looks up itself and its own deletions,
candidates are ranked by weighted Damerau-Levenshtein distance, and a value whose
best candidates are different entries, or too far, is reported as unmatched. How
often the literal entry occurs orders equal candidates, but decides none.

Only the reference list is broadcast, and its size is checked; the typed
values are reduced to distinct (field, value) rows first, so a spelling that a
third of all rows share is looked up once.

Null and blank values, values of other fields, and values that mean no single
entry are unmatched (valid_id null in ``map_values``).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 200_000
#: Typed words above this length are compared with the listed words of about their length; making their deletions would cost more.
LONG = 24


@dataclass(frozen=True)
class Wording:
    """What people write around a value; every part is a parameter, the defaults are fixed values.

    ``labels`` stand before a value and do not belong to it, ``tails`` behind it;
    ``long_tails`` are those long enough to be known when misspelled. ``edition`` are words for an
    edition, ``optional`` words that may be left out of a licence's name, ``fillers`` words that turn a name around.
    """

    labels: str = r"licen[cs]es?|lizenz|licence type|spdx|tasks?|task[_ ]ids?|task[_ ]categor(?:y|ies)|aufgabe|tarea|t[aâ]che|ml|category|released under|available under|published under|under|see|type"
    lead_ins: str = r"the|released under|available under|published under|lizenz|licence|license|aufgabe"
    tails: str = r"full text|only|unmodified|international|unported|supervised|unsupervised|licen[cs]e|problem|task|tasks|model|models|or later|deed|legalcode|text"
    long_tails: tuple[str, ...] = ("unmodified", "international", "supervised", "licence", "problem")
    edition: str = r"version|ver|v|edition|ed|release|rev"
    optional: frozenset[str] = frozenset({"licence", "license", "general", "use", "the", "agreement", "sharing"})
    fillers: frozenset[str] = frozenset({"for", "of", "on", "in", "the", "a"})


WORDING = Wording()


@lru_cache(maxsize=16)
def _patterns(w: Wording) -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """Label, tail, tail alone, and edition word."""
    return (
        re.compile(rf"^\W*(?:{w.labels})\s*[:=/|]\s*|^\W*(?:{w.lead_ins})\s+(?:the\s+)?", re.I),
        re.compile(rf"[\s,;(\[\-]+(?:{w.tails})\W*$", re.I), re.compile(rf"\W*(?:{w.tails})\W*", re.I), re.compile(rf"(?:{w.edition})"),
    )


def fold(text: str) -> str:
    """Compatibility form, lower case, accents kept apart from letters are dropped."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text


def words(text: str, camel: bool = True) -> list[str]:
    """Letters and digits runs of a folded text; with ``camel`` joined CamelCase words are cut apart."""
    if camel:
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    return re.findall(r"[^\W_]+", text.lower())


def distance(a: str, b: str, limit: float) -> float:
    """Weighted Damerau-Levenshtein distance: doubling a letter or dropping one of a pair 0.6, a transposition 0.85, other edits 1.

    ``limit`` + 1 stands for anything beyond the limit. Each letter that one string is ahead costs
    0.6 at least, so only a band of the table can matter.
    """
    if a == b:
        return 0.0
    m, n, beyond = len(a), len(b), limit + 1
    band = int(limit / 0.6 + 1e-9)
    if abs(m - n) > band:
        return beyond
    adds = [1.0] + [0.6 if j and b[j] == b[j - 1] else 1.0 for j in range(n)]
    before: list[float] = []
    row = [float(j) if j <= band else beyond for j in range(n + 1)]
    for i in range(1, m + 1):
        x, low, high = a[i - 1], i - band, i + band
        y = a[i - 2] if i > 1 else ""
        drop = 0.6 if x == y else 1.0
        now = [beyond] * (n + 1)
        best = beyond
        if low <= 0:
            low = 0
            best = now[0] = row[0] + 1.0
        last = now[0] if low == 0 else beyond
        for j in range(max(1, low), min(n, high) + 1):
            c = b[j - 1]
            cost = row[j - 1] if x == c else row[j - 1] + 1.0
            other = row[j] + drop
            if other < cost:
                cost = other
            other = last + adds[j]
            if other < cost:
                cost = other
            if j > 1 and y == c and x == b[j - 2] and i > 1:
                other = before[j - 2] + 0.85
                if other < cost:
                    cost = other
            now[j] = last = cost
            if cost < best:
                best = cost
        if best > beyond:
            return beyond
        before, row = row, now
    return min(row[n], beyond)


_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(LONG + 1)], np.uint64)
_INVERSE = np.array([pow(pow(_BASE, -1, 1 << 64), k, 1 << 64) for k in range(LONG + 1)], np.uint64)


@lru_cache(maxsize=64)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def deletions(word: str, most: int) -> np.ndarray:
    """Hashes of the word and of all its forms with up to ``most`` (at most two) letters deleted; longer words than ``LONG`` give none.

    A form's hash is put together from the hashes of the parts left of, between and right of what is deleted.
    """
    n = len(word)
    if n > LONG:
        return np.empty(0, np.uint64)
    c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ahead = np.zeros(n + 1, np.uint64)  # of the first letters
    ahead[1:] = np.cumsum(c * _INVERSE[:n], dtype=np.uint64) * _POWERS[:n]
    part = lambda a, b: ahead[b] - ahead[a] * _POWERS[b - a]
    out = [ahead[n:]]
    if most > 0 and n > 0:
        i = np.arange(n)
        out.append(ahead[i] * _POWERS[n - 1 - i] + part(i + 1, np.full(n, n)))
    if most > 1 and n > 1:
        i, j = _pairs(n)
        out.append(ahead[i] * _POWERS[n - 2 - i] + part(i + 1, j) * _POWERS[n - 1 - j] + part(j + 1, np.full(len(j), n)))
    return np.concatenate(out)


def collapsed(word: str) -> str:
    """The word with each run of one letter as one letter."""
    return re.sub(r"(.)\1+", r"\1", word)


def _allowed(word: str) -> float:
    """Edits that a word of this length may carry."""
    return 0.0 if len(word) < 4 else 1.0 if len(word) < 6 else 2.0


class Lexicon:
    """Symmetric-delete index over the words of the reference list, in compact form: sorted hashes of the forms with the words' numbers.

    Two edits need no more than two deletions on either side. Three edits within the bound of 2 can only be
    three doubled or dropped letters of pairs (a transposition among them would cost more); such words
    are equal once each run of one letter is one letter, and that form is indexed, too.
    """

    def __init__(self, vocabulary) -> None:
        self.words = sorted(set(vocabulary))
        forms, owners = [], []
        for number, word in enumerate(self.words):
            own = np.unique(self._forms(word, 2 if len(word) >= 6 else 1 if len(word) >= 4 else 0, len(word) >= 6))
            forms.append(own)
            owners.append(np.full(len(own), number, np.int32))
        hashes = np.concatenate(forms) if forms else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], (np.concatenate(owners) if owners else np.empty(0, np.int32))[order]
        self.by_length: dict[int, list[tuple[str, Counter]]] = defaultdict(list)
        for word in self.words:
            self.by_length[len(word)].append((word, Counter(word)))
        self.memo: dict[str, list[tuple[str, float]]] = {}

    @staticmethod
    def _forms(word: str, most: int, runs: bool) -> np.ndarray:
        forms = deletions(word, most)
        return np.append(forms, ~deletions(collapsed(word), 0)) if runs and len(word) <= LONG else forms

    def _candidates(self, word: str) -> list[str]:
        """Listed words that may lie within their bound of a typed word."""
        if len(word) <= LONG:
            forms = self._forms(word, 2 if len(word) >= 5 else 1 if len(word) >= 3 else 0, len(word) >= 3)
            low, high = np.searchsorted(self.hashes, forms, "left"), np.searchsorted(self.hashes, forms, "right")
            return [self.words[k] for k in sorted({k for a, b in zip(low, high) if a < b for k in self.owners[a:b].tolist()})]
        letters, out = Counter(word), []
        # The cheapest edit costs 0.6, so three are the most within a bound of 2; each adds or takes one letter at most.
        for n in range(len(word) - 3, len(word) + 4):
            for candidate, own in self.by_length.get(n, ()):
                if sum(abs(letters[c] - k) for c, k in own.items()) <= 6 and (letters - own).total() <= 3 and (own - letters).total() <= 3:
                    out.append(candidate)
        return out

    def near(self, word: str) -> list[tuple[str, float]]:
        """(word of the list, distance) of every word within its bound."""
        known = self.memo.get(word)
        if known is None:
            known = []
            for candidate in self._candidates(word):
                limit = _allowed(candidate)
                d = distance(word, candidate, limit)
                if d <= limit:
                    known.append((candidate, d))
            if len(self.memo) < 200_000:
                self.memo[word] = known
        return known


@lru_cache(maxsize=1 << 16)
def _variants(word: str) -> set[str]:
    """Spellings that mean the same word: plural, British and American endings."""
    out = {word}
    for a, b in (("isation", "ization"), ("ise", "ize"), ("isations", "izations"), ("licence", "license"), ("colour", "color"), ("labelling", "labeling"), ("modelling", "modeling"), ("our", "or")):
        if word.endswith(a):
            out.add(word[: -len(a)] + b)
        elif word.endswith(b):
            out.add(word[: -len(b)] + a)
    return out | {w + "s" for w in out} | {w + "es" for w in out if w.endswith(("s", "h", "x"))} | {w[:-1] + "ies" for w in out if w.endswith("y")}


class Matcher:
    """All spellings of one field's entries, with the rules of editions, turns and cut words.

    ``entries``: (valid_id, value, title or None, frequency of the literal value).
    """

    def __init__(self, entries: list[tuple[int, str, str | None, int]], wording: Wording = WORDING) -> None:
        self.wording = wording
        self.frequency = {v: n for v, _, _, n in entries}
        self.literal = {value for _, value, _, _ in entries}
        #: name words (sorted forms too) -> edition -> valid_id
        self.names: dict[tuple[str, ...], dict[str, set[int]]] = {}
        same: dict[str, str] = {}
        for valid_id, value, title, _ in entries:
            for spelling in filter(None, (value, title)):
                forms, edition = self._split(fold(spelling), title is not None)
                for form in forms:
                    self.names.setdefault(form, {}).setdefault(edition, set()).add(valid_id)
                    for w in form:
                        for v in _variants(w):
                            same.setdefault(v, w)
                        same[w] = w
        self.same = same
        self.lexicon = Lexicon(same)
        self.read: dict[str, list[tuple[str, float]]] = {}
        self.by_first: dict[tuple[str, ...], list[tuple[str, ...]]] = defaultdict(list)
        for form in self.names:
            self.by_first[form[:-1]].append(form)
        self.joined: dict[str, tuple[str, ...]] = {}
        for form in self.names:
            self.joined.setdefault("".join(form), form)
        self.joined_lexicon = Lexicon(self.joined)
        self.beginnings = {form[:n] for form in self.names for n in range(len(form) + 1)}

    def _split(self, text: str, licence: bool) -> tuple[set[tuple[str, ...]], str]:
        """Forms of the name and edition ("" if none) of a listed spelling."""
        m = re.search(r"(?:^|[\s\-_])(\d+(?:\.\d+)*)$", text)
        name = text[: m.start()] if m else text
        forms = self._forms(tuple(words(name)), licence) | self._forms(tuple(words(name, camel=False)), licence)
        return forms, m[1] if m else ""

    def _forms(self, name: tuple[str, ...], licence: bool) -> set[tuple[str, ...]]:
        """The name, without its optional words, and with head and tail turned."""
        forms = {name}
        if licence:
            core = tuple(w for w in name if w not in {"licence", "license"})
            forms |= {core, tuple(w for w in name if w not in self.wording.optional)}
        return {f for f in forms if f}

    def _edition(self, editions: dict[str, set[int]], edition: str) -> set[int]:
        """Ids of the edition meant: 4 means 4.0; without an edition only a name with a single one is clear."""
        if edition:
            wanted = edition if "." in edition else edition + ".0"
            return editions.get(wanted, set()) | (editions.get(edition, set()) if edition != wanted else set())
        if "" in editions:
            return editions[""]
        every = set().union(*editions.values())
        return every if len(every) == 1 else set()

    def _readings(self, typed: list[str]) -> list[list[tuple[str, float]]] | None:
        """For each typed word the listed words it may stand for."""
        out = []
        for w in typed:
            own = self.read.get(w)
            if own is None:
                near = [(self.same[x], d) for x, d in self.lexicon.near(w)]
                own = [x for x in near if x[1] == 0] or sorted(near, key=lambda x: x[1])
                if len(self.read) < 200_000:
                    self.read[w] = own
            if not own:
                return None
            out.append(own)
        return out

    def _spellings(self, typed: list[str]):
        """The typed words as they stand, and with their parts turned: X of Y, X (Y), X on Y."""
        yield typed
        for i, w in enumerate(typed):
            if w in self.wording.fillers and 0 < i < len(typed) - 1:
                yield typed[i + 1 :] + typed[:i]
        bare = [w for w in typed if w not in self.wording.fillers]
        if len(bare) < len(typed):
            yield bare

    def _names(self, typed: list[str]) -> dict[tuple[str, ...], float]:
        """Listed names that the typed words mean, with their distance."""
        found: dict[tuple[str, ...], float] = {}

        def put(name: tuple[str, ...], d: float) -> None:
            if d < found.get(name, 99.0):
                found[name] = d

        for spelling in self._spellings(typed):
            if not spelling:
                continue
            readings = self._readings(spelling)
            if readings is not None:
                for name, d in _products(readings, self.beginnings):
                    if name in self.names and d <= 3.0:
                        put(name, d)
            glued = "".join(spelling)
            for joined, d in self.joined_lexicon.near(glued):
                # A digit is never a slip: it may be of an edition that is not listed.
                if len(glued) >= 6 and re.sub(r"\D", "", glued) == re.sub(r"\D", "", joined):
                    put(self.joined[joined], d)
            # A cut last word: at least three of its letters, and only one listed name goes on so.
            head, last = spelling[:-1], spelling[-1]
            if len(last) >= 3 and head:
                heads = self._readings(head)
                for name, d in _products(heads, self.beginnings) if heads is not None else ():
                    goes_on = [f for f in self.by_first.get(name, ()) if any(v.startswith(last) for v in _variants(f[-1])) and f[-1] != last]
                    if len(goes_on) == 1 and d == 0:
                        put(goes_on[0], 0.5 + d)
        return found

    def match(self, typed: str | None) -> int | None:
        """valid_id of the one entry that a typed value means, else None."""
        if typed is None:
            return None
        best: dict[int, float] = {}
        for text in _readings_of(fold(typed), self.wording):
            for name_words, edition in _editions(text, self.wording):
                for name, d in self._names(name_words).items():
                    for valid_id in self._edition(self.names[name], edition):
                        best[valid_id] = min(d, best.get(valid_id, 99.0))
            if best:
                break
        if not best:
            return None
        ranked = sorted(best.items(), key=lambda x: (x[1], -self.frequency.get(x[0], 0), x[0]))
        if len(ranked) > 1 and ranked[1][1] - ranked[0][1] < 0.3:
            return None
        return ranked[0][0]


def _products(readings: list[list[tuple[str, float]]], beginnings: set[tuple[str, ...]]) -> list[tuple[tuple[str, ...], float]]:
    """Combinations of word readings that begin a listed name, each with its least sum of distances."""
    paths: dict[tuple[str, ...], float] = {(): 0.0}
    for options in readings:
        longer: dict[tuple[str, ...], float] = {}
        for p, d in paths.items():
            for w, e in options:
                if (q := (*p, w)) in beginnings and d + e < longer.get(q, 99.0):
                    longer[q] = d + e
        paths = longer
    return list(paths.items())


_URL = re.compile(r"^\W*(?:https?://)?(?:www\.)?[\w-]+(?:\.[a-z]+)+/(?P<path>\S+?)\W*$", re.I)
_LAST = re.compile(r"[\s,;(\[\-]+([^\W\d_]{5,})\W*$")
_TURNED = re.compile(r"^(?P<a>[^()]+)\((?P<b>[^()]+)\)(?P<rest>.*)$")


def _readings_of(text: str, wording: Wording = WORDING):
    """The value cleaned of labels, quotes and remarks, in the order of how much is taken away."""
    text = " ".join(text.split())
    url = _URL.match(text)
    if url:
        path = re.sub(r"\.(?:html?|txt|md|php)$", "", url["path"].strip("/"))
        path = re.sub(r"/(?:legalcode|deed|index)(?:\.\w+)?$", "", path)
        yield re.sub(r"/", " ", path)
        return
    label, tail, alone, _ = _patterns(wording)
    seen = set()
    while True:  # each layer taken away makes the text shorter
        if text and text not in seen:
            seen.add(text)
            yield text
            turned = _TURNED.match(text)
            if turned and not alone.fullmatch(turned["b"]):
                yield f"{turned['b']} {turned['a']} {turned['rest']}"
        shorter = label.sub("", text, count=1)
        cut = tail.sub("", shorter, count=1)
        if cut == shorter:
            last = _LAST.search(shorter)
            if last and any(distance(last[1].lower(), t, 2.0) <= 2.0 for t in wording.long_tails):
                cut = shorter[: last.start()]
        shorter = cut.strip(" \t\"'.,;:*!?")
        if shorter == text:
            break
        text = shorter


def _editions(text: str, wording: Wording = WORDING):
    """(name words, edition) of a cleaned value; an edition stands at the end, perhaps behind a word for it."""
    text = text.strip(" \t\"'.,;:*!?()[]{}")
    m = text[-1:].isdigit() and re.search(r"(?P<name>.*?)(?P<cue>[^\W\d_]*)[\s.,_\-]*(?<![\d.])(?P<edition>\d+(?:\.\d+)*)$", text)
    if not m:
        yield from ((w, "") for w in _cuts(text))
        return
    name, cue = m["name"], m["cue"].lower()
    edition = m["edition"]
    if cue and _is_cue(cue, wording):
        yield from ((w, edition) for w in _cuts(name))
    yield from ((w, edition) for w in _cuts(name + m["cue"]))


def _cuts(text: str) -> list[list[str]]:
    """The words with and without CamelCase cut apart; one list where that is the same."""
    apart, whole = words(text), words(text, camel=False)
    return [apart] if apart == whole else [apart, whole]


@lru_cache(maxsize=4096)
def _is_cue(word: str, wording: Wording = WORDING) -> bool:
    """A word for edition, or a misspelling of "version"."""
    return _patterns(wording)[3].fullmatch(word) is not None or (len(word) >= 5 and distance(word, "version", 2.0) <= 2.0)


def reference(valid_values: DataFrame, field: str | None = None, asset_type: str = "base") -> list[tuple]:
    """(field, valid_id, value, title) of the list, collected; its size is checked."""
    rows = valid_values.where(F.col("asset_type") == asset_type).where("valid_id is not null and value is not null and field is not null")
    if field:
        rows = rows.where(F.col("field") == field)
    rows = rows.select("field", "valid_id", "value", "title").distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries are too many to broadcast")
    return [tuple(r) for r in rows]


def matchers(entries: list[tuple], wording: Wording = WORDING) -> dict[str, Matcher]:
    """A matcher for each field of (field, valid_id, value, title, frequency) rows."""
    by_field = defaultdict(list)
    for field, *rest in entries:
        by_field[field].append(tuple(rest))
    return {field: Matcher(rest, wording) for field, rest in by_field.items()}


def map_values(values: DataFrame, valid_values: DataFrame, asset_type: str = "base", wording: Wording = WORDING) -> DataFrame:
    """(field, original_value, literal, valid_id) of every distinct typed value; valid_id is null where none is meant."""
    spark = values.sparkSession
    listed = reference(valid_values, asset_type=asset_type)
    typed = values.select("field", "original_value").groupBy("field", "original_value").agg(F.count("*").alias("n"))
    pool = spark.createDataFrame([(f, v, i) for f, i, v, _ in listed], "field string, original_value string, _valid long")
    counts = {(r["field"], r["original_value"]): r["n"] for r in typed.join(pool.select("field", "original_value").distinct(), ["field", "original_value"]).collect()} if listed else {}  # at most one row per entry
    entries = sorted((f, i, v, t or "", counts.get((f, v), 0)) for f, i, v, t in listed)
    # The dictionary is made once, here, and sent as it is.
    shared = spark.sparkContext.broadcast(matchers([(f, i, v, t or None, n) for f, i, v, t, n in entries], wording))

    @F.pandas_udf("long")
    def find(field: pd.Series, value: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known[f].match(v) if f in known and isinstance(v, str) else None for f, v in zip(field, value)], dtype="Int64")

    # Distinct values are few bytes but much work each, so they are spread evenly before they are matched.
    spread = typed.select("field", "original_value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = spread.join(F.broadcast(pool), ["field", "original_value"], "left")
    found = F.coalesce("_valid", find("field", "original_value"))
    return out.select("field", "original_value", F.col("_valid").isNotNull().alias("literal"), found.alias("valid_id"))


def mapped_rows(values: DataFrame, valid_values: DataFrame) -> DataFrame:
    """(value_id, field, original_value, literal, valid_id) of every row; repeated rows count once."""
    rows = values.select("value_id", "field", "original_value").distinct()
    mapped = map_values(rows, valid_values).select(F.col("field").alias("_f"), F.col("original_value").alias("_o"), "literal", "valid_id")
    out = rows.join(mapped, F.col("field").eqNullSafe(F.col("_f")) & F.col("original_value").eqNullSafe(F.col("_o")), "left")
    return out.select("value_id", "field", "original_value", F.coalesce("literal", F.lit(False)).alias("literal"), "valid_id")


def mapped_found(values: DataFrame, valid_values: DataFrame) -> DataFrame:
    """(value_id, valid_id) of the rows that are not literally listed but mean one entry."""
    rows = values.where("value_id is not null and original_value is not null and field is not null").select("value_id", "field", "original_value").distinct()
    mapped = map_values(rows, valid_values).where("not literal and valid_id is not null")
    return rows.join(mapped, ["field", "original_value"]).select("value_id", "valid_id").distinct()


def misses(values: DataFrame, valid_values: DataFrame) -> DataFrame:
    """Report of unmatched values: (field, original_value, rows), most frequent first within a field."""
    rows = values.select("value_id", "field", "original_value").distinct()
    counted = rows.groupBy("field", "original_value").agg(F.count("*").alias("rows"))
    mapped = map_values(rows, valid_values).where("valid_id is null").select(F.col("field").alias("_f"), F.col("original_value").alias("_o"))
    return counted.join(mapped, F.col("field").eqNullSafe(F.col("_f")) & F.col("original_value").eqNullSafe(F.col("_o")), "left_semi").orderBy("field", F.desc("rows"), "original_value")
