"""Typed metadata filters compiled to Column expressions.

A filter is a field, AND or OR, and up to five comparisons; up to five filters
are joined by AND. Checks run before any plan is built: the field exists, the
comparison is legal for its kind, the literal has the field's type. Strings
compare in lower case on both sides. A null column satisfies neither a
comparison nor its negation (three-valued logic).
"""

from __future__ import annotations

import difflib
import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.text import text_match
from lodeweave.schema import FieldSpec, Registry

MAX_FILTERS, MAX_EXPRESSIONS, MAX_NAME, MAX_TEXT = 5, 5, 30, 200
_COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Expression:
    value: object
    comparison_operator: str


@dataclass(frozen=True)
class Filter:
    field: str
    logical_operator: str
    expressions: tuple[Expression, ...]

    @classmethod
    def parse(cls, raw: dict) -> Filter:
        """From a nested dictionary; a condition's ``processed_value`` stands for ``value``, and null is an error."""
        out = []
        for e in raw["expressions"]:
            value = e["value"] if "value" in e else e.get("processed_value")
            if value is None:
                raise ValueError(f"{raw['field']}: an expression has no value")
            out.append(Expression(value, e["comparison_operator"]))
        return cls(raw["field"], raw.get("logical_operator", "AND"), tuple(out))


def check(f: Filter, spec: FieldSpec) -> Filter:
    """The filter with its literals in the field's type, or ValueError."""
    if len(f.field) > MAX_NAME:
        raise ValueError("field name too long")
    if f.logical_operator not in ("AND", "OR"):
        raise ValueError(f"unknown logical operator {f.logical_operator!r}")
    if not 1 <= len(f.expressions) <= MAX_EXPRESSIONS:
        raise ValueError(f"a filter has 1 to {MAX_EXPRESSIONS} expressions")
    out = []
    for e in f.expressions:
        if e.comparison_operator not in spec.operators:
            raise ValueError(f"{f.field}: {e.comparison_operator!r} is not among {spec.operators}")
        value = spec.convert(e.value)
        if spec.values and value.lower() not in {v.lower() for v in spec.values}:
            raise ValueError(f"{f.field}: {value!r} is not an allowed value")
        out.append(Expression(value, e.comparison_operator))
    return Filter(f.field, f.logical_operator, tuple(out))


def _literal(value):
    return F.lit(value.lower() if isinstance(value, str) else value)


def _one(spec: FieldSpec, column: Column, e: Expression) -> Column:
    if spec.is_list:
        held = F.array_compact(column)
        held = F.transform(held, F.lower) if spec.element == "string" else held
        has = F.array_contains(held, _literal(e.value))
        return has if e.comparison_operator == "==" else ~has
    if spec.text_match:
        has = text_match(column, e.value)
        return has if e.comparison_operator == "==" else ~has
    if spec.kind == "date":
        # As points in time: a lower-cased T in a string comparison would misplace rows of the same day.
        return _COMPARE[e.comparison_operator](F.try_to_timestamp(column), F.try_to_timestamp(F.lit(e.value)))
    left = F.lower(column) if spec.element == "string" else column
    return _COMPARE[e.comparison_operator](left, _literal(e.value))


def compile_filter(f: Filter, registry: Registry, column: Column | None = None) -> Column:
    """Column of one filter."""
    spec = registry[f.field]
    f = check(f, spec)
    target = F.col(f.field) if column is None else column
    join = operator.and_ if f.logical_operator == "AND" else operator.or_
    return reduce(join, [_one(spec, target, e) for e in f.expressions])


def compile_filters(filters: Sequence[Filter], registry: Registry, exclude: Iterable[str] = (), id_column: str = "asset_id") -> Column:
    """All filters joined by AND, and the excluded ids; true if there is nothing to filter by.

    ``exclude`` is for a short list of ids; a long one belongs in an anti-join.
    """
    if len(filters) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    parts = [compile_filter(f, registry) for f in filters]
    banned = list(exclude)
    if banned:
        parts.append(~F.col(id_column).isin(banned))
    return reduce(operator.and_, parts) if parts else F.lit(True)


def validate_query(text: str, topk: int) -> str:
    """A query text of 1 to 200 characters and 1 to 100 results, or ValueError."""
    if not text or not text.strip() or len(text) > MAX_TEXT:
        raise ValueError(f"a query has 1 to {MAX_TEXT} characters")
    if not 1 <= topk <= 100:
        raise ValueError("topk lies between 1 and 100")
    return text


def validate_asset_type(asset_type: str, built: Iterable[str], known: Iterable[str], allow_all: bool = True) -> str:
    """A known and built asset type; ``all`` only where it is allowed."""
    if asset_type == "all":
        if not allow_all:
            raise ValueError("filters need one asset type")
        return asset_type
    if asset_type not in set(known):
        raise ValueError(f"unknown asset type {asset_type!r}")
    if asset_type not in set(built):
        raise ValueError(f"{asset_type!r} has no collection yet")
    return asset_type


def nearest_allowed(value: str, allowed: Sequence[str], alike: float = 0.8) -> str | None:
    """The allowed value that a spelling means: equal but for case and separators, else the one clearly nearest; None if there is none."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    same = sorted({a for a in allowed if plain(a) == plain(value)})
    if same:
        return same[0]
    near = sorted(((difflib.SequenceMatcher(None, plain(value), plain(a)).ratio(), a) for a in set(allowed)), key=lambda x: (-x[0], x[1]))
    if not near or near[0][0] < alike or len(near) > 1 and near[1][0] == near[0][0]:
        return None
    return near[0][1]


def condition(raw: dict, registry: Registry) -> Filter | None:
    """A parsed natural-language condition as a filter, dropping expressions that do not fit; None if none is left.

    A value that is nearly an allowed one of the field counts as that.
    """
    if raw.get("discard") or raw.get("field") not in registry.fields:
        return None
    spec, kept = registry[raw["field"]], []
    for e in raw.get("expressions", []):
        value = e.get("processed_value", e.get("value"))
        if value in (None, "NONE") or e.get("discard"):
            continue
        try:
            if spec.values and isinstance(value, str):
                value = nearest_allowed(value, spec.values) or value
            kept += check(Filter(raw["field"], "AND", (Expression(value, e["comparison_operator"]),)), spec).expressions
        except (ValueError, TypeError):
            continue
    return Filter(raw["field"], raw.get("logical_operator", "AND"), tuple(kept[:MAX_EXPRESSIONS])) if kept else None
