"""Field registry: one description of each metadata field drives schemas, filter checks and descriptions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH, RANGE = ("==", "!="), (">", "<", ">=", "<=")
#: Legal comparisons by kind of field.
OPERATORS = {"date": RANGE, "categorical": MATCH, "numerical": MATCH + RANGE}
_TYPES = {"string": T.StringType(), "long": T.LongType(), "float": T.FloatType(), "boolean": T.BooleanType()}
_PYTHON = {"string": str, "long": int, "float": float, "boolean": bool}


@dataclass(frozen=True)
class FieldSpec:
    """A metadata field: element type, kind (date, categorical, numerical), bounds, allowed values."""

    name: str
    element: str = "string"
    kind: str = "categorical"
    is_list: bool = False
    max_length: int | None = None
    max_items: int | None = None
    text_match: bool = False
    pattern: str | None = None
    values: tuple[str, ...] | None = None

    @property
    def spark_type(self) -> T.DataType:
        base = _TYPES[self.element]
        return T.ArrayType(base) if self.is_list else base

    @property
    def operators(self) -> tuple[str, ...]:
        return OPERATORS[self.kind]

    def convert(self, value):
        """The literal in the field's type, or ValueError. Strings that spell a number or truth value are accepted."""
        want = _PYTHON[self.element]
        if value is None:
            raise ValueError(f"{self.name}: null is no value to compare with")
        if want is bool:
            if isinstance(value, bool):
                return value
            if str(value).lower() in ("true", "false"):
                return str(value).lower() == "true"
            raise ValueError(f"{self.name}: {value!r} is not a truth value")
        if want in (int, float):
            if isinstance(value, bool):
                raise ValueError(f"{self.name}: {value!r} is not a number")
            number = float(value)
            if want is int and number != int(number):
                raise ValueError(f"{self.name}: {value!r} is not a whole number")
            return want(number)
        if not isinstance(value, str):
            raise ValueError(f"{self.name}: {value!r} is not a string")
        return value

    def valid(self, column: Column) -> Column:
        """True where a stored value keeps the field's bounds; null counts as kept."""
        each = []
        if self.max_length is not None and self.element == "string":
            each.append(lambda x: F.length(x) <= self.max_length)
        if self.pattern:
            each.append(lambda x: F.rlike(x, F.lit(self.pattern)))
        if self.values:
            each.append(lambda x: F.lower(x).isin([v.lower() for v in self.values]))
        ok = F.lit(True)
        for check in each:
            ok = ok & (F.forall(column, check) if self.is_list else check(column))
        if self.is_list and self.max_items is not None:
            ok = ok & (F.size(column) <= self.max_items)
        return F.coalesce(ok, F.lit(True))


#: The catalogue's metadata fields with their types and bounds.
BASE = [
    FieldSpec("platform", max_length=32),
    FieldSpec("name", max_length=256, text_match=True),
    FieldSpec("date_published", kind="date", max_length=22),
    FieldSpec("same_as", max_length=256),
    FieldSpec("research_areas", is_list=True, max_length=128, max_items=16),
    FieldSpec("ml_tasks", is_list=True, max_length=64, max_items=64),
    FieldSpec("modalities", is_list=True, max_length=16, max_items=16),
    FieldSpec("languages", is_list=True, max_length=4, max_items=128),
    FieldSpec("industrial_sectors", is_list=True, max_length=128, max_items=16),
    FieldSpec("application_areas", is_list=True, max_length=128, max_items=16),
    FieldSpec("license", max_length=32),
    FieldSpec("frameworks", is_list=True, max_length=128, max_items=32),
]
SPECIFIC = {
    "datasets": [
        FieldSpec("datapoint_count", "long", "numerical"),
        FieldSpec("feature_count", "long", "numerical"),
        FieldSpec("data_formats", is_list=True, max_length=16, max_items=16),
        FieldSpec("label_types", is_list=True, max_length=32, max_items=8),
        FieldSpec("collection_methods", is_list=True, max_length=32, max_items=8),
        FieldSpec("source_type", max_length=32),
        FieldSpec("update_frequency", max_length=32),
        FieldSpec("dataset_size_gigabytes", "float", "numerical"),
        FieldSpec("class_count", "long", "numerical"),
        FieldSpec("geo_coverage", is_list=True, max_length=4, max_items=64),
        FieldSpec("temporal_coverage_start", kind="date", max_length=16),
        FieldSpec("temporal_coverage_end", kind="date", max_length=16),
    ],
    "ml_models": [
        FieldSpec("parameter_count_millions", "float", "numerical"),
        FieldSpec("model_size_gigabytes", "float", "numerical"),
        FieldSpec("architecture_families", is_list=True, max_length=32, max_items=16),
        FieldSpec("fine_tuned", "boolean"),
        FieldSpec("training_techniques", is_list=True, max_length=64, max_items=16),
        FieldSpec("training_compute_gpu_hours", "float", "numerical"),
        FieldSpec("llm_max_sequence_length", "long", "numerical"),
        FieldSpec("vocab_size", "long", "numerical"),
        FieldSpec("llm_training_data_volume_tokens", "long", "numerical"),
    ],
    "publications": [
        FieldSpec("authors", is_list=True, max_length=128, max_items=64),
        FieldSpec("affiliations", is_list=True, max_length=128, max_items=32),
        FieldSpec("publication_types", is_list=True, max_length=128, max_items=8),
        FieldSpec("publication_venues", is_list=True, max_length=128, max_items=4),
        FieldSpec("news_categories", is_list=True, max_length=32, max_items=4),
        FieldSpec("peer_reviewed", "boolean"),
        FieldSpec("open_access", "boolean"),
        FieldSpec("doi", max_length=128),
        FieldSpec("citation_count", "long", "numerical"),
    ],
    "educational_resources": [
        FieldSpec("resource_types", is_list=True, max_length=64, max_items=8),
        FieldSpec("educational_levels", is_list=True, max_length=128, max_items=8),
        FieldSpec("competency_levels", is_list=True, max_length=32, max_items=4),
        FieldSpec("learning_modes", is_list=True, max_length=32, max_items=4),
        FieldSpec("educational_paces", is_list=True, max_length=32, max_items=4),
        FieldSpec("prerequisites", is_list=True, max_length=128, max_items=16),
        FieldSpec("target_audiences", is_list=True, max_length=64, max_items=16),
        FieldSpec("estimated_duration_hours", "float", "numerical"),
        FieldSpec("provider", max_length=128),
        FieldSpec("certification_available", "boolean"),
    ],
}


class Registry:
    """The fields of one asset type."""

    def __init__(self, fields: list[FieldSpec]) -> None:
        self.fields = {f.name: f for f in fields}

    @classmethod
    def of(cls, asset_type: str) -> Registry:
        """Base fields plus those of the type; a type without metadata raises ValueError."""
        if asset_type not in SPECIFIC:
            raise ValueError(f"{asset_type!r} has no metadata fields")
        return cls(BASE + SPECIFIC[asset_type])

    def with_values(self, valid_values: DataFrame, asset_type: str = "base", most: int = 100_000) -> Registry:
        """The fields with the allowed values that a list (asset_type, field, value) names for them; its size is checked.

        Values under ``base`` hold for every type. Fields that the list does not name stay free.
        """
        rows = valid_values.where(F.col("asset_type").isin("base", asset_type) & F.col("value").isNotNull()).select("field", "value").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} allowed values")
        listed: dict[str, list[str]] = {}
        for field, value in sorted(tuple(r) for r in rows):
            listed.setdefault(field, []).append(value)
        return Registry([replace(f, values=tuple(listed[f.name])) if f.name in listed else f for f in self.fields.values()])

    def __getitem__(self, name: str) -> FieldSpec:
        if name not in self.fields:
            raise ValueError(f"unknown field {name!r}")
        return self.fields[name]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, True) for f in self.fields.values()])

    def field_schema(self) -> list[dict]:
        """Filterable fields for a caller: name, type, operators, allowed values."""
        return [{"field": f.name, "type": f.spark_type.simpleString(), "operators": list(f.operators), **({"values": list(f.values)} if f.values else {})} for f in self.fields.values()]

    def filter_schema(self, name: str) -> dict:
        """JSON schema of a filter on one field."""
        f = self[name]
        kind = {"string": "string", "long": "integer", "float": "number", "boolean": "boolean"}[f.element]
        value = {"type": kind} | ({"enum": list(f.values)} if f.values else {}) | ({"maxLength": f.max_length} if f.max_length and f.element == "string" else {}) | ({"pattern": f.pattern} if f.pattern else {})
        expression = {"type": "object", "properties": {"value": value, "comparison_operator": {"enum": list(f.operators)}}, "required": ["value", "comparison_operator"]}
        return {"type": "object", "properties": {"field": {"const": name}, "logical_operator": {"enum": ["AND", "OR"]}, "expressions": {"type": "array", "items": expression, "minItems": 1, "maxItems": 5}}, "required": ["field", "logical_operator", "expressions"]}
