"""Entity types: fields, schemas, references and the envelope every entity carries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T

ENVELOPE = (
    "id",
    "organization_id",
    "schema_id",
    "entity_type",
    "path",
    "version",
    "created_at",
    "updated_at",
)
COLUMNS = (
    "id",
    "organization_id",
    "schema_id",
    "entity_type",
    "path",
    "properties",
    "version",
    "created_at",
    "updated_at",
)


class FieldType(str, Enum):
    STRING = "STRING"
    INTEGER = "INTEGER"
    FLOAT = "FLOAT"
    BOOLEAN = "BOOLEAN"
    TIMESTAMP = "TIMESTAMP"
    JSON = "JSON"
    FILE_REFERENCE = "FILE_REFERENCE"
    GEOMETRY = "GEOMETRY"
    TIMESERIES = "TIMESERIES"
    REFERENCE = "REFERENCE"
    ENTITY_REFERENCE = "ENTITY_REFERENCE"
    ENTITY_REFERENCE_ARRAY = "ENTITY_REFERENCE_ARRAY"

    @classmethod
    def parse(cls, raw: str | FieldType) -> FieldType:
        """Type names compare without regard to case; the upload aliases are accepted too."""
        if isinstance(raw, cls):
            return raw
        name = str(raw).strip().upper()
        name = TYPE_ALIASES.get(name, name)
        try:
            return cls(name)
        except ValueError:
            raise ValueError(f"unsupported field type {raw!r}") from None


# Type names accepted for column overrides.
TYPE_ALIASES = {
    "INT": "INTEGER",
    "DOUBLE": "FLOAT",
    "DECIMAL": "FLOAT",
    "BOOL": "BOOLEAN",
    "DATETIME": "TIMESTAMP",
}

REFERENCE_TYPES = (FieldType.REFERENCE, FieldType.ENTITY_REFERENCE, FieldType.ENTITY_REFERENCE_ARRAY)

SPARK_TYPES = {
    FieldType.STRING: T.StringType(),
    FieldType.INTEGER: T.LongType(),
    FieldType.FLOAT: T.DoubleType(),
    FieldType.BOOLEAN: T.BooleanType(),
    FieldType.TIMESTAMP: T.TimestampType(),
    FieldType.JSON: T.VariantType(),
    FieldType.FILE_REFERENCE: T.StringType(),
    FieldType.GEOMETRY: T.VariantType(),
    FieldType.TIMESERIES: T.VariantType(),
    FieldType.REFERENCE: T.StringType(),
    FieldType.ENTITY_REFERENCE: T.StringType(),
    FieldType.ENTITY_REFERENCE_ARRAY: T.ArrayType(T.StringType()),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType = FieldType.STRING
    required: bool = False
    reference_entity_type: str = ""
    validation: str = ""
    default: str = ""
    description: str = ""

    def __post_init__(self):
        object.__setattr__(self, "type", FieldType.parse(self.type))

    @property
    def rules(self) -> dict:
        """Validation rules, kept as JSON text; unreadable text counts as no rules."""
        if not self.validation.strip():
            return {}
        try:
            parsed = json.loads(self.validation)
        except ValueError:
            return {}
        return parsed if isinstance(parsed, dict) else {}


@dataclass(frozen=True)
class EntitySchema:
    name: str
    fields: tuple[Field, ...] = ()
    version: str = "1.0.0"
    status: str = "ACTIVE"
    id: str = ""
    organization_id: str = ""

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def canonical_reference(self) -> str | None:
        """The first REFERENCE field is the human-readable key of the type."""
        return next((f.name for f in self.fields if f.type is FieldType.REFERENCE), None)

    def with_field(self, new: Field) -> EntitySchema:
        """Add a field, or replace the one of the same name in place."""
        if self.field(new.name) is None:
            return replace(self, fields=(*self.fields, new))
        return replace(self, fields=tuple(new if f.name == new.name else f for f in self.fields))

    def without_field(self, name: str) -> EntitySchema:
        return replace(self, fields=tuple(f for f in self.fields if f.name != name))

    def check(self) -> None:
        """Definition checks; struct columns need names that differ by more than case."""
        seen: set[str] = set()
        for f in self.fields:
            if f.reference_entity_type.strip() and f.type not in REFERENCE_TYPES:
                raise ValueError(
                    f"field {f.name} cannot declare reference_entity_type: type {f.type.value} is no reference"
                )
            if f.name.lower() in seen:
                raise ValueError(f"field {f.name} is declared twice")
            seen.add(f.name.lower())

    def struct_type(self) -> T.StructType:
        self.check()
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type]) for f in self.fields])


@dataclass(frozen=True)
class PropertyFilter:
    """One property test. ``value`` of None or "" tests nothing in DAG filters; saved joins test ""."""

    key: str
    value: str | None = None
    exists: bool | None = None
    in_array: tuple[str, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "in_array", tuple(self.in_array or ()))
