"""Typed, schema-on-read entities on Spark."""

from entityframe.model import EntitySchema, Field, FieldType, PropertyFilter
from entityframe.plans import nodes
from entityframe.plans.compile import Options, Result
from entityframe.session import tune
from entityframe.sources.tables import EntityStore, entities_from

__all__ = [
    "EntitySchema",
    "EntityStore",
    "Field",
    "FieldType",
    "Options",
    "PropertyFilter",
    "Result",
    "entities_from",
    "nodes",
    "tune",
]
