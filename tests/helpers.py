"""Small entity frames for unit tests."""

import json

from pyspark.sql import functions as F

from entityframe import EntityStore, entities_from


def bags(spark, entity_type, rows, org="org"):
    """Schemaless entities from (id, path, properties dict) triples; later rows are older."""
    data = [(i, p, json.dumps(props), n) for n, (i, p, props) in enumerate(rows)]
    df = spark.createDataFrame(data, "id string, path string, bag string, made_at int")
    created = F.timestamp_seconds(F.lit(1_700_000_000) - F.col("made_at"))
    return entities_from(df, entity_type, "id", F.parse_json("bag"), path="path", created_at=created, organization=org)


def typed(spark, entity_type, ddl, rows, org="org"):
    """Typed entities from tuples whose first item is the id."""
    data = [(*r, n) for n, r in enumerate(rows)]
    df = spark.createDataFrame(data, f"id string, {ddl}, made_at int")
    names = [c for c in df.columns if c not in ("id", "made_at")]
    created = F.timestamp_seconds(F.lit(1_700_000_000) - F.col("made_at"))
    return entities_from(df, entity_type, "id", names, created_at=created, organization=org)


def store(frames, schemas=()):
    out = EntityStore(frames=dict(frames))
    for s in schemas:
        out.schemas[s.name] = s
    return out


def column(df, name):
    return [r[0] for r in df.select(name).collect()]
