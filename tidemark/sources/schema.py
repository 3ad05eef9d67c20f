"""Fields of a topic, from the Avro schema its messages are registered with."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

# Avro primitive types and the Spark types they are read as.
AVRO_PRIMITIVES = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
}


def schema_from_avro(avro_schema: str) -> T.StructType:
    """Spark schema of an Avro record.

    Fields of primitive or optional primitive types have their Spark type. Of all others
    (records, arrays, maps, enumerations, fixed, unions of several) only the name matters
    here, as they are never aggregated; they appear as strings.
    """
    record = json.loads(avro_schema)
    if not isinstance(record, dict) or record.get("type") != "record":
        raise ValueError("The Avro schema of a topic must be a record.")
    return T.StructType([_field(field["name"], field["type"]) for field in record["fields"]])


def _field(name: str, kind) -> T.StructField:
    branches = kind if isinstance(kind, list) else [kind]
    branches = [_plain(branch) for branch in branches]
    nullable = "null" in branches
    kinds = [branch for branch in branches if branch != "null"]
    single = AVRO_PRIMITIVES.get(kinds[0]) if len(kinds) == 1 else None
    return T.StructField(name, single or T.StringType(), nullable)


def _plain(kind) -> str:
    while isinstance(kind, dict):
        kind = kind["type"]
    return kind if isinstance(kind, str) else ""


def avro_from_schema(schema: T.StructType, name: str) -> str:
    """Avro schema (JSON) of a record of primitive fields, the reverse of :func:`schema_from_avro`.

    Nullable fields are optional, with null as their default, so a reader of the schema can do
    without them. A name that Avro does not allow, and any other type, raise.
    """
    kinds = {kind: avro for avro, kind in AVRO_PRIMITIVES.items()}
    plain = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
    fields = []
    for f in schema.fields:
        if f.dataType not in kinds or not plain.fullmatch(f.name):
            raise ValueError(f"Field {f.name!r} of type {f.dataType.simpleString()} has no place in an Avro record.")
        kind = kinds[f.dataType]
        fields.append({"name": f.name, "type": ["null", kind], "default": None} if f.nullable else {"name": f.name, "type": kind})
    record = {"type": "record", "name": re.sub(r"[^A-Za-z0-9_]", "_", name), "fields": fields}
    return json.dumps(record, separators=(",", ":"))
