"""A store of message schemas in files, and the header that points to them.

Subjects are called ``<topic>-value``. A schema's id is a hash of its text, the same
wherever and whenever it is registered, so writers need not agree on numbers. A value
carries five bytes before its body, as registry clients write them: a zero and the id.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import names_in, read_text, write_text


class SchemaMismatch(ValueError):
    """The sink exists with another schema."""


def schema_id(schema: str) -> int:
    """A positive 31-bit number for a schema, the same for the same content."""
    canonical = json.dumps(json.loads(schema), separators=(",", ":"))
    return int.from_bytes(hashlib.sha256(canonical.encode()).digest()[:4], "big") >> 1


@dataclass(frozen=True)
class SchemaStore:
    """Schemas below ``root``: ``<subject>/<version>-<id>.json``, versions counted from 1."""

    root: str

    def versions(self, spark: SparkSession, subject: str) -> list[tuple[int, int, str]]:
        """Version, id and text of every schema of a subject, the latest last."""
        found = []
        for name in names_in(spark, f"{self.root}/{subject}"):
            if name.endswith(".json") and not name.startswith("."):
                version, number = name[:-5].split("-")
                found.append((int(version), int(number), read_text(spark, f"{self.root}/{subject}/{name}")))
        return sorted(found)

    def latest(self, spark: SparkSession, subject: str) -> str:
        """The schema that messages of a subject have now; ``KeyError`` if there is none."""
        versions = self.versions(spark, subject)
        if not versions:
            raise KeyError(subject)
        return versions[-1][2]

    def by_id(self, spark: SparkSession, subject: str, number: int) -> str:
        """The schema with this id; ``KeyError`` if the subject never had it."""
        return {n: text for _, n, text in self.versions(spark, subject)}[number]

    def register(self, spark: SparkSession, subject: str, schema: str, evolve: bool = False) -> int:
        """The id of ``schema``, which becomes the subject's if it has none.

        If the subject has another one, :class:`SchemaMismatch` is raised or, with ``evolve``, the
        schema becomes its next version.
        """
        number, versions = schema_id(schema), self.versions(spark, subject)
        if versions and versions[-1][1] == number:
            return number
        if versions and not evolve:
            raise SchemaMismatch(f"{subject} has {versions[-1][2]}, the aggregated topic has {schema}")
        version = versions[-1][0] + 1 if versions else 1
        write_text(spark, f"{self.root}/{subject}/{version}-{number}.json", schema)
        # Two first writers at once find out about one another here.
        now = [n for v, n, _ in self.versions(spark, subject) if v == version]
        if now != [number]:
            raise SchemaMismatch(f"{subject} got other schemas at the same time: {now}")
        return number


def with_header(body: Column, number: int) -> Column:
    """A message value: the header for schema ``number`` and the body."""
    return F.concat(F.lit(b"\x00" + number.to_bytes(4, "big")), body)


def header_id(value: Column) -> Column:
    """The schema id in the header of a message value, null where there is no header."""
    number = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int")
    has = (F.length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(has, number)
