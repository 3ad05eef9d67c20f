"""Which columns of a topic are kept, how they are called, which are aggregated."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.config import SourceTopic
from tidemark.functions.quoting import quoted

# Fixed names: columns every summary row has, hence never aggregated.
RESERVED_FIELDS = ("time", "window_size", "count")


def project_topic(df: DataFrame, source: SourceTopic, carry: Sequence[str] = ()) -> DataFrame:
    """Keep and rename the fields of one source topic.

    ``carry`` names message columns (event time, topic, partition, offset) that
    pass through unchanged.
    """
    fields = list(source.fields) if source.fields is not None else [
        name for name in df.columns if name not in carry
    ]
    missing = [name for name in [*carry, *fields, *source.map] if name not in df.columns]
    if missing:
        raise ValueError(f"Topic {source.name!r} has no field {missing}; it has {df.columns}")
    kept = {name for name in fields if source.map.get(name, name) == name}
    passed = [name for name in carry if name not in kept]
    outputs = passed + source.output_fields(fields)
    clashes = sorted({name for name in outputs if outputs.count(name) > 1})
    if clashes:
        raise ValueError(f"Topic {source.name!r} would have several columns called {clashes}")
    renamed = [f"{quoted(name)} AS {quoted(source.map.get(name, name))}" for name in fields]
    return df.selectExpr(*map(quoted, passed), *renamed)


def numeric_fields(
    schema: T.StructType, mode: str = "all", exclude: Iterable[str] = ()
) -> list[str]:
    """Names of the fields that get statistics, in schema order.

    ``all`` takes every numeric type; ``strict`` takes BIGINT and DOUBLE only.
    Booleans are never numeric.
    """
    kinds = {"all": T.NumericType, "strict": (T.LongType, T.DoubleType)}
    if mode not in kinds:
        raise ValueError(f"numeric must be one of {sorted(kinds)}, not {mode!r}")
    skipped = {*RESERVED_FIELDS, *exclude}
    return [
        field.name
        for field in schema.fields
        if isinstance(field.dataType, kinds[mode]) and field.name not in skipped
    ]
