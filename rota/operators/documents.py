"""Document assembly: nested arrays and objects per owner, and their JSON text.

Children are aggregated to one row per parent key with ``collect_list`` and
attached with a left join, so a parent without children gets NULL (never an
empty array). Arrays are sorted by their leading fields, so documents are
deterministic. Inside the plan everything stays a struct or array; JSON text
is produced once, at the edge, by ``to_json`` (NULL fields are left out).

Dates print as ``yyyy-MM-dd``, timestamps of either kind as
``yyyy-MM-ddTHH:mm:ss``, with as many digits of a second as are not zero and no
time zone (a TIMESTAMP in the session's zone).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DataType, MapType, StructType, TimestampNTZType, TimestampType,
)

from rota.functions.columns import sorted_array

ENCODINGS = ("nested", "text")


def _has_time(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_time(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _has_time(kind.elementType)
    if isinstance(kind, MapType):
        return _has_time(kind.valueType)
    return isinstance(kind, (TimestampType, TimestampNTZType))


def json_ready(value: Column, kind: DataType) -> Column:
    """``value`` of type ``kind`` with its timestamps, at any depth, as their JSON text.
    (``to_json`` has one fixed pattern per type, which prints a fraction always
    or never.) Values without timestamps are left as they are."""
    if not _has_time(kind):
        return value
    if isinstance(kind, StructType):
        fields = [json_ready(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: json_ready(e, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: json_ready(v, kind.valueType))
    return F.replace(value.cast("string"), F.lit(" "), F.lit("T"))


def detail_object(fields: Sequence[str], encoding: str = "nested",
                  schema: StructType | None = None) -> Column:
    """One object from a row's ``fields``.

    ``nested`` keeps it a struct, so it is embedded in the parent as a JSON
    object; ``text`` turns it into JSON text first, so the parent carries it
    as an escaped string value. ``schema``: of the row, for the text of its timestamps.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    if encoding == "nested":
        return F.struct(*[F.col(f) for f in fields])
    return F.to_json(F.struct(*[
        F.col(f) if schema is None else json_ready(F.col(f), schema[f].dataType).alias(f)
        for f in fields]))


def child_array(children: DataFrame, parent_key: Sequence[str] | str,
                fields: Sequence[str], out: str) -> DataFrame:
    """One sorted array of ``struct(fields)`` per parent key: (parent_key..., out)."""
    keys = [parent_key] if isinstance(parent_key, str) else list(parent_key)
    return children.groupBy(*keys).agg(sorted_array(*fields).alias(out))


def keyed_elements(keys: DataFrame, details: DataFrame, parent_key: str, key: str,
                   detail: str, out: str) -> DataFrame:
    """Array of ``{key, detail}`` per parent, one element per distinct key of
    ``keys`` (a NULL key included: it matches no detail and yields ``{}``).

    ``details`` has (parent_key, key, detail). The join is a plain equality, so
    a NULL key never finds its detail.
    """
    distinct_keys = keys.select(parent_key, key).distinct()
    joined = distinct_keys.join(
        details.select(F.col(parent_key).alias("_p"), F.col(key).alias("_k"), detail),
        (F.col(parent_key) == F.col("_p")) & (F.col(key) == F.col("_k")), "left")
    return child_array(joined.select(parent_key, key, detail), parent_key, [key, detail], out)


def attach(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
           columns: Sequence[str]) -> DataFrame:
    """Left join of a one-row-per-key child onto the parent; ``columns`` are
    carried over, NULL where the parent has no child row."""
    right = child.select(F.col(child_key).alias("_ck"), *columns)
    joined = parent.join(right, parent[parent_key] == right["_ck"], "left")
    return joined.drop("_ck")


def to_json_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace the named struct/array columns by their JSON text."""
    return df.select(*[F.to_json(json_ready(F.col(c), df.schema[c].dataType)).alias(c)
                       if c in columns else F.col(c) for c in df.columns])
