"""Names and marks for work columns beside those of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spare(documents: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has a column of that name already (in any case of letters)."""
    taken = {c.lower() for c in documents.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashable(c: Column, kind: T.DataType) -> Column:
    """Maps can't be hashed or compared: their entries in order can, deeper ones as JSON."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, (T.StructType, T.ArrayType)) and "map<" in kind.simpleString():
        return F.to_json(c)
    return c


def mark(documents: DataFrame) -> Column:
    """A hash that equal rows share and others don't: nulls count, wherever they stand."""
    parts = []
    for field in documents.schema.fields:
        own = documents[f"`{field.name.replace('`', '``')}`"]
        parts += [own.isNull(), _hashable(own, field.dataType)]
    return F.xxhash64(*parts)
