"""Every string of nested data rewritten where it stands: a walk over the schema, not over the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from notemill.functions import text as T


def each_string(value: Column, kind: DataType, change: Callable[[Column], Column]) -> Column:
    """value with `change` put to every string in it, in structs, arrays and map values of any depth. Map keys, other types and nulls stay."""
    if isinstance(kind, StringType):
        return change(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: each_string(x, kind.elementType, change))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: each_string(x, kind.valueType, change))
    if isinstance(kind, StructType):
        fields = [each_string(value.getField(f.name), f.dataType, change).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    return value


def sanitized(df: DataFrame, change: Callable[[Column], Column] = T.sanitize) -> DataFrame:
    """df with every string of every column sanitised; column names and types stay."""
    return df.select(*[each_string(F.col(f"`{f.name}`"), f.dataType, change).alias(f.name) for f in df.schema.fields])
