"""Layers of extracted fields: missing leaves made null and layers merged, as one column expression that follows the schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from docketry.functions.text import blank_to_null


def _fields(value: Column, kind: S.StructType) -> dict[str, tuple[Column, S.DataType]]:
    return {f.name: (value[f.name], f.dataType) for f in kind.fields}


def is_missing(value: Column, kind: S.DataType) -> Column:
    """For values that went through ``filled``: null, or a struct of missing leaves."""
    if not isinstance(kind, S.StructType):
        return value.isNull()
    return reduce(lambda a, b: a & b, [is_missing(*field) for field in _fields(value, kind).values()], F.lit(True))


def filled(value: Column, kind: S.DataType) -> Column:
    """``value`` with null for every leaf that says nothing: empty texts, the number 0, empty arrays and maps.

    Elements of arrays and values of maps that are missing go; structs stay, with null leaves. Truth values stay as they are.
    """
    if isinstance(kind, S.StringType):
        return blank_to_null(value)
    if isinstance(kind, S.NumericType):
        return F.when(value != 0, value)
    if isinstance(kind, S.StructType):
        return F.struct(*[filled(*field).alias(name) for name, field in _fields(value, kind).items()])
    if isinstance(kind, S.ArrayType):
        kept = F.filter(F.transform(value, lambda x: filled(x, kind.elementType)), lambda x: ~is_missing(x, kind.elementType))
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, S.MapType):
        kept = F.map_filter(F.transform_values(value, lambda _, x: filled(x, kind.valueType)), lambda _, x: ~is_missing(x, kind.valueType))
        return F.when(F.size(kept) > 0, kept)
    return value


def merged(first: Column, first_kind: S.DataType, second: Column, second_kind: S.DataType) -> Column:
    """Two filled values of one field: the first wins leaf by leaf, the second fills what it lacks.

    Structs are merged by field name (fields that only one has are kept), maps by key, an array is taken as a whole.
    Fields of one name must be of one sort in both.
    """
    if isinstance(first_kind, S.StructType) and isinstance(second_kind, S.StructType):
        left, right = _fields(first, first_kind), _fields(second, second_kind)
        both = {name: merged(*left[name], *right[name]) if name in right else left[name][0] for name in left}
        return F.struct(*[value.alias(name) for name, value in (both | {n: f[0] for n, f in right.items() if n not in left}).items()])
    if isinstance(first_kind, S.MapType) and isinstance(second_kind, S.MapType):
        alone = F.map_filter(second, lambda key, _: ~F.coalesce(F.map_contains_key(first, key), F.lit(False)))
        return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(first, alone))
    if isinstance(first_kind, (S.StructType, S.MapType)) or isinstance(second_kind, (S.StructType, S.MapType)):
        raise TypeError(f"a field is {first_kind.simpleString()} in one layer and {second_kind.simpleString()} in the other")
    return F.coalesce(first, second)
