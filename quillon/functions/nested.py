"""Nested records to flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    found = []
    for field in schema.fields:
        here = path + (field.name,)
        if isinstance(field.dataType, T.StructType):
            found += _leaves(field.dataType, here)
        else:
            found.append((here, field.dataType))
    return found


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields become columns named by their path; arrays stay and are marked ``[]``."""
    out = []
    for path, dtype in _leaves(df.schema):
        name = sep.join(path) + ("[]" if isinstance(dtype, T.ArrayType) else "")
        out.append(F.col(".".join(f"`{p}`" for p in path)).alias(name))
    return df.select(*out)


def explode_array(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """One row per element (a row without elements is kept), then flat again."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    name = column.removesuffix("[]")
    return flatten_structs(df.select(*rest, F.explode_outer(f"`{column}`").alias(name)), sep)


def parse_json(df: DataFrame, column: str, schema: T.StructType | str, into: str = "doc") -> DataFrame:
    """Decode a JSON text column; text that is not an object of this shape gives NULL."""
    return df.withColumn(into, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
