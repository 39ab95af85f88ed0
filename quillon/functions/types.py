"""Type names of the sources, their families, and the Spark type of each family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The type names accepted from sources, by family.
FAMILIES = {
    "integer": ("int", "integer", "bigint", "smallint", "tinyint"),
    "float": ("float", "real", "double"),
    "decimal": ("decimal", "numeric", "money", "currency"),
    "string": ("varchar", "char", "text", "nvarchar", "nchar", "string"),
    "datetime": ("date", "datetime", "datetime2", "timestamp", "time"),
    "boolean": ("bit", "boolean", "bool"),
    "binary": ("binary", "varbinary", "image"),
}
FAMILY_OF = {name: family for family, names in FAMILIES.items() for name in names}

# The name of each family in the report model.
MODEL_NAMES = {
    "integer": "int64", "float": "double", "decimal": "decimal", "string": "string",
    "datetime": "dateTime", "boolean": "boolean", "binary": "binary",
}

# Pandas dtypes and the SQL types they load as.
FRAME_DTYPES = {
    "object": "VARCHAR", "category": "VARCHAR", "int64": "BIGINT", "int32": "INTEGER",
    "float64": "FLOAT", "float32": "REAL", "bool": "BOOLEAN", "datetime64[ns]": "TIMESTAMP",
}


def base_name(name: str) -> str:
    """``DECIMAL(10, 2)`` and ``varchar(20)`` lose their arguments."""
    return name.strip().lower().split("(")[0].strip()


def family(name: str) -> str:
    """Family of a source, pandas or Spark type name; unknown names count as text."""
    dtype = FRAME_DTYPES.get(name.strip())
    key = base_name(dtype or name)
    key = {"long": "bigint", "short": "smallint", "byte": "tinyint",
           "timestamp_ntz": "timestamp", "timestamp_ltz": "timestamp"}.get(key, key)
    return FAMILY_OF.get(key, "string")


def model_type(name: str) -> str:
    return MODEL_NAMES[family(name)]


def map_type(name: str) -> T.DataType:
    """Spark type of a source type name."""
    kind, key = family(name), base_name(FRAME_DTYPES.get(name.strip(), name))
    if kind == "integer":
        return T.LongType()
    if kind == "float":
        return T.DoubleType()
    if kind == "decimal":
        if key in ("money", "currency"):
            return T.DecimalType(19, 4)
        inside = name[name.find("(") + 1:name.find(")")] if "(" in name else ""
        parts = [int(p) for p in inside.split(",") if p.strip().isdigit()]
        return T.DecimalType(*(parts + [0])[:2]) if parts else T.DecimalType(38, 18)
    if kind == "datetime":
        return T.DateType() if key == "date" else T.StringType() if key == "time" else T.TimestampType()
    if kind == "boolean":
        return T.BooleanType()
    if kind == "binary":
        return T.BinaryType()
    return T.StringType()


def spark_family(dtype: T.DataType) -> str:
    """Family of a Spark type; nested types have none and are called ``nested``."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return family(dtype.simpleString())


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema.fields if spark_family(f.dataType) in families]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "integer", "float", "decimal")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "string")


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "datetime")


def value_or_null(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing, as every statistic here does."""
    dtype = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def cast_plan(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Every named column at its mapped type; values that do not convert become NULL."""
    return df.select(*[
        F.col(f"`{c}`").try_cast(map_type(types[c])).alias(c) if c in types else F.col(f"`{c}`")
        for c in df.columns
    ])


def failed_casts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per cast column: its target type, non-null values, and values lost by the cast."""
    counts = []
    for name, type_name in types.items():
        col = F.col(f"`{name}`")
        lost = col.isNotNull() & col.try_cast(map_type(type_name)).isNull()
        counts.append(F.struct(
            F.lit(name).alias("column"),
            F.lit(map_type(type_name).simpleString()).alias("target_type"),
            F.count(col).alias("value_count"),
            F.count_if(lost).alias("failed_count"),
        ))
    return df.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))
