"""Where private rows come from: CSV and Parquet files, any DataFrame, and literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hushframe.plans.frame import KINDS, TYPES, PrivateFrame, Props
from hushframe.privacy import Definition, PrivacyError


def materialize(spark: SparkSession, file_path: str, column_names: Sequence[str], public: bool = False, skip_row: bool = True, definition: Definition | None = None, rows_per_individual: int = 1) -> PrivateFrame:
    """A CSV file: every column a string, in the named order; columns beyond the names are dropped and missing ones are empty."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in column_names])
    df = spark.read.schema(schema).option("header", skip_row).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(file_path).fillna("")
    return PrivateFrame(df, {n: Props("str") for n in column_names}, definition or Definition(), stability=rows_per_individual, public=public)


def from_dataframe(df: DataFrame, definition: Definition | None = None, rows_per_individual: int = 1, public: bool = False, columns: Sequence[str] | None = None) -> PrivateFrame:
    """Any DataFrame. rows_per_individual: rows that one individual may own, as after a join. Columns of other types than numbers, strings and booleans are left out."""
    kinds = {n: KINDS[k] for n, k in df.dtypes if k in KINDS and (columns is None or n in columns)}
    if columns is not None and set(columns) - set(kinds):
        raise PrivacyError(f"cannot hold {sorted(set(columns) - set(kinds))}")
    df = df.select(*[df[f"`{n}`"].cast("long").alias(n) if k == "int" else df[f"`{n}`"] for n, k in kinds.items()])
    return PrivateFrame(df, {n: Props("str" if k == "string" else k) for n, k in kinds.items()}, definition or Definition(), stability=rows_per_individual, public=public)


def read_parquet(spark: SparkSession, path: str, **options) -> PrivateFrame:
    return from_dataframe(spark.read.parquet(path), **options)


def literal(spark: SparkSession, columns: dict[str, Sequence], definition: Definition | None = None, public: bool = False) -> PrivateFrame:
    """A table of given values; None is a missing value."""
    names = list(columns)
    kind = {n: next((("bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str") for v in columns[n] if v is not None), "float") for n in names}
    schema = T.StructType([T.StructField(n, T._parse_datatype_string({"str": "string"}.get(kind[n]) or TYPES[kind[n]])) for n in names])
    return PrivateFrame(spark.createDataFrame(list(zip(*columns.values())), schema), {n: Props(kind[n]) for n in names}, definition or Definition(), public=public)
