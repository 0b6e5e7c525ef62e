"""Models on disk: a folder of Parquet or JSON tables with a metadata table, read and written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import SerializationError

FORMATS = {"BINARY": "parquet", "BIN": "parquet", "PARQUET": "parquet", "JSON": "json"}


def format_of(name: str) -> str:
    """The Spark format of a name like binary, bin or json, in any case."""
    try:
        return FORMATS[name.upper()]
    except KeyError:
        raise SerializationError(f"unknown format {name}") from None


def auto_format(path: str) -> str:
    return "json" if path.rstrip("/").endswith(".json") else "parquet"


def save(tables: dict[str, DataFrame], path: str, params: dict | None = None, format: str | None = None) -> None:
    """Writes each table below path, and params as JSON text in the table metadata."""
    kind = format_of(format) if format else auto_format(path)
    for name, df in tables.items():
        df.write.format(kind).mode("overwrite").save(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    schemas = {n: df.schema.json() for n, df in tables.items()}
    meta = json.dumps({"format": kind, "schemas": schemas, "params": params or {}})
    spark.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a model, and its params."""
    from pyspark.sql.types import StructType

    meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/metadata").collect()))
    tables = {n: spark.read.schema(StructType.fromJson(json.loads(s))).format(meta["format"]).load(f"{path}/{n}") for n, s in meta["schemas"].items()}
    return tables, meta["params"]


def to_json(bits, size: int):
    """A bit column as JSON text {"dims": [size], "bits": [...]}."""
    return F.when(bits.isNotNull(), F.to_json(F.struct(F.array(F.lit(size)).alias("dims"), bits.alias("bits"))))


def from_json(text):
    """struct<dims, bits> of such text."""
    return F.from_json(text, "dims array<int>, bits array<int>")
