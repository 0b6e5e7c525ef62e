"""A store of model versions: tables are never overwritten, and a version exists once its manifest does.

``save`` writes the tables of a new version under names of their own and its manifest last, by a rename: a save that is
cut off at any point leaves the versions before readable and nothing else visible. A table with keys is saved as its changes
since the version before (rows that are new or differ, and keys that are gone), up to CHAIN such steps on a whole table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quillon.errors import SerializationError

#: Changes on a whole table, at most.
CHAIN = 16
GONE = "gone_"


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """The numbers of the versions, ascending."""
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version, by default the last one, is made of."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else None)
        if version not in known:
            raise SerializationError(f"no version {version} in {self.path}")
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:08d}", wholetext=True).first()[0])

    def load(self, version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
        """The tables of a version, by default the last one, and its params."""
        manifest = self.manifest(version)
        return {n: self._table(t) for n, t in manifest["tables"].items()}, manifest["params"]

    def save(self, tables: dict[str, DataFrame], params: dict | None = None, keys: dict[str, list[str]] | None = None) -> int:
        """Saves a new version and returns its number. keys names the columns that tell the rows of a table apart."""
        known = self.versions()
        before = self.manifest(known[-1])["tables"] if known else {}
        made = {n: self._write(n, df, (keys or {}).get(n), before.get(n)) for n, df in tables.items()}
        version = known[-1] + 1 if known else 1
        self._publish(version, {"params": params or {}, "tables": made})
        return version

    def _write(self, name: str, df: DataFrame, keys: list[str] | None, before: dict | None) -> dict:
        path = f"{self.path}/tables/{name}-{uuid.uuid4().hex}"
        schema = df.schema.json()
        if keys and before and before["keys"] == keys and json.loads(before["schema"]) == json.loads(schema) and len(before["changes"]) < CHAIN:
            changed(self._table(before), df, keys).write.parquet(path)
            return {**before, "changes": [*before["changes"], path]}
        df.write.parquet(path)
        return {"schema": schema, "keys": keys, "whole": path, "changes": []}

    def _table(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        rows = self.spark.read.schema(schema).parquet(entry["whole"])
        if not entry["changes"]:
            return rows
        marked = StructType([*schema.fields, StructField(GONE, BooleanType())])
        steps = [self.spark.read.schema(marked).parquet(p).withColumn("step_", F.lit(k)) for k, p in enumerate(entry["changes"])]
        changes = steps[0]
        for step in steps[1:]:
            changes = changes.unionByName(step)
        keys = entry["keys"]
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns, GONE), "step_").alias("last"))
        kept = rows.join(last.select(*[F.col(k).alias(f"key_{n}") for n, k in enumerate(keys)]), [rows[k].eqNullSafe(F.col(f"key_{n}")) for n, k in enumerate(keys)], "left_anti")
        return kept.unionByName(last.where(~F.col(f"last.{GONE}")).select(*[F.col(f"last.{c}").alias(c) for c in rows.columns]))

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest appears whole or not at all; of two writers of one version the second fails."""
        hidden, shown = self._at(f"{self.path}/unpublished/{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{version:08d}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(shown.getParent())
        if self._fs.exists(shown) or not self._fs.rename(hidden, shown):
            raise SerializationError(f"version {version} of {self.path} has been saved by another writer")


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of after that before lacks or has otherwise, with gone_ false, and the rows of before whose keys are gone, with gone_ true."""
    columns = after.columns
    a, b = (df.select(F.struct(*columns).alias(n)) for df, n in ((before, "a"), (after, "b")))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, same, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    row = F.coalesce("b", "a")
    return both.select(*[row[c].alias(c) for c in columns], F.col("b").isNull().alias(GONE))
