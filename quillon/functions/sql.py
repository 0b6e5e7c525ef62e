"""SQL names for the algebra, as session functions over bit arrays."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, body), native SQL so that the optimizer sees through them.
FUNCTIONS = {
    "sdr_overlap": ("a ARRAY<INT>, b ARRAY<INT>", "INT", "size(array_intersect(a, b))"),
    "sdr_union": ("a ARRAY<INT>, b ARRAY<INT>", "ARRAY<INT>", "array_sort(array_union(a, b))"),
    "sdr_intersection": ("a ARRAY<INT>, b ARRAY<INT>", "ARRAY<INT>", "array_sort(array_intersect(a, b))"),
    "sdr_sparsity": ("a ARRAY<INT>, n INT", "DOUBLE", "size(a) / n"),
    "anomaly_score": ("active ARRAY<INT>, predicted ARRAY<INT>", "DOUBLE", "if(size(active) = 0, 0.0D, 1 - size(array_intersect(active, predicted)) / size(active))"),
    "encode_scalar": ("v DOUBLE, low DOUBLE, high DOUBLE, size INT, width INT", "ARRAY<INT>", "transform(sequence(0, width - 1), i -> i + cast(least(floor((least(greatest(v, low), high) - low) / (high - low) * (size - width + 1)), size - width) as int))"),
}


def register(spark: SparkSession) -> None:
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
