from pyspark.sql import functions as F

from quillon.functions import kernels


def test_bits_udf_hands_on_few_elements(spark, monkeypatch):
    """A function sees rows of about UDF_ELEMENTS elements at a time, whatever the batch holds."""
    monkeypatch.setattr(kernels, "UDF_ELEMENTS", 500)
    df = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.sequence(F.lit(0), (F.col("id") % 90).cast("int"))).alias("x"))
    seen = kernels.bits_udf(lambda column: [None if r is None else [sum(len(q) for q in column if q is not None)] for r in column])
    rows = df.select("id", seen("x").alias("n")).collect()
    assert len(rows) == 1000 and all((r.n is None) == (r.id % 7 == 0) for r in rows)
    assert max(r.n[0] for r in rows if r.n) <= 600
