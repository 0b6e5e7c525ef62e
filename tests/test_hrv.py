from pyspark.sql import functions as F

from quillon.operators.encoders import signal


def test_steps_of_exactly_fifty(spark):
    """26.91 to 24.41 are 2.5 apart, 50 ms in units of 20: not over 50, whatever 26.91 * 20 rounds to."""
    df = spark.createDataFrame([([26.91, 24.41, 17.06],)], "s array<double>")
    m = df.select(signal.hrv_metrics(F.col("s"), 20.0).alias("m")).first().m
    assert m.pnn50 == 50.0 and m.mean_rr == (26.91 + 24.41 + 17.06) / 3 * 20
