"""Statistics over all pairs of baselines against plain loops."""

import random

import numpy as np
import pytest

from quillon.operators import windows
from quillon.plans import catalog

FIELDS = [f"{k}: double" for k in windows.WEIGHTS]


def table(spark, rows):
    return spark.createDataFrame([(tuple(r),) for r in rows], f"f struct<{', '.join(FIELDS)}>")


def brute(rows):
    w = list(windows.WEIGHTS.values())
    known = [r for r in rows if None not in r]
    d = [sum(abs(a - b) * v for a, b, v in zip(p, q, w, strict=True)) for k, p in enumerate(known) for q in known[:k]]
    return (np.mean(d), np.std(d)) if d else (None, None)


@pytest.mark.parametrize("together", [1000, 20])
def test_distance_statistics_are_of_all_pairs(spark, monkeypatch, together):
    monkeypatch.setattr(windows, "TOGETHER", together)
    draw = random.Random(3)
    kinds = [lambda: draw.uniform(0, 500), lambda: draw.gauss(0, 9), lambda: draw.choice([0.0, 0.0, 0.0, 7.5, draw.random()]), lambda: -draw.expovariate(0.1), lambda: draw.uniform(0, 90) ** 2, lambda: float(draw.randrange(4)), lambda: 3.0]
    rows = [[f() for f in kinds] for _ in range(300)] + [[None, *[1.0] * 6]]
    rows += rows[:40]
    rows = [[*r[:6], r[0] if k % 2 else r[6]] if r[0] is not None else r for k, r in enumerate(rows)]
    assert windows.distance_statistics(table(spark, rows).repartition(3)) == pytest.approx(brute(rows), rel=1e-11)


def test_distance_statistics_of_few(spark):
    draw = random.Random(4)
    rows = [[draw.uniform(-5, 5) for _ in range(7)] for _ in range(5)]
    assert windows.distance_statistics(table(spark, rows)) == pytest.approx(brute(rows), rel=1e-11)
    assert windows.distance_statistics(table(spark, rows[:2])) == (pytest.approx(brute(rows[:2])[0]), 0.0)  # one pair
    assert windows.distance_statistics(table(spark, rows[:1] * 9)) == (0.0, 0.0)
    for few in ([], rows[:1]):
        assert windows.distance_statistics(table(spark, few)) == (None, None)
    assert all(np.isnan(windows.distance_statistics(table(spark, [*rows, [float("inf")] + [0.0] * 6]))))


def test_hybrid_score_takes_all_pairs(spark, tmp_path):
    """130 baselines, of which a stride would leave out most pairs."""
    draw = random.Random(5)
    rows = [(u, k, 1000 * u + k, draw.uniform(0, 60) if k < 10 or u % 3 else draw.uniform(0, 4 * u)) for u in range(1, 131) for k in range(20)]
    spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.win): r for r in catalog.hybrid_score(spark, str(tmp_path)).collect()}
    f = {(r.user_id, r.win): [r.f[k] for k in windows.WEIGHTS] for r in catalog.scored_windows(spark, str(tmp_path)).collect()}
    mean, sd = brute([v for k, v in f.items() if k[1] == 0])
    assert len(got) == 260 and sum(r.distance > mean for r in got.values()) > 20
    for r in got.values():
        z = (r.distance - mean) / sd
        assert abs(r.score - 0.3 * max(0, 1 - r.overlap / 40) - 0.7 * max(0, z / (1 + abs(z)))) < 2e-6
