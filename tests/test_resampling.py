"""Resampling of per-report counts against numpy."""

import numpy as np

from grovemark.operators import resampling as rs


def test_poisson_draws_are_a_bootstrap(spark):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (400, 3))
    units = spark.createDataFrame([(32 * (i // 8) + i % 8, *map(int, c)) for i, c in enumerate(counts)], "report long, tp long, fp long, fn long")
    got = np.array([r["f1"] for r in rs.poisson_draws(units, 4000).collect()])
    tp, den = counts[:, 0], 2 * counts[:, 0] + counts[:, 1] + counts[:, 2]
    at = rng.integers(0, 400, (4000, 400))
    want = 2 * tp[at].sum(axis=1) / den[at].sum(axis=1)
    width = lambda x: np.subtract(*np.percentile(x, [97.5, 2.5]))
    assert len(got) == 4000 and len(set(got)) > 3000
    assert abs(width(got) / width(want) - 1) < 0.08 and abs(got.mean() - want.mean()) < 0.003
