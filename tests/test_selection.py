"""Percentiles by ranges against the built-in aggregate and plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmill.operators import selection

SHARES = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "one", "skewed", "tiny"])
@pytest.mark.parametrize(("bins", "most"), [(4096, 100_000), (8, 20), (3, 5)])
def test_percentiles(spark, kind, bins, most):
    rng = random.Random(1)
    values = {
        "normal": [rng.gauss(0, 5) for _ in range(700)], "ties": [float(rng.randrange(4)) for _ in range(600)] + [2.0] * 900, "one": [3.5], "skewed": [10.0 ** rng.uniform(-9, 9) for _ in range(500)],
        "tiny": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0, 5.0] * 20,
    }[kind]
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(3)
    got = selection.percentiles(frame, "x", SHARES, bins, most)
    assert got == pytest.approx(list(np.percentile(values, [100 * s for s in SHARES])), rel=1e-12)
    own = frame.filter("x IS NOT NULL AND NOT isnan(x)").agg(*[F.percentile("x", F.lit(s)) for s in SHARES]).first()
    assert got == pytest.approx(list(own), rel=1e-12)


def test_nothing(spark):
    assert selection.percentiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
