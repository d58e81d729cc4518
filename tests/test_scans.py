"""Exponentially weighted means against a plain loop, in one task or several."""

import random

import numpy as np
import pytest

from tidewater.operators import scans, windows


def loop(values, alpha, adjust, ignore_nulls, least):
    keep, top, bottom, seen, out = 1 - alpha, 0.0, 0.0, 0, []
    for x in values:
        if x is not None:
            seen += 1
            if adjust or not bottom:
                top, bottom = top * keep + x, bottom * keep + 1
            else:
                share = bottom * keep / (bottom * keep + alpha)
                top, bottom = share * top + (1 - share) * x, 1.0
        elif not ignore_nulls:
            bottom, top = bottom * keep, top * keep if adjust else top
        mean = (top / bottom if adjust else top) if bottom else None
        out.append(mean if seen >= least else None)
    return out


def test_affine():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 100, 1000):
        a, b = rng.choice([0.0, 0.3, 0.9, 1.0], n), rng.normal(size=n)
        y, want = 2.5, []
        for i in range(n):
            y = a[i] * y + b[i]
            want.append(y)
        assert np.allclose(scans.affine(a, b, 2.5), want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_nulls", [True, False])
def test_ewm_against_a_loop(spark, adjust, ignore_nulls):
    rng = random.Random(7)
    sizes = {"hot": 3000, None: 40, "nulls": 300, "one": 1, "b": 500, "c": 2}
    rows = [(k, i, None if k == "nulls" or rng.random() < 0.3 or (k == "hot" and 900 < i < 1900) else rng.uniform(-5, 5)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(5)
    for ranges, alpha, least in ((0, 0.4, 1), (13, 0.4, 3), (13, 0.01, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 170)
        try:
            found = windows.ewm(df, "x", ["k"], ["i"], alpha=alpha, adjust=adjust, ignore_nulls=ignore_nulls, min_periods=least, ranges=ranges).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        got = {(r.k, r.i): r.ewm for r in found}
        assert len(got) == len(rows)
        for k in sizes:
            mine = [x for key, _, x in rows if key == k]
            for i, want in enumerate(loop(mine, alpha, adjust, ignore_nulls, least)):
                assert (got[k, i] is None) == (want is None) and (want is None or abs(got[k, i] - want) < 1e-9), (k, i, got[k, i], want)
    assert windows.ewm(df.limit(0), "x", ["k"], ["i"], alpha=0.5, ranges=3).count() == 0
