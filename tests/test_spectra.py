"""Transforms in tasks and in two rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import spectra


def numbers(df, key):
    return {r.k: complex(r.re, r.im) for r in df.where(F.col("key") == key).collect()}


def test_short_and_long_transforms_are_the_same(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 90, "b": 97, "c": 1, "d": 128}
    data = {k: rng.normal(size=n) + 1j * rng.normal(size=n) for k, n in sizes.items()}
    rows = [(k, i, float(x.real), float(x.imag), sizes[k]) for k, v in data.items() for i, x in enumerate(v) if i % 5 != 4]
    df = spark.createDataFrame(rows, "key string, pos long, re double, im double, n long")
    for sign, half in ((-1, False), (1, False), (-1, True), (1, True)):
        for whole in (spectra.WHOLE, 95, 0):
            out = spectra.dft(df, ["key"], sign, half, whole)
            for k, n in sizes.items():
                x = np.where(np.arange(n) % 5 != 4, data[k], 0)
                want = np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * n
                want = want[: n // 2 + 1] if half else want
                found = numbers(out, k)
                assert sorted(found) == list(range(len(want))) and [found[i] for i in range(len(want))] == pytest.approx(list(want), abs=1e-9)


def test_a_short_transform_is_not_made_by_its_definition(spark):
    """32,768 places would be 11 million steps in two rounds; here they are one row, whose values go through one exchange."""
    df = spark.range(3 << 15).select((F.col("id") % 3).alias("key"), F.floor(F.col("id") / 3).alias("pos"), F.col("id").cast("double").alias("re"), F.lit(0.0).alias("im"), F.lit(1 << 15).cast("long").alias("n"))
    out = spectra.dft(df, ["key"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3 << 15


def test_nulls_stay_in_their_transform(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0.0, 2), ("a", 1, None, 0.0, 2), ("b", 0, 1.0, 0.0, 2), ("b", 1, 3.0, 0.0, 2)], "key string, pos long, re double, im double, n long")
    found = {(r.key, r.k): r.re for r in spectra.dft(df, ["key"]).collect()}
    assert found == {("a", 0): None, ("a", 1): None, ("b", 0): 4.0, ("b", 1): -2.0}
