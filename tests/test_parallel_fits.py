"""Fits of the end-to-end flow run at the same time; results keep their order, errors come through."""

from __future__ import annotations

import threading

import pytest

from canframes.plans.train_evaluate import _at_once


def test_fits_overlap_and_keep_their_order(spark):
    both = threading.Barrier(2, timeout=60)

    def fit(n):
        both.wait()  # passes only if two fits run at the same time
        return spark.range(n)

    got = _at_once(spark, [lambda n=n: fit(n) for n in (3, 1, 4, 2)])
    assert [df.count() for df in got] == [3, 1, 4, 2]


def test_an_error_in_a_fit_is_raised(spark):
    def broken():
        raise ValueError("no rows to fit on")

    with pytest.raises(ValueError):
        _at_once(spark, [lambda: spark.range(1), broken])
