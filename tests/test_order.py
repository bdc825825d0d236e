"""Compiled comparisons against a plain evaluator of the total order."""

import itertools
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioq.functions import values as V
from folioq.functions.values import Val

RANK = {type(None): 1, int: 2, float: 2, Decimal: 2, str: 6, bool: 12}
VALUES = {
    "i int": [None, -5, 0, 7],
    "l long": [None, -5, 2**40, 7],
    "d double": [None, float("nan"), float("-inf"), -5.0, 0.5, 7.0, float("inf")],
    "s string": [None, "", "a", "B"],
    "b boolean": [None, False, True],
}


def compare(a, b):
    ra, rb = RANK[type(a)], RANK[type(b)]
    if ra != rb:
        return (ra > rb) - (ra < rb)
    if a is None:
        return 0
    nan = [isinstance(x, float) and math.isnan(x) for x in (a, b)]
    if any(nan):
        return nan[1] - nan[0]
    return (a > b) - (a < b)


@pytest.mark.parametrize("left, right", list(itertools.product(VALUES, VALUES)))
def test_columns(spark, left, right):
    (n, t), (m, u) = left.split(), right.split()
    df = spark.createDataFrame([(x, y) for x in VALUES[left] for y in VALUES[right]], f"x {t}, y {u}")
    a, b = (Val(F.col(c), df.schema[c].dataType) for c in "xy")
    cols = [V.equal(a, b), V.less(a, b), V.less(a, b, True), V.more(a, b), V.more(a, b, True)]
    for r in df.select("x", "y", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
        c = compare(r.x, r.y)
        assert list(r)[2:] == [c == 0, c < 0, c <= 0, c > 0, c >= 0], (r, c)


@pytest.mark.parametrize("left", VALUES)
def test_constants(spark, left):
    n, t = left.split()
    df = spark.createDataFrame([(x,) for x in VALUES[left]], f"x {t}")
    a = Val(F.col("x"), df.schema["x"].dataType)
    for y in (None, -5, 7, 0.5, "a", True):
        b = V.lit(y)
        tests = {"=": (V.equal, 0), "<": (V.less, -1), ">": (V.more, 1)}
        for f, want in tests.values():
            got = {repr(r.x) for r in df.where(f(a, b)).collect()}
            assert got == {repr(x) for x in VALUES[left] if compare(x, y) == want}, (left, y, want)


def test_sorting(spark):
    df = spark.createDataFrame([(x,) for x in VALUES["d double"]], "x double")
    v = Val(F.col("x"), df.schema["x"].dataType)
    up = [r.x for r in df.orderBy(*V.sort_keys(v, False)).collect()]
    assert [repr(x) for x in up] == ["None", "nan", "-inf", "-5.0", "0.5", "7.0", "inf"]
    down = [r.x for r in df.orderBy(*V.sort_keys(v, True)).collect()]
    assert [repr(x) for x in down] == [repr(x) for x in up[::-1]]
