import datetime
import math

import pytest

from folioq.database import Database
from folioq.errors import FolioError


def value(spark, text):
    return Database(spark).execute(f"SELECT {text} AS x").first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("DOUBLE('1,234.5')", 1234.5), ("DOUBLE(',5')", None), ("DOUBLE('.5')", 0.5), ("DOUBLE('5.')", 5.0), ("DOUBLE('1e3')", 1000.0), ("DOUBLE('(2)')", -2.0), ("DOUBLE('(2')", None),
        ("DOUBLE('( 1.5)')", None), ("DOUBLE('1e999')", math.inf), ("DOUBLE('-Infinity')", -math.inf), ("DOUBLE('∞')", None), ("DOUBLE('∞', 'en-US')", math.inf),
        ("DOUBLE('1.234,5', 'de-DE')", 1234.5), ("DOUBLE('.5', 'de-DE')", None), ("DOUBLE('1 234,5', 'fr-FR')", 1234.5), ("DOUBLE('')", None), ("DOUBLE('x')", None),
        ("DATETIME('15.01.2020', 'de-DE')", datetime.datetime(2020, 1, 15)), ("DATETIME('1/15/2020', 'de-DE')", None), ("DATETIME('1/15/2020')", datetime.datetime(2020, 1, 15)),
        ("DATETIME('15/1/2020 10:30', 'fr')", datetime.datetime(2020, 1, 15, 10, 30)), ("DATETIME('2020-01-15', 'de-DE')", datetime.datetime(2020, 1, 15)),
        ("DATETIME('30.02.2020', 'de-DE')", None),
    ],
)
def test_cultures(spark, text, want):
    assert value(spark, text) == want


def test_not_a_number(spark):
    assert math.isnan(value(spark, "DOUBLE('-NaN')"))


def test_unknown_cultures_are_refused(spark):
    with pytest.raises(FolioError):
        value(spark, "DOUBLE('1.5', 'en US')")
