import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def scratch(spark):
    yield
    from folioq.llm.common import clear_scratch

    clear_scratch(spark)
