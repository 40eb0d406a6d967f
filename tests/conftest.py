import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cloudloom.session import build_session

    s = build_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cloud(spark):
    """Turn an (n, 3) array into a points table."""
    import pandas as pd

    def make(xyz, first=0, scan="s"):
        pdf = pd.DataFrame({"scan_id": scan, "point_id": range(first, first + len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
        return spark.createDataFrame(pdf).repartition(3)

    return make
