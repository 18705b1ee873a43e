from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from evalframe.session import get_session

    scratch = tempfile.mkdtemp(prefix="evalframe-tests-")
    s = get_session("local[*]", app_name="evalframe-tests", shuffle_partitions=8, extra_conf={
        "spark.checkpoint.dir": scratch + "/ckpt",
        "spark.local.dir": scratch + "/local",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="evalframe-t-")
