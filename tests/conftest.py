from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(HOME), str(HOME / "tests")]
os.environ["PYTHONPATH"] = f"{HOME}:{os.environ.get('PYTHONPATH', '')}".rstrip(":")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{at}")
        .config("spark.sql.warehouse.dir", f"file://{at}/warehouse")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return f"{DATA}/sf0.001"
