from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilgraph.functions.crypto import Keys  # noqa: E402
from veilgraph.runtime import local_session  # noqa: E402

KEY_BYTES = {"content": b"c" * 32, "token": b"t" * 32, "index": b"i" * 32}
LOW_CUTOFFS = (("Executive", 6), ("Manager", 4), ("Employee", 2), ("External", 1))


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared_folder):
    folders = {"spark.checkpoint.dir": str(shared_folder), "spark.sql.warehouse.dir": str(shared_folder / "warehouse")}
    return local_session(8, **{"spark.sql.shuffle.partitions": "4"}, **folders)


@pytest.fixture(scope="session")
def keys(spark):
    return Keys.of(spark, **KEY_BYTES)


def pairs_of(spark, edges):
    return spark.createDataFrame([(int(a), int(b)) for a, b in edges], "u bigint, v bigint")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
