import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__  # noqa: E402,F401  (registers the packages for workers)
from pixelframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tiny inputs: compiling each plan would cost more than running it. contract/check.py and
    # bench.py run the same queries with code generation on.
    session = local_session(
        "8", shuffle_partitions=4,
        spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN",
    )
    yield session
    session.stop()


@pytest.fixture
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def partitions(spark):
    """Run a callable under a given number of shuffle partitions."""

    def run(count, fn):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(count))
        try:
            return fn()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    return run
