import pytest
from edge_cases import CLASHING, SCHEMA, edge_rows


@pytest.fixture(scope="session")
def edge(spark):
    rows = [r + ("clash",) * len(CLASHING) for r in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
