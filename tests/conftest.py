import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snapcat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "snapcat-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression without input."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


def snapshots(spark, lines, side="src", root="tank/src"):
    """Rows from (name, guid, creation, createtxg[, written[, userrefs]])."""
    from snapcat.sources.readers import with_name_columns

    rows = [tuple(line) + (None,) * (6 - len(line)) for line in lines]
    schema = "name STRING, guid STRING, creation BIGINT, createtxg BIGINT, written BIGINT, userrefs STRING"
    return with_name_columns(spark.createDataFrame(rows, schema), side, root)


def values(df, *columns):
    return sorted(tuple(row[c] for c in columns) if len(columns) > 1 else row[columns[0]] for row in df.collect())
