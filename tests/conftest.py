import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    if path not in sys.path:
        sys.path.insert(0, path)

from limewash.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a table from columns: ``frame(a=[...], b=[...])``; text unless a schema is given."""

    def build(schema: str | None = None, **columns):
        names = list(columns)
        schema = schema or ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        return spark.createDataFrame(list(zip(*columns.values())), schema)

    return build
