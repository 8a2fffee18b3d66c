import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (list, dict)) else (False, "", str(x)) for x in t))
