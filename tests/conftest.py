import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from echolens.schemas import MESSAGES  # noqa: E402
from echolens.session import build_session  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__sql__maxMetadataStringLength="2000",
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def make_messages(spark):
    """Message rows from dicts; what a dict leaves out is NULL or a plain default."""

    def make(*rows):
        defaults = {"source": "github", "content": "text", "created_at": START, "fetched_at": START}
        full = [{**defaults, "source_id": row["id"], **row} for row in rows]
        return spark.createDataFrame([tuple(row.get(n) for n in MESSAGES.names) for row in full], MESSAGES)

    return make


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()
