import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from wardline.catalog import views  # noqa: E402
from wardline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def policies(spark):
    return views.policies(spark)


@pytest.fixture(scope="session")
def lexicon(spark):
    return views.lexicon(spark)


@pytest.fixture
def requests_of(spark):
    """Requests of one tenant with the given prompts, in order."""

    def make(prompts, tenant="tenant_0"):
        rows = [(f"r{i}", tenant, p) for i, p in enumerate(prompts)]
        df = spark.createDataFrame(rows, "request_id string, tenant_id string, prompt string")
        return df.selectExpr("request_id", "tenant_id", "timestamp_seconds(1704067200 + cast(substr(request_id, 2) as int)) AS ts", "prompt")

    return make


@pytest.fixture
def entries_of(spark):
    """Ledger entries from ``(request_id, tenant, action, rule)`` rows, one second apart."""

    def make(rows, start=1704067200):
        data = [(*row, "CLOSED", start + i) for i, row in enumerate(rows)]
        df = spark.createDataFrame(
            data, "request_id string, tenant_id string, action_taken string, rule_violated string, review_status string, s long"
        )
        return df.selectExpr("* except (s)", "timestamp_seconds(s) AS ts", "false AS is_output")

    return make
