import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("storeflow-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(work / "warehouse"))
        .config("spark.checkpoint.dir", str(work / "shared"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("test tables are not available")
    return str(folder)


@pytest.fixture
def final_plan():
    """The physical plan a query ended up with after adaptive execution."""

    def run(df):
        df.collect()
        kept, skip_from = [], None
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            depth = len(line) - len(line.lstrip(" :"))
            if skip_from is not None and depth > skip_from:
                continue
            skip_from = depth if "== Initial Plan ==" in line else None
            if skip_from is None:
                kept.append(line)
        return "\n".join(kept)

    return run
