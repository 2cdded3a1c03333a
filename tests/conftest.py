import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


CATALOG = (
    "row_id long, id string, ra double, dec double, size double, mag double, type string, extra_info string, common_names string,"
    " priority int, catalog string, plate string, updated_at timestamp, loaded_at timestamp"
)


@pytest.fixture
def catalog(spark):
    """Make catalogue rows from dictionaries; what is not given is null."""
    names = [c.split()[0] for c in CATALOG.split(",")]

    def make(*rows, extra=""):
        schema = CATALOG + (f", {extra}" if extra else "")
        every = names + [c.split()[0] for c in extra.split(",") if c]
        return spark.createDataFrame([tuple(r.get(n) for n in every) for r in rows], schema)

    return make
