import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over one row: one(lambda c: ..., value)."""

    def run(f, *values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]

    return run
