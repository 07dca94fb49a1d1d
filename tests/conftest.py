import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample_entries(spark):
    """The entries of the literal containers."""
    from mathquarry import samples
    from mathquarry.sources import containers

    files = spark.createDataFrame([(name, bytearray(data)) for name, data in samples.containers().items()], "doc_id string, content binary").coalesce(1)
    return containers.entries_of(containers.described(files)).cache()
