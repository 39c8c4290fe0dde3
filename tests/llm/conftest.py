import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents with what goes wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, "The cat sat on the mat and then it ran away from the big dog in the yard", "en", "a", 70, "x"),
        (2, "The cat sat on the mat and then it ran away from the big dog in the yard", "en", "a", 70, "x"),
        (2, "The cat sat on the mat and then it ran away from the big dog in the yard", "en", "a", 70, "x"),
        (3, None, None, None, None, None),
        (4, "", "de", "b", 0, "y"),
        (5, "   \n\t ", "de", "b", 6, "y"),
        (None, "no id here at all", "en", None, 17, "z"),
        (6, long, "en", "a", len(long), "x"),
        (7, "1234 5678 !!!", "fr", "b", 13, "x"),
        (8, "x" * 100_000, "fr", "b", 100_000, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
