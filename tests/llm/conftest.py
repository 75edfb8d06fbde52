import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").appName("textloom-tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    )


#: Rows that every text operator must take: nulls, empty and odd texts, ties and repeated rows.
ODD = [
    (1, "plain words and  more\n\nwords"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "<|endoftext|> inside <|startoftext|> text"),
    (6, "Ünïcode   ΣΑΣ İ ſ   中文 🙂 á \x1c\x85 x"),
    (6, "Ünïcode   ΣΑΣ İ ſ   中文 🙂 á \x1c\x85 x"),
    (None, "no id"),
    (7, "long " * 60000 + "x" * 3000),
    (8, "don't you'll 'S !!??  12345 ---- ====="),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.select("*", F.lit("x").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_tokens"), F.lit("k").alias("ids"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
