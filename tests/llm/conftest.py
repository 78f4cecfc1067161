import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("n", T.LongType())])

LONG = "word%d stays here. " * 3000 % tuple(range(3000))
TEXTS = ["Hello  world, it's one.", "Hello world, it's\tone.", "Helloworld, it'sone.", None, "", " \n\t ", LONG, LONG + "x", "the same text twice over here", "the same text twice over here", "école \U0001f600 ß Σας", "a\x00b \x1c c", "x" * 5000]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, a shared id, and columns whose names clash."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 3 else f"src{i % 4}", len(t or ""), "z", "r", i) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, TEXTS[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (1, "another text under the same id", "en", "src1", 5, "z", "r", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


SF = "/root/testdata/sf0.001"
