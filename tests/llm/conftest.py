import pytest

#: Nulls in every column, empty texts, ties, repeated rows, and a column whose name the operators use inside.
ODD_ROWS = [
    (1, "The cat of the mat sat on a mat. 4111 1111 1111 1111", "a"),
    (1, "The cat of the mat sat on a mat. 4111 1111 1111 1111", "a"),
    (2, "THE CAT of the mat sat on a mat. 4111 1111 1111 1111", None),
    (3, None, "b"),
    (4, "", "b"),
    (5, "   \n\t\n", "b"),
    (None, "no id at all in the end", None),
    (None, None, None),
    (7, "x", "c"),
    (8, "word " * 60000 + "\nend", "c"),
    (9, "Licensed under the Apache License, Version 2.0.\nThe end of it is near to you", "d"),
    (10, "x" * 70000, "d"),
]
ODD_SCHEMA = "doc_id long, text string, row string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
