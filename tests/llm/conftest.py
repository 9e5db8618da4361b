import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "pages", "labels"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


LONG = "word " * 30_000 + "tail of a very long text. " * 400

#: Nulls, empty, blank, one word, ties, repeated rows and ids, a very long
#: text; extra columns named like the operators' own.
ODD_ROWS = [
    (1, None, "a", 1), (2, "", "a", 2), (3, " \n\t ", None, None), (4, "one", "b", 4), (5, "one two three", "b", 5),
    (6, "one two three", "b", 5), (7, "é ü — 中文   wide\xa0space", "c", 7), (8, LONG, "c", 8), (8, LONG, "c", 8), (8, "another text of that id", "d", 9),
    (None, "no id here", "d", 10), (None, "no id here", "d", 10), (12, "x" * 5_000, "e", 11), (13, "a\nb\na\nb\n\n", "e", 12),
]
ODD_SCHEMA = "doc_id bigint, text string, _th string, key int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
