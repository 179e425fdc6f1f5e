from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t int, part string, n_lines int, score string, fp int"
LONG = " ".join(f"word{i % 977} and{i % 13} of the" for i in range(9000))
#: Nulls in any column, empty and very long texts, repeated rows and ids, ties, blanks of every kind, marks, other scripts.
EDGES = [
    (10_001, None), (10_002, ""), (10_003, " \t\n\x0b\f\r "), (10_004, LONG), (10_005, LONG + " end"), (10_006, "Same TEXT here"),
    (10_007, "same text HERE"), (10_007, "same text HERE"), (10_008, "ÄÖ ñandú 漢字 漢字\nİstanbul ΣΑΣ é́"), (None, "Same text here"), (None, None),
    (10_009, "one"), (10_010, "one two"), (10_011, "a\n\nb\na\n" * 40), (10_012, "the of and to in\nThe OF and to in is\nthe of and to in"),
    (10_013, "x" * 5000), (10_014, "!!! ??? ..."), (10_015, "it's, don't. 'tis the-end (really)"),
]


def rows(texts):
    return [(i, t, None if n % 3 else "en", None if n % 4 == 0 else f"src{n % 3}", None, "7", n, "p", n, "s", n) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """The smallest given documents and the edge cases, as (id, text)."""
    given = []
    if DATA.exists():
        import duckdb

        given = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{DATA}/documents.parquet')").fetchall()
    return [*given, *EDGES]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
